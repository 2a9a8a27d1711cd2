"""Operators over whole tables, against SQL or brute force, and their edge cases; the pipeline."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import _sorted_rows, oracle
from conftest import SMALL
from rosterlake.llm import common, mixing, neardup, queries, topk, urls, warc
from rosterlake.session import new_path


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_sql(spark, name):
    result = oracle(SMALL).execute(queries.SQL[name])
    columns = [d[0] for d in result.description]
    df = queries.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(columns)
    assert _sorted_rows(df.columns, df.collect()) == _sorted_rows(columns, result.fetchall())


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}


def shingles(text, size):
    words = re.findall(common.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_components(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    having = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in having[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_by_brute_force(spark, size, percent):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    draw = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = draw.choices(words, k=300)
    for i in range(200):  # a group of near copies larger than a small bucket, some of them linked only through others
        own = list(base)
        for _ in range(draw.randint(0, 9)):
            own[draw.randrange(300)] = f"x{draw.randrange(10**6)}"
        rows.append((10_000 + i, " ".join(own)))
    rows += [(20_000 + i, " ".join(base)) for i in range(40)] + [(30_000, None), (30_001, ""), (30_002, " \t"), (30_003, "One"), (30_004, "one"), (30_005, "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bands", F.lit("clash"))
    expected = brute_components(rows, size, percent)
    found = neardup.near_duplicates(df, size=size, percent=percent).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_shingles, r.component_id) == expected[r.doc_id], r
        assert r.kept == (r.component_id == r.doc_id)
    assert len({r.component_id for r in found if 10_000 <= r.doc_id < 30_000}) < 150  # some linked, some not


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (None, "q r s t"), (3, "a b c d"), (3, "a b c d"), (3, "other words here now"), (1, "a b c d")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85)
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in found.collect()) == [
        ("1", "1", True), ("3", "1", False), ("3", "1", False), ("3", "3", True), ("None", "1", False), ("None", "None", True),
    ]
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_is_circulant():
    own = neardup.shingles("a b c d e f g h", 3)
    scatter, slices = neardup.permutations()
    places = scatter[own & np.uint64(neardup.PLACES - 1)].astype(np.int64)
    assert neardup.signature(own).tolist() == [min(int(slices[(p + k) % neardup.PLACES][0]) for p in places) for k in range(neardup.BANDS * neardup.ROWS)]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101)]
    found = neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_top_k_by_brute_force(spark):
    draw = np.random.default_rng(2)
    vectors = draw.normal(0, 0.4, (300, 7)).astype(np.float32)
    vectors[50:90] = vectors[3]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(1000, None), (1020, [None] * 7), (1040, [float("nan")] * 7), (1060, [float("inf")] * 7), (None, [0.5] * 7)]
    df = spark.createDataFrame(rows + bad + [(40, rows[40][1])], "vec_id long, embedding array<float>").withColumn("values", F.lit(1))
    found = topk.top_k(df, F.pmod("vec_id", F.lit(20)) == 0, 9, block_rows=64).collect()
    whole = np.floor(64 * vectors.astype(float)).astype(np.int64)
    ids = np.array([*range(300), 40])
    whole = np.vstack((whole, whole[40]))
    for q in range(0, 300, 20):
        scores = whole @ whole[q]
        best = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:9]
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert own == [(n + 1, ids[i], scores[i]) for n, i in enumerate(best)]
    assert {r.query_id for r in found} == set(range(0, 300, 20))


def test_top_k_of_several_query_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    vectors = np.random.default_rng(5).normal(0, 0.4, (200, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = topk.top_k(df, F.pmod("vec_id", F.lit(10)) == 0, 5, block_rows=64).collect()
    whole = np.floor(64 * vectors).astype(np.int64)
    expected = []
    for q in range(0, 200, 10):
        scores = whole @ whole[q]
        best = [i for i in np.lexsort((np.arange(200), -scores)) if i != q][:5]
        expected += [(q, n, i, scores[i]) for n, i in enumerate(best, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == expected


def test_top_k_of_few_ragged_and_no_vectors(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0]), (1, [1.0]), (2, []), (3, [-1.0, 0.5])], "vec_id long, embedding array<float>")
    found = topk.top_k(df, F.col("vec_id") == 20, 20).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank)] == [(1, 64 * 64), (2, 0), (3, 0)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 20, 20).count() == 0


def test_top_k_keeps_large_vectors_and_refuses_what_no_score_can_hold(spark):
    vectors = {20: [1.0, -2.0, 0.5], 1: [2.0**30, 0.25, 0.0], 2: [-(2.0**49), 1.0, 3.0], 3: [5.0, -(2.0**49), -1.0], 4: [1.0, 1.0, 1.0]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * x) for x in v] for i, v in vectors.items()}
    scores = {i: sum(a * b for a, b in zip(v, whole[20])) for i, v in whole.items() if i != 20}
    found = sorted(topk.top_k(df, F.col("vec_id") == 20, 20).collect(), key=lambda r: r.rank)
    assert [(r.vec_id, r.score) for r in found] == sorted(scores.items(), key=lambda x: -x[1])
    with pytest.raises(OverflowError):
        topk.top_k(df, F.col("vec_id") == 2, 20)
    # A finite component that is no long itself takes part: it raises, and if all queries are zeros it scores 0.
    huge = spark.createDataFrame([(5, [1e30, 3.0, 0.0]), (6, [-1e308, 0.0, 0.0]), (40, [0.0, 0.0, 0.0])], df.schema)
    for rows in (df.unionByName(huge.filter("vec_id = 5")), df.unionByName(huge.filter("vec_id = 6"))):
        with pytest.raises(OverflowError):
            topk.top_k(rows, F.col("vec_id") == 20, 20)
    found = topk.top_k(huge, F.col("vec_id") == 40, 20).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in found) == [(1, 5, 0), (2, 6, 0)]


PAGES = "page_id long, url string, html string, payload string"


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [
        (1, "http://a.b/\r\nx", big, "clash"), (2, "http://a.b/2", big, None), (3, None, None, None), (4, "u", "", None),
        (5, "u", "tiny", None), (6, "u", "tiny", None), (7, "v", f"x{warc.END}y", None), (7, "v", f"x{warc.END}y", None),
        (8, "w", f"p{warc.END}{warc.BEGIN}WARC-Type: response\r\nContent-Length: 3{warc.END}abc{warc.END}", None),
        (None, "n", big, None), (9, "z", "ends\r\n\r\n", None), (10, "z", "\r\n" * 5, None),
    ]
    df = spark.createDataFrame(rows, PAGES)
    for compression in ("gzip", "none"):
        path = new_path(spark, "warc-test")
        warc.write_archive(warc.with_revisits(df), path, compression=compression)
        found = warc.assemble(warc.read_records(spark, path)).collect()
        assert len(found) == len(rows)
        got = sorted((str(r.response["page_id"]), r.response["kind"], r.response["bytes"], str(r.response["refers_to"])) for r in found)
        expected = sorted(
            (str(i), "revisit" if h == big and i != 2 else "response", len((h or "").encode()), "2" if h == big and i != 2 else "None")
            for i, _, h, _ in rows
        )
        assert got == expected
        payloads = sorted((str(r.response["page_id"]), r.response["payload"]) for r in found if r.response["kind"] == "response")
        assert payloads == sorted((str(i), h or "") for i, _, h, _ in rows if h != big or i == 2)
        assert all(len(r.requests) == len(r.metadata) == 1 for r in found)


def test_captures_describe_their_requests_and_metadata(spark):
    df = spark.createDataFrame([(1, "http://a/b", "x" * 1200, None), (2, "a\nb", None, None), (3, None, "y", None)], PAGES)
    path = new_path(spark, "warc-test")
    warc.write_archive(warc.with_revisits(df), path)
    records = warc.read_records(spark, path)
    rows = {r.page_id: r for r in warc.described(warc.assemble(records)).collect()}
    assert [(r.target_uri, r.request_line, r.metadata_bytes, r.n_requests, r.n_metadata) for _, r in sorted(rows.items())] == [
        ("http://a/b", "GET http://a/b HTTP/1.1", 1200, 1, 1), ("a%0Ab", "GET a%0Ab HTTP/1.1", 0, 1, 1), (None, "GET / HTTP/1.1", 1, 1, 1),
    ]
    assert all(r.metadata_bytes == r.payload_bytes for r in rows.values())
    alone = warc.described(warc.assemble(records.filter(warc.field("WARC-Type") == "response"))).collect()
    assert {(r.n_requests, r.n_metadata, r.request_line, r.metadata_bytes) for r in alone} == {(0, 0, None, None)}


def test_archives_are_bounded(spark):
    version = f"p{warc.END}{warc.BEGIN}Content-Length: 3{warc.END}abc{warc.END}"
    df = spark.range(2_500).selectExpr("id AS page_id", "'u' AS url", "concat('page ', id) AS html").coalesce(1)
    df = df.withColumn("html", F.when(F.col("page_id") == 7, F.lit(version)).otherwise(F.col("html")))
    path = new_path(spark, "warc")
    warc.write_archive(warc.with_revisits(df).coalesce(1), path)
    records = warc.read_records(spark, path)
    assert spark.read.format("binaryFile").load(path).select("path").count() == 3
    assert records.count() == 7_500
    found = warc.assemble(records).select("response.page_id", "response.payload")
    assert {r.page_id: r.payload for r in found.collect()} == {str(i): version if i == 7 else f"page {i}" for i in range(2_500)}


def test_warc_of_nothing_and_orphans(spark):
    path = new_path(spark, "warc-test")
    warc.write_archive(warc.with_revisits(spark.createDataFrame([], PAGES)), path)
    assert warc.assemble(warc.read_records(spark, path)).count() == 0
    orphan = spark.createDataFrame([("WARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nWARC-Concurrent-To: <b>", "x")], "head string, block string")
    row = warc.assemble(orphan).first()
    assert row.record_id == "<b>" and row.response["kind"] is None and len(row.metadata) == 1


def test_urls(spark):
    given = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"),
        "HTTP://Sub.Example.NET/en/1?x#y": ("sub.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/EN/": ("example.net", "/EN/", "net/", "block"), "http://a.net": ("a.net", "", None, "allow"),
        "http://example.com/de/x": ("example.com", "/de/x", "example.com/de/", "block"), "http://badexample.com/de/x": ("badexample.com", "/de/x", None, "allow"),
        "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"), "http://x.org?q=/fr/": ("x.org", "", None, "allow"),
        "http://www.listed.com/a/index.html#z": ("www.listed.com", "/a/index.html", None, "block"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    df = spark.createDataFrame([(u, "clash") for u in given] * 2, "url string, verdict string")
    listed = spark.createDataFrame([("listed.com/a",), (None,), ("listed.com/a",)], "entry string")
    rows = urls.judge(df, listed).collect()
    assert len(rows) == 2 * len(given)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == given[r.url], r
    assert urls.judge(df, listed.limit(0)).filter("url like '%listed%' and verdict = 'block'").count() == 0
    assert urls.judge(df.limit(0), listed).count() == 0


def test_repeated_urls_are_listed(spark):
    given = ["http://A.com/x/", "https://www.a.com/x?q", "http://a.com/y", "http://b.com", "http://b.com/index.html", None, None, "no", "no"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "page_id long, url string")
    assert {r.entry for r in urls.repeated(df).collect()} == {"a.com/x", "b.com"}
    blocked = {r.page_id for r in urls.judge(df, urls.repeated(df)).filter("verdict = 'block'").collect()}
    assert blocked == {0, 1, 3, 4}
    assert urls.repeated(df.limit(0)).count() == 0


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    entries = spark.range(20_000).select(F.concat(F.lit("h/"), "id").alias("entry"))
    asked = spark.range(40_000).select(F.concat(F.lit("h/"), "id").alias("canonical"))
    assert urls.in_list(asked, entries).filter(F.col("listed") != (F.substring("canonical", 3, 9).cast("int") < 20_000)).count() == 0
    blocks = -(-20_000 * urls.BITS_PER_URL // 512)
    probed = urls._hashed(asked, "canonical", blocks).join(urls.bloom_filter(entries, "entry", blocks), "_block")
    for i, m in enumerate(urls._hashes(F.col("canonical"))):
        probed = probed.filter(F.col(f"w{i}").bitwiseAND(m) == m)
    assert 20_000 <= probed.count() < 21_000


def targets(totals):
    """Water-filling by hand: (source -> words) to (source -> target)."""
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(totals.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * totals[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * totals[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix_reaches_its_targets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source")
    extra = [(None, "a b", None), (1, None, None), (2, "", "src0"), (2, "", "src0"), (3, "w " * 30_000, "big"), (4, "x y z", "tiny")]
    df = docs.union(spark.createDataFrame(extra + [(4, "x y z", "tiny")], docs.schema)).withColumn("size", F.lit("clash"))
    rows = mixing.taken_words(df).collect()
    assert len(rows) == df.count()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.taken_words(df.repartition(7)).collect()))  # reruns agree
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    words = lambda t: len(re.findall(common.WORD, t or ""))
    given = df.collect()
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(r.doc_id), words(r.text)) for r in given)
    totals = collections.Counter()
    for r in given:
        totals[r.source] += words(r.text)
    expected = targets(dict(totals))
    source = {(str(r.doc_id), words(r.text)): r.source for r in given}
    taken = collections.Counter()
    for r in rows:
        s = source[str(r.doc_id), r.size]
        taken[s] += r.taken
        assert r.source_size == totals[s] and math.isclose(r.target, expected[s], rel_tol=1e-9)
    for s, t in expected.items():
        assert abs(taken[s] - t) <= max(2, 0.02 * t), (s, taken[s], t)


def test_permutation_and_draws(spark):
    sources = spark.createDataFrame([("=a", 1000), ("=b", 2_097_143), ("=c", 1)], "key string, blocks long").withColumn("multiplier", F.lit(2_097_133).cast("long"))
    slots = sources.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    for n in ("=a", "=b", "=c"):
        own = slots.filter(F.col("key") == n).select(mixing.block_of(F.col("slot")).alias("b"), "blocks").agg(F.countDistinct("b"), F.max("b"), F.max("blocks")).first()
        assert own[0] == own[2] and own[1] == own[2] - 1
    quotas = spark.createDataFrame([("=a", 30_000), ("=b", 10_000), ("=c", 0), ("=d", 7)], "key string, quota long")
    plan = mixing.shard_plan(quotas)
    assert {r.key: (r.n, r.m) for r in plan.groupBy("key").agg(F.count("*").alias("n"), (F.max("slot") + 1).alias("m")).collect()} == {"=a": (30_000, 30_000), "=b": (10_000, 10_000), "=d": (7, 7)}
    shares = [r.n for r in plan.filter("key = '=a'").groupBy("shard").agg(F.count("*").alias("n")).orderBy("shard").collect()][:-1]
    deviation = np.array(shares) / mixing.SLOTS_PER_SHARD - 0.75
    assert 0 < np.abs(deviation).max() < 0.05


def test_mixed_texts_hold_the_taken_words(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns
    counts = mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    both = mixing.taken_words(docs).filter("taken > 0").join(counts, "doc_id", "full")
    assert both.filter("n is null or taken is null or n <> taken").count() == 0
    assert mixing.mixed_texts(docs.limit(0)).count() == 0
    assert mixing.taken_words(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["identify_language", "drop_near_duplicates", "redact_secrets", "mix_sources", "encode_texts"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = [(-1, None, "en", "src0", None), (-2, "12 34 !!", None, None, 8), (-3, "password = hunter2hunter2 for the house of the man", "en", "src1", 49)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    named = corpus_pipeline.identify_language(spark, docs, SMALL)
    assert {r.doc_id for r in docs.select("doc_id").exceptAll(named.select("doc_id")).collect()} == {-1, -2}
    single = corpus_pipeline.drop_near_duplicates(spark, named, SMALL)
    expected = brute_components([(r.doc_id, r.text) for r in named.collect()], 5, 80)
    kept = [expected[r.doc_id][1] for r in single.collect()]
    assert sorted(kept) == sorted({root for _, root in expected.values()})  # one row of each component
    again = corpus_pipeline.drop_near_duplicates(spark, single.union(single).union(spark.createDataFrame(extra[:1] * 2, docs.schema)), SMALL)
    assert again.count() == single.count() + 2  # equal rows are one document, null texts are not duplicates
    clean = corpus_pipeline.redact_secrets(spark, single, SMALL)
    assert clean.count() == single.count() and clean.filter("doc_id = -3").first().text == "[secret] for the house of the man"
    assert clean.filter("n_chars <> length(text)").count() == 0
    mixed = corpus_pipeline.mix_sources(spark, clean, SMALL)
    for df in (named, single, clean, mixed):
        assert df.columns == docs.columns
    last = corpus_pipeline.encode_texts(spark, mixed, SMALL)
    assert last.count() == mixed.count()


def test_pipeline_on_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0
