"""Divergence audit, fill-in-the-middle and license scans, against SQL or brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from compare import _sorted_rows, oracle
from conftest import SMALL
from rosterlake.llm import divergence, infill, notices, queries

ODD = [
    None,
    "",
    " \t\n",
    "\n\n",
    "one line without a break",
    "Two\nlines\n",
    "a <P> mark",
    "ends with <\nS>< S>\n<",
    "MIT License, mit  licence; MIT LICENSE",
    "\x00Zoë\x01ÄÖ日本 x\r\ny z\x85",
    "x" * 1_000_000,
    "license " * 20_000,
    "\n" * 200_000,
]
CLASH = "doc_id long, text string, lang string, source string, place int, n string, infill int, notices string, spans int, item string, `row` int, code int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, [None, "en"][i % 2], [None, "s", "t"][i % 3], 1, "n", 2, "x", 3, "i", 4, 5) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "no\nid\n", *rows[0][2:])], CLASH)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.mark.parametrize("name", ["op11_divergence", "op12_infill"])
def test_query_equals_sql(spark, name):
    found = queries.QUERIES[name](spark, SMALL)
    result = oracle(SMALL).execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(names)
    assert _sorted_rows(found.columns, found.collect()) == _sorted_rows(names, result.fetchall())


# Source divergence


def plain_divergence(rows, least, top=10):
    """(lang, source, part, item, value, rank) by the definition, in plain loops."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, d in docs[lang].items() if d >= least)
        whole = Counter()
        for s in sources:
            whole.update(n[lang, s])
        share = lambda count: {t: 1 + 10**9 * (count[t] + 2) // (sum(count[k] for k in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(n[lang, s]) for s in sources}
        q = share(whole)
        f = lambda a, b, t: (a[t] - b[t]) ** 2 // (a[t] + b[t])
        for s in sources:
            parts = {
                "pair": [(sum(f(p[s], p[o], t) for t in kept), o) for o in sources if o != s],
                "term": [(f(p[s], q, t), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]],
            }
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(found, 1) if part == "pair" or r <= top]
    return sorted(out)


def test_divergence_by_brute_force(spark, documents, odd, monkeypatch):
    columns = ("text", "lang", "source")
    for df, least in ((odd, 1), (odd, 10), (documents, 2)):
        expected = plain_divergence(df.select(*columns).collect(), least)
        for shard, block, held in ((1_000, 128, 400_000), (60, 9, 500)):
            for name, value in (("SHARD_TERMS", shard), ("BLOCK", block), ("HELD", held), ("PIECE_BYTES", 100 * shard)):
                monkeypatch.setattr(divergence, name, value)
            assert sorted(tuple(r) for r in divergence.divergence(df, least=least).collect()) == expected


def test_divergence_edge_cases(spark, odd):
    assert divergence.divergence(odd.limit(0)).count() == 0
    # One document a language: nothing is kept, the sources are still compared.
    rows = divergence.divergence(spark.createDataFrame([("a b", "en", "s"), (None, "en", None), ("c", None, None)], "text string, lang string, source string"))
    assert sorted(map(tuple, rows.collect())) == [("en", "", "pair", "s", 0, 1), ("en", "s", "pair", "", 0, 1)]


def test_shares_are_exact_for_large_counts(spark):
    n, total, terms = 9 * 10**17, 9 * 10**18, 10**8
    row = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(terms))).first()
    assert row[0] == 1 + 10**9 * (n + 2) // (total + 2 * terms)


# Fill in the middle


def test_units_and_cuts():
    pattern = regex.compile(f"({infill.LINES})*+")
    generator = random.Random(5)
    for text in [t for t in ODD if t is not None] + ["".join(generator.choices("ab\n<P>", k=generator.randint(0, 30))) for _ in range(2_000)]:
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        ends = infill.unit_ends(pattern, text)
        assert [text[a:b] for a, b in zip([0, *ends], ends)] == lines
        numbers = tuple(generator.randrange(1 << 32) for _ in range(4))
        n, form, prefix, middle, output = infill.reorder(pattern, text, numbers)
        assert n == len(lines)
        if not text or any(m in text for m in infill.MARKS):
            assert (form, prefix, middle, output) == ("plain", None, None, text)
            continue
        i, j = sorted(x % (n + 1) for x in numbers[:2])
        parts = ["".join(lines[:i]), "".join(lines[i:j]), "".join(lines[j:])]
        assert (prefix, middle) == (len(parts[0]), len(parts[1]))
        expected = {"spm": "<S>{2}<P>{0}<M>{1}", "psm": "<P>{0}<S>{2}<M>{1}"}[form].format(*parts)
        assert output == expected and form == ("spm" if numbers[3] % 100 < 50 else "psm")


def test_infill_of_a_table(spark, odd):
    made = infill.fill_in_middle(odd, "doc_id")
    assert [c for c in made.columns if c != "infill"] == [c for c in odd.columns if c != "infill"]
    rows = made.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "infill", infill.restored(F.col("infill.form"), F.col("infill.output")).alias("back")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.back == r.text
        digest = hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        assert infill.draws(7, r.doc_id) == tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    assert infill.fill_in_middle(odd.limit(0), "doc_id").count() == 0
    assert {r.infill.form for r in infill.fill_in_middle(odd, "doc_id", rate=0).collect()} == {"plain"}


# License scans


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_places(text):
    words = words_of(text)
    return sorted(
        (i, label)
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    )


def edited(text, edits, generator):
    for _ in range(edits):
        at = generator.randrange(len(text))
        text = generator.choice([text[:at] + text[at + 1 :], text[:at] + "q" + text[at:], text[:at] + "q" + text[at + 1 :]])
    return text


def test_base_places_by_brute_force():
    finder = notices.Finder(notices.NOTICES)
    generator = random.Random(3)
    parts = ["MIT", "License", "mit license", "general", "public", "licence", "apache license", "the", "limit", "Ä", "-", "gnu", "mitlicense"]
    for text in ODD + [" ".join(generator.choices(parts, k=generator.randint(1, 40))) for _ in range(500)]:
        n, found = notices.places(finder, text)
        assert n == len(words_of(text))
        assert sorted((p["first_word"], p["label"]) for p in found if p["base"]) == base_places(text)
        for p in found:
            inside = words_of(text[p["start"] : p["end"]])
            assert inside == words_of(text)[p["first_word"] : p["last_word"] + 1]


def test_notices_within_the_bound_are_found_and_others_are_not():
    finder = notices.Finder(notices.NOTICES)
    generator = random.Random(4)
    filler = ["the", "house", "software", "license", "public", "under", "terms", "use"]
    for i, notice in enumerate(notices.NOTICES):
        for edits in range(0, notice.edits + 1):
            for _ in range(20):
                inner = edited(notice.text[1:-1], edits, generator)
                kept = [w for w in notice.text.split() if len(w) <= notices.SHORT]
                if notice.phrase and not set(kept) <= set(inner.split()):
                    continue
                around = [" ".join(generator.choices(filler, k=5)) for _ in range(2)]
                words = " ".join(f" {around[0]} {inner} {around[1]} ".split())
                found = [p for p in finder.find(f" {words} ") if p[2] == i]
                every = [m for m in finder.patterns[i].finditer(f" {words} ", overlapped=True) if sum(m.fuzzy_counts) <= notice.edits]
                assert bool(found) == bool(every), (words, notice.text)
                assert all(p[3] <= notice.edits for p in found)
    for text in ("emit license", "limit license", "the public house", "licensed under oath", "x" * 500, ""):
        assert notices.places(finder, text)[1] == []


def test_a_phrase_that_overlaps_itself():
    finder = notices.Finder((notices.Notice("loop", "again and again", phrase=True),))
    assert [p["first_word"] for p in notices.places(finder, "again and again and again")[1]] == [0, 2]


def test_license_scan_of_a_table(spark, odd, documents):
    for df in (odd, documents):
        scanned = notices.scan(df)
        assert [c for c in scanned.columns if c != "notices"] == [c for c in df.columns if c != "notices"]
        rows = notices.summary(scanned, "text").collect()
        assert len(rows) == df.count()
        for r in rows:
            places = base_places(r.text)
            assert (r.n_words, r.n_base) == (len(words_of(r.text)), len(places))
            assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
            assert r.base_labels == ",".join(sorted({label for _, label in places}))
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
            assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    licensed = documents.filter(F.lower("text").rlike(r"licensed? under|licen[cs]e")).count()
    assert notices.summary(notices.scan(documents)).filter("labels <> ''").count() == licensed > 0
    assert notices.scan(odd.limit(0)).count() == 0


def test_stages_leave_columns_with_clashing_names_alone(spark, documents):
    names = ["language", "_language", "row_number", "_row_number", "_row", "kept", "component_id", "n_shingles", "lang_pred", "score", "_pass", "_words", "passes", "pass", "size"]
    docs = documents.withColumns({n: F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")) for n in names})
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_near_duplicates, corpus_pipeline.mix_sources):
        plain, found = stage(spark, documents, SMALL), stage(spark, docs, SMALL)
        assert found.columns == docs.columns
        assert sorted(r.doc_id for r in found.select("doc_id").collect()) == sorted(r.doc_id for r in plain.select("doc_id").collect())
        for n in names:
            assert found.filter(F.col(n) != F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string"))).count() == 0
