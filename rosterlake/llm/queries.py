"""The registered queries of the text operators and of the pipeline, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rosterlake.llm import bpe, divergence, infill, language, mixing, neardup, notices, prefix_tokens, secrets, spotsigs, topk, urls, warc
from rosterlake.llm.common import table
from rosterlake.session import new_path


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = language.collect_model(language.learn(docs.filter(~held_out)))
    found = language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = new_path(spark, "warc")
    warc.write_archive(warc.with_revisits(pages), path)
    return warc.described(warc.assemble(warc.read_records(spark, path)))


OP2_SQL = """
with p as (select page_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') as target, coalesce(html, '') as payload from pages),
m as (select payload, max(page_id) as holder from p where strlen(payload) >= 1000 group by payload)
select p.page_id, cast(strlen(p.payload) as bigint) as payload_bytes, sha1(p.payload) as payload_digest,
 case when m.holder is null or m.holder is not distinct from p.page_id then 'response' else 'revisit' end as record_type,
 case when m.holder is distinct from p.page_id then m.holder end as refers_to,
 nullif(p.target, '') as target_uri, 'GET ' || coalesce(p.target, '/') || ' HTTP/1.1' as request_line,
 cast(strlen(p.payload) as bigint) as metadata_bytes, cast(1 as bigint) as n_requests, cast(1 as bigint) as n_metadata
from p left join m on m.payload = p.payload"""


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, size=3, percent=85)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.pmod("vec_id", F.lit(20)) == 0, 20)


OP4_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as q from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
 from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, bpe.build_lexicon(docs)).select("doc_id", "ids"))
    return bpe.digests(coded, "doc_id")


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs)).select("doc_id", "spans")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(secrets.listed(of(*secrets.KINDS[:3])).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.repeated(pages)).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = f"""
with a as (select page_id, case when strpos(url, '://') > 0 then substring(url, strpos(url, '://') + 3) end as rest from pages),
h as (select page_id,
 coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}'), '') as host,
 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from a),
t as (select *, '.' || host as dotted,
 case when starts_with(host, 'www.') then substring(host, 5) else host end
  || rtrim(case when path like '%/index.html' then left(path, -10) when path like '%/index.htm' then left(path, -9) else path end, '/') as address
 from h),
r as (select page_id, host, path, case when host <> '' then address end as address,
 case when (dotted like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
  when dotted like '%.example.com' and starts_with(path, '/de/') then 'example.com/de/'
  when dotted like '%.org' and starts_with(path, '/fr/') then 'org/fr/'
  when dotted like '%.net' and starts_with(path, '/') then 'net/' end as rule from t)
select page_id, host, path, rule,
 case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when address in (select address from r where address is not null group by address having count(*) > 1) then 'block' else 'allow' end as verdict
from r"""


def op10_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    counted = prefix_tokens.with_token_counts(docs.withColumn("n_bytes", n_bytes))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > prefix_tokens.LIMIT).alias("over_limit"), "fit_chars")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP11_SQL = f"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
  translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}') as text from documents),
g as (select distinct lang, source from d),
t as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
v as (select lang, term, count(*) as n from t group by all having count(distinct id) >= {divergence.LEAST_DOCUMENTS}),
c as (select g.lang, g.source, v.term, v.n as n_lang, coalesce(s.n, 0) as n
  from g join v on v.lang = g.lang
  left join (select lang, source, term, count(*) as n from t group by all) s
    on s.lang = g.lang and s.source = g.source and s.term = v.term),
p as (select lang, source, term, n,
  1 + (1000000000::hugeint * (n + 2)) // (sum(n) over w + 2 * count(*) over w)::hugeint as p,
  1 + (1000000000::hugeint * (n_lang + 2)) // (sum(n_lang) over w + 2 * count(*) over w)::hugeint as q
  from c window w as (partition by lang, source)),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from p a join p b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by all),
ranked as (
 select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pairs.value, 0) as value
  from g a join g b on b.lang = a.lang and b.source <> a.source
  left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
 union all
 select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // (p + q) as value from p where n > 0 and p > q),
numbered as (select lang, source, part, item, cast(value as bigint) as value,
  cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from ranked)
select * from numbered where part = 'pair' or rank <= {divergence.TOP}"""


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    of = lambda c: F.col(f"infill.{c}")
    back = infill.restored(of("form"), of("output"))
    return docs.select(
        "doc_id",
        *[of(c).alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")],
        F.sha2(of("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


OP12_SQL = """
with d as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units from d),
n as (select *, len(units) as n, cast('0x' || h[1:8] as bigint) % (len(units) + 1) as i, cast('0x' || h[9:16] as bigint) % (len(units) + 1) as j,
  cast('0x' || h[17:24] as bigint) % 100 as h3, cast('0x' || h[25:32] as bigint) % 100 as h4 from u),
f as (select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 >= 100 then 'plain'
  when h4 < 50 then 'spm' else 'psm' end as form,
  array_to_string(units[1:least(i, j)], '') as prefix, array_to_string(units[least(i, j) + 1:greatest(i, j)], '') as middle,
  array_to_string(units[greatest(i, j) + 1:], '') as suffix from n)
select doc_id, cast(n as bigint) as n, form,
  case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from f"""


def op13_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return notices.summary(notices.scan(docs), "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_warc, op3_minhash, op4_topk, op5_bpe, op6_spotsigs, op7_secrets, op8_mixing, op9_urls, op10_prefix_tokens,
        op11_divergence, op12_infill, op13_notices,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run

SQL = {"op2_warc": OP2_SQL, "op4_topk": OP4_SQL, "op9_urls": OP9_SQL, "op11_divergence": OP11_SQL, "op12_infill": OP12_SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
