"""One query for each operator of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velonet.llm import bm25, bpe, decontam, filteraudit, jaccard, linededup, ranking, runindex, secrets, store, substrings, toxicity, urlfilter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    store.bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written, read back and assembled: one row per page."""
    path = store.new_path(spark, "warc")
    warc.write_captures(table(spark, sf_dir, "pages"), path)
    records = store.materialise(warc.read_records(spark, path, with_payload=False), "warc-records")
    captures = warc.assemble(records)
    own = F.regexp_extract(F.col("metadata")[0]["payload"].cast("string"), r"page-id: (-?\d+)", 1).cast("long")
    # read_records keeps the page's id in each capture's metadata, so references are resolved by record id alone
    captures = captures.withColumn("page_id", own).drop("request", "metadata", "payload")
    full = warc.resolve_revisits(captures, carry=["page_id"])
    kind = F.when(F.col("type") == "revisit", "revisit").otherwise("response")
    return full.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), F.col("refers_page_id").alias("refers_to"))


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as n, sha1(html) as sha from p),
m as (select *, max(page_id) over (partition by n, sha) as last from d)
select page_id, cast(n as bigint) as payload_bytes, sha as payload_digest,
       case when n >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id <> last then last end as refers_to
from m
"""


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), digest=True).drop("ids")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def blocklist(pages: DataFrame) -> DataFrame:
    """(key) The tables bring no list of hosts; those of a quarter of all hosts, by their md5, and of advertisers and trackers, by a label, stand for one."""
    hosts = pages.select(urlfilter.host_and_path(F.col("url"))[0].alias("key")).distinct()
    return hosts.filter((F.md5(F.col("key").cast("binary")) < "4") | F.col("key").rlike(r"(^|\.)(ads|track)"))


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, RULES, blocklist(pages)).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
with p as (
  select page_id, case when url like '%://%' then regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's') else '' end as raw,
         case when url like '%://%' then regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's') else '' end as path
  from pages),
h as (select page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from p),
r as (select page_id, host, path, case
    when ('.' || host) like '%.www.example.com' and starts_with(path, '/en/') then 'www.example.com/en/'
    when ('.' || host) like '%.example.com' and starts_with(path, '/en/') then 'example.com/en/'
    when ('.' || host) like '%.net' and starts_with(path, '/es/') then 'net/es/'
    when ('.' || host) like '%.net' and starts_with(path, '/fr/') then 'net/fr/'
    when ('.' || host) like '%.com' and starts_with(path, '/') then 'com/' end as rule from h)
select page_id, host, path, rule, case
    when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
    when md5(host) < '4' or regexp_matches(host, '(^|\.)(ads|track)') then 'block' else 'allow' end as verdict
from r
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned spans of benchmark items in documents."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
with l as (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null),
c as (select doc_id, lines, list_transform(lines, lambda x: len(regexp_extract_all(x, '[^ \t\n\x0B\f\r]+'))) as n from l),
w as (select doc_id, unnest(generate_series(1, len(lines))) as pos, lines, n from c),
m as (select doc_id, pos, lines, case when n[pos] >= 50 then 1 when n[pos] + n[pos + 1] >= 50 then 2 when pos + 2 <= len(lines) then 3 end as many from w),
k as (select doc_id, pos, many, lines[pos : pos + many - 1] as run from m where many is not null),
r as (select doc_id, pos, many, row_number() over (partition by run order by doc_id, pos) as n from k),
g as (select distinct doc_id, pos + o as line from r, (values (0), (1), (2)) as v(o) where n > 1 and o < many),
e as (select doc_id, unnest(lines) as x, unnest(generate_series(1, len(lines))) as line from l),
s as (select e.doc_id, count(*) as n_lines, count(g.line) as n_removed,
             coalesce(string_agg(e.x, chr(10) order by e.line) filter (where g.line is null), '') as kept
      from e left join g on e.doc_id = g.doc_id and e.line = g.line group by e.doc_id)
select d.doc_id, coalesce(s.n_lines, 0) as n_lines, coalesce(s.n_removed, 0) as n_removed, sha256(s.kept) as kept_sha256
from documents d left join s on d.doc_id = s.doc_id
"""


def op7_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best other documents for each document whose doc_id is divisible by 20."""
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.filter("doc_id % 20 = 0"), k=10, own=True)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), k=35, with_text=False).drop("kept")


OP8_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') as w from documents),
p as (select doc_id, unnest(generate_series(1, len(w) - 34)) as pos, w from d where len(w) >= 35),
k as (select doc_id, pos, array_to_string(w[pos : pos + 34], ' ') as run from p),
r as (select doc_id, pos, count(*) over (partition by run) as n from k),
m as (select doc_id, list(pos) as ats from r where n > 1 group by doc_id),
g as (select distinct doc_id, unnest(generate_series(a, a + 34)) as word from (select doc_id, unnest(ats) as a from m)),
e as (select doc_id, unnest(w) as x, unnest(generate_series(1, len(w))) as word from d where len(w) > 0),
s as (select e.doc_id, count(*) as n_words, count(g.word) as n_removed,
             coalesce(string_agg(e.x, ' ' order by e.word) filter (where g.word is null), '') as kept
      from e left join g on e.doc_id = g.doc_id and e.word = g.word group by e.doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join s on d.doc_id = s.doc_id
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (toxicity.fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories are (source, lang), owners are sources; classes, repos and owners list what ``spans`` lists."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang"), F.col("source"))
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    spans = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(n(k).alias(f"n_{k}") for k in secrets.KINDS), "base_sha256", spans.alias("spans"), *(F.array_join(F.col("secrets")[k].cast("array<string>"), ",").alias(v) for k, v in (("class", "classes"), ("repos", "repos"), ("owners", "owners"))))


def op11_runindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.remove_repeats(table(spark, sf_dir, "documents"), k=100, with_text=False).drop("kept")


def op12_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def queries():
    own = (op1_warc, op2_bpe, op3_jaccard, op4_urlfilter, op5_decontamination, op6_linededup, op7_bm25, op8_substrings, op9_toxicity, op10_secrets, op11_runindex, op12_filteraudit, op13_ranking)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op4_urlfilter": OP4_SQL, "op6_linededup": OP6_SQL, "op7_bm25": bm25.SQL, "op8_substrings": OP8_SQL, "op11_runindex": runindex.SQL, "op12_filteraudit": filteraudit.SQL, "op13_ranking": ranking.SQL}
