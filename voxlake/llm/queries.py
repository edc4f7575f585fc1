"""The corpus operators' registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from voxlake.llm import chat_format, decontamination, exact_dedup, line_dedup, packing, quality, secret_scan, set_join, toxicity, warc
from voxlake.llm._defaults import default_tokenizer, fold
from voxlake.session import read_table

#: The letters that are lower-cased, for SQL.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_recurring(spark, read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op2_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.train(spark, docs, labels.where(fold("doc_id", 3) != 1))
    found = toxicity.score_documents(spark, docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages")


#: Both texts of the extra conversation, which imitate the template's control strings.
IMITATION = "\\### Assistant: </turn> ok"


def op3_fsm_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(IMITATION).alias("text"))
    out = chat_format.format_conversations(rows.unionByName(extra))
    turns = chat_format.parse_formatted(F.col("formatted"))
    masked = F.transform(F.filter("segments", lambda s: s.loss), lambda s: chat_format.unescaped(s.text))
    return out.withColumn("back", turns).withColumn("learned", F.array_join(masked, "")).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda b: F.concat(b.role, F.lit("\n"), b.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP3_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s as (
  select *, length(text) + length(regexp_replace(text, '[^\\#<:]', '', 'g')) + length('### :  </turn>.') + length(role) as formatted,
    lag(role) over (partition by conv_id order by turn) as before, turn = max(turn) over (partition by conv_id) as last from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(formatted)::bigint as formatted_chars,
  bool_and(case when before is null then role in ('system', 'user') when before = 'user' then role = 'assistant' else role = 'user' end and (not last or role = 'assistant')) as valid
from s group by conv_id
"""


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.train(spark, docs, labels.where(fold("doc_id", 4) != 2), labels)
    found = quality.score_documents(spark, docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= quality.GOOD).cast("int").alias("predicted"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.link_components(spark, read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP5_SQL = f"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (
  select distinct doc_id, hash(array_to_string(w[i : i + 4], ' ')) as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b using (g) where a.doc_id <> b.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
reached(id, l) as (select doc_id, doc_id from documents union select b, l from reached join links on a = id where l < b)
select id as doc_id, coalesce(any_value(n), 0) as n_shingles, min(l) as component_id from reached left join sizes on doc_id = id group by id
"""


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, read_table(spark, sf_dir, "documents"), default_tokenizer(), added_tokens=True)


def op7_grace_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.group_exact(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = f"""
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from (select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents)
window w as (partition by t)
"""


def op8_novelty_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind != "novel")
    return found.select("doc_id", *[number(k) for k in secret_scan.KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.convert_archives(spark, warc.pages_to_arc(read_table(spark, sf_dir, "pages")), folder)
    return warc.read_archives(spark, folder).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 of the digest: each five hexadecimal digits are four letters.
OP9_SQL = """
with p as (select page_id, coalesce(html, '') as t from pages),
d as (select page_id, strlen(t) as payload_bytes, sha1(t) as h, max(page_id) over (partition by t) as top from p)
select page_id, payload_bytes::bigint as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(h, i // 4 * 5 + 1, 5) as integer) >> (15 - i % 4 * 5)::integer) & 31), 1) for i in range(32)], '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to
from d
"""


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


OP10_SQL = f"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
items as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where item_id is not null),
spans as (
  select item, w, len(w) as n, unnest(range(1, greatest(len(w) - 8, 0) + 2)) as i from items where len(w) > 0),
windows as (
  select distinct item, least(n, 8) as n, array_to_string(w[i : i + least(n, 8) - 1], ' ') as s from spans),
lengths as (select distinct n from windows),
grams as (
  select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, lengths where len(w) >= n)),
hits as (select doc_id, i, n, item from grams join windows using (n, s)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
found as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as s from hits group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from words left join hit using (doc_id) left join found using (doc_id)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_template_line_dedup": op1_template_line_dedup,
    "op2_segment_toxicity": op2_segment_toxicity,
    "op3_fsm_chat_format": op3_fsm_chat_format,
    "op4_pu_quality": op4_pu_quality,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_harmonic_packing": op6_harmonic_packing,
    "op7_grace_exact_dedup": op7_grace_exact_dedup,
    "op8_novelty_secret_scan": op8_novelty_secret_scan,
    "op9_arc_to_warc": op9_arc_to_warc,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op3_fsm_chat_format": OP3_SQL,
    "op5_ngram_jaccard_join": OP5_SQL,
    "op7_grace_exact_dedup": OP7_SQL,
    "op9_arc_to_warc": OP9_SQL,
    "op10_benchmark_decontamination": OP10_SQL,
}
