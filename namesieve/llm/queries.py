"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.llm import (
    bpe,
    chat_format,
    exact_dedup,
    filter_audit,
    line_dedup,
    mixing,
    packing,
    quality_mil,
    quality_rules,
    ranked_search,
    simhash,
    toxicity,
    url_filter,
)
from namesieve.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PACKED_VOCABULARY = "word_bpe_49k.json"
HARD_TEXT = "\\### Assistant: </turn> ok"
URL_RULES = [
    url_filter.rule(verdict, text)
    for verdict, text in (
        ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
        ("block", "net/es/"), ("block", "net/fr/"),
    )
]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "verdict.*").drop("anomaly")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.exact_groups(docs, in_files=True).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = [(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)]
    hard = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # turn_template writes each turn by itself, so prefixes may restart in costly conversations.
    spans = chat_format.format_turns(turns.unionByName(hard), window=64)
    return chat_format.read_back(chat_format.require_stable(spans))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), URL_RULES).drop("score")


def tokenizer(spark: SparkSession, ranks_path: str | None = None) -> bpe.Tokenizer:
    path = ranks_path or public_tokenizers.path(VOCABULARY)
    return bpe.Tokenizer(spark, path, public_tokenizers.PATTERN)


def token_digests(encoded: DataFrame, *more: Column) -> DataFrame:
    return encoded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more,
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_digests(bpe.encode_documents(docs, tokenizer(spark)))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.drop("filter")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PACKED_VOCABULARY)
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"), path))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_url_filter": op7_url_filter,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_ranked_search": op12_ranked_search,
    "op13_packing": op13_packing,
}

LINES_SQL = r"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
lines as (
  select doc_id, i, parts[i + 1] as line,
    translate(regexp_replace(parts[i + 1], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from docs, lateral unnest(range(len(parts))) as r(i)),
shared as (
  select key, min(doc_id) as keeper from lines where length(key) >= 10
  group by key having count(distinct doc_id) >= 2),
marked as (
  select l.*, s.keeper is not null and l.doc_id <> s.keeper as dropped
  from lines l left join shared s on l.key = s.key)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
"""

COPIES_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""

CHAT_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shaped as (
  select *, length(text) + length(regexp_replace(text, '[^\\#<:]', '', 'g')) as escaped,
    case when role in ('system', 'user', 'assistant') then length(role)
         else 1 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) end as head
  from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), ''))
    as loss_sha256,
  sum(length('### : </turn>') + 1 + head + escaped)::bigint as formatted_chars
from shaped group by conv_id
"""

AUDIT_SQL = r"""
with docs as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as body,
    min(doc_id) over (partition by coalesce(text, '')) as first_id from documents),
split as (
  select *, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from docs),
flags as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
masked as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (len(words) < 200)::int
      + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
      + 4 * (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body))::int
      + 8 * regexp_matches(body, '[#$%&*|]')::int
      + 16 * (doc_id > first_id)::int as mask
  from split left join flags using (doc_id)),
cells as (
  select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from masked group by all),
letters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as l(letter, bit)),
orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order,
    [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a, letters b, letters c, letters d, letters e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31
    and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps as (
  select filter_order, step::int as step, bits[step] as bit,
    coalesce(list_sum(bits[1:step - 1]), 0)::bigint as state
  from orders, unnest(range(1, 6)) as s(step)),
counted as (
  select part, filter_order, step, bit,
    coalesce(sum(n) filter (where mask & (state | bit) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (where mask & state = 0 and mask & bit <> 0), 0)::bigint as removed,
    coalesce(sum(n) filter (where mask & state <> 0 and mask & bit <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (where mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (where mask & state = 0 and mask & bit <> 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (where mask & state = 0 and mask & bit <> 0), 0)::bigint as toxic_lost
  from cells, steps group by all)
select * exclude (bit), sum(removed) over (partition by part, bit)::bigint as shapley from counted
"""

SEARCH_SQL = r"""
with tokens as (
  select doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
held as (select doc_id, term, count(*) as tf from tokens group by all),
sizes as (select doc_id, sum(tf)::bigint as n from held group by all),
totals as (select count(*) as docs, sum(n)::bigint as terms from sizes),
asked as (
  select item_id, term, count(*) as c from (
    select item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
found as (select * from held where term in (select term from asked)),
weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w
  from (select term, count(*) as df from found group by all), totals),
norms as (select doc_id, 100 - 25 + (25 * n * docs) // terms as m from sizes, totals),
scored as (
  select item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from asked join found using (term) join weights using (term) join norms using (doc_id) group by all),
ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
  from scored where score > 0)
select * from ranked where rank <= 20
"""

ORACLES = {
    "op2_line_dedup": LINES_SQL,
    "op5_exact_dedup": COPIES_SQL,
    "op6_chat_format": CHAT_SQL,
    "op11_filter_audit": AUDIT_SQL,
    "op12_ranked_search": SEARCH_SQL,
}
