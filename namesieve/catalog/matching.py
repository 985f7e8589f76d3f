"""Registered queries: normalisation, candidates, scores, screening."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.catalog.tables import (
    PART_CODES_SQL,
    PART_TYPE_SQL,
    benchmark_requests,
    clauses,
    clauses_sql,
    document_entities,
    document_names,
    lcs_sql,
    norm_sql,
    part_entities,
    part_names,
    read,
    strip_sql,
)
from namesieve.functions.phonetics import phonetic_codes
from namesieve.functions.scoring import combined_score, layers_fired, phonetic_score, rounded
from namesieve.functions.similarity import fuzzy_udf
from namesieve.functions.text import name_variants, normalise_name
from namesieve.operators.candidates import (
    candidate_union,
    distinct_forms,
    fuzzy_rows,
    normalised_rows,
    phonetic_pairs,
    spread_scan,
    token_keys,
    vector_keys,
    vector_rows,
)
from namesieve.operators.index import build_index
from namesieve.operators.normalising import phonetic_keys as keys_of_forms
from namesieve.operators.normalising import unique_normalised
from namesieve.operators.screening import (
    match_payload,
    screen,
    screening_audit,
    validate_requests,
)
from namesieve.operators.vectors import encode_forms, lookup_scores, sync_plan, vector_key
from namesieve.params import HONORIFICS, LAYERS, ScreeningParams
from namesieve.workspace import work_folder, written

P = ScreeningParams()


def rounded_sql(value: str) -> str:
    """Two decimals, correctly rounded from the binary value."""
    doubled, shifted = "(v * 200.0::double)", "(v * 134217729.0::double)"
    high = f"({shifted} - ({shifted} - v))"
    error = f"(({high} * 200.0::double - {doubled}) + (v - {high}) * 200.0::double)"
    tie = f"({doubled} = round({doubled}) and abs({doubled}) % 2 = 1)"
    return (
        f"list_transform([{value}], lambda v: case"
        f" when {tie} and {error} > 0 then ({doubled} + 1) / 200.0::double"
        f" when {tie} and {error} < 0 then ({doubled} - 1) / 200.0::double"
        f" else round_even(v * 100.0::double, 0) / 100.0::double end)[1]"
    )


# ---------------------------------------------------------------- text


def normalise_names(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_scan(read(spark, sf, "documents"))
    return docs.select("doc_id", normalise_name(F.col("text")).alias("name_normalised"))


NORMALISE_SQL = f"select doc_id, {norm_sql('text')} as name_normalised from documents"

_TITLES_SQL = "[" + ", ".join(f"'{h}'" for h in HONORIFICS) + "]"


def honorific_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Product names behind one or two titles chosen by the key."""
    titles = F.array(*(F.lit(h) for h in HONORIFICS))
    n = len(HONORIFICS)

    def title(salt: int):
        return F.element_at(titles, F.pmod(F.col("p_partkey") + salt, F.lit(n)).cast("int") + 1)

    named = read(spark, sf, "part").select(
        "p_partkey", normalise_name(F.concat_ws(" ", title(0), title(7), "p_name")).alias("form")
    )
    variants = named.select("p_partkey", F.explode(name_variants(F.col("form"))).alias("variant"))
    return variants.groupBy("p_partkey", "variant").agg(F.count("*").alias("n"))


HONORIFIC_SQL = f"""
with named as (select p_partkey, {_TITLES_SQL}[p_partkey % {len(HONORIFICS)} + 1] || ' ' ||
                      {_TITLES_SQL}[(p_partkey + 7) % {len(HONORIFICS)} + 1] || ' ' || p_name as form
               from part),
     v as (select p_partkey, form as variant from named
           union select p_partkey, {strip_sql('form')} from named)
select p_partkey, variant, count(*) as n from v group by all"""


def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = clauses(read(spark, sf, "documents"), "doc_id")
    return unique_normalised(rows, "name", "name_id").select("name_normalised", "first_position")


UNIQUE_SQL = f"""
select name_normalised, min(name_id) as first_position
from (select name_id, {norm_sql('name')} as name_normalised
      from ({clauses_sql('documents', 'doc_id')}))
where name_normalised <> '' group by 1"""


def _conversation_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Whole turns as requests, with parameters derived from the row."""
    turns = read(spark, sf, "conversations")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.when(F.length("text") % 11 == 0, F.lit(" --- ")).otherwise(F.col("text")).alias("name"),
        F.when(F.col("turn") > 0, F.col("turn") * 30.0).alias("threshold"),
        F.when(F.col("conv_id") > 0, F.length("text") - 100).cast("int").alias("max_results"),
        F.when(F.col("role") == "user", "individual")
        .when(F.col("role") == "assistant", F.lit(None))
        .otherwise(F.col("role"))
        .alias("entity_type"),
    )


def validated_requests(spark: SparkSession, sf: str) -> DataFrame:
    valid, rejected = validate_requests(_conversation_requests(spark, sf))
    columns = ["query_id", "threshold", "max_results", "entity_type"]
    return valid.select(*columns, F.lit("ok").alias("reason")).unionByName(
        rejected.select(*columns, "reason")
    )


VALIDATE_SQL = f"""
with r as (
  select conv_id * 1000 + turn as query_id,
         case when length(text) % 11 = 0 then ' --- ' else text end as name,
         case when turn > 0 then turn * 30.0::double end as threshold,
         case when conv_id > 0 then (length(text) - 100)::int end as max_results,
         case role when 'user' then 'individual' when 'assistant' then null else role end
           as entity_type
  from conversations),
 c as (
  select *, case
    when name is null or length(name) < 1 then 'name_missing'
    when length(name) > 500 then 'name_too_long'
    when threshold is not null and threshold not between 0 and 100 then 'threshold_out_of_range'
    when max_results is not null and max_results not between 1 and 100
      then 'max_results_out_of_range'
    when entity_type is not null
      and entity_type not in ('individual', 'entity', 'vessel', 'aircraft')
      then 'unknown_entity_type'
    when {norm_sql('name')} = '' then 'name_unmatchable' else 'ok' end as reason
  from r)
select query_id, reason, entity_type,
       case when reason = 'ok' then coalesce(threshold, 75.0) else threshold end as threshold,
       case when reason = 'ok' then coalesce(max_results, 10) else max_results end as max_results
from c"""


# ---------------------------------------------------------------- phonetic


def phonetic_keys(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part")
    forms = part.select("p_partkey", normalise_name(F.col("p_name")).alias("form"))
    return keys_of_forms(forms, "form").drop("form")


_KEY_CTE = f"""
codes(token, code) as {PART_CODES_SQL},
forms as (select p_name as form, count(*) as n from part group by 1),
tokens as (select form, unnest(string_split(form, ' ')) as token from forms),
keys as (select form, string_agg(code, ' ' order by code) as key, list(code) as codes
         from tokens join codes using (token) group by form)"""

PHONETIC_KEY_SQL = f"""
with {_KEY_CTE}
select p_partkey, key as metaphone_key from part join keys on form = p_name"""


def _reversed(name: str = "p_name"):
    return F.array_join(F.reverse(F.split(F.col(name), " ")), " ")


def phonetic_join(spark: SparkSession, sf: str) -> DataFrame:
    """Reordered product names against all product names, with row counts."""
    part = read(spark, sf, "part")
    queries = part.select(_reversed().alias("form"))
    names = part.select(F.col("p_name").alias("form"))
    pairs = phonetic_pairs(distinct_forms(queries, P), distinct_forms(names, P))
    n_queries = queries.groupBy(F.col("form").alias("query_form")).agg(
        F.count("*").alias("n_queries")
    )
    n_names = names.groupBy(F.col("form").alias("name_form")).agg(F.count("*").alias("n_names"))
    return pairs.join(n_queries, "query_form").join(n_names, "name_form")


PHONETIC_JOIN_SQL = f"""
with {_KEY_CTE}
select array_to_string(list_reverse(string_split(q.form, ' ')), ' ') as query_form,
       n.form as name_form, qf.n as n_queries, nf.n as n_names
from keys q join keys n on q.key = n.key
join forms qf on qf.form = q.form join forms nf on nf.form = n.form"""


def phonetic_dice(spark: SparkSession, sf: str) -> DataFrame:
    """Each product name against its brand's first product name and a longer form."""
    part = read(spark, sf, "part")
    first = part.groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("other"))
    pairs = part.join(first, "p_brand").select(
        "p_partkey",
        F.array("p_name").alias("query"),
        F.array("other", F.concat_ws(" ", "other", "p_name")).alias("name"),
    )
    coded = pairs.select(
        "p_partkey", phonetic_codes("query").alias("q"), phonetic_codes("name").alias("n")
    )
    return coded.select("p_partkey", phonetic_score(F.col("q"), F.col("n")).alias("phonetic"))


def _dice_sql(a: str, b: str) -> str:
    return (
        f"200.0::double * list_sum(list_transform(list_distinct({a}), lambda c: least("
        f"len(list_filter({a}, lambda x: x = c)), len(list_filter({b}, lambda x: x = c)))))"
        f" / (len({a}) + len({b}))"
    )


PHONETIC_DICE_SQL = f"""
with {_KEY_CTE},
first as (select p_brand, arg_min(p_name, p_partkey) as other from part group by 1)
select p_partkey, {rounded_sql(f"greatest({_dice_sql('q.codes', 'n.codes')}, {_dice_sql('q.codes', 'list_concat(n.codes, q.codes)')})")} as phonetic
from part join first using (p_brand)
join keys q on q.form = p_name join keys n on n.form = other"""


# ---------------------------------------------------------------- fuzzy


def _misspelt(spark: SparkSession, sf: str) -> DataFrame:
    """Reordered product names with one character dropped, by key."""
    part = read(spark, sf, "part").withColumn("swapped", _reversed())
    at = F.pmod(F.col("p_partkey"), F.length("swapped")).cast("int")
    query = F.concat(
        F.substring(F.col("swapped"), F.lit(1), at),
        F.substring(F.col("swapped"), at + 2, F.length("swapped")),
    )
    return part.select("p_partkey", "p_name", normalise_name(query).alias("form"))


_MISSPELT_SQL = f"""
misspelt as (
  select p_partkey, p_name, {norm_sql("substr(s, 1, cut) || substr(s, cut + 2)")} as form
  from (select *, p_partkey % length(s) as cut
        from (select *, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') as s
              from part)))"""


def _sorted_sql(name: str) -> str:
    return f"array_to_string(list_sort(string_split({name}, ' ')), ' ')"


def fuzzy_topk(spark: SparkSession, sf: str) -> DataFrame:
    queries = _misspelt(spark, sf).select("form").distinct()
    names = normalised_rows(part_names(spark, sf), "name_original")
    typed = names.join(part_entities(spark, sf).select("entity_id", "entity_type"), "entity_id")
    rows = fuzzy_rows(queries, token_keys(typed, P), P)
    return rows.select("query_form", "name_id", "token_sort_ratio")


FUZZY_TOPK_SQL = f"""
with {_MISSPELT_SQL},
q as (select distinct form, {_sorted_sql('form')} as s from misspelt),
n as (select distinct p_name as form, {_sorted_sql('p_name')} as s from part),
pairs as (select q.form as query_form, n.form as name_form,
                 200.0::double * {lcs_sql('q.s', 'n.s')} / (length(q.s) + length(n.s)) as r
          from q, n),
rows as (select query_form, p_partkey as name_id, r,
                row_number() over (partition by query_form order by r desc, p_partkey) as k
         from pairs join part on p_name = name_form where r >= 60)
select query_form, name_id, r as token_sort_ratio from rows where k <= 64"""


def fuzzy_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Every product name against its misspelt form."""
    pairs = _misspelt(spark, sf).groupBy("form", "p_name").agg(F.count("*").alias("n_rows"))
    blend = fuzzy_udf(P.token_sort_weight, P.partial_weight)
    return pairs.select(
        "form", "p_name", "n_rows", rounded(blend("form", "p_name")).alias("fuzzy")
    )


def _partial_sql(short: str, long: str) -> str:
    """Best ratio of short against all windows of long, for length(short) <= length(long)."""
    window = f"substr({long}, greatest(st, 0) + 1, least(st + length({short}), length({long})) - greatest(st, 0))"
    return (
        f"list_max(list_transform(range(1 - length({short}), length({long})), lambda st:"
        f" 200.0::double * {lcs_sql(short, window)} / (length({short}) + length({window}))))"
    )


def _blend_sql(q: str, n: str) -> str:
    tsr = (
        f"200.0::double * {lcs_sql(_sorted_sql(q), _sorted_sql(n))}"
        f" / (length({q}) + length({n}))"
    )
    partial = (
        f"case when length({q}) < length({n}) then {_partial_sql(q, n)}"
        f" when length({q}) > length({n}) then {_partial_sql(n, q)}"
        f" else greatest({_partial_sql(q, n)}, {_partial_sql(n, q)}) end"
    )
    return rounded_sql(f"0.7::double * ({tsr}) + 0.3::double * ({partial})")


FUZZY_BLEND_SQL = f"""
with {_MISSPELT_SQL},
pairs as (select form, p_name, count(*) as n_rows from misspelt group by all)
select form, p_name, n_rows, {_blend_sql('form', 'p_name')} as fuzzy from pairs"""


# ---------------------------------------------------------------- vectors


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("name_id"),
        F.col("vec_id").cast("string").alias("form"),
        F.col("embedding").alias("vector"),
        "label",
    )


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    listed = vectors.select(
        "name_id", "form", F.col("name_id").alias("entity_id"), F.lit("entity").alias("entity_type")
    )
    rows = vector_rows(vectors, vector_keys(listed, vectors.select("form", "vector"), P), P)
    return rows.select("query_form", "name_id", F.round("cosine", 6).alias("cosine"))


VECTOR_TOPK_SQL = """
with v as (select vec_id, embedding::double[] as e from embeddings),
s as (select q.vec_id as q, n.vec_id as n, round(list_inner_product(q.e, n.e), 9) as c from v q, v n),
k as (select *, row_number() over (partition by q order by c desc, n) as r from s where c >= 0.45)
select q::varchar as query_form, n as name_id, round(c, 6) as cosine from k where r <= 64"""


def vector_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all (supplier, part) pairs; ids without a vector get none."""
    pairs = read(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    keyed = pairs.select(
        F.col("l_suppkey").cast("string").alias("query_form"),
        F.col("l_partkey").cast("string").alias("name_form"),
    )
    vectors = _vectors(spark, sf).select("form", "vector")
    scored = lookup_scores(keyed, vectors, vectors)
    return scored.select(
        "query_form", "name_form", F.round("cosine", 6).alias("cosine"), "embedding"
    )


VECTOR_LOOKUP_SQL = f"""
with v as (select vec_id, embedding::double[] as e from embeddings),
p as (select distinct l_suppkey, l_partkey from lineitem),
s as (select l_suppkey::varchar as query_form, l_partkey::varchar as name_form,
             list_inner_product(q.e, n.e) as c
      from p left join v q on q.vec_id = l_suppkey left join v n on n.vec_id = l_partkey)
select query_form, name_form, round(c, 6) as cosine,
       coalesce({rounded_sql("100.0::double * greatest(0.0::double, c)")}, 0.0) as embedding
from s"""


def vector_sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    stored = _vectors(spark, sf).select(
        vector_key("form").alias("vector_key"),
        F.when(F.col("label") < 5, "current").otherwise("previous").alias("model"),
    )
    names = read(spark, sf, "labels").select(
        F.sha2(F.col("doc_id").cast("string"), 256).alias("vector_key")
    )
    keep, drop, encode = sync_plan(stored, names, "current")
    return (
        keep.select("vector_key", F.lit("keep").alias("action"))
        .unionByName(drop.select("vector_key", F.lit("drop").alias("action")))
        .unionByName(encode.select("vector_key", F.lit("encode").alias("action")))
    )


VECTOR_SYNC_SQL = """
with s as (select sha256(vec_id::varchar) as vector_key, label < 5 as current from embeddings),
n as (select sha256(doc_id::varchar) as vector_key from labels)
select vector_key, case when current and vector_key in (select vector_key from n)
                        then 'keep' else 'drop' end as action from s
union all
select vector_key, 'encode' from n
where vector_key not in (select vector_key from s where current)"""


def letter_frequencies():
    """A small encoder with a closed form: how often each letter a-z occurs."""

    def encode(texts: np.ndarray) -> np.ndarray:
        letters = "abcdefghijklmnopqrstuvwxyz"
        return np.array([[text.count(c) for c in letters] for text in texts], dtype=np.float64)

    return encode


def vector_encode(spark: SparkSession, sf: str) -> DataFrame:
    forms = read(spark, sf, "part").select(F.col("p_name").alias("form")).distinct()
    encoded = encode_forms(forms, letter_frequencies)
    return encoded.select("form", F.posexplode("vector").alias("dimension", "value")).select(
        "form", "dimension", F.round(F.col("value").cast("double"), 5).alias("value")
    )


_LETTERS_SQL = "string_split('abcdefghijklmnopqrstuvwxyz', '')"


def _letter_vector_sql(form: str) -> str:
    counts = (
        f"list_transform({_LETTERS_SQL}, lambda c: (length({form}) -"
        f" length(replace({form}, c, '')))::double)"
    )
    norm = f"sqrt(list_inner_product({counts}, {counts}))"
    return f"list_transform({counts}, lambda v: (v / {norm})::float)"


VECTOR_ENCODE_SQL = f"""
with v as (select form, {_letter_vector_sql('form')} as e
           from (select distinct p_name as form from part))
select form, i::int as dimension, round(e[i + 1]::double, 5) as value
from v, lateral unnest(range(26)) as r(i)"""


# ---------------------------------------------------------------- scores


def _layer_rows(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "R", 100.0).otherwise(0.0).alias("exact"),
        rounded(F.col("l_quantity") * 2).alias("phonetic"),
        rounded(F.col("l_discount") * 1000).alias("fuzzy"),
        rounded(F.col("l_tax") * 1250).alias("embedding"),
    )


_LAYERS_SQL = f"""
l as (select l_orderkey, l_linenumber,
             case when l_returnflag = 'R' then 100.0::double else 0.0::double end as exact,
             {rounded_sql('l_quantity * 2')} as phonetic,
             {rounded_sql('l_discount * 1000')} as fuzzy,
             {rounded_sql('l_tax * 1250')} as embedding
      from lineitem)"""
_AGREE_SQL = "(phonetic >= 80)::int + (fuzzy >= 80)::int + (embedding >= 80)::int >= 2"
_MAX_SQL = (
    "greatest(1.0::double * exact, 0.9::double * phonetic, 0.97::double * fuzzy,"
    " 0.85::double * embedding)"
)


def _combine_sql(base: str) -> str:
    return rounded_sql(
        f"case when exact = 0 and {_AGREE_SQL} then least({base} + 3.0::double,"
        f" 99.0::double) else {base} end"
    )


def _combined(spark: SparkSession, sf: str, params: ScreeningParams) -> DataFrame:
    layers = {k: F.col(k) for k in LAYERS}
    return _layer_rows(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        combined_score(layers, params).alias("score"),
        F.array_join(layers_fired(layers), ",").alias("layers_fired"),
    )


def combine_max(spark: SparkSession, sf: str) -> DataFrame:
    return _combined(spark, sf, P)


def combine_weighted_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _combined(spark, sf, ScreeningParams(strategy="weighted_sum"))


_FIRED_SQL = (
    "concat_ws(',', " + ", ".join(f"case when {k} > 0 then '{k}' end" for k in LAYERS) + ")"
)
COMBINE_MAX_SQL = f"""
with {_LAYERS_SQL}
select l_orderkey, l_linenumber, {_combine_sql(_MAX_SQL)} as score, {_FIRED_SQL} as layers_fired
from l"""


def _weighted_sql() -> str:
    weights = {"exact": 1.0, "phonetic": 0.9, "fuzzy": 0.97, "embedding": 0.85}
    total = " + ".join(
        f"case when {k} > 0 then {w}::double * {k} else 0 end" for k, w in weights.items()
    )
    weight = " + ".join(
        f"case when {k} > 0 then {w}::double else 0 end" for k, w in weights.items()
    )
    return f"(0.0::double + {total}) / coalesce(nullif(0.0::double + {weight}, 0), 1.0::double)"


COMBINE_WEIGHTED_SQL = f"""
with {_LAYERS_SQL}
select l_orderkey, l_linenumber, {_combine_sql(_weighted_sql())} as score,
       {_FIRED_SQL} as layers_fired from l"""


def united_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Four overlapping candidate sets taken from the line items."""
    rows = read(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("query_id"),
        F.col("l_partkey").alias("name_id"),
        "l_returnflag",
        "l_linestatus",
        "l_discount",
    )
    return candidate_union(
        rows.filter("l_returnflag = 'R'"),
        rows.filter("l_returnflag = 'A'"),
        rows.filter("l_linestatus = 'O'"),
        rows.filter("l_discount >= 0.05"),
    )


CANDIDATE_UNION_SQL = """
select l_suppkey as query_id, l_partkey as name_id from lineitem
where l_returnflag in ('R', 'A') or l_linestatus = 'O' or l_discount >= 0.05 group by all"""


# ---------------------------------------------------------------- screening


def screen_exact(spark: SparkSession, sf: str) -> DataFrame:
    valid, _ = validate_requests(benchmark_requests(spark, sf))
    folder = work_folder(spark)
    names, entities = document_names(spark, sf), document_entities(spark, sf)
    index = build_index(names, entities, folder, P, fuzzy=False)
    matches = screen(valid, index, P, fuzzy=False, phonetic=False)
    return matches.select("query_id", "rank", "entity_id", "name_id", "exact")


SCREEN_EXACT_SQL = f"""
with q as (select name_id as query_id, {norm_sql('name')} as form
           from ({clauses_sql('benchmark', 'item_id')})),
n as (select doc_id as entity_id, name_id, {norm_sql('name')} as form
      from ({clauses_sql('documents', 'doc_id')})),
qv as (select query_id, form as v from q where form <> ''
       union select query_id, {strip_sql('form')} from q where form <> ''),
nv as (select entity_id, name_id, form as v from n where form <> ''
       union select entity_id, name_id, {strip_sql('form')} from n where form <> ''),
best as (select query_id, entity_id, min(name_id) as name_id
         from qv join nv using (v) group by 1, 2),
ranked as (select *, row_number() over (partition by query_id order by entity_id) as rank from best)
select query_id, rank::int as rank, entity_id, name_id, 100.0::double as exact
from ranked where rank <= 10"""


def part_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every product name reordered and in capitals, with its own parameters."""
    tokens = F.split("p_name", " ")
    return read(spark, sf, "part").select(
        F.col("p_partkey").alias("query_id"),
        F.concat(F.upper(F.element_at(tokens, 2)), F.lit(", "), F.element_at(tokens, 1)).alias(
            "name"
        ),
        (F.col("p_size") + 50.0).alias("threshold"),
        F.col("p_size").alias("max_results"),
        F.when(F.col("p_type") == "PROMO", "vessel").alias("entity_type"),
    )


def _screen_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    names, entities = part_names(spark, sf), part_entities(spark, sf)
    valid, _ = validate_requests(part_requests(spark, sf))
    folder = work_folder(spark)
    n = normalised_rows(names, "name_original").select("form").distinct()
    index = build_index(names, entities, folder, P, encode_forms(n, letter_frequencies))
    q = encode_forms(valid.select(F.col("query_form").alias("form")).distinct(), letter_frequencies)
    q = written(q, f"{folder}/query_vectors")
    matches = screen(valid, index, P, q, path=folder)
    return valid, names, entities, matches


def screen_full(spark: SparkSession, sf: str) -> DataFrame:
    _, _, _, matches = _screen_parts(spark, sf)
    return matches.select(
        "query_id", "rank", "entity_id", "name_id", "score", *LAYERS,
        F.array_join("layers_fired", ",").alias("layers_fired"),
    )


# The whole screening job over the distinct product names, then over the rows.
SCREEN_PARTS_CTE = f"""
{_KEY_CTE},
requests as (
  select p_partkey as query_id,
         upper(split_part(p_name, ' ', 2)) || ', ' || split_part(p_name, ' ', 1) as name,
         p_name as base, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) as qf,
         p_size + 50.0::double as threshold, p_size as max_results,
         case when p_type = 'PROMO' then 'vessel' end as entity_type
  from part where p_size between 1 and 50),
q as (select distinct base, qf from requests),
vectors as (select form, {_letter_vector_sql('form')}::double[] as e from forms),
pairs as (
  select q.qf, n.form as nf, kq.key = kn.key as same_key,
         case when q.qf = n.form then 100.0::double else 0.0::double end as exact,
         {rounded_sql(_dice_sql('kq.codes', 'kn.codes'))} as phonetic,
         200.0::double * {lcs_sql(_sorted_sql('q.qf'), _sorted_sql('n.form'))}
           / (length(q.qf) + length(n.form)) as tsr,
         list_inner_product(vq.e, vn.e) as cosine
  from q, forms n join keys kn on kn.form = n.form join vectors vn on vn.form = n.form
  join keys kq on kq.form = q.base join vectors vq on vq.form = q.base),
fuzzy_top as (
  select qf, nf, name_id from (
    select qf, nf, p_partkey as name_id,
           row_number() over (partition by qf order by tsr desc, p_partkey) as k
    from pairs join part on p_name = nf where tsr >= 60) where k <= 64),
vector_top as (
  select qf, nf, name_id from (
    select qf, nf, p_partkey as name_id,
           row_number() over (partition by qf order by round(cosine, 9) desc, p_partkey) as k
    from pairs join part on p_name = nf where round(cosine, 9) >= 0.45) where k <= 64),
candidates as (
  select qf, nf, p_partkey as name_id from pairs join part on p_name = nf
  where same_key or exact > 0
  union select * from fuzzy_top union select * from vector_top),
scored as (
  select qf, nf, exact, phonetic, {_blend_sql('qf', 'nf')} as fuzzy,
         {rounded_sql("100.0::double * greatest(0.0::double, cosine)")} as embedding
  from pairs semi join candidates c using (qf, nf)),
final as (select *, {_combine_sql(_MAX_SQL)} as score, {_FIRED_SQL} as layers_fired from scored),
ranked as (
  select r.query_id, name_id as entity_id, name_id, f.*, max_results,
         row_number() over (partition by r.query_id order by score desc, name_id) as rank
  from requests r join final f on f.qf = r.qf
  join candidates c on c.qf = f.qf and c.nf = f.nf
  join part e on e.p_partkey = c.name_id
  where score >= threshold and (entity_type is null or entity_type = {PART_TYPE_SQL})),
matches as (select * from ranked where rank <= max_results)"""

SCREEN_FULL_SQL = f"""
with {SCREEN_PARTS_CTE}
select query_id, rank::int as rank, entity_id, name_id, score, exact, phonetic, fuzzy, embedding,
       layers_fired from matches"""


def _payload(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    valid, names, entities, matches = _screen_parts(spark, sf)
    return valid, match_payload(matches, names, entities)


def payload_rows(spark: SparkSession, sf: str) -> DataFrame:
    _, payload = _payload(spark, sf)
    return payload.select(
        "query_id", "rank", "matched_name", "matched_name_normalised", "matched_name_type",
        "alias_quality", "score", "layers.fuzzy", "layers.phonetic",
        F.element_at("layers_fired", 1).alias("first_layer"),
        "entity.source_list", "entity.reference_number", "entity.primary_name",
        "entity.entity_type", "entity.nationality", "entity.listed_date",
    )


MATCH_PAYLOAD_SQL = f"""
with {SCREEN_PARTS_CTE}
select query_id, rank::int as rank, p_name as matched_name, nf as matched_name_normalised,
       'primary' as matched_name_type, p_brand as alias_quality, score, fuzzy, phonetic,
       split_part(layers_fired, ',', 1) as first_layer, p_brand as source_list,
       p_partkey::varchar as reference_number, p_name as primary_name,
       {PART_TYPE_SQL} as entity_type, null::varchar as nationality,
       p_size::varchar as listed_date
from matches join part on p_partkey = entity_id"""


def audit_rows(spark: SparkSession, sf: str) -> DataFrame:
    valid, payload = _payload(spark, sf)
    audit = screening_audit(valid, payload)
    return audit.select(
        "query_id", "query_name", "query_name_normalised", "threshold", "entity_type_filter",
        "max_results", "match_count", "top_score",
        F.coalesce(F.array_join(
            F.from_json("results_json", "array<struct<entity:struct<reference_number:string>>>")[
                "entity"
            ]["reference_number"],
            ",",
        ), F.lit("")).alias("references"),
    )


AUDIT_SQL = f"""
with {SCREEN_PARTS_CTE},
grouped as (select query_id, count(*) as match_count, max(score) as top_score,
                   string_agg(entity_id::varchar, ',' order by rank) as refs
            from matches group by 1)
select query_id, name as query_name, qf as query_name_normalised, threshold,
       entity_type as entity_type_filter, max_results,
       coalesce(match_count, 0) as match_count, top_score, coalesce(refs, '') as "references"
from requests left join grouped using (query_id)"""


def screen_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """All layers but vectors: benchmark clauses against all document clauses."""
    valid, _ = validate_requests(benchmark_requests(spark, sf))
    folder = work_folder(spark)
    index = build_index(document_names(spark, sf), document_entities(spark, sf), folder, P)
    matches = screen(valid, index, P, path=folder)
    return matches.select(
        "query_id", "rank", "entity_id", "name_id", "score", "exact", "phonetic", "fuzzy"
    )


QUERIES = {
    "screen_exact": screen_exact,
    "normalise_names": normalise_names,
    "honorific_variants": honorific_variants,
    "unique_normalised": unique_names,
    "validate_requests": validated_requests,
    "phonetic_key": phonetic_keys,
    "phonetic_join": phonetic_join,
    "phonetic_dice": phonetic_dice,
    "fuzzy_topk": fuzzy_topk,
    "fuzzy_blend": fuzzy_blend,
    "vector_topk": vector_topk,
    "vector_lookup": vector_lookup,
    "vector_sync_plan": vector_sync_plan,
    "vector_encode": vector_encode,
    "combine_max": combine_max,
    "combine_weighted_sum": combine_weighted_sum,
    "candidate_union": united_candidates,
    "screen_full": screen_full,
    "match_payload": payload_rows,
    "screening_audit": audit_rows,
    "screen_clauses": screen_clauses,
}

ORACLES = {
    "screen_exact": SCREEN_EXACT_SQL,
    "normalise_names": NORMALISE_SQL,
    "honorific_variants": HONORIFIC_SQL,
    "unique_normalised": UNIQUE_SQL,
    "validate_requests": VALIDATE_SQL,
    "phonetic_key": PHONETIC_KEY_SQL,
    "phonetic_join": PHONETIC_JOIN_SQL,
    "phonetic_dice": PHONETIC_DICE_SQL,
    "fuzzy_topk": FUZZY_TOPK_SQL,
    "fuzzy_blend": FUZZY_BLEND_SQL,
    "vector_topk": VECTOR_TOPK_SQL,
    "vector_lookup": VECTOR_LOOKUP_SQL,
    "vector_sync_plan": VECTOR_SYNC_SQL,
    "vector_encode": VECTOR_ENCODE_SQL,
    "combine_max": COMBINE_MAX_SQL,
    "combine_weighted_sum": COMBINE_WEIGHTED_SQL,
    "candidate_union": CANDIDATE_UNION_SQL,
    "screen_full": SCREEN_FULL_SQL,
    "match_payload": MATCH_PAYLOAD_SQL,
    "screening_audit": AUDIT_SQL,
}
