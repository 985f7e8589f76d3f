"""Registered queries: evaluation cases and quality measures.

Every clause of every English document is one listed individual here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.catalog.tables import clauses, clauses_sql, norm_sql, read
from namesieve.functions.text import normalise_name
from namesieve.operators.evaluation import (
    LETTERS,
    NEGATIVE_FIRST,
    NEGATIVE_LAST,
    QUOTAS,
    TRANSLITERATIONS,
    case_counts,
    case_outcomes,
    eligible_seeds,
    entity_forms,
    evaluation_cases,
    exact_percentiles,
    misspelt,
    negative_cases,
    nicknamed,
    precision_recall,
    recall_by_perturbation,
    reordered,
    respaced,
    transliterated,
    without_middle,
)
from namesieve.workspace import work_folder, written

# Short forms of common words of the test documents and product names.
SHORT_FORMS = {"the": "th", "and": "an", "that": "tht", "with": "w", "small": "sm", "red": "rd"}


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    rows = clauses(read(spark, sf, "documents"), "doc_id")
    return rows.select(
        F.col("source").alias("source_list"),
        F.col("name_id").cast("string").alias("reference_number"),
        F.col("name").alias("primary_name"),
        F.when(F.col("lang") == "en", "individual").otherwise("entity").alias("entity_type"),
        F.col("name_id").alias("seed"),
    )


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    return eligible_seeds(_listed(spark, sf))


SEEDS_CTE = f"""
listed as (select source as source_list, name_id::varchar as reference_number, name as primary_name,
                  lang, name_id as seed, {norm_sql('name')} as norm
           from ({clauses_sql('documents', 'doc_id', 'lang, source')})),
seeds as (select *, string_split(norm, ' ') as tokens from listed
          where lang = 'en' and regexp_matches(norm, '^[a-z0-9]+( [a-z0-9]+)+$'))"""


def eval_seeds(spark: SparkSession, sf: str) -> DataFrame:
    seeds = _seeds(spark, sf)
    forms = entity_forms(
        _listed(spark, sf).withColumn("name_normalised", normalise_name(F.col("primary_name")))
    )
    per_list = forms.groupBy("source_list").agg(F.count("*").alias("n_forms"))
    counted = seeds.groupBy("source_list", F.size("tokens").alias("n_tokens")).agg(
        F.count("*").alias("n_seeds"), F.min("norm").alias("first_norm")
    )
    return counted.join(per_list, "source_list")


EVAL_SEEDS_SQL = f"""
with {SEEDS_CTE},
f as (select source_list, count(*) as n_forms
      from (select distinct source_list, reference_number, norm from listed) group by 1)
select source_list, len(tokens)::int as n_tokens, count(*) as n_seeds, min(norm) as first_norm,
       any_value(n_forms) as n_forms
from seeds join f using (source_list) group by 1, 2"""


def _perturbation(query: Column):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _seeds(spark, sf).withColumn("query", query)
        return rows.filter("query is not null").select("reference_number", "query")

    return run


def _pick(salt: int, n: str) -> str:
    return f"((seed + {salt}) % nullif({n}, 0))"


_RULES_SQL = (
    "[" + ", ".join(f"{{'src': '{s}', 'dst': '{d}'}}" for s, d in TRANSLITERATIONS) + "]"
)
TRANSLITERATION_SQL = f"""
select reference_number, substr(norm, 1, instr(norm, rule.src) - 1) || rule.dst
         || substr(norm, instr(norm, rule.src) + length(rule.src)) as query
from (select *, fitting[{_pick(0, 'len(fitting)')} + 1] as rule
      from (select *, list_filter({_RULES_SQL}, lambda r: contains(norm, r.src)) as fitting
            from seeds))
where rule is not null"""


def _edit_sql(source: str, salt: int) -> str:
    kind = _pick(salt + 1, "4")
    return f"""
select *, case
    when {kind} = 0 then substr(t, 1, p - 1)
      || substr(replace('{LETTERS}', c, ''), {_pick(salt + 2, '25')} + 1, 1) || substr(t, p + 1)
    when {kind} = 1 and length(t) > 4 then substr(t, 1, p - 1) || substr(t, p + 1)
    when {kind} = 2 then substr(t, 1, p - 1) || substr('{LETTERS}', {_pick(salt + 3, '26')} + 1, 1)
      || c || substr(t, p + 1)
    when {kind} = 3 and regexp_matches(f, '[a-z]') then substr(t, 1, p - 1) || f || c
      || substr(t, p + 2)
    else t end as edited
from (select *, substr(t, p, 1) as c, substr(t, p + 1, 1) as f
      from (select *, places[{_pick(salt, 'len(places)')} + 1] as p
            from (select *, list_filter(range(1, length(t) + 1),
                                        lambda i: regexp_matches(substr(t, i, 1), '[a-z]')) as places
                  from ({source}))))"""


TYPO_SQL = f"""
select reference_number, case when {_pick(5, '3')} = 2 then twice else once end as query
from (select reference_number, seed, once, edited as twice from ({_edit_sql(
    "select reference_number, seed, edited as once, edited as t from ("
    + _edit_sql("select reference_number, seed, norm as t from seeds", 11) + ")", 29)}))
where once is not null"""

ORDER_SWAP_SQL = f"""
select reference_number, array_to_string(rotated, ' ') as query
from (select *, list_concat(tokens[k + 1:], tokens[:k]) as rotated
      from (select *, {_pick(3, 'len(tokens) - 1')} + 1 as k from seeds))
where rotated <> tokens"""

DROPPED_SQL = """
select reference_number, tokens[1] || ' ' || tokens[-1] as query from seeds
where len(tokens) >= 3"""

_SHORT_SQL = "case t " + " ".join(f"when '{a}' then '{b}'" for a, b in SHORT_FORMS.items()) + " end"
_KNOWN_SQL = "(" + ", ".join(f"'{a}'" for a in SHORT_FORMS) + ")"
NICKNAME_SQL = f"""
select reference_number, array_to_string(list_transform(tokens, lambda t, i:
         case when i = place then {_SHORT_SQL} else t end), ' ') as query
from (select *, places[{_pick(2, 'len(places)')} + 1] as place
      from (select *, list_filter(range(1, len(tokens) + 1),
                                  lambda i: tokens[i] in {_KNOWN_SQL}) as places from seeds))
where place is not null"""

SPACING_SQL = f"""
select reference_number, query from (
  select reference_number, case
    when style < 2 then array_to_string(list_concat(tokens[:i],
      [tokens[i + 1] || case when style = 1 then '-' else '' end || tokens[i + 2]],
      tokens[i + 3:]), ' ')
    when length(token) >= 6 then array_to_string(list_concat(
      list_filter(tokens, lambda t: t <> token),
      [substr(token, 1, cut), substr(token, cut + 1)]), ' ') end as query
  from (select *, {_pick(6, 'length(token) - 4')} + 2 as cut
        from (select *, case when length(tokens[i + 1]) >= 6 then tokens[i + 1] else tokens[-1] end
                as token
              from (select *, {_pick(1, 'len(tokens) - 1')} as i, {_pick(4, '3')} as style
                    from seeds))))
where query is not null"""


def eval_cases(spark: SparkSession, sf: str) -> DataFrame:
    forms = entity_forms(
        _listed(spark, sf).withColumn("name_normalised", normalise_name(F.col("primary_name")))
    )
    cases = written(evaluation_cases(_seeds(spark, sf), forms), f"{work_folder(spark)}/cases")
    listed = cases.select(
        "case_id", "query", "perturbation", "original_name", "truth.source_list",
        "truth.reference_number",
    )
    counts = case_counts(cases).select(
        F.lit("total").alias("case_id"), F.col("n_cases").cast("string").alias("query"),
        "perturbation", F.lit(None).cast("string").alias("original_name"),
        F.lit(None).cast("string").alias("source_list"),
        F.lit(None).cast("string").alias("reference_number"),
    )
    return listed.unionByName(counts)


_KIND_SQL = {
    "transliteration": TRANSLITERATION_SQL,
    "typo": TYPO_SQL,
    "order_swap": ORDER_SWAP_SQL,
    "dropped_middle": DROPPED_SQL,
    "spacing_hyphen": SPACING_SQL,
}
_CASE_ORDER = {kind: number for number, kind in enumerate(QUOTAS)}
_CASES_SQL = " union all ".join(
    f"select *, '{kind}' as perturbation, {_CASE_ORDER[kind]} as kind, {QUOTAS[kind]} as quota"
    f" from ({sql})"
    for kind, sql in _KIND_SQL.items()
)
# No document holds one of the reference nicknames, so that kind has no cases.
EVAL_CASES_SQL = f"""
with {SEEDS_CTE},
cases as ({_CASES_SQL}),
kept as (
  select c.*, s.source_list, s.primary_name, row_number() over (
           partition by kind order by md5(source_list || '/' || reference_number), reference_number)
           as k
  from cases c join seeds s using (reference_number)
  where query <> '' and {norm_sql('query')} <> s.norm),
final as (select *, row_number() over (order by kind, k) as number from kept where k <= quota)
select printf('P%03d', number) as case_id, query, perturbation, primary_name as original_name,
       source_list, reference_number from final
union all
select 'total', count(*)::varchar, perturbation, null, null, null from final group by perturbation"""


def eval_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up names on no list; the listed names also hold some of them."""
    listed = _listed(spark, sf).withColumn("name_normalised", normalise_name(F.col("primary_name")))
    first = F.element_at(F.array(*(F.lit(n) for n in NEGATIVE_FIRST)), F.lit(1))
    customer = read(spark, sf, "customer").select(
        F.lit("C").alias("source_list"),
        F.col("c_custkey").cast("string").alias("reference_number"),
        normalise_name(
            F.concat_ws(
                " ", first,
                F.get(F.array(*(F.lit(n) for n in NEGATIVE_LAST)), F.col("c_nationkey")),
            )
        ).alias("name_normalised"),
    )
    forms = entity_forms(listed).unionByName(customer)
    return negative_cases(forms).select("case_id", "query", "perturbation")


def _strings_sql(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


NEGATIVES_SQL = f"""
with names as (select i, j, {_strings_sql(NEGATIVE_FIRST)}[i] || ' ' || {_strings_sql(NEGATIVE_LAST)}[j]
                 as query from range(1, 31) a(i), range(1, 26) b(j)),
listed as (select {norm_sql('name')} as norm from ({clauses_sql('documents', 'doc_id')})
           union select {norm_sql(f"'{NEGATIVE_FIRST[0]} ' || {_strings_sql(NEGATIVE_LAST)}[c_nationkey + 1]")}
           from customer),
fresh as (select *, row_number() over (order by i, j) as n from names
          where {norm_sql('query')} not in (select norm from listed))
select printf('N%03d', n) as case_id, query, 'negative' as perturbation from fresh where n <= 100"""


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cases, their line items as results, line numbers as entities."""
    cases = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_orderpriority").alias("perturbation"),
        F.when(F.col("o_orderstatus") != "P", F.pmod("o_custkey", F.lit(7)) + 1).alias("truth"),
    )
    results = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_linenumber").alias("entity"),
        (F.col("l_quantity") + 50).alias("score"),
    )
    return case_outcomes(cases, results.filter("score >= 60"), "truth", "entity")


_OUTCOMES_SQL = """
cases as (select o_orderkey as case_id, o_orderpriority as perturbation,
                 case when o_orderstatus <> 'P' then o_custkey % 7 + 1 end as truth from orders),
res as (select l_orderkey as case_id, l_linenumber as entity, l_quantity + 50 as score
        from lineitem where l_quantity + 50 >= 60),
out as (select case_id, perturbation, truth, max(score) as best,
               max(case when entity = truth then score end) as hit
        from cases left join res using (case_id) group by all)"""


def precision_recall_by_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return precision_recall(_outcomes(spark, sf), "truth")


PRECISION_SQL = f"""
with {_OUTCOMES_SQL},
c as (select t as threshold,
             count(*) filter (truth is not null and coalesce(hit >= t, false)) as tp,
             count(*) filter (coalesce(best >= t, false)
                              and not (truth is not null and coalesce(hit >= t, false))) as fp,
             count(*) filter (truth is not null and not coalesce(hit >= t, false)) as fn
      from out, (select unnest([60, 70, 75, 80, 90]) as t) group by 1),
r as (select *, case when tp + fp > 0 then tp::double / (tp + fp) else 0.0 end as precision,
             case when tp + fn > 0 then tp::double / (tp + fn) else 0.0 end as recall from c)
select *, case when precision + recall > 0
               then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from r"""


def recall_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return recall_by_perturbation(_outcomes(spark, sf), "truth").select(
        "perturbation", "n_cases", F.round("recall", 9).alias("recall")
    )


RECALL_SQL = f"""
with {_OUTCOMES_SQL}
select perturbation, count(*) as n_cases,
       round(avg(case when hit >= 75 then 1.0::double else 0.0::double end), 9) as recall
from out where truth is not null group by 1"""


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return exact_percentiles(read(spark, sf, "events"), "event_type", "value").select(
        "event_type", "calls", F.round("p50", 9).alias("p50"), F.round("p95", 9).alias("p95")
    )


PERCENTILES_SQL = """
with r as (select event_type, value, row_number() over (partition by event_type order by value) as k,
                  count(*) over (partition by event_type) as n from events),
j as (select *, greatest(1, least(19 * (n + 1) // 20, n - 1)) as j from r),
s as (select *, 19 * (n + 1) - 20 * j as share from j)
select event_type, max(n) as calls,
       round((max(value) filter (k = (n + 1) // 2) + max(value) filter (k = (n + 2) // 2)) / 2, 9)
         as p50,
       round((max(value * (20 - share)) filter (k = j) + max(value * share) filter (k = j + 1)) / 20,
             9) as p95
from s group by 1"""


QUERIES = {
    "eval_seeds": eval_seeds,
    # Columns need a session, so these are built when called.
    "perturb_transliteration": lambda s, d: _perturbation(
        transliterated(F.col("norm"), F.col("seed"))
    )(s, d),
    "perturb_typo": lambda s, d: _perturbation(misspelt(F.col("norm"), F.col("seed")))(s, d),
    "perturb_order_swap": lambda s, d: _perturbation(
        reordered(F.col("tokens"), F.col("seed"))
    )(s, d),
    "perturb_dropped_middle": lambda s, d: _perturbation(without_middle(F.col("tokens")))(s, d),
    "perturb_nickname": lambda s, d: _perturbation(
        nicknamed(F.col("tokens"), F.col("seed"), SHORT_FORMS)
    )(s, d),
    "perturb_spacing": lambda s, d: _perturbation(respaced(F.col("tokens"), F.col("seed")))(s, d),
    "eval_cases": eval_cases,
    "eval_negatives": eval_negatives,
    "precision_recall": precision_recall_by_threshold,
    "recall_by_type": recall_by_type,
    "latency_percentiles": latency_percentiles,
}

ORACLES = {
    "eval_seeds": EVAL_SEEDS_SQL,
    "perturb_transliteration": f"with {SEEDS_CTE} {TRANSLITERATION_SQL}",
    "perturb_typo": f"with {SEEDS_CTE} {TYPO_SQL}",
    "perturb_order_swap": f"with {SEEDS_CTE} {ORDER_SWAP_SQL}",
    "perturb_dropped_middle": f"with {SEEDS_CTE} {DROPPED_SQL}",
    "perturb_nickname": f"with {SEEDS_CTE} {NICKNAME_SQL}",
    "perturb_spacing": f"with {SEEDS_CTE} {SPACING_SQL}",
    "eval_cases": EVAL_CASES_SQL,
    "eval_negatives": NEGATIVES_SQL,
    "precision_recall": PRECISION_SQL,
    "recall_by_type": RECALL_SQL,
    "latency_percentiles": PERCENTILES_SQL,
}
