"""Evaluation: perturbed test names, negatives, and quality measures.

Choices that a random generator would make are functions of a row id and a
salt, so every run and every partitioning makes the same cases.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesieve.functions.text import normalise_name
from namesieve.operators.candidates import meeting, top_rows
from namesieve.workspace import work_folder, written

# Cases wanted per perturbation.
QUOTAS = {
    "transliteration": 40, "typo": 40, "order_swap": 30,
    "dropped_middle": 30, "nickname": 20, "spacing_hyphen": 40,
}
NEGATIVE_QUOTA = 100
#: Seeds that are perturbed first, the first ones in order of the cases.
FIRST_SEEDS = 4096

# Spelling variants of one romanised sound or name.
TRANSLITERATIONS = (
    ("mohammed", "muhammad"), ("mohammed", "mohamed"), ("muhammad", "mohammed"),
    ("hussein", "husain"), ("hussein", "hussain"), ("abdul", "abdool"), ("rahman", "rahmaan"),
    ("ahmed", "ahmad"), ("ahmad", "ahmed"), ("aziz", "azeez"), ("hakim", "hakeem"),
    ("rashid", "rasheed"), ("shaikh", "sheikh"), ("usama", "osama"), ("osama", "usama"),
    ("yusuf", "yousef"), ("yousef", "yusuf"), ("ibrahim", "ebrahim"), ("khalil", "khaleel"),
    ("jamal", "jamaal"), ("said", "sayid"), ("ali", "aly"), ("hasan", "hassan"),
    ("hassan", "hasan"), ("qasim", "kasim"), ("tariq", "tarek"), ("walid", "waleed"),
    ("sergei", "sergey"), ("aleksandr", "alexander"), ("viktor", "victor"),
    ("dmitri", "dmitriy"), ("yuri", "yury"), ("vladimir", "wladimir"), ("oleg", "olegh"),
    ("kim", "gim"), ("ou", "u"), ("oo", "u"), ("ee", "i"),
)

# Short forms of given names.
NICKNAMES = {
    "mohammed": "mohd", "muhammad": "mohd", "abdul": "abd", "vladimir": "vova",
    "alexander": "sasha", "aleksandr": "sasha", "mikhail": "misha", "sergei": "seryoga",
    "nikolai": "kolya", "dmitri": "dima", "dmitry": "dima", "ivan": "vanya",
    "viktor": "vitya", "yevgeny": "zhenya", "evgeny": "zhenya", "konstantin": "kostya",
    "william": "bill", "robert": "bob", "richard": "dick", "ibrahim": "ibro",
    "ismail": "isma", "abdullah": "abdu",
}

# Given and family names for people who are on no list.
NEGATIVE_FIRST = (
    "Bronwyn", "Lachlan", "Matilda", "Angus", "Imogen", "Declan", "Sienna", "Callum", "Freya",
    "Hamish", "Isla", "Rory", "Tahlia", "Ewan", "Greta", "Quentin", "Marigold", "Barnaby",
    "Clementine", "Digby", "Prudence", "Alistair", "Rosalind", "Fergus", "Winifred", "Horace",
    "Beatrix", "Cedric", "Gwendolyn", "Rupert",
)
NEGATIVE_LAST = (
    "Fairweather", "Thistlewood", "Brightwater", "Copperfield", "Dunstable", "Everingham",
    "Featherstone", "Greenhalgh", "Honeybourne", "Inglewood", "Kingsley-Smith", "Larkspur",
    "Merriweather", "Netherwood", "Oakhurst", "Pemberton", "Quigley", "Ravenscroft",
    "Silverthorne", "Tunbridge", "Underhill", "Waverley", "Wetherby", "Yarrow", "Ashcombe",
)

LETTERS = "abcdefghijklmnopqrstuvwxyz"
THRESHOLDS = (60, 70, 75, 80, 90)


def chosen(seed: Column, salt: int, n: Column | int) -> Column:
    """A 0-based choice out of ``n``; null when there is nothing to choose from."""
    count = F.nullif(n if isinstance(n, Column) else F.lit(n), F.lit(0))
    return F.pmod(seed + salt, count).cast("int")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def eligible_seeds(names: DataFrame, name: str = "primary_name") -> DataFrame:
    """Individuals with at least two tokens in plain Latin letters and digits."""
    normalised = names.filter(F.col("entity_type") == "individual").withColumn(
        "norm", F.explode(F.array(normalise_name(F.col(name))))
    )
    latin = F.col("norm").rlike("^[a-z0-9 ]+$") & F.contains("norm", F.lit(" "))
    return normalised.filter(latin).withColumn("tokens", F.split("norm", " "))


def entity_forms(names: DataFrame) -> DataFrame:
    """Distinct normalised names per entity."""
    return names.select("source_list", "reference_number", "name_normalised").distinct()


def transliterated(
    norm: Column, seed: Column, rules: Sequence[tuple[str, str]] = TRANSLITERATIONS
) -> Column:
    """One applicable spelling rule at its first occurrence."""
    table = F.array(*(F.struct(F.lit(s).alias("src"), F.lit(d).alias("dst")) for s, d in rules))

    def splice(rule: Column) -> Column:
        at = F.instr(norm, rule["src"])
        return F.concat(
            F.substring(norm, F.lit(1), at - 1),
            rule["dst"],
            F.substring(norm, at + F.length(rule["src"]), F.length(norm)),
        )

    fitting = F.filter(table, lambda r: F.contains(norm, r["src"]))
    return let(fitting, lambda rules: let(F.get(rules, chosen(seed, 0, F.size(rules))), splice))


def _one_edit(text: Column, seed: Column, salt: int) -> Column:
    """One chosen edit at a chosen letter; null if there is no letter."""

    def edit(at: Column) -> Column:
        char, following = F.substring(text, at, F.lit(1)), F.substring(text, at + 1, F.lit(1))
        before = F.substring(text, F.lit(1), at - 1)
        after = F.substring(text, at + 1, F.length(text))
        others = F.replace(F.lit(LETTERS), char, F.lit(""))
        substitute = F.substring(others, chosen(seed, salt + 2, 25) + 1, F.lit(1))
        inserted = F.substring(F.lit(LETTERS), chosen(seed, salt + 3, 26) + 1, F.lit(1))
        kind = chosen(seed, salt + 1, 4)
        return (
            F.when(kind == 0, F.concat(before, substitute, after))
            .when((kind == 1) & (F.length(text) > 4), F.concat(before, after))
            .when(kind == 2, F.concat(before, inserted, char, after))
            .when(
                (kind == 3) & following.between("a", "z"),
                F.concat(before, following, char, F.substring(text, at + 2, F.length(text))),
            )
            .when(at.isNotNull(), text)
        )

    letters = F.array_compact(
        F.transform(F.split(text, ""), lambda c, i: F.when(c.between("a", "z"), i + 1))
    )
    at = let(letters, lambda places: F.get(places, chosen(seed, salt, F.size(places))))
    return let(at, edit)


def misspelt(norm: Column, seed: Column) -> Column:
    """One edit, or two for one row in three."""

    def maybe_again(once: Column) -> Column:
        return F.when(chosen(seed, 5, 3) == 2, _one_edit(once, seed, 29)).otherwise(once)

    return let(_one_edit(norm, seed, 11), maybe_again)


def reordered(tokens: Column, seed: Column) -> Column:
    """Tokens rotated by a chosen offset; null if that changes nothing."""

    def rotate(words: Column) -> Column:
        offset = chosen(seed, 3, F.size(words) - 1) + 1
        rotated = F.concat(
            F.slice(words, offset + 1, F.size(words)), F.slice(words, F.lit(1), offset)
        )
        return let(rotated, lambda r: F.when(r != words, F.array_join(r, " ")))

    return let(tokens, rotate)


def without_middle(tokens: Column) -> Column:
    """First and last of at least three tokens."""
    ends = F.concat_ws(" ", F.element_at(tokens, 1), F.element_at(tokens, -1))
    return F.when(F.size(tokens) >= 3, ends)


def nicknamed(tokens: Column, seed: Column, nicknames: dict[str, str] = NICKNAMES) -> Column:
    """One known token replaced by its short form."""
    table = F.create_map(*(F.lit(v) for pair in nicknames.items() for v in pair))

    def shorten(words: Column) -> Column:
        def swap(place: Column) -> Column:
            swapped = F.transform(
                words, lambda w, i: F.when(i == place, F.element_at(table, w)).otherwise(w)
            )
            return F.when(place.isNotNull(), F.array_join(swapped, " "))

        known = F.array_compact(
            F.transform(words, lambda w, i: F.when(w.isin(*nicknames), i))
        )
        return let(
            let(known, lambda places: F.get(places, chosen(seed, 2, F.size(places)))), swap
        )

    return let(tokens, shorten)


def respaced(tokens: Column, seed: Column) -> Column:
    """Two neighbours merged or hyphenated, or one long token split."""
    style = chosen(seed, 4, 3)

    def change(words: Column) -> Column:
        i = chosen(seed, 1, F.size(words) - 1)
        left, right = F.get(words, i), F.get(words, i + 1)
        pair = F.concat(left, F.when(style == 1, "-").otherwise(""), right)
        rest = F.slice(words, i + 3, F.size(words))
        joined = F.concat(F.slice(words, F.lit(1), i), F.array(pair), rest)

        def split(token: Column) -> Column:
            cut = chosen(seed, 6, F.length(token) - 4) + 2
            halves = F.array(
                F.substring(token, F.lit(1), cut),
                F.substring(token, cut + 1, F.length(token)),
            )
            others = F.filter(words, lambda w: w != token)
            return F.when(F.length(token) >= 6, F.array_join(F.concat(others, halves), " "))

        long_one = F.when(F.length(left) >= 6, left).otherwise(F.element_at(words, -1))
        return F.when(style < 2, F.array_join(joined, " ")).otherwise(let(long_one, split))

    return let(tokens, change)


PERTURBATIONS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "transliteration": lambda norm, tokens, seed: transliterated(norm, seed),
    "typo": lambda norm, tokens, seed: misspelt(norm, seed),
    "order_swap": lambda norm, tokens, seed: reordered(tokens, seed),
    "dropped_middle": lambda norm, tokens, seed: without_middle(tokens),
    "nickname": lambda norm, tokens, seed: nicknamed(tokens, seed),
    "spacing_hyphen": lambda norm, tokens, seed: respaced(tokens, seed),
}


def perturbed(seeds: DataFrame, kinds: Sequence[str], seed: str = "seed") -> DataFrame:
    """Seeds once per perturbation that applies to them, with (kind, perturbation, query)."""
    made = F.array(
        *(
            F.struct(
                F.lit(number).alias("kind"),
                F.lit(kind).alias("perturbation"),
                PERTURBATIONS[kind](F.col("norm"), F.col("tokens"), F.col(seed)).alias("query"),
            )
            for number, kind in enumerate(kinds)
        )
    )
    return seeds.select("*", F.inline(made)).filter("query <> ''")


def evaluation_cases(
    seeds: DataFrame,
    forms: DataFrame,
    seed: str = "seed",
    quotas: dict[str, int] | None = None,
    kinds: Sequence[str] = tuple(PERTURBATIONS),
    first_seeds: int = FIRST_SEEDS,
) -> DataFrame:
    """Positive cases up to each perturbation's quota, numbered.

    Cases that normalise back to a name of their own entity are dropped.
    Entities take part in an order fixed by a hash of their key. The first
    ``first_seeds`` in it are perturbed first; perturbations whose quota they do
    not fill are made of all seeds.
    """
    quotas = quotas or QUOTAS
    key = ["source_list", "reference_number"]
    order = [F.col("_order"), F.col("reference_number"), F.col("source_list")]
    folder = work_folder(seeds.sparkSession)
    seeds = seeds.withColumn("_order", F.md5(F.concat_ws("/", *key)))
    seeds = written(seeds, f"{folder}/seeds")

    def fresh_cases(of: DataFrame, missing: Sequence[str], path: str) -> DataFrame:
        cases = written(perturbed(of, missing, seed), f"{path}/perturbed")
        cases = cases.withColumn("name_normalised", normalise_name(F.col("query")))
        own = meeting(forms, cases, "reference_number")
        fresh = cases.join(own, [*key, "name_normalised"], "left_anti")
        limits = [quotas[kind] for kind in missing]
        quota = F.element_at(F.array(*(F.lit(n) for n in limits)), F.col("kind") + 1)
        # The constant limit is what lets every task cut its own rows before the shuffle.
        found = top_rows(fresh, ["kind"], order, max(limits)).filter(F.col("_rank") <= quota)
        number = F.array_position(F.array(*(F.lit(kind) for kind in kinds)), F.col("perturbation"))
        return written(found.withColumn("kind", number), f"{path}/found")

    first = written(seeds.orderBy(*order).limit(first_seeds), f"{folder}/first_seeds")
    found = fresh_cases(first, kinds, f"{folder}/first")
    if first.count() == first_seeds:  # there may be more
        counts = {r["perturbation"]: r["count"] for r in found.groupBy("perturbation").count().collect()}
        missing = [kind for kind in kinds if counts.get(kind, 0) < quotas[kind]]
        if missing:
            rest = fresh_cases(seeds, missing, f"{folder}/all")
            found = found.filter(~F.col("perturbation").isin(missing)).unionByName(rest)
    # At most the sum of the quotas is left, so one ordered window numbers them.
    numbered = F.row_number().over(Window.orderBy("kind", "_rank"))
    return found.select(
        F.format_string("P%03d", numbered).alias("case_id"),
        "query",
        "perturbation",
        F.col("primary_name").alias("original_name"),
        F.struct(*key).alias("truth"),
    )


def negative_cases(forms: DataFrame, quota: int = NEGATIVE_QUOTA) -> DataFrame:
    """Made-up names that are on no list, in order, up to the quota."""
    spark = forms.sparkSession
    first = F.array(*(F.lit(n) for n in NEGATIVE_FIRST))
    last = F.array(*(F.lit(n) for n in NEGATIVE_LAST))
    names = (
        spark.range(1)
        .select(F.posexplode(first).alias("i", "first"))
        .select("i", "first", F.posexplode(last).alias("j", "last"))
        .select("i", "j", F.concat_ws(" ", "first", "last").alias("query"))
        .withColumn("name_normalised", normalise_name(F.col("query")))
    )
    # 750 made-up names at most: only their matches leave the large side.
    listed = forms.select("name_normalised").join(
        F.broadcast(names.select("name_normalised")), "name_normalised", "left_semi"
    )
    fresh = names.join(listed.distinct(), "name_normalised", "left_anti")
    numbered = F.row_number().over(Window.orderBy("i", "j"))
    nothing = F.lit(None)
    return (
        fresh.withColumn("_n", numbered)
        .filter(F.col("_n") <= quota)
        .select(
            F.format_string("N%03d", "_n").alias("case_id"),
            "query",
            F.lit("negative").alias("perturbation"),
            nothing.cast("string").alias("original_name"),
            nothing.cast("struct<source_list:string,reference_number:string>").alias("truth"),
        )
    )


def case_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("perturbation").agg(F.count("*").alias("n_cases"))


def case_outcomes(cases: DataFrame, results: DataFrame, truth: str, entity: str) -> DataFrame:
    """Per case: the best score of any match and of the true entity.

    ``results`` has (case_id, <entity>, score): the top matches at the lowest
    threshold. A case without a truth is a negative.
    """
    scored = results.join(cases.select("case_id", truth), "case_id")
    best = scored.groupBy("case_id").agg(
        F.max("score").alias("best_score"),
        F.max(F.when(F.col(entity) == F.col(truth), F.col("score"))).alias("truth_score"),
    )
    return cases.join(best, "case_id", "left")


def precision_recall(
    outcomes: DataFrame, truth: str, thresholds: Sequence[int] = THRESHOLDS
) -> DataFrame:
    """Counts, precision, recall and F1 per threshold.

    A positive case flagged only with other entities counts as a false positive
    and as a false negative.
    """
    levels = F.explode(F.array(*(F.lit(t) for t in thresholds)))
    judged = outcomes.withColumn("threshold", levels).select(
        "threshold",
        F.col(truth).isNotNull().alias("positive"),
        F.coalesce(F.col("best_score") >= F.col("threshold"), F.lit(False)).alias("flagged"),
        F.coalesce(F.col("truth_score") >= F.col("threshold"), F.lit(False)).alias("hit"),
    )
    counted = judged.groupBy("threshold").agg(
        F.count_if(F.expr("positive and hit")).alias("tp"),
        F.count_if(F.expr("flagged and not (positive and hit)")).alias("fp"),
        F.count_if(F.expr("positive and not hit")).alias("fn"),
    )

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    rates = counted.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumn("f1", ratio(2 * p * r, p + r))


def recall_by_perturbation(outcomes: DataFrame, truth: str, threshold: float = 75) -> DataFrame:
    hit = F.coalesce(F.col("truth_score") >= threshold, F.lit(False))
    return (
        outcomes.filter(F.col(truth).isNotNull())
        .groupBy("perturbation")
        .agg(F.count("*").alias("n_cases"), F.avg(hit.cast("double")).alias("recall"))
    )


#: Ranges of a group: a quantile sketch of accuracy 10,000 can tell about half as many apart.
RANGE_ROWS = 200_000
LEAST_RANGES = 16
MOST_RANGES = 5_000


def exact_percentiles(
    rows: DataFrame, group: str, value: str, buckets: int | None = None
) -> DataFrame:
    """Median and exclusive 95th percentile per group, exact at any group size.

    Equal values are counted first. Approximate quantiles then only cut each
    group into ranges; the exact rank is the rank within a range plus the size
    of the ranges before it, so no task sees a whole group. Without ``buckets``
    there are as many ranges as keep about ``RANGE_ROWS`` rows in one.
    """
    if buckets is None:
        buckets = min(max(LEAST_RANGES, -(-rows.count() // RANGE_ROWS)), MOST_RANGES)
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = counts.groupBy(group).agg(F.percentile_approx(value, cuts, 10_000).alias("bounds"))
    ranged = counts.join(bounds, group).withColumn(
        "range", F.size(F.filter("bounds", lambda b: b <= F.col(value)))
    )
    sizes = ranged.groupBy(group, "range").agg(F.sum("n").alias("size"))
    by_range = Window.partitionBy(group).orderBy("range")  # at most ``buckets`` rows per group
    offsets = sizes.select(
        group,
        "range",
        (F.sum("size").over(by_range) - F.col("size")).alias("before"),
        F.sum("size").over(Window.partitionBy(group)).alias("total"),
    )
    running = Window.partitionBy(group, "range").orderBy(value)
    ranked = ranged.join(offsets, [group, "range"]).withColumn(
        "last", F.col("before") + F.sum("n").over(running)
    )
    ranked = ranked.withColumn("first", F.col("last") - F.col("n") + 1)
    total = F.col("total")

    def lower_rank(n: Column) -> Column:
        """Rank below position 0.95 (n + 1), with a rank above it left over."""
        return F.greatest(F.lit(1), F.least(F.floor(19 * (n + 1) / 20), n - 1))

    def at(rank: Column) -> Column:
        inside = rank.between(F.col("first"), F.col("last"))
        return F.max(F.when(inside, F.col(value)))

    found = ranked.groupBy(group).agg(
        F.max("total").alias("calls"),
        at(F.floor((total + 1) / 2)).alias("_m0"),
        at(F.floor((total + 2) / 2)).alias("_m1"),
        at(lower_rank(total)).alias("_q0"),
        at(lower_rank(total) + 1).alias("_q1"),
    )
    calls = F.col("calls")
    share = 19 * (calls + 1) - 20 * lower_rank(calls)
    upper = F.coalesce("_q1", "_q0")
    p95 = (F.col("_q0") * (20 - share) + upper * share) / 20
    return found.select(
        group, "calls", ((F.col("_m0") + F.col("_m1")) / 2).alias("p50"), p95.alias("p95")
    )
