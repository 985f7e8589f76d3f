"""URL filtering by rules, and by gradient-boosted trees on lexical features.

Rules name a host and a path prefix; the longest rule that fits decides. URLs
that a rule decides are the labelled ones: gradient-boosted trees learn from a
bounded sample of them what blocked URLs look like - length, depth, digit
ratio, entropy of the characters, numbers of parameters, and how common and how
deep URLs of the same host suffix are - and judge the others.

Only DataFrame, SQL and MLlib operations run; nothing runs in Python on the
executors. Rules are literals of the plan, so their number should stay in the
hundreds. Suffix statistics cover all URLs: partial aggregates, then a join of
two written tables, which Spark splits if one suffix is hot.

Nulls and odd rows: a null URL, or one without ``://``, has an empty host and
path; no rule fits it and it is judged by its features like any other. Of equally long
rules that fit, the one with the longer host counts, then block. If the labelled URLs are all of
one verdict, the others get that verdict; without any they are allowed.
Repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.llm.common import first_by_hash
from namesieve.llm.line_dedup import LOWER, UPPER
from namesieve.workspace import work_folder, written


@dataclass(frozen=True)
class Rule:
    """A rule fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """From ``host/path``."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


@dataclass(frozen=True)
class UrlParams:
    """``per_verdict`` bounds the labelled URLs learnt from, per verdict."""

    per_verdict: int = 4000
    trees: int = 12
    depth: int = 4
    seed: int = 23
    threshold: float = 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the rule that decides, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "block", r.name))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(ordered):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


FEATURES = (
    "n_chars", "host_chars", "path_chars", "host_depth", "path_depth", "digit_ratio", "path_digits",
    "entropy", "n_params", "n_hyphens", "has_fragment", "is_secure", "suffix_count", "suffix_depth",
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(text, "")
    n = F.char_length(text).cast("double")
    share = lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n
    each = F.transform(F.filter(F.array_distinct(chars), lambda c: c != ""), lambda c: share(c) * F.log2(share(c)))
    return F.when(n > 0, -F.aggregate(each, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def lexical(rows: DataFrame) -> DataFrame:
    """``rows`` (url, host, path) with the features of each URL by itself."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    n = F.char_length(url).cast("double")
    return rows.withColumns({
        "suffix": F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0),
        "n_chars": n,
        "host_chars": F.char_length(host).cast("double"),
        "path_chars": F.char_length(path).cast("double"),
        "host_depth": _count(host, r"\."),
        "path_depth": _count(path, "/"),
        "digit_ratio": _count(url, "[0-9]") / F.greatest(n, F.lit(1.0)),
        "path_digits": _count(path, "[0-9]"),
        "entropy": entropy(url),
        "n_params": _count(url, "[?&][^=&#]*="),
        "n_hyphens": _count(url, "[-_]"),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "is_secure": F.startswith(url, F.lit("https:")).cast("double"),
    })


def with_suffix_statistics(rows: DataFrame, folder: str) -> DataFrame:
    """How many URLs share the last two labels of the host, and how deep they are on average."""
    stats = rows.groupBy("suffix").agg(
        F.log1p(F.count("*").cast("double")).alias("suffix_count"),
        F.avg("path_depth").alias("suffix_depth"),
    )
    return rows.join(written(stats, f"{folder}/suffixes"), "suffix")


def judged(pages: DataFrame, rules: list[Rule], params: UrlParams | None = None, url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score): ``score`` is the model's, null where a rule decides."""
    params = params or UrlParams()
    folder = work_folder(pages.sparkSession)
    rows = pages.select("page_id", F.col(url).cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = lexical(rows.withColumn("matched", matched(F.col("host"), F.col("path"), rules)))
    rows = written(rows, f"{folder}/lexical")
    rows = written(with_suffix_statistics(rows, folder).drop("url", "suffix"), f"{folder}/rows")
    found = ["page_id", "host", "path", F.col("matched.rule").alias("rule")]

    drawn = []
    decided = rows.filter("matched is not null").groupBy("matched.verdict").count()
    totals = {r["verdict"]: r["count"] for r in decided.collect()}
    for verdict in ("allow", "block"):
        of = rows.filter(F.col("matched.verdict") == verdict)
        key, total = ["page_id", "host", "path"], totals.get(verdict, 0)
        of = first_by_hash(of, key, params.per_verdict, total, params.seed)
        drawn.append(of.select((F.col("matched.verdict") == "block").cast("double").alias("label"), *FEATURES))
    sample = written(drawn[0].unionByName(drawn[1]).coalesce(1), f"{folder}/sample")
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        verdict = "block" if 1.0 in counts else "allow"
        return rows.select(
            *found, F.coalesce("matched.verdict", F.lit(verdict)).alias("verdict"),
            F.lit(None).cast("double").alias("score"),
        )
    # Both verdicts weigh alike, however many URLs the rules decide each way.
    weight = F.when(F.col("label") == 1.0, 0.5 / counts[1.0]).otherwise(0.5 / counts[0.0])
    sample = sample.withColumn("weight", weight * (counts[0.0] + counts[1.0]))
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(
        maxIter=params.trees, maxDepth=params.depth, seed=params.seed, labelCol="label",
        weightCol="weight", cacheNodeIds=False,
    )
    model = trees.fit(assemble.transform(sample).select("label", "weight", "features"))
    scored = model.transform(assemble.transform(rows))
    score = vector_to_array("probability").getItem(1)
    own = F.when(score >= params.threshold, "block").otherwise("allow")
    return scored.select(
        *found, F.coalesce("matched.verdict", own).alias("verdict"),
        F.when(F.col("matched").isNull(), score).alias("score"),
    )
