"""Drop lines that other documents hold too.

Lines are exploded with their position, normalised to a key, and hashed. A key
held by at least ``threshold`` documents loses its lines everywhere but in the
document with the smallest id; documents are then reassembled from the
positions that stay.

Data flow: only 16-byte digests, ids and positions are shuffled, never lines.
Documents per key are counted with partial aggregates (for a threshold of two,
a key is shared when its smallest and largest id differ), so a line of every
document costs one row per task. Digests meet the shared keys in a join whose
both sides are written tables, which Spark splits when one key is hot. Texts
are joined once with the positions they lose.

Nulls and odd rows: a null or empty text is one empty line. Ids are integers; a
null id ranks after every other. Rows with the same id are one document for counting; rows
equal in id and text are reassembled alike. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.llm.common import BLANKS, whole
from namesieve.workspace import work_folder, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = (1 << 63) - 1


@dataclass(frozen=True)
class LineParams:
    min_chars: int = 10
    threshold: int = 2


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def shared_keys(lines: DataFrame, params: LineParams) -> DataFrame:
    """(key, keeper): keys of at least ``threshold`` documents, and the smallest id."""
    if params.threshold == 2:
        ids = lines.groupBy("key").agg(F.min("id").alias("keeper"), F.max("id").alias("last"))
        return ids.filter("keeper < last").select("key", "keeper")
    once = lines.select("key", "id").distinct()
    ids = once.groupBy("key").agg(F.min("id").alias("keeper"), F.count("*").alias("n"))
    return ids.filter(F.col("n") >= params.threshold).select("key", "keeper")


def dedup_lines(docs: DataFrame, params: LineParams | None = None, text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): ``kept`` is the text of the lines that stay."""
    params = params or LineParams()
    folder = work_folder(docs.sparkSession)
    rows = docs.select("doc_id", whole(text).alias("body"))
    keyed = rows.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"),
        F.unhex(F.md5(F.col("body"))).alias("body_key"),
        F.posexplode(_lines(F.col("body"))).alias("position", "line"),
    )
    keyed = keyed.withColumn("line", line_key(F.col("line"))).filter(
        F.char_length("line") >= params.min_chars
    )
    digests = keyed.select("id", "body_key", "position", F.unhex(F.md5("line")).alias("key"))
    digests = written(digests, f"{folder}/digests")
    shared = written(shared_keys(digests, params), f"{folder}/shared")
    lost = digests.join(shared, "key").filter("id <> keeper").select("id", "body_key", "position")
    lost = written(lost, f"{folder}/lost")
    per_text = lost.groupBy("id", "body_key").agg(F.collect_set("position").alias("dropped"))

    texts = rows.select(
        "doc_id", "body",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"),
        F.unhex(F.md5(F.col("body"))).alias("body_key"),
    )
    joined = texts.join(per_text, ["id", "body_key"], "left")
    split = joined.select("doc_id", "body", "dropped", _lines(F.col("body")).alias("lines"))
    n_lines = F.size("lines")
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("dropped"))
    rebuilt = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    untouched = F.col("dropped").isNull()
    return split.select(
        "doc_id",
        n_lines.cast("long").alias("n_lines"),
        F.when(untouched, 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
        F.when(untouched, F.col("body")).otherwise(rebuilt).alias("kept"),
    )
