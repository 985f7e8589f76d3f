"""What several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.workspace import written

#: White space and words, as all word-based operators here understand them.
BLANKS = " \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: ``bytes.split()`` without an argument splits on exactly the bytes of BLANK.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bounds of a batch of rows on its way to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to BATCH_ROWS and BATCH_BYTES.

    Rows of whole texts queue in the JVM and in Python; the session's usual
    10,000 rows of them are more than a worker should hold.
    """
    rows, size = (f"spark.sql.execution.arrow.{name}" for name in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set(size, str(BATCH_BYTES))


def whole(text: str | Column = "text") -> Column:
    """A text with null as the empty text."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("string"), F.lit(""))


def located(docs: DataFrame, folder: str, in_files: bool = False) -> DataFrame:
    """(caller, path, row): every row in a struct, with the file and the place in it where it lies.

    The rows are written first, so that places are unique whatever the plan of
    ``docs`` does with its files. A caller whose table is a plain scan of
    different files states that with ``in_files``, which saves the copy.
    """
    if not in_files:
        docs = written(docs, f"{folder}/rows")
    columns = [F.col(f"`{name}`") for name in docs.columns]
    place = docs.metadataColumn("_metadata")
    return docs.select(
        F.struct(*columns).alias("caller"), place["file_path"].alias("path"), place["row_index"].alias("row")
    )


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows no label may be learnt from. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def first_by_hash(df: DataFrame, key: list[str], n: int, total: int, seed: int) -> DataFrame:
    """At most ``n`` of about ``total`` rows, in the order of a seeded hash of ``key``.

    Rows far down that order are filtered out first, so that no more than about
    ``2 * n`` reach the task that sorts them, however many tasks read the table.
    """
    draw = F.xxhash64(*key, F.lit(seed))
    if total > 4 * n:
        unit = F.shiftrightunsigned(draw, 33) / float(1 << 31)
        df = df.filter(unit < 2.0 * n / total)
    return df.orderBy(draw, *key).limit(n)


def labelled_sample(labels: DataFrame, label: str, per_class: dict[int, int], seed: int) -> DataFrame:
    """(doc_id, label): at most ``per_class`` rows of each class that may be learnt from.

    The bound is a parameter of the models that use it, so the sample may be
    broadcast. Ids that carry both labels are left out, repeated rows count once.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & ~held_out())
    one = usable.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other"))
    one = one.filter("label = other").select("doc_id", "label")
    totals = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    sample = None
    for value, bound in per_class.items():
        of_class = one.filter(F.col("label") == value)
        part = first_by_hash(of_class, ["doc_id"], bound, totals.get(value, 0), seed)
        sample = part if sample is None else sample.unionByName(part)
    return sample
