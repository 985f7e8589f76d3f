"""Exact duplicates by a stateful stream over digests, with full bytes checked on hits.

Every row becomes (digest, id, locator); the locator says in which file, and at
which row of it, the text lies. A stream reads these rows and keeps one state
row per digest - the largest id, its locator, the number of rows - in a state
store on disk (RocksDB, checkpointed to the shared folder) that never expires.
More batches can be added to the same folder later, and the state goes on.
A digest held twice is a hit: the texts of its rows are read by their locators
and compared byte for byte with the kept text before a row counts as a copy.
Rows whose bytes differ in spite of an equal digest form groups of their own.

Only DataFrame and streaming operations run on the executors. Texts are
shuffled only for hits: the rows of a hit are picked by digest, and all copies
of one text meet the single kept row in a join of two written tables, which
Spark splits when one text is hot.

Nulls and odd rows: a null text equals the empty text. A null id ranks below
every other. Of rows equal in text and id, the one with the largest locator
stays, so exactly one row of a group is kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.llm.common import located, whole
from namesieve.workspace import work_folder, written

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Otherwise every partition's store reserves megabytes of disk before it holds a row.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


class DedupState:
    """Digests seen so far, in one shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def add(self, rows: DataFrame) -> None:
        """Append (digest, n_bytes, id, path, row) to the stream's input and let the state take it up."""
        rows.write.mode("append").parquet(f"{self.folder}/rows")
        seen = self.spark.readStream.schema(rows.schema).parquet(f"{self.folder}/rows")
        # The struct orders by id, then locator; a null id is below any other.
        best = F.max(F.struct("id", "path", "row")).alias("best")
        state = seen.groupBy("digest", "n_bytes").agg(best, F.count("*").alias("n"))

        def keep(changed: DataFrame, batch: int) -> None:
            out = f"{self.folder}/changes/batch={batch}"
            changed.write.mode("overwrite").parquet(out)

        with _settings(self.spark, STATE_SETTINGS):
            query = (
                state.writeStream.outputMode("update")
                .option("checkpointLocation", f"{self.folder}/state")
                .trigger(availableNow=True)
                .foreachBatch(keep)
                .start()
            )
        query.awaitTermination()

    def groups(self) -> DataFrame:
        """(digest, n_bytes, best, n): the latest state of every digest."""
        changes = self.spark.read.parquet(f"{self.folder}/changes")
        latest = F.max_by(F.struct("best", "n"), "n").alias("last")
        return changes.groupBy("digest", "n_bytes").agg(latest).select("digest", "n_bytes", "last.*")


def exact_groups(
    docs: DataFrame, text: str = "text", digest: Callable[[Column], Column] = sha256, in_files: bool = False
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, path, row), one row per row of ``docs``.

    ``in_files``: the table is a plain scan of different files, see ``located``.
    """
    folder = work_folder(docs.sparkSession)
    return _groups(located(docs, folder, in_files), folder, text, digest)


def _groups(
    rows: DataFrame, folder: str, text: str = "text", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """``exact_groups`` of rows that have their locator."""
    spark = rows.sparkSession
    placed = rows.select(
        F.col("caller.doc_id").alias("id"), whole(F.col(f"caller.`{text}`")).alias("body"), "path", "row"
    )
    named = placed.select(
        digest(F.col("body")).alias("digest"), F.octet_length("body").alias("n_bytes"),
        "id", "path", "row",
    )
    state = DedupState(spark, f"{folder}/stream")
    state.add(named)
    if state_is_empty(spark, f"{folder}/stream"):
        none = placed.limit(0)
        return none.select(
            F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"), digest(F.col("body")).alias("digest"), "path", "row",
        )
    groups = written(state.groups(), f"{folder}/groups")
    rows = spark.read.parquet(f"{folder}/stream/rows")

    # Hits: bytes of every row of a digest held more than once.
    hits = groups.filter("n > 1").select("digest", "n_bytes", "best")
    bodies = placed.withColumn("digest", digest(F.col("body"))).withColumn(
        "n_bytes", F.octet_length("body")
    )
    held = bodies.join(hits, ["digest", "n_bytes"])
    first = (F.col("path") == F.col("best.path")) & (F.col("row") == F.col("best.row"))
    held = written(held.withColumn("first", first), f"{folder}/hits")
    keepers = held.filter("first").select("digest", "n_bytes", F.col("body").alias("kept_body"))
    compared = held.filter("not first").join(keepers, ["digest", "n_bytes"])
    compared = compared.select(
        "digest", "n_bytes", "id", "path", "row", (F.col("body") == F.col("kept_body")).alias("same"),
        F.when(F.col("body") != F.col("kept_body"), F.col("body")).alias("other_body"),
    )
    compared = written(compared, f"{folder}/compared")
    # Equal digest, other bytes: grouped by the text itself.
    apart = compared.filter("not same")
    own = apart.groupBy("other_body").agg(
        F.max(F.struct("id", "path", "row")).alias("best"), F.count("*").alias("n")
    )
    own = written(own, f"{folder}/apart")
    moved = apart.join(own, "other_body").select("digest", "id", "path", "row", "best", "n")
    fewer = apart.groupBy("digest", "n_bytes").agg(F.count("*").alias("apart"))
    sized = groups.join(fewer, ["digest", "n_bytes"], "left").select(
        "digest", "n_bytes", "best", (F.col("n") - F.coalesce("apart", F.lit(0))).alias("n")
    )
    sized = written(sized, f"{folder}/sized")
    stayed = rows.join(apart.select("path", "row"), ["path", "row"], "left_anti")
    placed_rows = stayed.join(sized, ["digest", "n_bytes"]).select(
        "digest", "id", "path", "row", "best", "n"
    )
    everything = placed_rows.unionByName(moved)
    return everything.select(
        F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("path") == F.col("best.path")) & (F.col("row") == F.col("best.row"))).alias("kept"),
        "digest", "path", "row",
    )


def state_is_empty(spark: SparkSession, folder: str) -> bool:
    """True if no batch ever changed the state, as over an empty table."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/changes")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return not files.exists(root)


def without_copies(docs: DataFrame, in_files: bool = False) -> DataFrame:
    """The kept rows, with the columns of ``docs``: one row of each text, also where ids repeat.

    ``in_files``: the table is a plain scan of different files, see ``located``.
    """
    folder = work_folder(docs.sparkSession)
    placed = located(docs, folder, in_files)
    kept = _groups(placed, folder).filter("kept").select("path", "row")
    return placed.join(kept, ["path", "row"], "left_semi").select("caller.*")
