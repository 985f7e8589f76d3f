"""Working tables: what a write leaves on disk, and search tables cut to what is asked."""

import time

import pytest
from pyspark.sql import functions as F

from namesieve.operators.candidates import exact_pairs
from namesieve.workspace import CLEANUP, written


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in names if name.startswith("shuffle_")}


def test_a_write_leaves_no_shuffle_files(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 50).alias("k")).agg(F.count("*").alias("n"))
    before, kept = shuffle_files(spark), spark.conf.get(CLEANUP, "false")
    table = written(rows, str(tmp_path / "rows"))
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(CLEANUP, "false") == kept
    assert sorted(map(tuple, table.collect())) == [(k, 20) for k in range(50)]
    assert any(f.name.endswith(".zstd.parquet") for f in (tmp_path / "rows").iterdir())
    with pytest.raises(Exception):
        written(rows, str(tmp_path / "rows"))
    assert spark.conf.get(CLEANUP, "false") == kept


def test_few_queries_cut_the_listed_forms_before_their_shuffle(spark, tmp_path):
    forms = spark.range(200).select(F.concat(F.lit("name "), F.col("id")).alias("form"))
    listed = written(forms.withColumn("variants", F.array("form")), str(tmp_path / "listed"))
    asked = written(listed.filter("form in ('name 7', 'name 9')"), str(tmp_path / "asked"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        pairs = exact_pairs(asked, listed)
        assert "LeftSemi, BuildRight" in pairs._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, pairs.collect())) == [("name 7", "name 7"), ("name 9", "name 9")]
    finally:
        spark.conf.set(threshold, before)
