"""Entries of XML lists whose splits tear entries, comments and sections of raw text."""

import random
import re

from namesieve.sources.list_xml import ENTITY_SCHEMA, merged, read_entities
from namesieve.sources.xml_entries import xml_entries
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SETTING = "spark.sql.files.maxPartitionBytes"


def listed(n: int) -> str:
    rng, parts = random.Random(7), ["<ENTITIES a='1'>\n"]
    for i in range(n):
        more = rng.choice(["", f"<ENTITY_ALIAS><ALIAS_NAME>b {i}</ALIAS_NAME></ENTITY_ALIAS>" * rng.randrange(4),
                           f"<NOTE lang='x'>n{i}</NOTE>", "<DEEP>\n <LOW>1</LOW> <LOW>2</LOW></DEEP>", "<BARE/>",
                           "<COMMENTS1>" + "long " * 300 + "</COMMENTS1>", "<!-- <ENTITY> </ENTITY> -->",
                           "<COMMENTS1><![CDATA[a </ENTITY> b]]></COMMENTS1>", "<LOOSE>w<LOW>3</LOW></LOOSE>"])
        parts.append(f"<ENTITY>\n <DATAID>{i:03}</DATAID> <FIRST_NAME> Ä {i} </FIRST_NAME>{more}</ENTITY>")
        parts.append(rng.choice(["", "\n", "<!-- <ENTITY><DATAID>none</DATAID></ENTITY> " + "x > " * 100 + "-->"]))
    return "".join(parts) + "<ENTITY_ALIAS>none</ENTITY_ALIAS></ENTITIES>"


def small_splits(spark, size: str):
    before = spark.conf.get(SETTING)
    spark.conf.set(SETTING, size)
    return before


def test_entries_of_torn_splits(spark, tmp_path):
    texts = {"a.xml": listed(40), "b c.xml": listed(90), "none.xml": "<E/>" + "<INDIVIDUAL></INDIVIDUAL>" * 200}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    raw = re.compile(r"<!--.*?-->|(<ENTITY>(?:<!--.*?-->|<!\[CDATA\[.*?\]\]>|.)*?</ENTITY>)", re.S)
    wanted = [e for name in sorted(texts) for e in raw.findall(texts[name]) if e]
    before = small_splits(spark, "700")
    try:
        found = xml_entries(spark, str(tmp_path), "ENTITY")
        assert found.select("position.block").distinct().count() > 20
        assert [r.entry for r in found.orderBy("position").collect()] == wanted
        whole = xml_entries(spark, str(tmp_path / "none.xml"), "INDIVIDUAL")
        assert whole.count() == 200
    finally:
        spark.conf.set(SETTING, before)


def test_large_list_is_read_by_many_tasks_as_spark_reads_it(spark, tmp_path):
    path = tmp_path / "list.xml"
    path.write_text(listed(120), encoding="utf-8")
    reader = spark.read.format("xml").options(rowTag="ENTITY", inferSchema=False)
    known = merged(StructType.fromDDL(ENTITY_SCHEMA), reader.load(str(path)).schema)
    wanted = reader.schema(known).load(str(path))
    before = small_splits(spark, "2000")
    try:
        rows = read_entities(spark, str(path)).orderBy("position").drop("position")
        assert rows.schema == wanted.schema
        record = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
        assert [r[0] for r in rows.select(record).collect()] == [r[0] for r in wanted.select(record).collect()]
        blocks = read_entities(spark, str(path)).select("position.block").distinct().count()
        assert blocks > 5
    finally:
        spark.conf.set(SETTING, before)
