import pytest
from pyspark.sql import functions as F

from namesieve.functions.text import fold_text, name_variants, normalise_name, strip_honorifics
from namesieve.operators.normalising import unique_normalised

NAMES = {
    "MOHAMMED": "mohammed",
    "Müller": "muller",
    "François Café": "francois cafe",
    "O'Brien": "o brien",
    "Abd al-Rahman, Muhammad": "abd al rahman muhammad",
    "  Ali \t  Hassan \n": "ali hassan",
    "...---...": "",
    "": "",
    "ﬁnance": "finance",
    "Vessel 21": "vessel 21",
    "ПУТИН Владимир": "путин владимир",
    "Straße": "strasse",
    "under_score": "under score",
    "¼ Ｆｕｌｌ": "1 4 full",
}


def apply(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_normalise_name(spark):
    assert apply(spark, NAMES, normalise_name) == list(NAMES.values())


def test_arabic_variants_normalise_equal(spark):
    forms = apply(spark, ["أسامة بن لادن", "اسامة بن لادن", "مُحَمَّد", "محمد"], normalise_name)
    assert forms[0] == forms[1] and forms[2] == forms[3]


def test_fast_paths_equal_the_definition(spark):
    """Every character below U+3000, alone and between letters."""
    values = [f"a{chr(c)}b" for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    from namesieve.functions.text import folded

    got = {r.v: r.f for r in df.select("v", folded(F.col("v")).alias("f")).collect()}
    wrong = [v for v in values if got[v] != fold_text(v)]
    assert not wrong


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("haji abdul manan", "abdul manan"),
        ("mullah haji mohammed", "mohammed"),
        ("mullah haji", "haji"),
        ("haji", "haji"),
        ("al assad", "al assad"),
        ("al hajj mohammed omar", "mohammed omar"),
        ("mohammed haji omar", "mohammed haji omar"),
        ("mr " * 20_000 + "x", "x"),
    ],
)
def test_honorifics(spark, name, expected):
    assert apply(spark, [name], strip_honorifics) == [expected]


def test_variants(spark):
    got = apply(spark, ["ali hassan", "haji abdul manan", ""], lambda c: name_variants(c))
    assert got == [["ali hassan"], ["haji abdul manan", "abdul manan"], []]


def test_unique_normalised_keeps_first_order(spark):
    rows = spark.createDataFrame(
        [(3, "Hassan Ali"), (1, "Ali Hassan"), (2, "ALI  HASSAN"), (4, "")], "p int, n string"
    )
    out = unique_normalised(rows, "n", "p").collect()
    assert [(r.name_normalised, r.first_position) for r in out] == [
        ("ali hassan", 1),
        ("hassan ali", 3),
    ]
