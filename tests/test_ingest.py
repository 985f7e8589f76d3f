import pytest
from pyspark.sql import functions as F

from listfiles import write_files
from namesieve.operators.shaping import ParsedList, domain_violations
from namesieve.operators.reports import list_summary
from namesieve.operators.sync import colliding_ids
from namesieve.plans.ingest import ingest, party_list, sheet_list, xml_list
from namesieve.sources.party_csv import read_lines, scan_aliases, scan_parties
from namesieve.sources.store import ListStore, file_fingerprints, read_cases
from namesieve.workspace import create_file


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    return write_files(tmp_path_factory.mktemp("lists"))


@pytest.fixture(scope="module")
def parsers(spark, files):
    return {
        "OFAC": lambda: party_list(
            spark, files["parties"], files["aliases"], files["addresses"], files["overflow"]
        ),
        "UN": lambda: xml_list(spark, files["list"]),
        "DFAT": lambda: sheet_list(spark, files["sheet"]),
    }


def by_reference(parsed: ParsedList):
    return {r.reference_number: r for r in parsed.entities.collect()}


def names_of(parsed: ParsedList, reference):
    rows = parsed.names.filter(F.col("reference_number") == reference).collect()
    return {(r.name_type, r.name_original, r.alias_quality) for r in rows}


def test_party_files(parsers):
    parsed = parsers["OFAC"]()
    found = by_reference(parsed)
    assert {k: r.entity_type for k, r in found.items()} == {
        "88": "aircraft", "12": "individual", "40": "entity", "13": "individual",
    }
    assert found["12"].date_of_birth == "1949; circa 1950"
    assert [found[k].nationality for k in ("12", "13", "88")] == ["Sylvania", "Freedonia", None]
    assert found["40"].date_of_birth == "2001"
    assert "newer note" in found["40"].raw_record and "older note" not in found["40"].raw_record
    assert '"addresses_count":2' in found["40"].raw_record
    raw = {(r.reference_number, r.kind, r.record) for r in parsed.raw_rows.collect()}
    assert ("12", "aliases", '{"alt_name":"Tammy Reyes","alt_type":"weak"}') in raw
    assert sorted(k for k, kind, _ in raw if kind == "addresses") == ["40", "40"]
    assert len(raw) == 5
    assert names_of(parsed, "40") == {
        ("primary", "Copper Lantern Bakery", None),
        ("nka", "Tin Lantern Bakery", None), ("fka", "Iron Lantern Bakery", None),
    }
    assert ("aka", "Tammy Reyes", None) in names_of(parsed, "12")
    assert not names_of(parsed, "99")


def test_rejected_rows_are_kept_aside(spark, files):
    scan = scan_parties(read_lines(spark, files["parties"]))
    assert [r.reason for r in scan.rejected.collect()] == ["short_row"]


def test_missing_optional_files(spark, files):
    parsed = party_list(spark, files["parties"], None, files["parties"] + ".none")
    assert parsed.names.count() == 4 and parsed.raw_rows.count() == 0


def test_latin1_file(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes('1,2,"aka","José Muñoz","-0- "\n'.encode("latin-1"))
    other = tmp_path / "utf8.csv"
    other.write_bytes('2,3,"aka","José Muñoz","-0- "\n'.encode())
    rows = scan_aliases(read_lines(spark, [str(path), str(other)])).rows.collect()
    assert {r.alt_name for r in rows} == {"José Muñoz"}


def test_xml_list(parsers):
    parsed = parsers["UN"]()
    found = by_reference(parsed)
    assert {k: r.primary_name for k, r in found.items()} == {
        "DATAID-3001": "Harbour Choir", "P-4": "Odalys Brandt", "P-5": "Ulrika Vance Lindqvist",
    }
    assert found["P-4"].date_of_birth == "1987-11-30; between 1985 and ?"
    assert found["P-4"].nationality == "Freedonia" and found["P-5"].nationality is None
    assert found["DATAID-3001"].entity_type == "entity"
    assert ("alias", "Ulla Lindqvist", "Good") in names_of(parsed, "P-5")
    assert len(names_of(parsed, "DATAID-3001")) == 2


def test_sheet(parsers):
    parsed = parsers["DFAT"]()
    found = by_reference(parsed)
    assert {k: r.primary_name for k, r in found.items()} == {"60": "Teal Compass", "61": "Nikos the Pilot"}
    assert found["60"].listed_date == "2019-06-07" and found["60"].entity_type == "vessel"
    assert found["61"].listed_date == "not known" and found["61"].date_of_birth == "about 1930"
    assert names_of(parsed, "61") == {
        ("primary", "Nikos the Pilot", None), ("alias", "Pilot Nikos", "Weak"),
        ("original_script", "Ο Πλοηγός", None),
    }


def test_ingest_is_idempotent(spark, parsers, files, tmp_path):
    store = ListStore(spark, str(tmp_path / "store"))
    paths = {"OFAC": files["parties"]}
    assert ingest(store, parsers, paths)
    ids = {r.name_id for r in store.read("names").collect()}
    assert store.read("entities").count() == 9 and store.read("raw_rows").count() == 9
    assert ingest(store, parsers, paths, frozenset({"UN"}))
    assert {r.name_id for r in store.read("names").collect()} == ids
    log = store.read_log().collect()
    first = [r for r in log if r.entities_inserted]
    second = [r for r in log if not r.entities_inserted]
    assert sorted(r.entities_inserted for r in first) == [2, 3, 4]
    assert store.read("raw_rows").count() == 9
    assert [(r.entities_inserted, r.entities_updated) for r in second] == [(0, 0)] * 3
    assert {r.status for r in second} == {"success", "fallback_cache"}
    digest = file_fingerprints(spark, files["parties"]).first().file_sha256
    assert {r.file_sha256 for r in log if r.source_list == "OFAC"} == {digest}
    keys = {r.metaphone_key for r in store.read("names").collect()}
    assert None not in keys and "" not in keys


def test_changed_entity_keeps_first_seen(spark, parsers, files, tmp_path):
    store = ListStore(spark, str(tmp_path / "store"))
    ingest(store, {"OFAC": parsers["OFAC"]})
    before = {r.reference_number: r for r in store.read("entities").collect()}
    changed = tmp_path / "parties.csv"
    with open(files["parties"], encoding="utf-8") as source:
        lines = [x.replace("Port Elm", "Port Ash") for x in source if "BRIGHT ANCHOR" not in x]
    changed.write_text("".join(lines))
    more = tmp_path / "addresses.csv"
    more.write_text('12,3,"1 Hill","Port Elm","Sylvania"\n')  # 40 loses both of its addresses
    ingest(store, {"OFAC": lambda: party_list(spark, str(changed), files["aliases"],
                                              str(more), files["overflow"])})
    after = {r.reference_number: r for r in store.read("entities").collect()}
    assert set(after) == set(before)  # 88 vanished from the file but stays listed
    moved = {k for k in after if after[k].last_updated_at > before[k].last_updated_at}
    assert moved == {"12", "13", "40"}
    assert all(after[k].first_seen_at == before[k].first_seen_at for k in after)
    kinds = [(r.reference_number, r.kind) for r in store.read("raw_rows").collect()]
    assert kinds.count(("12", "addresses")) == 1 and ("40", "addresses") not in kinds


def test_failed_list_is_logged_and_others_go_on(spark, parsers, tmp_path):
    store = ListStore(spark, str(tmp_path / "store"))
    bad = {"OFAC": lambda: party_list(spark, str(tmp_path / "absent.csv"))}
    assert ingest(store, bad | {"UN": parsers["UN"]})
    log = {r.source_list: r for r in store.read_log().collect()}
    assert log["OFAC"].status == "failed" and log["OFAC"].message
    assert log["UN"].status == "success"
    assert not ingest(ListStore(spark, str(tmp_path / "other")), bad)


def test_domain_violations(spark, parsers):
    parsed = parsers["UN"]()
    wrong = ParsedList(parsed.entities.withColumn("entity_type", F.lit("ship")), parsed.names)
    assert domain_violations(parsed).count() == 0
    assert domain_violations(wrong).count() == 3


def test_cases_in_one_document(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(
        '{"seed": 1, "cases": [\n {"case_id": "P001", "query": "a b", "perturbation": "typo",'
        ' "original_name": "ab", "truth": {"source_list": "UN", "reference_number": "9"}},\n'
        ' {"case_id": "N001", "query": "c", "perturbation": "negative", "original_name": null,'
        ' "truth": null}]}'
    )
    rows = read_cases(spark, str(path), single_document=True).orderBy("case_id").collect()
    assert [r.case_id for r in rows] == ["N001", "P001"]
    assert rows[0].truth is None and rows[1].truth.reference_number == "9"


def xml_of(path, *entries):
    path.write_text("<ALL>" + "".join(f"<ENTITY>{e}</ENTITY>" for e in entries) + "</ALL>")
    return str(path)


def test_undeclared_tags_are_part_of_the_record(spark, tmp_path):
    store = ListStore(spark, str(tmp_path / "store"))
    plain = "<FIRST_NAME>Reed Guild</FIRST_NAME><REFERENCE_NUMBER>7</REFERENCE_NUMBER>"
    other = "<FIRST_NAME>Moss Guild</FIRST_NAME><REFERENCE_NUMBER>8</REFERENCE_NUMBER>"
    more = "<SEAT><TOWN>Elmport</TOWN><TOWN>Ashport</TOWN></SEAT>"
    for number, seat in enumerate(("", more, more.replace("Ash", "Oak")), 1):
        # Entry 8 stays the same, whatever tags entry 7 gains.
        path = xml_of(tmp_path / f"{number}.xml", plain + seat, other)
        assert ingest(store, {"UN": lambda: xml_list(spark, path)})
    log = store.read_log().orderBy("log_id").collect()
    assert [(r.entities_inserted, r.entities_updated) for r in log] == [(2, 0), (0, 1), (0, 1)]
    record = {r.reference_number: r.raw_record for r in store.read("entities").collect()}["7"]
    assert '"SEAT":[{"TOWN":["Elmport","Oakport"]}]' in record


def test_last_of_a_repeated_reference_brings_its_names(spark, tmp_path):
    store = ListStore(spark, str(tmp_path / "store"))
    one, two = (
        f"<FIRST_NAME>{n}</FIRST_NAME><REFERENCE_NUMBER>5</REFERENCE_NUMBER>"
        f"<ENTITY_ALIAS><ALIAS_NAME>{a}</ALIAS_NAME></ENTITY_ALIAS>"
        for n, a in (("Early Bell", "Bell One"), ("Late Bell", "Bell Two"))
    )
    path = xml_of(tmp_path / "list.xml", one, two)
    assert ingest(store, {"UN": lambda: xml_list(spark, path)})
    assert {r.name_original for r in store.read("names").collect()} == {"Late Bell", "Bell Two"}


def test_sheet_cells_with_line_breaks(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text('Reference,Name,Address,Control Date\n70a,Low Gate,"1 Quay\n77,fake",2020-02-03\n')
    parsed = sheet_list(spark, str(path))
    (row,) = parsed.entities.collect()
    assert (row.reference_number, row.primary_name, row.listed_date) == ("70", "Low Gate", "2020-02-03")
    spark.read.options(header=True, multiLine=True).csv(str(path)).write.parquet(str(tmp_path / "sheet.parquet"))
    (same,) = sheet_list(spark, str(tmp_path / "sheet.parquet")).entities.collect()
    assert same.raw_record == row.raw_record


def test_a_list_is_stored_by_itself(spark, parsers, tmp_path):
    store = ListStore(spark, str(tmp_path / "store"))
    ingest(store, {"UN": parsers["UN"], "DFAT": parsers["DFAT"]})
    before = store.versions()
    ingest(store, {"UN": parsers["UN"]})
    assert store.versions() == {"DFAT": before["DFAT"], "UN": max(before.values()) + 1}
    plan = store.read("entities", ["UN"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(source_list" in plan
    summary = list_summary(store.read("entities"), store.read("names"), store.read_log()).collect()
    assert [(r.source_list, r.entity_count, r.last_status) for r in summary] == [
        ("DFAT", 2, "success"), ("UN", 3, "success"),
    ]


def test_colliding_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c")], "id long, key string")
    assert [r.id for r in colliding_ids(rows, "id", ["key"]).collect()] == [2]


def test_value_moved_to_a_null_column_is_an_update(spark, tmp_path):
    store = ListStore(spark, str(tmp_path / "store"))
    head = "Name,Reference,Name Type,Address,Citizenship,Date of Birth\n"
    party = '9,"Dana Birch","individual",' + ",".join(['"-0- "'] * 9) + "\n"
    runs = [
        ("Dana Birch,60,Primary Name,Tehran,,\n", '9,1,"-0- ","Tehran","-0- "\n'),
        ("Dana Birch,60,Primary Name,,Tehran,\n", '9,1,"-0- ","-0- ","Tehran"\n'),
    ]
    for number, (row, address) in enumerate(runs):
        files = {"sheet": head + row, "party": party, "address": address}
        paths = {name: tmp_path / f"{name}-{number}.csv" for name in files}
        for name, text in files.items():
            paths[name].write_text(text)
        party_paths = str(paths["party"]), None, str(paths["address"])
        assert ingest(store, {"OFAC": lambda: party_list(spark, *party_paths),
                              "DFAT": lambda: sheet_list(spark, str(paths["sheet"]))})
    entities = {r.source_list: r for r in store.read("entities").collect()}
    assert entities["DFAT"].nationality == "Tehran"
    assert all(r.last_updated_at > r.first_seen_at for r in entities.values())
    log = sorted((r.log_id, r.entities_inserted, r.entities_updated) for r in store.read_log().collect())
    assert [x[1:] for x in log] == [(1, 0), (1, 0), (0, 1), (0, 1)]


def test_swapped_sheet_rows_are_an_update(spark, tmp_path):
    """Without a primary name the first row of a group gives the entity its fields."""
    store = ListStore(spark, str(tmp_path / "store"))
    head = "Name,Reference,Name Type,Citizenship\n"
    rows = ["Rosa Quist,70,aka,Freedonia\n", "Rosalind Quist,70,aka,Sylvania\n"]
    for number, order in enumerate((rows, rows[::-1], rows[::-1])):
        path = tmp_path / f"sheet-{number}.csv"
        path.write_text(head + "".join(order))
        assert ingest(store, {"DFAT": lambda: sheet_list(spark, str(path))})
    (entity,) = store.read("entities").collect()
    assert (entity.primary_name, entity.nationality) == ("Rosalind Quist", "Sylvania")
    log = sorted((r.log_id, r.entities_inserted, r.entities_updated) for r in store.read_log().collect())
    assert [x[1:] for x in log] == [(1, 0), (0, 1), (0, 0)]


def test_a_claimed_run_number_is_not_taken_again(spark, tmp_path):
    store = ListStore(spark, str(tmp_path / "store"))
    row = spark.createDataFrame([("UN", "failed")], "source_list string, status string")
    assert create_file(spark, f"{store.root}/run_numbers/1")  # by a run that has not logged its rows yet
    assert store.append_run(row) == 2 and store.append_run(row) == 3
    assert sorted(r.log_id for r in store.read_log().collect()) == [2, 3]
