"""Small list files in the three formats, made from tables of fields."""

from __future__ import annotations

from pathlib import Path

NONE = "-0- "


def _csv(*fields: str) -> str:
    return ",".join(f if f.isdigit() else '"' + f.replace('"', '""') + '"' for f in fields)


def _party(number: str, name: str, kind: str, remarks: str, **more: str) -> str:
    fields = dict.fromkeys("program title call type tonnage gross flag owner".split(), NONE) | more
    return _csv(number, name, kind, *fields.values(), remarks)


#: Four parties out of order, one with two birth dates, one rejected row before the last.
PARTIES = [
    _party("88", "BRIGHT ANCHOR 7", "aircraft", NONE, flag="Sylvania", owner='The "Anchor" Club'),
    _party("12", "Tamsin Okonjo-Reyes", "Individual", "DOB 1949; alt. DOB circa 1950; nationality Sylvania"),
    _party("40", "Copper Lantern Bakery", NONE, NONE, program="X-9"),
    _csv("41", "only", "three"),
    _party("13", "Wendeline Ashgrove", "individual", "Nationality: Freedonia; POB Port Elm"),
]
ALIASES = [
    _csv("40", "9", "nka", "Tin Lantern Bakery", NONE),
    _csv("12", "1", "weak", "Tammy Reyes", NONE),
    _csv("40", "8", "fka", "Iron Lantern Bakery", NONE),
    _csv("99", "7", "aka", "Nobody's Alias", NONE),
]
ADDRESSES = [_csv("40", "1", "5 Mill Lane", "Port Elm", "Freedonia"), _csv("40", "2", "6 Mill Lane", "Port Elm", NONE)]
OVERFLOW = [_csv("13", "see file 3"), _csv("40", "older note"), _csv("40", "newer note; DOB 2001")]


def _tag(name: str, *inside: str) -> str:
    return f"<{name}>{''.join(inside)}</{name}>"


_BORN = "INDIVIDUAL_DATE_OF_BIRTH"
XML = '<?xml version="1.0" encoding="UTF-8"?>' + _tag(
    "CATALOGUE",
    _tag("SECTION", _tag(
        "ENTITY", _tag("DATAID", "3001"), _tag("FIRST_NAME", "Harbour Choir"),
        _tag("ENTITY_ALIAS", _tag("ALIAS_NAME", "Choir of the Harbour")),
        _tag("ENTITY_ALIAS", _tag("ALIAS_NAME", " ")),
    )),
    _tag("SECTION", _tag(
        "INDIVIDUAL", _tag("DATAID", "4004"), _tag("FIRST_NAME", "Odalys"), _tag("FOURTH_NAME", "Brandt"),
        _tag("REFERENCE_NUMBER", "P-4"), _tag("NATIONALITY", _tag("VALUE", "Freedonia")),
        _tag(_BORN, _tag("TYPE_OF_DATE", "EXACT"), _tag("DATE", "1987-11-30")),
        _tag(_BORN, _tag("TYPE_OF_DATE", "BETWEEN"), _tag("FROM_YEAR", "1985")),
    ), _tag(
        "INDIVIDUAL", _tag("DATAID", "4005"), _tag("FIRST_NAME", "Ulrika"), _tag("SECOND_NAME", "Vance"),
        _tag("THIRD_NAME", "Lindqvist"), _tag("REFERENCE_NUMBER", "P-5"),
        _tag("INDIVIDUAL_ALIAS", _tag("QUALITY", "Good"), _tag("ALIAS_NAME", "Ulla Lindqvist")),
    )),
)

_HEADER = "Name of Individual or Entity,Reference,Name Type,Type,Alias Strength,Control Date,Date of Birth,Citizenship"
SHEET = "\n".join([
    _HEADER,
    "Teal Compass,60,Primary Name,Vessel,,2019-06-07 00:00:00,,",
    "Ο Πλοηγός,61c,Original Script,Individual,,,,",
    "Pilot Nikos,61b,Alias,Individual,Weak,,,",
    "Nikos the Pilot,61a,Primary Name,Individual,,not known,about 1930,Sylvania",
    ",62,Primary Name,Entity,,,,",
    "Without Reference,,Primary Name,Entity,,,,",
]) + "\n"


def write_files(folder: Path) -> dict[str, str]:
    lines = {"parties": PARTIES, "aliases": ALIASES, "addresses": ADDRESSES, "overflow": OVERFLOW}
    files = {f"{name}.csv": "\n".join(rows) + "\n" for name, rows in lines.items()}
    files |= {"list.xml": XML, "sheet.csv": SHEET}
    for name, text in files.items():
        (folder / name).write_text(text, encoding="utf-8")
    return {name.split(".")[0]: str(folder / name) for name in files}
