"""Search tables kept from one opening to the next: a base, and segments of what changed since.

A refresh compares the lists with the rows it knows and writes one segment: the
added and changed rows, the ids that went, and, for the forms and token keys
those rows touch, their search rows as they are now. Only forms that no search
row has yet are given variants and phonetic codes. A reader takes of every form
the row of the last segment that touched it, so opening costs a scan of the base
and of the small segments. Every ``merge_every`` segments a new base is written.

A version is never changed, so a reader that names its version sees the same
lists after any later refresh.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.functions.text import sorted_tokens
from namesieve.operators.candidates import distinct_forms, first_rows, normalised_rows
from namesieve.operators.index import NameIndex, form_members
from namesieve.params import ScreeningParams
from namesieve.sources.segments import SegmentStore
from namesieve.workspace import work_folder, written

TABLES = {
    "names": ("name_id", "gone_names"),
    "rows": ("name_id", "gone_names"),
    "entities": ("entity_id", "gone_entities"),
    "forms": ("form", "touched_forms"),
    "form_rows": ("name_key", "touched_form_rows"),
    "keys": ("name_key", "touched_keys"),
}
MARK = "_mark"


@dataclass(frozen=True)
class Refresh:
    """What a refresh found: the version now current, name rows added (or changed) and gone,
    and forms that had to be coded."""

    version: int
    added: int
    gone: int
    coded: int


@dataclass(frozen=True)
class Snapshot:
    """The lists and search tables of one version."""

    version: int
    names: DataFrame
    entities: DataFrame
    index: NameIndex
    form_rows: DataFrame | None = None

    def with_vectors(self, vectors: DataFrame) -> Snapshot:
        """The same with a vector layer; ``vectors`` has (form, vector) with distinct forms."""
        if self.form_rows is None:
            raise ValueError("the store was made without a vector layer")
        keyed = vectors.select(F.col("form").alias("name_key"), "vector")
        found = self.form_rows.join(keyed, "name_key")
        return replace(self, index=replace(self.index, vectors=found))


def _mark(df: DataFrame) -> Column:
    """A digest of a row's columns, nulls told apart."""
    values = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    return F.unhex(F.sha2(values, 256))


@dataclass(frozen=True)
class IndexStore:
    """Search tables under ``root``; ``fuzzy`` and ``vectors`` name the layers they serve."""

    spark: SparkSession
    root: str
    params: ScreeningParams = ScreeningParams()
    fuzzy: bool = True
    vectors: bool = False
    merge_every: int = 8

    @property
    def segments(self) -> SegmentStore:
        return SegmentStore(self.spark, self.root, TABLES)

    def current(self) -> int | None:
        return self.segments.current()

    def _tables(self) -> list[str]:
        wanted = {"keys": self.fuzzy, "form_rows": self.vectors}
        return [name for name in TABLES if wanted.get(name, True)]

    def open(self, version: int | None = None) -> Snapshot:
        """The lists and search tables of a version, by default the current one."""
        log = self.segments.log()
        version = max(log, default=None) if version is None else version
        if version not in log:
            raise ValueError(f"there is no version {version} under {self.root}")
        read = {name: self.segments.read(name, version, log) for name in self._tables()}
        index = NameIndex(read["forms"], read.get("keys"), None, self.params)
        names, entities = read["names"].drop(MARK), read["entities"].drop(MARK)
        return Snapshot(version, names, entities, index, read.get("form_rows"))

    def _changes(self, table: str, new: DataFrame, version: int | None, folder: str):
        """(rows that are new or other than before, ids to replace)."""
        key, _ = TABLES[table]
        new = written(new.withColumn(MARK, _mark(new)), f"{folder}/new-{table}")
        if version is None:
            return new, new.select(key).limit(0)
        before = self.segments.read(table, version).select(key, F.col(MARK).alias("_before"))
        both = new.select(key, F.col(MARK).alias("_after")).join(before, key, "full_outer")
        other = both.filter("_before is null or _after is null or _before <> _after")
        other = written(other, f"{folder}/other-{table}")
        added = new.join(other.filter("_after is not null").select(key), key, "left_semi")
        return written(added, f"{folder}/added-{table}"), other.filter("_before is not null").select(key)

    def refresh(self, names: DataFrame, entities: DataFrame) -> Refresh:
        """Bring the search tables in step with the lists; nothing is written if they are.

        ``names``: (name_id, entity_id, name_original, ...) with distinct ids;
        ``entities``: (entity_id, entity_type, ...) likewise. Names of unknown
        entities are left out.
        """
        folder = work_folder(self.spark)
        store, params = self.segments, self.params
        log = store.log()
        old = max(log, default=None)
        typed = names.join(entities.select("entity_id", "entity_type"), "entity_id")
        added, gone = self._changes("names", typed, old, folder)
        new_entities, gone_entities = self._changes("entities", entities, old, folder)
        n_added, n_gone = added.count(), gone.count()
        if old is not None and not n_added and not n_gone and new_entities.isEmpty() and gone_entities.isEmpty():
            return Refresh(old, 0, 0, 0)

        fresh = normalised_rows(added, "name_original").select("name_id", "entity_id", "entity_type", "form")
        fresh = written(fresh.withColumn("name_key", sorted_tokens(F.col("form"))), f"{folder}/fresh")
        stay, touched = fresh, fresh.select("form", "name_key")
        if old is not None:
            before = store.read("rows", old, log)
            touched = touched.unionByName(before.join(gone, "name_id", "left_semi").select("form", "name_key"))
            stay = before.join(gone, "name_id", "left_anti").unionByName(fresh)
        touched = written(touched.distinct(), f"{folder}/touched")
        forms, keys = touched.select("form"), touched.select("name_key").distinct()
        of_forms = written(stay.join(forms, "form", "left_semi"), f"{folder}/rows-of-forms")
        members = written(form_members(of_forms, params.max_results_bound), f"{folder}/members")
        # Forms that had a search row keep its variants and codes.
        uncoded, known = members.select("form"), None
        if old is not None:
            known = store.read("forms", old, log).join(uncoded, "form", "left_semi")
            known = written(known.select("form", "variants", "codes"), f"{folder}/known")
            uncoded = uncoded.join(known, "form", "left_anti")
        coded = written(distinct_forms(uncoded, params), f"{folder}/coded")
        codes = coded if known is None else coded.unionByName(known)

        segment = {
            "names": added, "rows": fresh, "entities": new_entities, "forms": codes.join(members, "form"),
        }
        if self.vectors:
            segment["form_rows"] = first_rows(of_forms, F.col("form"), params.vector_limit)
        if self.fuzzy:
            of_keys = stay.join(keys, "name_key", "left_semi").drop("name_key")
            segment["keys"] = first_rows(of_keys, sorted_tokens(F.col("form")), params.fuzzy_limit)
        if old is not None:
            replaced = {
                "gone_names": gone, "gone_entities": gone_entities, "touched_forms": forms, "touched_keys": keys,
                "touched_form_rows": forms.select(F.col("form").alias("name_key")),
            }
            wanted = {TABLES[table][1] for table in self._tables()}
            segment |= {table: rows for table, rows in replaced.items() if table in wanted}
        version = 0 if old is None else old + 1
        base = version if old is None else log[old].base
        store.write(version, base, segment)
        if version - base >= self.merge_every:
            version = self.merge()
        return Refresh(version, n_added, n_gone, coded.count())

    def merge(self) -> int:
        """Write the current version as a new base; its number."""
        return self.segments.merge(self._tables())
