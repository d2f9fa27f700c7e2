"""Tables that change as one: immutable files in buckets, marks of deleted rows, and snapshots that name both.

A change writes new files only. Rows lie in folders by a hash of their bucket columns, so a change of some keys reads the
buckets that these hash to and no others. What a change deletes or replaces is marked by position (file and row number) in
a small table of its own. A snapshot is one file that names, for each table, the folders and the marks that make it up;
it is written last, under the next number, and only if no other writer has taken that number. So all tables change at
once or not at all, a change that is killed leaves files that no snapshot names, and a reader keeps to the
snapshot it opened, whatever is written meanwhile. ``vacuum`` deletes what no recent snapshot names.
"""

from __future__ import annotations

import copy
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimweave.operators.store import latest

from . import files

_POSITION = ("part", "bucket", "file", "row")
_MARKS = "part string, bucket int, file string, row long"


class Conflict(Exception):
    """The tables changed after the change began; it may be made again on the new snapshot."""


@dataclass(frozen=True)
class Table:
    """A table's key, and the columns of it that rows are bucketed by. Rows with a null in the key equal no others."""

    keys: tuple[str, ...]
    bucket_by: tuple[str, ...]


@dataclass(frozen=True)
class VersionedTables:
    spark: SparkSession
    folder: str
    tables: dict[str, Table]
    #: Buckets of a new table. One that is written anew as a whole gets one for every ``bucket_rows`` rows, if that is more.
    buckets: int = 8
    bucket_rows: int = 1_000_000
    #: Folders of a table beyond which a commit writes it anew.
    most_parts: int = 32

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in files.names(self.spark, f"{self.folder}/_snapshots") if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> dict:
        """A snapshot's contents, the latest by default; an empty one, number 0, where there is none."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "tables": {}}
        return json.loads(files.read_text(self.spark, self._manifest(version)))

    def read(self, name: str, snapshot: dict | None = None) -> DataFrame | None:
        """A table's rows by a snapshot, the latest by default; None if it was never written."""
        state = (snapshot or self.snapshot())["tables"].get(name)
        return None if state is None else self._live(name, state).select(StructType.fromJson(state["schema"]).names)

    def begin(self) -> Change:
        return Change(self, copy.deepcopy(self.snapshot()))

    def compact(self, *names: str) -> int:
        """Writes tables anew, as one folder each without marks."""
        change = self.begin()
        for name in names or list(change.state["tables"]):
            change.compact(name)
        return change.commit()

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the last ``keep`` snapshots, and the files that these don't name. Not beside a change that is under way."""
        versions = self.versions()
        kept = [self.snapshot(v) for v in versions[-keep:]]
        for v in versions[:-keep]:
            files.delete(self.spark, self._manifest(v))
        for name in self.tables:
            states = [s["tables"][name] for s in kept if name in s["tables"]]
            for kind, folder, prefix in (("parts", f"{self.folder}/{name}", "_part="), ("marks", f"{self.folder}/_marks/{name}", "")):
                named = {prefix + p["path"] for s in states for p in s[kind]}
                for found in set(files.names(self.spark, folder)) - named:
                    files.delete(self.spark, f"{folder}/{found}")

    def _manifest(self, version: int) -> str:
        return f"{self.folder}/_snapshots/{version:012d}.json"

    def _bucket(self, name: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in self.tables[name].bucket_by)), F.lit(buckets)).cast("int")

    def _live(self, name: str, state: dict, buckets: list[int] | None = None) -> DataFrame:
        """Rows that aren't marked, with their positions."""
        schema = StructType.fromJson(state["schema"]).add("_part", "string").add("_bucket", "integer")
        parts = [p["path"] for p in state["parts"] if buckets is None or set(p["buckets"]) & set(buckets)]
        if not parts:
            return self.spark.createDataFrame([], schema).selectExpr("*", "_part AS part", "_bucket AS bucket", "'' AS file", "0L AS row")
        at = f"{self.folder}/{name}"
        rows = self.spark.read.schema(schema).option("basePath", at).parquet(*(f"{at}/_part={p}" for p in parts))
        if buckets is not None:
            rows = rows.where(F.col("_bucket").isin(buckets))
        placed = rows.select("*", F.col("_part").alias("part"), F.col("_bucket").alias("bucket"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        if state["marks"]:
            placed = placed.join(self.spark.read.schema(_MARKS).parquet(*(f"{self.folder}/_marks/{name}/{m['path']}" for m in state["marks"])), list(_POSITION), "left_anti")
        return placed


@dataclass
class Change:
    """Changes of several tables, each on top of those before it, that ``commit`` makes visible at once."""

    store: VersionedTables
    state: dict
    _based_on: int = field(init=False)

    def __post_init__(self) -> None:
        self._based_on = self.state["version"]

    def read(self, name: str) -> DataFrame | None:
        return self.store.read(name, self.state)

    def matching(self, name: str, rows: DataFrame) -> DataFrame | None:
        """The table's rows with the keys of others, read from the buckets these fall in; None if it was never written."""
        if (state := self.state["tables"].get(name)) is None:
            return None
        keys = list(self.store.tables[name].keys)
        near = self.store._live(name, state, self._buckets_of(name, rows)).select(StructType.fromJson(state["schema"]).names)
        return near.join(rows.select(*keys).distinct(), keys, "left_semi")

    def replace(self, name: str, rows: DataFrame) -> None:
        """The table is these rows and no others."""
        self._add(name, rows, fresh=True)

    def compact(self, name: str) -> None:
        """The table's rows in one folder, without marks, in as many buckets as they fill."""
        state = self.state["tables"][name]
        live = sum(p["rows"] for p in state["parts"]) - sum(m["rows"] for m in state["marks"])
        self._add(name, self.read(name), fresh=True, buckets=max(self.store.buckets, -(-live // self.store.bucket_rows)))

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows whose keys the table is known not to hold."""
        self._add(name, rows)

    def upsert(self, name: str, rows: DataFrame, order: list[str] | None = None) -> None:
        """Rows take the place of those with their keys. By an order, the last of all rows of a key stays, stored ones
        included; without one, rows win over stored ones, and one of those that share a key is taken."""
        keys = list(self.store.tables[name].keys)
        before = self.state["tables"].get(name)
        if before is None:
            self._add(name, latest(rows, keys, order) if order else rows.dropDuplicates(keys))
            return
        if order:
            rows = latest(self.matching(name, rows).unionByName(rows, allowMissingColumns=True), keys, order)
        else:
            rows = rows.dropDuplicates(keys)
        part = self._write(name, rows)
        if part is None:
            return
        new = self.store._live(name, {"schema": rows.schema.jsonValue(), "parts": [part], "marks": []})
        self._mark(name, self.store._live(name, before, part["buckets"]).join(new.select(*keys), keys, "left_semi"))
        self._record(name, part, rows.schema)

    def delete(self, name: str, gone: DataFrame, on: list[str] | None = None) -> None:
        """Rows whose columns ``on``, the key by default, are among those of ``gone``."""
        on = on or list(self.store.tables[name].keys)
        if (state := self.state["tables"].get(name)) is None:
            return
        ids = gone.select(*on).distinct()
        touched = self._buckets_of(name, ids) if set(self.store.tables[name].bucket_by) <= set(on) else None
        self._mark(name, self.store._live(name, state, touched).join(ids, on, "left_semi"))

    def commit(self) -> int:
        """Makes the change visible; refused if another was since it began."""
        for name, state in list(self.state["tables"].items()):
            if len(state["parts"]) > self.store.most_parts or sum(m["rows"] for m in state["marks"]) > 0.5 * sum(p["rows"] for p in state["parts"]) > 0:
                self.compact(name)
        self.state["version"] = self._based_on + 1
        try:
            files.write_new(self.store.spark, self.store._manifest(self.state["version"]), json.dumps(self.state))
        except files.Exists as e:
            raise Conflict(f"{self.store.folder} is at version {max(self.store.versions())}, the change began at {self._based_on}") from e
        return self.state["version"]

    def _buckets(self, name: str) -> int:
        return self.state["tables"].get(name, {}).get("buckets", self.store.buckets)

    def _buckets_of(self, name: str, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.store._bucket(name, self._buckets(name))).distinct().collect()]  # as many numbers as there are buckets, at most

    def _write(self, name: str, rows: DataFrame, buckets: int | None = None) -> dict | None:
        path, at, seen = uuid.uuid4().hex, f"{self.store.folder}/{name}", Observation()
        placed = rows.withColumn("_bucket", self.store._bucket(name, buckets or self._buckets(name))).hint("rebalance", "_bucket")
        placed.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy("_bucket").parquet(f"{at}/_part={path}")
        if not seen.get["n"]:
            return None
        held = sorted(int(n.split("=")[1]) for n in files.names(self.store.spark, f"{at}/_part={path}") if n.startswith("_bucket="))
        return {"path": path, "buckets": held, "rows": seen.get["n"]}

    def _record(self, name: str, part: dict | None, schema: StructType, fresh: bool = False, buckets: int | None = None) -> None:
        state = self.state["tables"].get(name)
        if state is None or fresh:
            self.state["tables"][name] = {"schema": schema.jsonValue(), "buckets": buckets or self._buckets(name), "parts": [part] if part else [], "marks": []}
            return
        known = StructType.fromJson(state["schema"])
        for f in schema.fields:  # columns may come, not change
            if f.name not in known.names:
                known.add(f.name, f.dataType, True)
            elif known[f.name].dataType.simpleString() != f.dataType.simpleString():
                raise ValueError(f"{name}.{f.name} is {known[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        state["schema"] = known.jsonValue()
        if part:
            state["parts"].append(part)

    def _add(self, name: str, rows: DataFrame, fresh: bool = False, buckets: int | None = None) -> None:
        self._record(name, self._write(name, rows, buckets), rows.schema, fresh, buckets)

    def _mark(self, name: str, rows: DataFrame) -> None:
        path = uuid.uuid4().hex
        at = f"{self.store.folder}/_marks/{name}/{path}"
        seen = Observation()
        rows.select(*_POSITION).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(at)
        if n := seen.get["n"]:
            self.state["tables"][name]["marks"].append({"path": path, "rows": n})
