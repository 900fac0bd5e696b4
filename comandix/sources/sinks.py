"""Writers: JSON envelopes, ledgers that grow, snapshots that are replaced, chart series."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from comandix.sources.commits import Commits


def json_envelope(df: DataFrame) -> DataFrame:
    """Every row as ``{"ok": true, "result": {...}}``, one document per row.

    One document with all rows would have to be built by one task.
    """
    return df.select(
        F.to_json(F.struct(F.lit(True).alias("ok"), F.struct(*df.columns).alias("result"))).alias("document")
    )


def write_json(df: DataFrame, path: str) -> None:
    json_envelope(df).write.mode("overwrite").text(path)


class Ledger:
    """A table that grows by batches, laid out by day first and then by part.

    Every batch is one part. A commit makes it visible, and takes the place of the part the same batch
    had before, so a batch may be written again. ``compact`` rewrites the parts of many batches as one; readers follow
    the commits, so they see each row once, before, during and after.
    """

    def __init__(self, spark: SparkSession, path: str, day: str | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.day = day
        self._commits = Commits(spark, path)

    def _state(self) -> tuple[int, dict]:
        """The newest commit's number and what it says: live parts by batch, parts that may go, batches that a merged part
        holds in an older form."""
        last = self._commits.last()
        return last, self._commits.read(last) if last else {"live": {}, "old": [], "hidden": [], "day": self.day}

    def _write(self, rows: DataFrame, part: str) -> None:
        if self.day:
            rows.withColumn("part", F.lit(part)).write.mode("append").partitionBy(self.day, "part").parquet(f"{self.path}/data")
        else:
            rows.write.parquet(f"{self.path}/data/part={part}")

    def _commit(self, change: Callable[[dict], dict]) -> None:
        while True:
            last, state = self._state()
            if self._commits.claim(last + 1, change(state)):
                return

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add a batch's rows. Its rows of an earlier try, if any, go in the same commit."""
        part = f"{batch}-{uuid.uuid4().hex}"
        self._write(rows.withColumn("batch", F.lit(str(batch))), part)

        def change(state: dict) -> dict:
            before = state["live"].get(str(batch))
            merged = bool(before) and before.startswith("merged-")
            old = state["old"] + ([before] if before and not merged else [])
            hidden = state["hidden"] + ([[before, str(batch)]] if merged else [])
            schema = rows.withColumn("batch", F.lit(str(batch))).schema.jsonValue()
            return {"day": self.day, "schema": schema, "live": {**state["live"], str(batch): part}, "old": old, "hidden": hidden}

        self._commit(change)

    def read(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """All rows, or those of the days from ``first`` to ``last``, whose folders are the only ones listed."""
        _, state = self._state()
        day = state["day"]
        folders = [f"{self.path}/data"]
        if day and (first or last):
            names = [n for n in self._commits.names("data") if n.startswith(f"{day}=")]
            inside = [n for n in names if (first or "") <= n.split("=", 1)[1] <= (last or "~")]
            folders = [f"{self.path}/data/{n}" for n in inside] or folders
            if not inside:
                return self._live(folders, state).limit(0)
        return self._live(folders, state)

    def batch(self, batch: str) -> DataFrame:
        """The rows of one batch; nothing else is listed."""
        _, state = self._state()
        part = state["live"][str(batch)]
        if state["day"] and not any(f"part={part}" in self._commits.names(f"data/{n}") for n in self._commits.names("data")):
            return self.spark.createDataFrame([], StructType.fromJson(state["schema"]))  # a batch without rows has no day
        days = f"{state['day']}=*/" if state["day"] else ""
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data/{days}part={part}")
        return rows.where(F.col("batch") == str(batch)).drop("part")

    def _live(self, folders: list[str], state: dict) -> DataFrame:
        if not any("=" in name for name in self._commits.names("data")):
            return self.spark.createDataFrame([], StructType.fromJson(state["schema"]))
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*folders)
        rows = rows.where(F.col("part").isin(sorted(set(state["live"].values()))))
        for part, batch in state["hidden"]:
            rows = rows.where((F.col("part") != part) | (F.col("batch") != batch))
        return rows.drop("part")

    def compact(self, whole: bool = False) -> int:
        """Rewrites the parts of single batches as one part, with ``whole`` all parts; gives how many.

        Files are cut by size, a day in as many as it needs. Replaced parts are deleted by the next compaction,
        so readers that have begun may end.
        """
        _, state = self._state()
        merged = {b: p for b, p in state["live"].items() if whole or not p.startswith("merged-")}
        if len(set(merged.values())) < 2:
            return 0
        part = f"merged-{uuid.uuid4().hex}"
        rows = self._live([f"{self.path}/data"], {**state, "live": merged})
        by = f"`{self.day}`" if self.day else ""
        self._write(self.spark.sql(f"SELECT /*+ REBALANCE{f'({by})' if by else ''} */ * FROM {{rows}}", rows=rows), part)
        gone: list[str] = []

        def change(now: dict) -> dict:
            gone[:] = now["old"]
            kept = {b: (part if merged.get(b) == p else p) for b, p in now["live"].items()}
            hidden = [[p, b] for p, b in now["hidden"] if p in kept.values()]
            return {**now, "live": kept, "old": sorted(set(merged.values())), "hidden": hidden}

        if any(self._state()[1]["live"].get(b) != p for b, p in merged.items()):
            return 0  # a batch was written again meanwhile: its old rows are in the new part
        self._commit(change)
        for folder in [n for n in self._commits.names("data") if n.startswith(f"{self.day}=")] if self.day else [""]:
            for name in self._commits.names("/".join(filter(None, ["data", folder]))):
                if name.removeprefix("part=") in gone:
                    self._commits.remove(*filter(None, ["data", folder, name]))
        return len(set(merged.values()))


def append_ledger(rows: DataFrame, path: str, batch: str, day: str | None = None) -> None:
    """Add one batch of rows to a ledger. Writing the same batch again replaces it, so a retry is safe.

    With ``day``, a date column, days are folders of their own.
    """
    Ledger(rows.sparkSession, path, day).append(rows, batch)


def read_ledger(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    return Ledger(spark, path).read(first, last)


@dataclass(frozen=True)
class Outputs:
    """What a batch changes: tables written whole, rows laid over a table by key, rows added to a table."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    changes: dict[str, tuple[DataFrame, list[str]]] = field(default_factory=dict)
    appends: dict[str, DataFrame] = field(default_factory=dict)


#: Changes of a table that are kept beside it before they are merged into a new copy.
CHANGES = 8


class VersionedTables:
    """Tables replaced together, as if in one transaction.

    A publication writes its tables in a folder of its own and then claims the next version with one commit that
    names the parts of every table. Readers follow the newest commit, so they see all of a publication or none
    of it, and nothing being read is overwritten. Of two writers one gets the number and the other the next
    one; both versions are there. A table may also be published as the rows that changed: it is then the
    newest of its rows by key, and after ``CHANGES`` publications they are merged.

    The newest ``keep`` versions stay readable; what only older ones name is deleted.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 50):
        self.spark = spark
        self.path = path.rstrip("/")
        self.keep = keep
        self._commits = Commits(spark, path)

    def version(self) -> int:
        """Newest published version, 0 when there is none."""
        return self._commits.last()

    def versions(self) -> list[int]:
        return self._commits.numbers()

    def names(self, version: int | None = None) -> list[str]:
        return sorted(self._tables(self.version() if version is None else version))

    def _tables(self, version: int) -> dict[str, dict]:
        return self._commits.read(version)["tables"] if version else {}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._read(self._tables(self.version() if version is None else version)[name])

    def _read(self, table: dict) -> DataFrame:
        if not table["key"]:
            return self.spark.read.parquet(*[f"{self.path}/{p}" for p in table["parts"]])
        parts = [self.spark.read.parquet(f"{self.path}/{p}") for p in table["parts"]]
        if len(parts) == 1:
            return parts[0]
        numbered = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
        whole = numbered[0]
        for part in numbered[1:]:
            whole = whole.unionByName(part)
        rest = [c for c in parts[0].columns if c not in table["key"]]
        newest = F.max_by(F.struct(*rest) if rest else F.lit(True), "_part").alias("_row")
        return whole.groupBy(*table["key"]).agg(newest).select(*[c if c in table["key"] else F.col(f"_row.{c}") for c in parts[0].columns])

    def publish(
        self,
        tables: dict[str, DataFrame] | None = None,
        version: int | None = None,
        changes: dict[str, tuple[DataFrame, list[str]]] | None = None,
        expired: dict[str, Column] | None = None,
    ) -> int:
        """Write ``tables`` whole and ``changes`` (rows, key) on top of the version before, as one new version.

        Rows of a changed table for which ``expired`` holds go when its changes are next merged.

        A table that neither names stays as it is. With ``version`` given, one already published is left as it is; without,
        a writer that comes second gets the next number. ``changes`` are made against the newest version, so
        two writers of changes of one table must not overlap in keys; use ``update`` where they may.
        """
        current = self.version()
        if version is not None and version <= current:
            return current
        written = self._write(tables or {}, changes or {}, version or current + 1) | {"expired": expired or {}}
        while True:
            number = self.version() + 1 if version is None else version
            if self._claim(number, written):
                return number
            if version is not None:
                return self.version()

    def decided(
        self, name: str, decide: Callable[[Callable[[str], DataFrame]], DataFrame], derive: Callable[[Callable[[str], DataFrame], DataFrame], Outputs],
        version: int | None = None,
    ) -> int:
        """Publish what was decided about a batch, and everything that follows from it, as one version.

        ``decide`` makes one row per request of the tables of the version before; the rows are written once, as table
        ``name``, and ``derive`` makes all other outputs of what was written. So requests are read once
        for all outputs together, and outputs agree whatever is computed again. A writer that another one overtakes
        decides again on the newer tables. With ``version`` given, one already published is left as it is.
        """
        while True:
            base = self.version()
            if version is not None and version <= base:
                return base
            number = base + 1 if version is None else version
            folder = f"data/{number:019d}-{uuid.uuid4().hex}"

            def at(table: str, base: int = base) -> DataFrame:
                return self.read(table, base)

            decide(at).write.parquet(f"{self.path}/{folder}/{name}")
            outputs = derive(at, self.spark.read.parquet(f"{self.path}/{folder}/{name}"))
            written = self._write(outputs.tables, outputs.changes, number, folder, outputs.appends)
            written["appends"][name] = f"{folder}/{name}"
            if self._claim(number, written):
                return number

    def update(self, change: Callable[[VersionedTables, int], dict[str, DataFrame]]) -> int:
        """Publish what ``change`` makes of a version; if another writer was faster, make it again of that one's."""
        while True:
            base = self.version()
            if self._claim(base + 1, self._write(change(self, base), {}, base + 1)):
                return base + 1

    def _write(
        self, tables: dict[str, DataFrame], changes: dict[str, tuple[DataFrame, list[str]]], version: int,
        folder: str | None = None, appends: dict[str, DataFrame] | None = None,
    ) -> dict:
        folder = folder or f"data/{version:019d}-{uuid.uuid4().hex}"
        for name, table in {**tables, **(appends or {})}.items():
            table.write.parquet(f"{self.path}/{folder}/{name}")
        for name, (rows, _) in changes.items():
            rows.write.parquet(f"{self.path}/{folder}/{name}")
        whole = {name: {"parts": [f"{folder}/{name}"], "key": []} for name in tables}
        return {
            "tables": whole,
            "changes": {name: [f"{folder}/{name}", key] for name, (_, key) in changes.items()},
            "appends": {name: f"{folder}/{name}" for name in appends or {}},
            "folder": folder,
        }

    def _claim(self, number: int, written: dict) -> bool:
        before = self._tables(number - 1) if number - 1 in self.versions() else self._tables(self.version())
        after = {**before, **written["tables"]}
        for name, (part, key) in written["changes"].items():
            parts = [*before.get(name, {"parts": []})["parts"], part]
            after[name] = {"parts": parts, "key": key}
            if len(parts) > CHANGES:
                merged = f"{written['folder']}/{name}-merged"
                rows = self._read(after[name])
                if name in written.get("expired", {}):
                    rows = rows.where(~F.coalesce(written["expired"][name], F.lit(False)))
                rows.write.mode("overwrite").parquet(f"{self.path}/{merged}")
                after[name] = {"parts": [merged], "key": key}
        for name, part in written["appends"].items():
            after[name] = {"parts": [*before.get(name, {"parts": []})["parts"], part], "key": []}
        if not self._commits.claim(number, {"tables": after}):
            return False
        self._retire(number)
        return True

    def _retire(self, newest: int) -> None:
        """Deletes versions beyond ``keep``, and data that none of the others names."""
        numbers = self.versions()
        kept, gone = numbers[-self.keep :], numbers[: -self.keep]
        if not gone:
            return
        for number in gone:
            self._commits.remove("commits", f"{number:019d}.json")
        named = {part.split("/")[1] for n in kept for table in self._tables(n).values() for part in table["parts"]}
        for folder in self._commits.names("data"):
            if folder not in named and int(folder.split("-")[0]) < kept[0]:
                self._commits.remove("data", folder)


def replace_snapshot(spark: SparkSession, path: str, name: str, table: DataFrame) -> DataFrame:
    """Publish a new version of one table and return it as readers see it."""
    store = VersionedTables(spark, path)
    store.publish({name: table})
    return store.read(name)


def chart_series(df: DataFrame, label: str, value: str, by: str | None = None) -> DataFrame:
    """Labels and values of a chart, in label order.

    A chart has one point per label, so this is for reports whose labels are bounded, such as the
    days of a range. ``by`` makes one chart per value of a column, e.g. one per year.
    """
    points = F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col(value).alias("value"))))
    grouped = df.groupBy(by) if by else df.groupBy()
    series = grouped.agg(points.alias("_points"))
    return series.select(
        *([by] if by else []), F.col("_points.label").alias("labels"), F.col("_points.value").alias("values")
    )
