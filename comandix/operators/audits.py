"""Integrity audits of the stored tables.

Keys are counted before they meet another table: what is joined is one row per distinct key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comandix import model
from comandix.operators import hotkeys
from comandix.operators.joins import ledger_vs_snapshot


def duplicate_keys(table: DataFrame, key: list[str], ignore_case: bool = False) -> DataFrame:
    """Keys that occur more than once; with ``ignore_case``, text that differs only in case is one key."""
    if ignore_case:
        text = [f.name for f in table.schema.fields if f.name in key and f.dataType.typeName() == "string"]
        table = table.withColumns({name: F.collate(name, "UTF8_LCASE") for name in text})
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def audit_keys(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Per table: repeated keys, the rows that have them, and rows with a NULL in the key.

    Keys that should be unique gain nothing from being added up before the shuffle, but would fill the memory of its tasks, so
    bare keys are dealt out.
    """
    return _stacked(
        [
            hotkeys.spread(table.select(*key), *key)
            .groupBy(*key)
            .agg(F.count(F.lit(1)).alias("_rows"))
            .agg(
                F.count(F.when(F.col("_rows") > 1, 1)).alias("repeated_keys"),
                F.coalesce(F.sum(F.when(F.col("_rows") > 1, F.col("_rows"))), F.lit(0)).alias("repeated_rows"),
                F.coalesce(F.sum(F.when(_any([F.col(c).isNull() for c in key]), F.col("_rows"))), F.lit(0)).alias(
                    "null_rows"
                ),
            )
            .select(F.lit(name).alias("table_name"), "repeated_keys", "repeated_rows", "null_rows")
            for name, (table, key) in tables.items()
        ]
    )


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values of ``column`` that no parent row has, with their rows. NULL refers to nothing."""
    used = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(key)).agg(F.count(F.lit(1)).alias("rows"))
    return used.join(parent.select(key), key, "left_anti")


@dataclass(frozen=True)
class Reference:
    """A column that names rows of ``parent``: its value, the rows it counts for, and whether a value counts once only."""

    parent: str
    column: Column
    where: Column | None = None
    once: bool = False


@dataclass(frozen=True)
class Source:
    """A stored table with all references and all keys that come from its rows, whatever tables of the model they belong to.

    A reference may have several values a row, as a list of columns.
    """

    table: DataFrame
    references: dict[str, Reference | list[Reference]]
    keys: dict[str, Column]


def audit_foreign_keys(sources: list[Source]) -> DataFrame:
    """Per reference: values no parent row has, and the rows that use them. All keys are whole numbers, NULL refers to nothing.

    Each source is scanned once. Its references and keys become tagged rows, and one aggregation by parent and key
    tells both whether the key is there and how often each reference uses it, so nothing is joined; rows of a
    popular key are added up before the shuffle.
    """
    parents: dict[str, int] = {}
    slots: dict[int, list[tuple[str, bool]]] = {}
    tagged: list[DataFrame] = []
    for source in sources:
        marks = []
        for parent, key in source.keys.items():
            marks.append(_mark(parents.setdefault(parent, len(parents)), -1, key))
        for name, several in source.references.items():
            for k, reference in enumerate(several if isinstance(several, list) else [several]):
                place = parents.setdefault(reference.parent, len(parents))
                own = slots.setdefault(place, [])
                if k == 0:
                    own.append((name, reference.once))
                column = reference.column if reference.where is None else F.when(reference.where, reference.column)
                marks.append(_mark(place, len(own) - 1, column))
        tagged.append(source.table.select(F.explode(F.array(*marks)).alias("_m")).select("_m.*").where("_key IS NOT NULL"))
    widest = max(map(len, slots.values()), default=0)
    uses = [F.count(F.when(F.col("_slot") == k, 1)).alias(f"_use{k}") for k in range(widest)]
    keys = _stacked(tagged).groupBy("_parent", "_key").agg(F.max((F.col("_slot") == -1).cast("int")).alias("_there"), *uses)
    lost = keys.where("_there = 0").groupBy("_parent").agg(
        *[F.count(F.when(F.col(f"_use{k}") > 0, 1)).alias(f"_keys{k}") for k in range(widest)],
        *[F.sum(f"_use{k}").alias(f"_rows{k}") for k in range(widest)],
    )
    # One row per parent from here on; references without orphans are reported too.
    names = F.create_map(*[F.lit(x) for place, own in slots.items() for x in (place, [name for name, _ in own])])
    once = F.create_map(*[F.lit(x) for place, own in slots.items() for x in (place, [o for _, o in own])])
    every = keys.sparkSession.range(len(parents)).select(F.col("id").cast("int").alias("_parent"))
    listed = every.join(lost, "_parent", "left").where(F.col("_parent").isin(list(slots)))
    found = F.arrays_zip(
        names[F.col("_parent")].alias("reference"), once[F.col("_parent")].alias("once"),
        F.array(*[F.col(f"_keys{k}") for k in range(widest)]).alias("keys"), F.array(*[F.col(f"_rows{k}") for k in range(widest)]).alias("rows"),
    )
    each = listed.select(F.explode(found).alias("_f")).where("_f.reference IS NOT NULL")
    n_keys = F.coalesce("_f.keys", F.lit(0))
    return each.select(F.col("_f.reference").alias("reference"), n_keys.alias("orphan_keys"), F.when(F.col("_f.once"), n_keys).otherwise(F.coalesce("_f.rows", F.lit(0))).alias("orphan_rows"))


def _mark(parent: int, slot: int, key: Column) -> Column:
    return F.struct(F.lit(parent).alias("_parent"), F.lit(slot).alias("_slot"), key.cast("bigint").alias("_key"))


def audit_domains(rules: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """Per table and rule: rows that break it. Each table is read once for all its rules."""
    reports = []
    for name, (table, broken) in rules.items():
        counts = table.agg(*[F.count(F.when(rule, 1)).alias(rule_name) for rule_name, rule in broken.items()])
        pairs = [F.struct(F.lit(r).alias("rule"), F.col(r).alias("bad_rows")) for r in broken]
        reports.append(
            counts.select(F.lit(name).alias("table_name"), F.explode(F.array(*pairs)).alias("r")).select(
                "table_name", "r.rule", "r.bad_rows"
            )
        )
    return _stacked(reports)


def missing(column: str) -> Column:
    return F.col(column).isNull()


def too_long(column: str) -> Column:
    return F.length(column) > model.NAME_LENGTH


def below_zero(column: str) -> Column:
    return F.col(column) < 0


def out_of_range(column: str, digits: int) -> Column:
    """More whole digits than the stored type has."""
    return F.abs(F.col(column)) >= F.lit(10**digits).cast("decimal(20,0)")


def not_one_of(column: str, values: tuple[str, ...]) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(*values)


def audit_ledger_drift(ledger: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Supplies whose snapshot and ledger disagree."""
    return ledger_vs_snapshot(ledger, snapshot).where("difference <> 0")


def supplies_without_stock(supplies: DataFrame, snapshot: DataFrame) -> DataFrame:
    return supplies.join(snapshot.select("supply_id"), "supply_id", "left_anti").select("supply_id", "supply_name")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
