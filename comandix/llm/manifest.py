"""A Merkle manifest of a dataset: a digest for every row, one root for all, and a proof for each row.

Rows are leaves. Each group's leaves in the order of their ids make a tree in which every ``ARITY``
consecutive nodes (the last run may have fewer, even one) become their digest, until one node is left, the
subroot; the subroots in the order of the groups (NULL first, then bytewise) make the root in the same way.

Nodes are kept as a log in postorder, the order in which they are completed. A builder takes
``ARITY**HEIGHT`` leaves that begin at a multiple of that number, so its part of the log is one run of
consecutive positions and builders need nothing of each other; what they complete are the leaves of the
next tier, a ``ARITY**HEIGHT``-th of the size, and stand in the log of both tiers. The position of a node is a closed formula of its level, its index
and the tree's number of leaves (``position``). Proofs are read off the log: the siblings of a node are at
positions that the formula gives, and the path above a builder comes from the tier above, from the top down.

No task holds more than one builder's nodes. A leaf's place in its group is worked out from a range shuffle
and counts per slice, so a group that holds most of the rows is cut like any other.
"""

from __future__ import annotations

import hashlib
import string
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from comandix.session import work_dir

ARITY, HEIGHT = 8, 4
BUILDER = ARITY**HEIGHT
#: What a leaf's digest is taken of.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

LOG = "tree binary, tier int, block long, position long, level int, node long, leaves long, digest binary, payload binary"
PATH = "tree binary, node long, leaves long, lefts array<int>, sides array<string>, subroot string, root string, payload binary, digest binary"
_LOG_KINDS = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
_PATH_KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.string(), pa.binary(), pa.binary()]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def combined(texts: list[str]) -> str:
    """The digest of texts one after the other."""
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above the leaves."""
    level = 0
    while leaves > 1:
        leaves, level = -(-leaves // ARITY), level + 1
    return level


def position(level: int, node: np.ndarray | int, leaves: int) -> np.ndarray | int:
    """Place in postorder, from 0: the number of nodes that are complete before this one.

    Below and on its level those are the nodes that begin before its last leaf, above it those
    that end before its first.
    """
    first = node * ARITY**level
    end = np.minimum(first + ARITY**level, leaves)
    before = -1
    for k in range(height(leaves) + 1):
        size = ARITY**k
        before = before + (-(-end // size) if k <= level else first // size)
    return before


def levels_of(digests: list[str], upto: int) -> list[list[str]]:
    """The nodes over consecutive digests, level by level."""
    levels = [digests]
    for _ in range(upto):
        last = levels[-1]
        levels.append([combined(last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
    return levels


def built(key: tuple, rows: pa.Table) -> pa.Table:
    """Task code: one builder's nodes in the order of completion. Levels and nodes are counted in the whole tree."""
    tree, tier, block = (k.as_py() for k in key)
    rows = rows.sort_by("node")
    leaves = rows["leaves"][0].as_py()
    top = height(leaves)
    base = tier * HEIGHT
    levels = levels_of([d.hex() for d in rows["digest"].to_pylist()], min(HEIGHT, top - base))
    payload = rows["payload"].to_pylist()
    nodes = []
    for k, digests in enumerate(levels):
        start = block * BUILDER // ARITY**k
        index = np.arange(start, start + len(digests), dtype=np.int64)
        places = position(base + k, index, leaves).tolist()
        kept = payload if k == 0 else [None] * len(digests)
        nodes += [(tree, tier, block, p, base + k, i, leaves, bytes.fromhex(d), x) for p, i, d, x in zip(places, index.tolist(), digests, kept)]
    nodes.sort(key=lambda x: x[3])
    return pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*nodes), _LOG_KINDS)], _names(LOG))


def extracted(key: tuple, log: pa.Table, above: pa.Table) -> pa.Table:
    """Task code: the path of every leaf of one builder to the root, from the builder's nodes and the path above it."""
    tree, tier, block = (k.as_py() for k in key)
    empty = pa.Table.from_arrays([pa.array([], kind) for kind in _PATH_KINDS], _names(PATH))
    if not log.num_rows or not above.num_rows:
        return empty
    base, leaves = tier * HEIGHT, log["leaves"][0].as_py()
    digest = {p: d.hex() for p, d in zip(log["position"].to_pylist(), log["digest"].to_pylist())}
    upto = min(HEIGHT, height(leaves) - base)
    counts = [-(-leaves // ARITY ** (base + k)) for k in range(upto + 1)]
    rest = above.slice(0, 1).to_pylist()[0]
    runs: dict[tuple[int, int], list[str]] = {}
    for k in range(upto):
        low, high = block * BUILDER // ARITY**k, min((block + 1) * BUILDER // ARITY**k, counts[k])
        for first in range(low, high, ARITY):
            last = min(first + ARITY, counts[k])
            at = position(base + k, np.arange(first, last, dtype=np.int64), leaves)
            runs[k, first // ARITY] = [digest[p] for p in np.atleast_1d(at).tolist()]
    own = log.filter(pa.compute.equal(log["level"], base)).sort_by("node")
    lefts, sides = [], []
    for node in own["node"].to_pylist():
        left, side = [], []
        for k in range(upto):
            run, slot = divmod(node, ARITY)
            others = runs[k, run]
            left.append(slot)
            side.append("".join(others[:slot] + others[slot + 1 :]))
            node = run
        lefts.append(left + rest["lefts"])
        sides.append(side + rest["sides"])
    n = own.num_rows
    columns = [own["tree"], own["node"], own["leaves"], lefts, sides, [rest["subroot"]] * n, [rest["root"]] * n, own["payload"], own["digest"]]
    return pa.Table.from_arrays([pa.array(x.to_pylist() if isinstance(x, pa.ChunkedArray) else x, kind) for x, kind in zip(columns, _PATH_KINDS)], _names(PATH))


def folded(leaf: str, lefts: list[int], sides: list[str]) -> str:
    """The root that a leaf and the siblings on its way lead to."""
    for left, side in zip(lefts, sides):
        leaf = combined([side[: 64 * left], leaf, side[64 * left :]])
    return leaf


def leaf_text(columns: list[str | Column]) -> Column:
    """What a leaf's digest is taken of: ``-`` for NULL, else length in bytes, a colon and the value, for each column."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def digest_of(columns: list[str | Column]) -> Column:
    return F.unhex(F.sha2(leaf_text(columns).cast("binary"), 256))


def _written(df: DataFrame, purpose: str) -> DataFrame:
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``node``, the place in its tree by ``order``, and ``leaves``, the tree's size.

    A range shuffle sorts the rows; ids rise within a slice without gaps, so a place is an id's distance from
    the slice's first plus the sizes of the slices before. Sizes are one row per slice and tree.
    """
    spark = leaves.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["tree", *order]
    ordered = leaves.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    ordered = _written(ordered.withColumns({"_slice": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "manifest-leaves")
    sizes = ordered.groupBy("tree", "_slice").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("tree").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("tree").alias("_tree"), F.col("_slice").alias("_of"), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy("tree")).alias("leaves"),
    )
    placed = ordered.join(sizes, (F.col("tree") == F.col("_tree")) & (F.col("_slice") == F.col("_of")))
    return placed.withColumn("node", F.col("_at") + F.col("_shift")).drop("_tree", "_of", "_slice", "_at", "_shift")


def _grown(leaves: DataFrame, folder: str) -> DataFrame:
    """Writes the log of all trees of ``leaves`` (tree, node, leaves, digest, payload), a folder a tier; the top nodes."""
    spark = leaves.sparkSession
    most = leaves.agg(F.max("leaves")).first()[0] or 0
    level = leaves.select("tree", "node", "leaves", "digest", "payload")
    tops: list[DataFrame] = []
    tier = 0
    while True:
        builders = level.withColumns({"tier": F.lit(tier), "block": F.floor(F.col("node") / BUILDER).cast("long")})
        log = builders.groupBy("tree", "tier", "block").applyInArrow(built, LOG)
        log.write.parquet(f"{folder}/tier={tier}")
        log = spark.read.schema(LOG).parquet(f"{folder}/tier={tier}")
        size = BUILDER ** (tier + 1)
        tops.append(log.where((F.col("node") == 0) & (F.col("leaves") <= min(size, most))))
        if most <= size:
            break
        over = log.where((F.col("level") == (tier + 1) * HEIGHT) & (F.col("leaves") > size))
        level = over.select("tree", "node", "leaves", "digest", F.lit(None).cast("binary").alias("payload"))
        tier += 1
    whole = tops[0]
    for t in tops[1:]:
        whole = whole.unionByName(t)
    last = F.max_by(F.struct("digest", "leaves", "tier"), "level").alias("_t")
    return whole.groupBy("tree").agg(last).select("tree", F.col("_t.digest").alias("digest"), F.col("_t.leaves").alias("leaves"), F.col("_t.tier").alias("tier"))


def _paths(log: str, tops: DataFrame, tiers: int, start: DataFrame) -> DataFrame:
    """The path of every leaf; ``start`` has that of each tree's top node (tree, lefts, sides, subroot, root)."""
    spark = tops.sparkSession
    start = tops.select("tree", "tier").join(start, "tree")
    found: DataFrame | None = None
    for tier in reversed(range(tiers)):
        above = start.where(F.col("tier") == tier).select("tree", F.lit(tier).alias("tier"), F.lit(0).cast("long").alias("block"), "lefts", "sides", "subroot", "root")
        if found is not None:
            above = above.unionByName(found.select("tree", F.lit(tier).alias("tier"), F.col("node").alias("block"), "lefts", "sides", "subroot", "root"))
        nodes = spark.read.schema(LOG).parquet(f"{log}/tier={tier}")
        found = nodes.groupBy("tree", "tier", "block").cogroup(above.groupBy("tree", "tier", "block")).applyInArrow(extracted, PATH)
    return found


@dataclass(frozen=True)
class Manifest:
    """Where the logs are, a row per group (its key as ``tree``, its subroot), and the root, None where there are no rows."""

    folder: str
    tiers: int
    top_tiers: int
    subroots: DataFrame
    tops: DataFrame
    root: str | None

    def paths(self) -> DataFrame:
        """A row per leaf: digest, payload, its place, the siblings on the way (``lefts`` of them stand before it), subroot, root."""
        spark = self.subroots.sparkSession
        none = F.array().cast("array<int>"), F.array().cast("array<string>")
        top = self.tops.select("tree", none[0].alias("lefts"), none[1].alias("sides"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
        groups = _paths(f"{self.folder}/groups", self.tops, self.top_tiers, top)
        start = groups.select(F.col("payload").alias("tree"), "lefts", "sides", F.lower(F.hex("digest")).alias("subroot"), "root")
        return _paths(f"{self.folder}/rows", _trees(spark, self.folder), self.tiers, start)


def _trees(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/trees")


def _tiers(leaves: DataFrame) -> int:
    most, tiers = leaves.agg(F.max("leaves")).first()[0] or 0, 1
    while most > BUILDER**tiers:
        tiers += 1
    return tiers


def group_key(column: str) -> Column:
    """Bytes whose order is that of the groups: NULL first, then bytewise."""
    return F.coalesce(F.concat(F.unhex(F.lit("01")), F.col(column).cast("string").cast("binary")), F.unhex(F.lit("00")))


def manifest(rows: DataFrame, folder: str | None = None) -> Manifest:
    """Builds the logs of ``rows``: ``tree`` (binary), ``digest`` (32 bytes), ``payload`` (bytes that go with a leaf) and
    ``_order``, by which a tree's leaves stand; equal ones stand by digest and payload.

    ``folder`` is new and empty, a path that all executors share. No rows give a manifest without a root.
    """
    spark = rows.sparkSession
    folder = folder or work_dir(spark, "manifest")
    rows = _written(rows.withColumn("_any", F.monotonically_increasing_id()), "manifest-digests")  # spreads equal rows
    leaves = _written(numbered(rows, ["_order", "digest", "payload", "_any"]).drop("_order", "_any"), "manifest-numbered")
    _grown(leaves, f"{folder}/rows").write.parquet(f"{folder}/trees")
    trees = _trees(spark, folder)
    subroots = trees.select(F.lit(b"").alias("tree"), "digest", F.col("tree").alias("payload"))
    subroots = _written(numbered(subroots, ["payload"]), "manifest-subroots")
    top = _grown(subroots, f"{folder}/groups")
    top.write.parquet(f"{folder}/top")
    top = spark.read.parquet(f"{folder}/top")
    last = top.first()
    root = last and last["digest"].hex()
    return Manifest(folder, _tiers(leaves), _tiers(subroots), trees.select("tree", F.lower(F.hex("digest")).alias("subroot")), top, root)


def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: proofs digested, and followed from the leaf as it is now. A payload is that leaf's digest and the id in decimal."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            rows = []
            for r in batch.to_pylist():
                now, name = r["payload"][:32], r["payload"][32:]
                end = folded(now.hex(), r["lefts"], r["sides"])
                rows.append((int(name) if name else None, r["digest"].hex(), r["subroot"], r["root"], combined(r["sides"]), end, end == r["root"]))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), _CHECKED)], _names(CHECKED))


CHECKED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_CHECKED = [pa.int64(), *[pa.string()] * 5, pa.bool_()]


def lowered_thirds(key: Column, text: Column) -> Column:
    """The tampering of the query: A-Z become a-z where 3 divides the crc32 of the id in decimal; a NULL id's text stays."""
    hit = F.crc32(key.cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(text)


def verified(
    docs: DataFrame, tampered: Callable[[Column, Column], Column], columns: tuple[str, ...] = COLUMNS,
    id_col: str = "doc_id", group: str = "lang", text_col: str = "text",
) -> DataFrame:
    """Manifest of ``docs``, and every row checked against it with the text that ``tampered`` makes of (id, text).

    One row per row of ``docs``. NULLs count as values of their own everywhere: a NULL id stands before all others, a
    NULL group is the first. Equal ids stand by leaf digest and repeated rows are leaves of their own, which
    differ in their proofs only. Other columns are ignored; empty tables give no rows. Texts of any
    length are read once and only their digests go on.
    """
    inner = docs.select(*[F.col(c).alias(f"_{c}") for c in dict.fromkeys([*columns, id_col, group])])
    now = [tampered(F.col(f"_{id_col}"), F.col(f"_{c}")) if c == text_col else F.col(f"_{c}") for c in columns]
    payload = F.concat(digest_of(now), F.coalesce(F.col(f"_{id_col}").cast("string"), F.lit("")).cast("binary"))
    rows = inner.select(group_key(f"_{group}").alias("tree"), F.col(f"_{id_col}").alias("_order"), digest_of([f"_{c}" for c in columns]).alias("digest"), payload.alias("payload"))
    return manifest(rows).paths().select("payload", "digest", "lefts", "sides", "subroot", "root").mapInArrow(checked, CHECKED)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
