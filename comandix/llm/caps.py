"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector belongs to all filters whose direction it meets above a
threshold. Directions come from a random product code: after a random rotation the coordinates are
cut into two blocks with ``CODES`` random unit vectors each, and every pair of them is a direction, so
``CODES``**2 filters take 2 * CODES products. A vector's filters are list-decoded: the codes of a block
are sorted by their products, and pairs are walked as long as their sum exceeds the threshold. It is
set so that a random direction's filter takes a vector with probability ``LIST`` / CODES**2, and a
vector that few filters take gets the ``LEAST_LIST`` nearest. Two random vectors of 64 components with a cosine of
0.93 then share a filter with a probability of 0.999.

Vectors with equal components are one node with a weight. Nodes of one label and filter are dealt
into blocks, and blocks are compared with each other by matrix products, so a filter with most of the
rows is many tasks. A pair that meets in several filters counts in the first of them only.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comandix.llm import common

CODES, LIST, LEAST_LIST, BLOCK = 48, 64, 32, 512


def code_book(dims: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A rotation, and the unit vectors of both blocks."""
    random = np.random.default_rng(seed)
    rotation = np.linalg.qr(random.normal(size=(dims, dims)))[0]
    half = max(1, dims // 2)
    blocks = []
    for size in (half, max(1, dims - half)):
        drawn = random.normal(size=(CODES, size))
        blocks.append(drawn / np.linalg.norm(drawn, axis=1, keepdims=True))
    return rotation, blocks[0], blocks[1]


def threshold(dims: int, seed: int = 4) -> float:
    """The sum of two products that a random unit vector exceeds for ``LIST`` of the pairs on average."""
    rotation, left, right = code_book(dims)
    probe = np.random.default_rng(seed).normal(size=(400, dims))
    probe = (probe / np.linalg.norm(probe, axis=1, keepdims=True)) @ rotation
    half = max(1, dims // 2)
    second = probe[:, half:] if dims > 1 else np.zeros((len(probe), 1))
    sums = (probe[:, :half] @ left.T)[:, :, None] + (second @ right.T)[:, None, :]
    return float(np.quantile(sums, 1 - LIST / CODES**2))


def filters_of(unit: np.ndarray) -> list[np.ndarray]:
    """The filters of each unit vector, sorted: all above the threshold, and ``LEAST_LIST`` at least."""
    dims = unit.shape[1]
    rotation, left, right = code_book(dims)
    least, half = threshold(dims), max(1, dims // 2)
    turned = unit @ rotation
    second = turned[:, half:] if dims > 1 else np.zeros((len(unit), 1))
    a, b = turned[:, :half] @ left.T, second @ right.T
    by_a, by_b = np.argsort(-a, axis=1), np.argsort(-b, axis=1)
    a, b = np.take_along_axis(a, by_a, 1), np.take_along_axis(b, by_b, 1)
    out = []
    for i in range(len(unit)):
        reach = np.searchsorted(-b[i], -(least - a[i]), "right")  # how many codes of the second block go with each of the first
        rows = np.repeat(np.arange(CODES), reach)
        columns = np.arange(len(rows)) - np.repeat(np.cumsum(reach) - reach, reach)
        found = by_a[i][rows] * CODES + by_b[i][columns]
        if len(found) < LEAST_LIST:
            best = np.argsort(-(a[i][:LEAST_LIST, None] + b[i][None, :LEAST_LIST]), axis=None)[:LEAST_LIST]
            found = by_a[i][best // LEAST_LIST] * CODES + by_b[i][best % LEAST_LIST]
        out.append(np.sort(found))
    return out


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: (node, components) to the node and its filters; vectors that link with nothing have none."""
    for batch in batches:
        nodes, filters = [], []
        by_size: dict[int, list] = {}
        for node, value in zip(batch.column(0), batch.column(1)):
            vector = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
            by_size.setdefault(len(vector), []).append((node, vector))
        for rows in by_size.values():
            vectors = np.stack([v for _, v in rows])
            scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
            unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
            for lo in range(0, len(rows), 2048):
                filters += filters_of(unit[lo : lo + 2048])
            nodes += [n for n, _ in rows]
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array([n.as_py() for n in nodes], pa.binary()), pa.array([f.tolist() for f in filters], pa.list_(pa.int32()))], ["_s", "_f"])


def compared(least: float):
    """Code of one pair of blocks of one filter.

    Rows are (block pair, side, node, weight, filters, components, filter). Gives the links found per
    node, and one node of those that its links connect it with here, the same for all of them.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        side = table.column("_side").to_numpy()
        mine = np.flatnonzero(side == 0)
        within = bool(table.column("_within")[0].as_py())
        yours = mine if within else np.flatnonzero(side == 1)
        if not len(mine) or not len(yours):
            return _found([], [], [])
        names = table.column("_s").to_pylist()
        weight = table.column("_c").to_numpy()
        at = table.column("_at")[0].as_py()
        lists = table.column("_f").to_pylist()
        vectors = table.column("_v").to_pylist()
        links = np.zeros(len(names), np.int64)
        group = np.arange(len(names))
        for size in {len(v) for v in vectors}:
            rows = [np.array([i for i in group if len(vectors[i]) == size], np.int64) for group in (mine, yours)]
            if not len(rows[0]) or not len(rows[1]):
                continue
            a, b = (_unit(np.array([vectors[i] for i in r], np.float64)) for r in rows)
            hit_a, hit_b = np.nonzero(a @ b.T >= least)
            i, j = rows[0][hit_a], rows[1][hit_b]
            if within:
                i, j = i[(ordered := i < j)], j[ordered]
            if not len(i):
                continue
            first = ~_met_before(lists, i, j, at)
            i, j = i[first], j[first]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            _merge(group, i, j)
        rows = np.flatnonzero(links).tolist()
        return _found([names[i] for i in rows], links[rows].tolist(), [names[group[i]] for i in rows])

    return run


def _merge(group: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lowers the group of everything that the links (i, j) connect to its smallest place."""
    while True:
        before = group.copy()
        low = np.minimum(group[i], group[j])
        for end in (i, j):
            np.minimum.at(group, group[end], low)
            np.minimum.at(group, end, low)
        while (group[group] != group).any():
            group[:] = group[group]
        if (group == before).all():
            return


def _met_before(lists: list[list[int]], i: np.ndarray, j: np.ndarray, at: int) -> np.ndarray:
    """Which of the pairs (i, j) share a filter before ``at``, by a product of membership matrices."""
    rows = np.unique(np.concatenate([i, j]))
    before = [[f for f in lists[r] if f < at] for r in rows.tolist()]
    used = np.unique(np.array([f for fs in before for f in fs], np.int64))
    if not len(used):
        return np.zeros(len(i), bool)
    member = np.zeros((len(rows), len(used)), np.float32)
    for r, fs in enumerate(before):
        member[r, np.searchsorted(used, fs)] = 1
    a, b = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
    shared = member[np.searchsorted(rows, a[0])] @ member[np.searchsorted(rows, b[0])].T
    return shared[a[1], b[1]] > 0


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _found(nodes: list, links: list, to: list) -> pa.Table:
    return pa.table({"_s": pa.array(nodes, pa.binary()), "_links": pa.array(links, pa.int64()), "_to": pa.array(to, pa.binary())})


def near_vectors(
    vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Rows of one label are linked from a cosine of ``least`` on, in double precision. A NULL or empty
    vector, one of zeros, one with a NULL or non-finite component, and a NULL label link with nothing.
    Vectors of different lengths don't link. Repeated rows are rows of their own, linked as equal.
    component_id is the smallest id that is not NULL. Other columns are ignored.
    """
    size = F.size("_v")
    fine = F.col("_v").isNotNull() & F.col("_label").isNotNull() & (size > 0)
    finite = F.forall("_v", lambda x: F.coalesce((F.abs(x) < math.inf) & ~F.isnan(x), F.lit(False)))
    base = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), F.col(label_col).alias("_label"))
    # Adding zero turns -0.0 into 0.0, so that equal vectors are equal bytes.
    clean = F.when(fine & finite & F.exists("_v", lambda x: x != 0), F.transform("_v", lambda x: x + F.lit(0.0)))
    rows = base.withColumn("_v", clean).withColumn("_s", F.when(F.col("_v").isNotNull(), common.row_key_of(F.to_json(F.struct("_label", "_v")))))
    rows = common.stored(rows)
    nodes = rows.where("_s is not null").groupBy("_s").agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct("_label", "_v")).alias("_r"))
    nodes = common.stored(nodes.select("_s", "_c", "_r.*"))
    lists = nodes.select("_s", "_v").mapInArrow(decoded, "_s binary, _f array<int>")
    nodes = common.stored(nodes.join(lists, "_s"))
    found = common.stored(_compared(nodes, least))
    links = common.components(found.where("_to is not null").select(F.col("_s").alias("a"), F.col("_to").alias("b")))
    counts = found.groupBy("_s").agg(F.sum("_links").alias("_links"))
    named = nodes.select("_s", "_c").join(counts, "_s", "left").join(links.withColumnRenamed("node", "_s"), "_s", "left")
    named = named.withColumn("component", F.coalesce("component", "_s"))
    ids = rows.where("_s is not null").groupBy("_s").agg(F.min("_id").alias("_id"))
    smallest = named.join(ids, "_s").groupBy("component").agg(F.min("_id").alias("_to"))
    named = named.join(smallest, "component").select("_s", "_c", "_links", "_to")
    out = rows.select("_id", "_s").join(named, "_s", "left")
    component = F.when(F.col("_s").isNull(), F.col("_id")).otherwise(F.col("_to"))
    n_links = F.coalesce(F.col("_links"), F.lit(0)) + F.coalesce(F.col("_c") - 1, F.lit(0))
    return out.select(F.col("_id").alias(id_col), n_links.cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("_id")).alias("kept"))


def _compared(nodes: DataFrame, least: float) -> DataFrame:
    members = nodes.select("_s", "_c", "_label", "_v", "_f", F.explode("_f").alias("_at"))
    sizes = members.groupBy("_label", "_at").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sizes = sizes.select(F.col("_label").alias("_l2"), F.col("_at").alias("_a2"), F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    dealt = members.join(sizes, (F.col("_label") == F.col("_l2")) & (F.col("_at") == F.col("_a2"))).drop("_l2", "_a2")
    mine = F.pmod(F.xxhash64("_s"), "_blocks").cast("int")
    both = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda other: F.struct(F.least(mine, other).alias("_b1"), F.greatest(mine, other).alias("_b2"), (mine > other).cast("int").alias("_side"), (mine == other).alias("_within")),
    )
    dealt = dealt.select("_s", "_c", "_label", "_v", "_f", "_at", F.explode(both).alias("_p")).select("*", "_p.*").drop("_p")
    return dealt.groupBy("_label", "_at", "_b1", "_b2").applyInArrow(compared(least), "_s binary, _links long, _to binary")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
