"""Near-duplicates by MinHash with tensored banding.

Two small collections of short hash rows are kept per text, ``SIDE`` on the left and ``SIDE`` on
the right, each of ``DEPTH`` minhashes. The keys of the ``SIDE * SIDE`` tables are the pairs of one
left and one right row, so 72 minhashes serve 144 tables of 6 hashes that would take 864. Two texts
of Jaccard similarity s meet with probability (1 - (1 - s**DEPTH)**SIDE)**2: 0.9996 at 0.8.

Texts with equal sets are one node throughout. Left rows that no other node shares are dropped
before the pairs are formed. Within a table nodes are compared with its lowest node, and links are
confirmed on the whole sets, read from the texts. Tables whose nodes are then in different components
are compared in full: their nodes are dealt to units, and all pairs of two units that meet in a table are tested in
one task, once for all the tables they meet in; pairs of nodes are never listed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comandix.llm import common, textbytes

SIDE, DEPTH = 12, 3
HASHES = 2 * SIDE * DEPTH
#: Matching bytes of HASHES below which a pair at 0.8 or more falls with a probability under 1e-4.
LEAST_MATCHES = 43
#: Nodes of a unit, and their shingles, that are compared with those of another in one task.
UNIT, UNIT_SHINGLES = 512, 1 << 19
#: Nodes whose minhashes are compared with a unit's at once.
BLOCK = 256
#: Pairs whose sets are held at once when they are confirmed.
PAIRS = 128
#: Distinct shingles of one product of membership matrices.
CHUNK = 8192
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(size: int):
    """Task code: (row key, text) to (row key, set size, 16 bytes that name the set, minhashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in textbytes.pieces(batch.column(1)):
                sets = textbytes.shingles(data, offsets, size)
                sizes = np.array([len(s) for s in sets], np.int64)
                filled = np.flatnonzero(sizes)
                names = np.zeros((hi - lo, 2), np.uint64)
                hashes = np.zeros((hi - lo, HASHES), np.uint32)
                if len(filled):
                    flat = np.concatenate([sets[i] for i in filled])
                    at = np.concatenate([[0], np.cumsum(sizes[filled])[:-1]])
                    for k in range(2):
                        names[filled, k] = np.add.reduceat(textbytes.mixed(flat + np.uint64(k + 1)), at)
                    for k in range(HASHES):
                        hashes[filled, k] = np.minimum.reduceat(((flat * _FACTORS[k]) >> np.uint64(32)).astype(np.uint32), at)
                raw = [x.tobytes() if n else None for x, n in zip(names, sizes)]
                rows = pa.ListArray.from_arrays(
                    pa.array(np.arange(hi - lo + 1, dtype=np.int32) * HASHES), pa.array(hashes.view(np.int32).ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(raw, pa.binary()), rows], ["_k", "_n", "_s", "_h"]
                )

    return run


def confirmed(size: int, least: int):
    """Task code: (a, text of a, b, text of b) to the pairs whose sets overlap by ``least`` percent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo in range(0, batch.num_rows, PAIRS):
                ends = (batch.column(k).slice(lo, PAIRS) for k in (1, 3))
                sets = [[s for *_, data, offsets in textbytes.pieces(c) for s in textbytes.shingles(data, offsets, size)] for c in ends]
                for i, (a, b) in enumerate(zip(*sets), lo):
                    if 100 * min(len(a), len(b)) >= least * max(len(a), len(b)) > 0:
                        at = np.searchsorted(a, b)
                        both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                        keep[i] = 100 * both >= least * (len(a) + len(b) - both)
            if keep.any():
                found = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([found.column(0), found.column(2)], ["a", "b"])

    return run


def _possible(a: tuple, b: tuple, percent: int) -> np.ndarray:
    """Which nodes of a (component, set size, bytes of minhashes) go with which of b by component, size and minhashes."""
    (ca, na, ha), (cb, nb, hb) = a, b
    ok = (ca[:, None] != cb) & (100 * np.minimum(na[:, None], nb) >= percent * np.maximum(na[:, None], nb))
    columns = np.ascontiguousarray(hb.T)
    for lo in range(0, len(ca), BLOCK):
        part = ok[lo : lo + BLOCK]
        if part.any():
            same = np.zeros(part.shape, np.uint8)
            for k in range(HASHES):
                same += ha[lo : lo + BLOCK, k, None] == columns[k]
            part &= same >= LEAST_MATCHES
    return ok


def _sides(table: pa.Table) -> tuple:
    """(component, set size, bytes of minhashes) of the rows, and the rows of both sides: all twice if there is one."""
    names = table.column("_c").to_numpy()
    hashes = table.column("_h").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, HASHES)
    side = table.column("_side").to_numpy()
    mine, yours = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = bool(table.column("_within")[0].as_py())
    return (np.unique(names, return_inverse=True)[1], table.column("_n").to_numpy(), hashes), mine, mine if within else yours


def candidates(percent: int):
    """Code of two units: their nodes that sizes and minhashes leave a partner in the other."""

    def run(table: pa.Table) -> pa.Table:
        nodes, mine, yours = _sides(table)
        ok = _possible(tuple(x[mine] for x in nodes), tuple(x[yours] for x in nodes), percent)
        rows = np.unique(np.concatenate([mine[ok.any(1)], yours[ok.any(0)]]))
        return table.select(["ua", "ub", "_s", "_side"]).take(pa.array(rows))

    return run


def _shared(sets: list[np.ndarray], mine: np.ndarray, yours: np.ndarray) -> np.ndarray:
    """How many shingles each of ``mine`` shares with each of ``yours``, by products of membership matrices."""
    out = np.zeros((len(mine), len(yours)), np.int64)
    if not out.size:
        return out
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    for lo in range(0, int(ids[-1]) + 1, CHUNK):
        first, last = np.searchsorted(ids, [lo, lo + CHUNK])
        member = np.zeros((len(sets), CHUNK), np.float32)
        member[owner[first:last], ids[first:last] - lo] = 1
        out += (member[mine] @ member[yours].T).astype(np.int64)
    return out


def joined(size: int, percent: int):
    """Code of two units: links between components, as few as connect what the texts connect."""

    def run(table: pa.Table) -> pa.Table:
        nodes, mine, yours = _sides(table)
        ok = _possible(tuple(x[mine] for x in nodes), tuple(x[yours] for x in nodes), percent)
        mine, yours, ok = mine[ok.any(1)], yours[ok.any(0)], ok[ok.any(1)][:, ok.any(0)]
        rows = np.unique(np.concatenate([mine, yours]))
        texts = table.column("_t").take(pa.array(rows)).combine_chunks()
        texts = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
        sets = [s for t in texts for *_, data, offsets in textbytes.pieces(t) for s in textbytes.shingles(data, offsets, size)]
        at = [np.searchsorted(rows, x) for x in (mine, yours)]
        sizes, shared = np.array([len(s) for s in sets], np.int64), _shared(sets, *at)
        ok &= 100 * shared >= percent * (sizes[at[0]][:, None] + sizes[at[1]] - shared)
        place = list(range(int(nodes[0].max()) + 1))

        def of(c: int) -> int:
            while place[c] != c:
                place[c] = c = place[place[c]]
            return c

        links = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(ok))):
            i, j = int(mine[i]), int(yours[j])
            one, two = of(nodes[0][i]), of(nodes[0][j])
            if one != two:
                place[one] = two
                links.append((i, j))
        names = table.column("_c").to_pylist()
        return pa.table({end: pa.array([names[x[k]] for x in links], pa.int64()) for k, end in enumerate("ab")})

    return run


def _matches(a: str, b: str):
    """How many of the minhashes of two nodes agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, component_id, kept).

    ``percent`` from 80 on; the tables are laid out for that. A-Z is lower-cased, a NULL or empty text
    or one of spaces only has no shingles and is linked with nothing; its component is its own id.
    Rows with equal texts are linked. Repeated ids are separate rows; the smallest id that is not
    NULL names a component. Rows with a NULL id take part and are kept only if all of the
    component's ids are NULL. Other columns of ``docs`` are ignored.
    """
    out = _grouped(_source(docs, id_col, text_col), words, percent)
    kept = F.col("_to").eqNullSafe(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_to").alias("component_id"), kept.alias("kept"))


def without_near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with its columns and one row of each group, that with the smallest id; see ``near_duplicates``.

    Rows without shingles all stay, but for rows that repeat id and text.
    """
    rows, groups = _rows_and_groups(_source(docs, id_col, text_col), words, percent)
    named = rows.select("_k", "_id", "_s").join(groups.select(F.col("_set").alias("_s"), _name().alias("_c")), "_s", "left")
    group = F.coalesce(F.col("_c"), F.col("_k"))
    # The smallest id that is not NULL, and of its rows one.
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_k"))
    keep = named.groupBy(group.alias("_g")).agg(first.alias("_r")).select("_r._k").distinct()
    inner = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    name = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    kept = inner.withColumn("_k", common.row_key(name[id_col], name[text_col])).join(keep, "_k").dropDuplicates(["_k"])
    return kept.select(*[F.col(name[c]).alias(c) for c in docs.columns])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).withColumn("_k", common.row_key("_id", "_t"))


def _rows_and_groups(source: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of ``source`` (_id, _t, _k): (key, id, set size, set, minhashes) of every row, and (set, group) of every set."""
    if percent < 80:
        raise ValueError("the tables are laid out for a similarity of 80 percent or more")
    kind = dict(source.dtypes)["_id"]
    signed = source.select("_k", "_t", "_id").mapInArrow(
        _with_id(signatures(words)), f"_k binary, _n long, _s binary, _h array<int>, _id {kind}"
    )
    rows = common.stored(signed)
    sets = rows.where("_n > 0").groupBy("_s").agg(F.min(F.struct("_k", "_n", "_h")).alias("_r")).select(F.col("_s").alias("_set"), "_r.*")
    # A number names a set from here on: half as much in every table and pair.
    nodes = common.stored(sets.withColumn("_s", F.monotonically_increasing_id()))
    names = _components(source, nodes, _tables(nodes), words, percent)
    groups = nodes.select("_set", "_s").join(names, "_s", "left").select("_set", F.coalesce("_c", "_s").alias("_c"))
    return rows, groups


def _name():
    """The group's number as bytes that no row key equals."""
    return F.concat(F.lit("component of set "), F.col("_c").cast("string")).cast("binary")


def _grouped(source: DataFrame, words: int, percent: int) -> DataFrame:
    """One row per row of ``source`` (_id, _t, _k): id, set size, the group's smallest id."""
    rows, groups = _rows_and_groups(source, words, percent)
    ids = rows.where("_n > 0").groupBy("_s").agg(F.min("_id").alias("_id")).withColumnRenamed("_s", "_set")
    labelled = groups.join(ids, "_set")
    smallest = labelled.groupBy("_c").agg(F.min("_id").alias("_to"))
    target = labelled.join(smallest, "_c").select(F.col("_set").alias("_s"), "_to")
    out = rows.select("_id", "_n", "_s").join(target, "_s", "left")
    return out.select("_id", "_n", F.when(F.col("_s").isNull(), F.col("_id")).otherwise(F.col("_to")).alias("_to"))


def _with_id(inner):
    """Carries the third column past ``inner``, which keeps the order of rows."""

    def run(batches):
        for batch in batches:
            at = 0
            for made in inner([batch]):
                yield pa.RecordBatch.from_arrays([*made.columns, batch.column(2).slice(at, made.num_rows)], [*made.schema.names, "_id"])
                at += made.num_rows

    return run


def _tables(nodes: DataFrame) -> DataFrame:
    """(node, table key) of all keys that two nodes or more share."""

    def row(side: int, i: int):
        at = (side * SIDE + i) * DEPTH
        return F.xxhash64(F.lit(side * SIDE + i), *[F.col("_h")[at + k] for k in range(DEPTH)])

    left = nodes.select("_s", F.explode(F.array(*[row(0, i) for i in range(SIDE)])).alias("_l"))
    shared = left.groupBy("_l").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_l")
    lefts = left.join(shared, "_l").groupBy("_s").agg(F.collect_list("_l").alias("_ls"))
    pairs = common.stored(lefts.join(nodes.select("_s", F.array(*[row(1, i) for i in range(SIDE)]).alias("_rs")), "_s"))
    keyed = pairs.select("_s", "_rs", F.explode("_ls").alias("_l")).select(
        "_s", F.explode(F.transform("_rs", lambda r: F.xxhash64("_l", r))).alias("_key")
    )
    # Lone keys are not written: whether two nodes have a key is counted in the pass before.
    shared = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_key")
    return common.stored(keyed.join(shared, "_key").select("_s", "_key"))


def _texts(source: DataFrame, nodes: DataFrame, tables: DataFrame) -> DataFrame:
    """(node, text) of the nodes that share a table key; equal rows are joined with once."""
    members = tables.select("_s").distinct().join(nodes.select("_s", "_k"), "_s")
    return common.stored(source.select("_k", "_t").join(members, "_k").dropDuplicates(["_k"]).select("_s", "_t"))


def _components(source: DataFrame, nodes: DataFrame, tables: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of the nodes that have a confirmed link; a component is named by one of its nodes."""
    texts = _texts(source, nodes, tables)
    # One byte of each minhash is enough to rule pairs out, and what pairs carry through two joins.
    light = nodes.select("_s", "_n", F.transform("_h", lambda x: (x.bitwiseAND(255) - 128).cast("tinyint")).alias("_h"))

    lowest = tables.groupBy("_key").agg(F.min("_s").alias("a"))
    pairs = tables.join(lowest, "_key").where("a <> _s").select("a", F.col("_s").alias("b")).distinct()
    # Pairs that sizes and minhashes don't rule out are confirmed on the whole sets.
    a = light.select(F.col("_s").alias("a"), F.col("_n").alias("_na"), F.col("_h").alias("_ha"))
    b = light.select(F.col("_s").alias("b"), F.col("_n").alias("_nb"), F.col("_h").alias("_hb"))
    near = pairs.join(b, "b").join(a, "a")
    near = near.where((100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb")) & (_matches("_ha", "_hb") >= LEAST_MATCHES))
    full = near.select("a", "b").join(texts.select(F.col("_s").alias("b"), F.col("_t").alias("_tb")), "b")
    full = full.join(texts.select(F.col("_s").alias("a"), F.col("_t").alias("_ta")), "a")
    links = full.select("a", "_ta", "b", "_tb").mapInArrow(confirmed(words, percent), "a long, b long")
    names = common.stored(common.components(links).toDF("_s", "_c"))
    return _completed(names, tables, light, texts, words, percent)


def _moved(names: DataFrame, ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """``names`` after links between components (``ends``); the nodes of ``nodes`` that had no name get one."""
    to = common.components(ends).toDF("_c", "_to")
    alone = nodes.select("a").union(nodes.select("b")).distinct().toDF("_s").join(names, "_s", "left_anti")
    names = names.union(alone.select("_s", F.col("_s").alias("_c"))).join(to, "_c", "left")
    return common.stored(names.select("_s", F.coalesce("_to", "_c").alias("_c")))


def _units(dealt: DataFrame, light: DataFrame) -> DataFrame:
    """(node, component, set size, bytes of minhashes, unit, the unit's smallest and largest component).

    A node goes with its largest table, and the table with the one that most of its nodes have gone with, so that
    nodes that share tables are in few units.
    """
    largest = F.max(F.struct("_m", "_key"))["_key"]
    homes = common.stored(dealt.groupBy("_s").agg(F.min("_c").alias("_c"), largest.alias("_home")))
    most = dealt.join(homes.select("_s", "_home"), "_s").groupBy("_key", "_home").agg(F.count(F.lit(1)).alias("_z"))
    most = most.groupBy("_key").agg(F.max(F.struct("_z", "_home"))["_home"].alias("_to"))
    homes = homes.join(most, F.col("_home") == F.col("_key")).select("_s", "_c", F.col("_to").alias("_home"))
    homes = common.stored(homes.join(light, "_s"))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / UNIT, F.sum("_n") / UNIT_SHINGLES))
    sizes = homes.groupBy("_home").agg(parts.alias("_z"))
    unit = F.xxhash64("_home", F.pmod(F.xxhash64("_s"), "_z"))
    units = homes.join(sizes, "_home").select("_s", "_c", "_n", "_h", unit.alias("_u"))
    return common.stored(units.join(units.groupBy("_u").agg(F.min("_c").alias("_x"), F.max("_c").alias("_y")), "_u"))


def _completed(names: DataFrame, tables: DataFrame, light: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``names`` after all pairs of one table and different components are tested.

    A table of two nodes has been tested by its first representative. Of the others each lists the units that meet
    in it, and two units are compared once for all tables: the minhashes of all their nodes, then the texts of the
    nodes that have a possible partner.
    """
    now = tables.join(names, "_s", "left").select("_s", "_key", F.coalesce("_c", "_s").alias("_c"))
    torn = now.groupBy("_key").agg(F.count(F.lit(1)).alias("_m"), F.min("_c").alias("_x"), F.max("_c").alias("_y"))
    dealt = common.stored(now.join(torn.where("_m > 2 and _x <> _y").select("_key", "_m"), "_key"))
    if dealt.isEmpty():
        return names
    units = _units(dealt, light)
    met = dealt.join(units.select("_s", "_u", "_x", "_y"), "_s").groupBy("_key")
    met = met.agg(F.array_sort(F.collect_set(F.struct("_u", "_x", "_y"))).alias("_us"))
    pairs = met.select("_us", F.posexplode("_us").alias("_i", "_a"))
    pairs = pairs.select("_a", F.explode(F.slice("_us", F.col("_i") + 1, F.size("_us"))).alias("_b"))
    pairs = pairs.where("_a._x <> _a._y or _b._x <> _b._y or _a._x <> _b._x").select(F.col("_a._u").alias("ua"), F.col("_b._u").alias("ub"))
    ends = pairs.distinct().select("ua", "ub", F.explode(F.array_distinct(F.array("ua", "ub"))).alias("_u"))
    side, within = (F.col("_u") != F.col("ua")).cast("int").alias("_side"), (F.col("ua") == F.col("ub")).alias("_within")
    nodes = ends.join(units, "_u").select("ua", "ub", side, within, "_s", "_c", "_n", "_h")
    near = nodes.groupBy("ua", "ub").applyInArrow(candidates(percent), "ua long, ub long, _s long, _side int")
    near = common.stored(near).withColumn("_within", F.col("ua") == F.col("ub"))
    members = near.join(units.drop("_u", "_x", "_y"), "_s").join(texts, "_s")
    found = common.stored(members.groupBy("ua", "ub").applyInArrow(joined(words, percent), "a long, b long"))
    return names if found.isEmpty() else _moved(names, found, found)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
