"""Stock movements in sequence, where a refused issue must not count for the next one.

A running sum is wrong here: it would keep counting what was refused. Each key's movements are
walked in order instead, by tasks that read sorted Arrow batches and hold one balance at a time.

A key with very many movements is cut into slices (see ``hotkeys``). A slice needs the balance
the slice before it ends with. Slices are all walked at once from a guessed balance and walked
again only where the guess was wrong:

* a slice that starts with at least what it takes out on the way refuses nothing, so its end is
  its start plus its sum, for any such start, without walking it again;
* otherwise its end holds only for the start it was walked with.

Each round settles at least one more slice per key, and as refusals make balances meet again
within a few movements, two or three rounds are usual. The result is exact in every case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comandix.operators import hotkeys
from comandix.operators.stock_walk import CENTS, KEY, OPENING, SLICE, end_walker, summarise, walker

PLACE = "_place"


def fold_movements(
    rest: DataFrame, hot: DataFrame | None, key: str, order: list[str], qty: Column, opening: Column
) -> DataFrame:
    """Add ``accepted`` to every movement of ``rest`` and ``hot``, as ``hotkeys.split_hot`` gives them.

    ``qty`` is the signed quantity that counts, ``opening`` the key's balance before its first
    movement. Quantities have two decimals and are walked as whole cents. Keys are not NULL.

    The window that numbers a key's movements is what brings them together and in order: unlike a
    repartition it is a requirement the adaptive planner keeps, and a shuffle by ``key`` that a join
    before has made serves it too.
    """

    def prepared(movements: DataFrame) -> DataFrame:
        return movements.withColumns(
            {
                KEY: F.col(key).cast("bigint"),
                CENTS: (qty * 100).cast("bigint"),
                OPENING: (opening * 100).cast("bigint"),
            }
        )

    def accepting(movements: DataFrame) -> T.StructType:
        return T.StructType([*movements.schema.fields, T.StructField("accepted", T.BooleanType())])

    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    whole = prepared(rest).withColumn(PLACE, place)
    done = whole.mapInArrow(walker({}), accepting(whole)).drop(PLACE)
    if hot is not None:
        slices = hotkeys.cut(prepared(hot), [key, *order])
        done = done.unionByName(slices.mapInArrow(walker(_settle(slices)), accepting(slices)).drop(SLICE))
    return done.drop(KEY, CENTS, OPENING)


def _settle(slices: DataFrame) -> dict[tuple[int, int], int]:
    """Exact start balance of every slice: one small row per slice comes to the driver."""
    narrow = slices.select(KEY, SLICE, CENTS, OPENING)
    rows = narrow.mapInArrow(summarise, "key bigint, slice int, opening bigint, total bigint, need bigint").collect()
    chains: dict[int, list] = {}
    for row in sorted(rows, key=lambda r: (r["key"], r["slice"])):
        chains.setdefault(row["key"], []).append(row)

    walked: dict[tuple[int, int], tuple[int, int]] = {}
    while True:
        starts: dict[tuple[int, int], int] = {}
        wrong: dict[tuple[int, int], int] = {}
        for key, chain in chains.items():
            balance = chain[0]["opening"]
            for row in chain:
                at = (key, row["slice"])
                starts[at] = balance
                if balance >= row["need"]:
                    balance += row["total"]
                elif at in walked and walked[at][0] == balance:
                    balance = walked[at][1]
                else:
                    wrong[at] = balance
                    balance = walked[at][1] if at in walked else max(balance + row["total"], 0)
        if not wrong:
            return starts
        again = narrow.where(F.col(SLICE).isin(sorted({s for _, s in wrong})))
        for row in again.mapInArrow(end_walker(wrong), "key bigint, slice int, ending bigint").collect():
            at = (row["key"], row["slice"])
            walked[at] = (wrong[at], row["ending"])
