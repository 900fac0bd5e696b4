"""What keyed streams do with the rows and the state of one key.

These functions travel to the executors by value, so the package need not be installed there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming.state import GroupState

# Most keys a task holds while it combines rows; beyond it, what is combined so far moves on.
COMBINE_KEYS = 200_000
DELIVERED = "ENTREGADO"


def newest_per_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame.sort_values(["order_id", "micros", "event_id"]).drop_duplicates("order_id", keep="last"))
        if sum(map(len, held)) > COMBINE_KEYS:
            held = [pd.concat(held).sort_values(["order_id", "micros", "event_id"]).drop_duplicates("order_id", keep="last")]
            if len(held[0]) > COMBINE_KEYS:
                yield held.pop()
    if held:
        yield pd.concat(held).sort_values(["order_id", "micros", "event_id"]).drop_duplicates("order_id", keep="last")


def order_mover(keep: int | None):
    """Moves an order on the board. With ``keep``, microseconds, the state of a delivered order ends that long after it."""

    def move_order(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get if state.exists else None
        newest = before
        for frame in frames:
            row = frame.sort_values(["micros", "event_id"]).iloc[-1]
            candidate = (int(row["micros"]), int(row["event_id"]), row["state"])
            if newest is None or candidate[:2] > newest[:2]:
                newest = candidate
        if newest is None:
            return
        state.update(newest)
        if keep is not None and newest[2] == DELIVERED:
            state.setTimeoutTimestamp(_after(newest[0] + keep, state))
        if newest == before:
            return
        moved = ([] if before is None else [(before[2], -1)]) + [(newest[2], 1)]
        if before is None or before[2] != newest[2]:
            yield pd.DataFrame(moved, columns=["state", "change"])

    return move_order


def _after(micros: int, state: GroupState) -> int:
    """The millisecond after a moment, and after the watermark."""
    return max(micros // 1000, state.getCurrentWatermarkMs()) + 1


def order_releaser(keep: int | None):
    """Releases an order's events in order. With ``keep``, the state of a delivered order ends that long after it."""

    def release(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from release_in_order(key, frames, state)
        waiting, _, _, last_micros, last_state = state.get
        if keep is None or waiting or last_state != DELIVERED:
            return
        if state.getCurrentWatermarkMs() * 1000 > last_micros + keep:
            state.remove()
        else:
            state.setTimeoutTimestamp(_after(last_micros + keep, state))

    return release


def release_in_order(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    micros, ids, states, last_micros, last_state = state.get if state.exists else ([], [], [], None, None)
    waiting = list(zip(micros, ids, states, strict=True))
    if not state.hasTimedOut:
        for frame in frames:
            stamps = frame["ts"].astype("datetime64[us]").astype("int64")
            waiting += zip(stamps.tolist(), frame["event_id"].tolist(), frame["state"].tolist(), strict=True)
    passed = state.getCurrentWatermarkMs() * 1000
    waiting.sort()
    ready = [event for event in waiting if event[0] < passed]
    waiting = waiting[len(ready) :]
    released = []
    for stamp, event_id, to_state in ready:
        spent = None if last_micros is None else stamp - last_micros
        released.append((event_id, key[0], last_state, to_state, spent))
        last_micros, last_state = stamp, to_state
    state.update(
        ([w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting], last_micros, last_state)
    )
    if waiting:
        state.setTimeoutTimestamp(max(waiting[0][0], passed) // 1000 + 1)
    if released:
        frame = pd.DataFrame(
            released, columns=["event_id", "order_id", "from_state", "to_state", "micros_in_state"]
        )
        yield frame.astype({"micros_in_state": "Int64"})


cloudpickle.register_pickle_by_value(sys.modules[__name__])
