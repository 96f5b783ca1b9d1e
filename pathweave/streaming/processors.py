"""Incremental versions of the sequential operators. State per key is a few numbers; rows of a key are taken in event
order inside a batch (batches themselves arrive in order)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pathweave.operators.lifting import choose_nearest


def _ordered(pdfs: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(pdfs), ignore_index=True).sort_values(by, kind="stable").reset_index(drop=True)


def history(steps: DataFrame, k: int) -> DataFrame:
    """The last k event ids at every event, front-padded with the earliest (input: demo_id, ts, event_id)."""

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _ordered(pdfs, ["ts", "event_id"])
        last = list(state.get[0]) if state.exists else []
        out = []
        for e in rows["event_id"]:
            last = (last + [int(e)])[-k:]
            out.append(",".join(map(str, [last[0]] * (k - len(last)) + last)))
        state.update((last,))
        yield pd.DataFrame({"demo_id": key[0], "event_id": rows["event_id"], "history": out})

    return steps.groupBy("demo_id").applyInPandasWithState(
        step, "demo_id bigint, event_id bigint, history string", "last array<bigint>", "append", GroupStateTimeout.NoTimeout)


def episode(steps: DataFrame) -> DataFrame:
    """Latch and length per key: counts events up to and including the first success, later ones change nothing
    (input: demo_id, ts, event_id, success). Emits the state after every batch; the largest length is the last one."""

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _ordered(pdfs, ["ts", "event_id"])
        done, length = state.get if state.exists else (False, 0)
        if not done:
            hits = np.flatnonzero(rows["success"].to_numpy(bool))
            done = bool(len(hits))
            length += int(hits[0]) + 1 if done else len(rows)
        state.update((done, length))
        yield pd.DataFrame({"demo_id": [key[0]], "success": [done], "length": [length]})

    return steps.groupBy("demo_id").applyInPandasWithState(
        step, "demo_id bigint, success boolean, length bigint", "done boolean, length bigint", "append", GroupStateTimeout.NoTimeout)


def segments(steps: DataFrame, debounce: int, idle: str = "10 days") -> DataFrame:
    """Debounced state changes (input: demo_id, ts, event_id, state with a watermark on ts).

    A change is given out when ``debounce`` events agree. A change that is still pending when the key has been idle
    past the watermark counts as well, the same as a change at the end of a recording.
    """
    need = max(1, debounce)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, cur, pend, at, count = state.get if state.exists else (0, -1, -1, -1, 0)
        out = []
        if state.hasTimedOut:
            if count:
                out.append((at, pend))
            state.remove()
        else:
            rows = _ordered(pdfs, ["ts", "event_id"])
            for s in rows["state"].astype(int):
                if cur < 0:
                    cur = s
                    out.append((n, s))
                elif s == cur:
                    pend, at, count = -1, -1, 0
                else:
                    at, count = (n, 1) if count == 0 or s != pend else (at, count + 1)
                    pend = s
                    if count >= need:
                        out.append((at, s))
                        cur, pend, at, count = s, -1, -1, 0
                n += 1
            state.update((n, cur, pend, at, count))
            last = int(rows["ts"].max().value // 1_000_000)
            state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"demo_id": [key[0]] * len(out), "t": [a for a, _ in out], "state": [b for _, b in out]})

    return steps.groupBy("demo_id").applyInPandasWithState(
        step, "demo_id bigint, t int, state int", "n int, cur int, pend int, at int, count int", "append", GroupStateTimeout.EventTimeTimeout)


def jumps(steps: DataFrame, limit: float) -> DataFrame:
    """Events whose value is more than ``limit`` away from the one before, with the running count per key
    (input: demo_id, ts, event_id, value)."""

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _ordered(pdfs, ["ts", "event_id"])
        prev, total = state.get if state.exists else (None, 0)
        v = rows["value"].to_numpy(float)
        delta = np.abs(np.diff(v, prepend=v[0] if prev is None else prev))
        hit = delta > limit
        counts = total + np.cumsum(hit)
        state.update((float(v[-1]), int(counts[-1])))
        yield pd.DataFrame({"demo_id": key[0], "event_id": rows["event_id"][hit], "step": delta[hit], "exceed": counts[hit]})

    return steps.groupBy("demo_id").applyInPandasWithState(
        step, "demo_id bigint, event_id bigint, step double, exceed bigint", "prev double, total bigint", "append", GroupStateTimeout.NoTimeout)


def temporal_patch(cands: DataFrame, weight: float, percentile: float) -> DataFrame:
    """The previous-point choice of operators.lifting.temporal_patch, kept per track between batches. Empty windows have a null position."""

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _ordered(pdfs, ["t"])
        prev = np.array(state.get) if state.exists else None
        picked = []
        for _, _, _, cx, cy, cz, z, dist in rows[["demo_id", "point_id", "t", "cx", "cy", "cz", "z", "pd"]].itertuples(index=False, name=None):
            xyz = np.stack([cx, cy, cz], axis=1)
            prev = xyz[choose_nearest(prev, xyz, np.asarray(z), np.asarray(dist), weight, percentile)] if len(xyz) else np.full(3, np.nan)
            picked.append(prev)
        state.update(tuple(float(c) for c in prev))
        out = np.array(picked)
        yield pd.DataFrame({"demo_id": key[0], "point_id": key[1], "t": rows["t"], "x": out[:, 0], "y": out[:, 1], "z": out[:, 2]})

    return cands.groupBy("demo_id", "point_id").applyInPandasWithState(
        step, "demo_id bigint, point_id bigint, t int, x double, y double, z double", "px double, py double, pz double", "append", GroupStateTimeout.NoTimeout)
