"""Per-key detectors over run-log streams: surprise threshold, family competence, novelty.

Rows of a key are taken in step order inside a micro-batch and in arrival order across them.  State is
a handful of numbers and one bounded ring per key.
"""
from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import learn

NO_TIMEOUT = GroupStateTimeout.NoTimeout


def _sorted(frames: Iterable[pd.DataFrame], step: str) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(step, kind="stable")


def _ddl(df: DataFrame, cols: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in cols)


def surprise(errors: DataFrame, keys: list[str], step: str = "step", error: str = "error",
             history: int = learn.HISTORY) -> DataFrame:
    """Streaming form of ``learn.surprise``: the threshold and the ring of past errors are the state."""
    def judge(key, frames, state):
        threshold, ring = state.get if state.exists else (learn.START, [])
        ring = list(ring)
        rows = _sorted(frames, step)
        out = []
        for s, e in zip(rows[step], rows[error]):
            past = float(np.mean(ring)) if ring else None
            before = threshold
            ring = (ring + [float(e)])[-history:]
            if len(ring) >= learn.WARM_UP:
                goal = learn.TARGET * float(np.mean(ring[-learn.WARM_UP:]))
                threshold = min(max(threshold + learn.RATE * (goal - threshold), learn.LOW), learn.HIGH)
            out.append((*key, s, e, before, threshold, e > before, e if past is None else e / (past + 1e-8)))
        state.update((threshold, ring))
        yield pd.DataFrame(out, columns=[*keys, step, error, "threshold", "threshold_after", "surprising", "novelty"])

    schema = (_ddl(errors, [*keys, step]) + f", `{error}` double, threshold double, threshold_after double, "
              "surprising boolean, novelty double")
    return errors.groupBy(*keys).applyInPandasWithState(
        judge, schema, "threshold double, ring array<double>", "append", NO_TIMEOUT)


def competence(errors: DataFrame, keys: list[str], step: str = "step", error: str = "error",
               window: int = learn.WINDOW) -> DataFrame:
    """Streaming form of ``learn.competence``: one updated row per key and micro-batch."""
    def judge(key, frames, state):
        ring = list(state.get[0]) if state.exists else []
        ring = (ring + [float(e) for e in _sorted(frames, step)[error]])[-window:]
        state.update((ring,))
        full, mean = len(ring) >= window, float(np.mean(ring))
        old, new = float(np.mean(ring[:window // 2] or [0.0])), float(np.mean(ring[window // 2:] or [0.0]))
        progress = (old - new) / old if full and old > 1e-8 else 0.0
        noise = float(np.std(ring)) / (mean + 1e-8) if full else 0.0
        stuck = full and mean > learn.HIGH_ERROR and not progress > learn.PROGRESS
        yield pd.DataFrame([(*key, len(ring), mean, progress, noise, full and mean < learn.MASTERED,
                             progress > learn.PROGRESS, stuck and noise > learn.NOISE,
                             stuck and noise <= learn.NOISE)],
                           columns=[*keys, "n", "mean_error", "progress", "noise_ratio", "mastered", "improving",
                                    "noisy", "needs_capacity"])

    schema = (_ddl(errors, keys) + ", n bigint, mean_error double, progress double, noise_ratio double, "
              "mastered boolean, improving boolean, noisy boolean, needs_capacity boolean")
    return errors.groupBy(*keys).applyInPandasWithState(
        judge, schema, "ring array<double>", "update", NO_TIMEOUT)


def novelty(runs: DataFrame, keys: list[str], step: str = "step", signature: str = "signature") -> DataFrame:
    """Streaming form of ``learn.novelty``: a counter per key and signature."""
    def count(key, frames, state):
        seen = state.get[0] if state.exists else 0
        # only the steps are read and one frame is made: a group is often a few rows, and each pandas call costs more than they do
        steps = [f[step] for f in frames]
        steps = steps[0] if len(steps) == 1 else pd.concat(steps, ignore_index=True)
        steps = np.sort(steps.to_numpy()) if steps.dtype.kind in "iu" else steps.sort_values(kind="stable").to_numpy()
        n = np.arange(seen + 1, seen + 1 + len(steps))
        state.update((int(n[-1]),))
        yield pd.DataFrame({**dict(zip([*keys, signature], key)), step: steps, "times_seen": n, "is_new": n == 1, "reward": 1 / np.sqrt(n)}, copy=False)

    schema = _ddl(runs, [*keys, signature, step]) + ", times_seen bigint, is_new boolean, reward double"
    return runs.groupBy(*keys, signature).applyInPandasWithState(
        count, schema, "seen bigint", "append", NO_TIMEOUT)


def ema(rows: DataFrame, keys: list[str], step: str = "step", value: str = "value", alpha: float = 0.1,
        start: float = 0.0) -> DataFrame:
    """Streaming form of ``learn.ema``."""
    def fold(key, frames, state):
        current = state.get[0] if state.exists else start
        data = _sorted(frames, step)
        out = []
        for s, v in zip(data[step], data[value]):
            current = alpha * float(v) + (1 - alpha) * current
            out.append((*key, s, current))
        state.update((current,))
        yield pd.DataFrame(out, columns=[*keys, step, "ema"])

    return rows.groupBy(*keys).applyInPandasWithState(
        fold, _ddl(rows, [*keys, step]) + ", ema double", "current double", "append", NO_TIMEOUT)
