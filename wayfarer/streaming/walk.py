"""The arc-length walk over a stream of fixes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import TRACK, require_columns

_STEPS = ("offset_m double", "step_idx bigint", "frame double", "x double", "y double", "late bigint")
_STATE = "frame double, x double, y double, walked double, steps bigint"


def walk_arc_stream(fixes: DataFrame, step_length: float, offset: float = 0.0) -> DataFrame:
    """The steps of walk_arc() for one offset, each as soon as the fix that passes it is there.

    The state of a track is its last fix, the length walked and the steps made. Fixes are put in order within a batch;
    one whose frame isn't after the last comes too late to be walked along: it makes a row without step whose `late`
    counts such fixes of the batch. Missing fixes are bridged. The key has the types that fixes has.
    """
    require_columns(fixes, *TRACK, "frame", "x", "y")

    kinds = dict(fixes.dtypes)
    columns = [*[f"{c} {kinds[c]}" for c in TRACK], *_STEPS]
    names = [c.split()[0] for c in columns]

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).dropna(subset=["x", "y"]).sort_values("frame")
        last = state.get if state.exists else None
        out, late = [], 0
        for frame, x, y in rows[["frame", "x", "y"]].itertuples(index=False):
            if last is None:
                last = (frame, x, y, 0.0, 0)
                if offset == 0:
                    out.append((*key, offset, 0, frame, x, y, 0))
                    last = (frame, x, y, 0.0, 1)
                continue
            f0, x0, y0, walked, steps = last
            if frame <= f0:
                late += 1
                continue
            length = ((x - x0) ** 2 + (y - y0) ** 2) ** 0.5
            while length > 0 and (t := offset + steps * step_length) <= walked + length:
                share = (t - walked) / length
                out.append((*key, offset, steps, f0 + share * (frame - f0), x0 + share * (x - x0), y0 + share * (y - y0), 0))
                steps += 1
            last = (frame, x, y, walked + length, steps)
        if last is not None:
            state.update(last)
        if late:
            out.append((*key, offset, None, None, None, None, late))
        yield pd.DataFrame(out, columns=names).astype({"step_idx": "Int64", "late": "Int64"})

    ready = fixes.selectExpr(*TRACK, "cast(frame as double) as frame", "x", "y")
    return ready.groupBy(*TRACK).applyInPandasWithState(advance, ", ".join(columns), _STATE, "append", GroupStateTimeout.NoTimeout)
