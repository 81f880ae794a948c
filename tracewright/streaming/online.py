"""Speeds of segments on a stream of positions, a state of one position for each trace."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.routing import metres
from ..operators.traces import SPEED_RANGE

OUTPUT = "traj_id long, ts long, dist double, elapsed long, speed double"
STATE = "ts long, lat double, lon double"


def online_speeds(stream: DataFrame) -> DataFrame:
    """traj_id, ts, dist, elapsed, speed between each position and the latest before it, as they arrive; odd speeds and late rows go.

    ``stream`` has traj_id, ts, lat, lon. Rows that are older than the state of their trace are dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        last = state.get if state.exists else None
        out = []
        for ts, lat, lon in rows[["ts", "lat", "lon"]].itertuples(index=False):
            if last is not None:
                if ts <= last[0]:
                    continue
                d = float(metres(last[1], last[2], lat, lon))
                speed = d / (ts - last[0])
                if SPEED_RANGE[0] <= speed <= SPEED_RANGE[1]:
                    out.append((int(key[0]), int(ts), d, int(ts - last[0]), speed))
            last = (int(ts), float(lat), float(lon))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["traj_id", "ts", "dist", "elapsed", "speed"])

    return stream.select("traj_id", "ts", "lat", "lon").groupBy("traj_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
