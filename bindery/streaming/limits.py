"""Token buckets over event time, for replaying what a rate limit would have let pass."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited(stream: DataFrame, key: str, time: str, per_second: float, refused: str | None = None) -> DataFrame:
    """``key, time, delay_seconds``: how long each event of a key must wait for a token of its bucket, which
    holds one second's worth and refills steadily. Works on streams whose events come in order of time
    within a micro-batch and key. ``refused`` names a boolean column: a call that was refused and told when to come again
    empties the bucket; null is no refusal."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        burst = max(1.0, per_second)
        tokens, last = state.get if state.exists else (burst, None)
        for pdf in batches:
            pdf = pdf.sort_values(time)
            delays = []
            empties = pdf[refused].fillna(False).astype(bool) if refused else [False] * len(pdf)
            for empty, at in zip(empties, pdf[time].astype("int64") / (1e9 if str(pdf[time].dtype).find("[ns") > 0 else 1e6)):
                if last is not None:
                    tokens = min(burst, tokens + max(0.0, at - last) * per_second)
                last = at if last is None else max(at, last)
                tokens -= 1
                delays.append(max(0.0, -tokens / per_second))
                tokens = min(tokens, 0.0) if empty else tokens
            yield pd.DataFrame({key: name[0], time: pdf[time], "delay_seconds": delays})
        state.update((tokens, last))

    kinds = dict(stream.dtypes)
    return stream.select(key, time, *([refused] if refused else [])).groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, {time} {kinds[time]}, delay_seconds double", "tokens double, last double", "append", GroupStateTimeout.NoTimeout
    )
