"""Chains and ledgers as streams (an extension: the batch operators are the definition).

Steps of a chain arrive in order, any number at a time; the state of a chain is a
few numbers for each threshold, so it stays small however long the stream runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REACH = "trial bigint, threshold string, reached_step int, failed_step int, steps int"


def first_reach(steps: DataFrame, thresholds: list[float]) -> DataFrame:
    """The running first reach of each chain and threshold, in update mode.

    ``steps``: a stream of (trial, step, restored, functional, similarity). A
    reached step never changes; after a failure none is reached any more. Steps
    that were seen before are ignored, so replays do no harm.
    """
    ordered = sorted(thresholds)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, failed, *reached = state.get if state.exists else (0, 0, *[0] * len(ordered))
        for step in pd.concat(list(frames)).sort_values("step").itertuples():
            if step.step <= seen:
                continue
            seen = int(step.step)
            if failed:
                continue
            if not step.functional:
                failed = seen
                continue
            if step.restored and step.similarity == step.similarity and step.similarity is not None:
                reached = [r or (seen if step.similarity >= t else 0) for r, t in zip(reached, ordered)]
        state.update((seen, failed, *reached))
        yield pd.DataFrame([(key[0], f"{t:.2f}", r or None, failed or None, seen) for t, r in zip(ordered, reached)], columns=["trial", "threshold", "reached_step", "failed_step", "steps"]).astype({"reached_step": "Int32", "failed_step": "Int32"})

    kept = "seen int, failed int, " + ", ".join(f"r{i} int" for i in range(len(ordered)))
    return steps.groupBy("trial").applyInPandasWithState(advance, REACH, kept, "update", GroupStateTimeout.NoTimeout)


def ledger_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls, known cost and errors by tumbling window and status; what comes later than ``late`` is left out."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type")
    return windowed.agg(F.count("*").alias("calls"), F.sum("value").alias("cost")).select("w.start", "event_type", "calls", "cost")


def appended(spark, path: str, schema: str) -> DataFrame:
    """An append-only folder of JSON lines as a stream."""
    return spark.readStream.schema(schema).json(path)
