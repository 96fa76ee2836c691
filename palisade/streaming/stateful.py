"""The loop's counters over an unbounded action stream, keyed by run.

The batch forms are windows (``operators.loops``); these keep the same counters as state,
so that a stream gives the rows that the batch gives. State is one row a run: the last
place, the number of the stay, and counts of proposals.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.loops import HINT_HERE, HINT_PLACE, SKIP_HERE, SKIP_PLACE, STOP_HERE, STOP_PLACE
from ..sources.stored import shared_folder

_OUT = "event_id long, moved boolean, visit long, here long, there long, tier string"


def _tier(here: int, there: int) -> str:
    if here > STOP_HERE or there > STOP_PLACE:
        return "stop"
    if here == SKIP_HERE or there == SKIP_PLACE:
        return "skip"
    return "hint" if here >= HINT_HERE or there >= HINT_PLACE else "go"


def _count(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    place, visit, here, there = json.loads(state.get[0]) if state.exists else (None, 0, {}, {})
    rows = pd.concat(list(batches)).sort_values(["at_ms", "event_id"], kind="stable")
    out = []
    for r in rows.itertuples(index=False):
        moved = place is not None and place != r.place
        if moved:
            visit, there = visit + 1, {}
        place = r.place
        both = f"{r.sign}@{r.state}"
        here[both], there[r.sign] = here.get(both, 0) + 1, there.get(r.sign, 0) + 1
        out.append((r.event_id, moved, visit, here[both], there[r.sign], _tier(here[both], there[r.sign])))
    state.update((json.dumps((place, visit, here, there)),))
    yield pd.DataFrame(out, columns=["event_id", "moved", "visit", "here", "there", "tier"])


def repeat_tiers(actions: DataFrame) -> DataFrame:
    """actions (run, at_ms, event_id, sign, state, place: string), streaming; a micro-batch's
    actions of a run are taken in order of time, and later batches go on from its state."""
    rows = actions.select("run", "at_ms", "event_id", "sign", "state", "place")
    return rows.groupBy("run").applyInPandasWithState(_count, _OUT, "counts string", "append", "NoTimeout")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that the source has now, through the stream, as a table: files and checkpoint
    stand in the folder that driver and executors share."""
    spark: SparkSession = stream.sparkSession
    at = shared_folder(spark, name)
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
