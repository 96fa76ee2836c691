"""Statistics over action streams: rate limits, repeats, places, outcomes.

Every window is by run, so a run is the unit of work; runs are short beside the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .validate import RATE_LIMIT, RATE_WINDOW_MS

# Repeats of a proposal in one state, and in one place, that hint, skip and stop.
HINT_HERE, SKIP_HERE, STOP_HERE = 2, 3, 3
HINT_PLACE, SKIP_PLACE, STOP_PLACE = 3, 6, 6
#: Fixed value: lines of history that are shown.
HISTORY = 8


def rate(actions: DataFrame, run: str, at_ms: str, window_ms: int = RATE_WINDOW_MS, limit: int = RATE_LIMIT) -> DataFrame:
    """Adds recent (earlier actions of the run within the window, its edge included) and
    limited (as many as the limit)."""
    w = Window.partitionBy(run).orderBy(at_ms).rangeBetween(-window_ms, 0)
    same = F.count("*").over(Window.partitionBy(run, at_ms))
    nth = F.row_number().over(Window.partitionBy(run, at_ms).orderBy("event_id"))
    recent = F.count("*").over(w) - same + nth - 1
    return actions.withColumns({"recent": recent, "limited": recent >= limit})


def signature(kind: Column, target: Column) -> Column:
    return F.concat_ws("|", kind, target.cast("string"))


def repeats(actions: DataFrame, run: str, order: list[str], sign: Column, state: Column, place: Column) -> DataFrame:
    """Adds here (times that this proposal was made in this state so far), moved (the
    place differs from the step before), visit (number of the stay), there (times in
    this stay), tier (stop, skip, hint or go)."""
    by = Window.partitionBy(run).orderBy(*order)
    rows = actions.withColumns({"__sign": sign, "__state": state, "__place": place})
    rows = rows.withColumn("moved", F.coalesce(F.lag("__place").over(by) != F.col("__place"), F.lit(False)))
    rows = rows.withColumn("visit", F.sum(F.col("moved").cast("long")).over(by))
    rows = rows.withColumns({
        "here": F.count("*").over(Window.partitionBy(run, "__sign", "__state").orderBy(*order)),
        "there": F.count("*").over(Window.partitionBy(run, "visit", "__sign").orderBy(*order)),
    })
    here, there = F.col("here"), F.col("there")
    tier = (
        F.when((here > STOP_HERE) | (there > STOP_PLACE), "stop").when((here == SKIP_HERE) | (there == SKIP_PLACE), "skip")
        .when((here >= HINT_HERE) | (there >= HINT_PLACE), "hint").otherwise("go")
    )
    return rows.withColumn("tier", tier).drop("__sign", "__state", "__place")


# Milliseconds that a page gets to settle, by kind of action (and whether it submits).
SETTLE_MS = {"click": 1500, "click_point": 1500, "select": 1200, "key_press": 1200, "scroll": 400}


def settle_budget(kind: Column, submits: Column) -> Column:
    out = F.when(kind == "type", F.when(submits, 2500).otherwise(400))
    for name, ms in SETTLE_MS.items():
        out = out.when(kind == name, ms)
    return out.otherwise(150)


def expects_change(kind: Column, submits: Column) -> Column:
    return kind.isin("click", "click_point", "goto_url", "go_back", "go_forward", "key_press", "scroll") | ((kind == "type") & submits)


def quiet_periods(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Stretches of events closer than the gap: begin, finish, n. Works on streams, too."""
    s = F.session_window(ts, gap)
    return events.groupBy(key, s).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("finish"), "n")
