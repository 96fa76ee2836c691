"""Replies of a model as actions: JSON found in prose, repaired, and read leniently.

Only the scanner that finds and closes the JSON is Python (it is a stack machine); all
that follows is JSON functions and expressions.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names of actions and what they stand for; the most actions of a reply.
ALIASES = {
    "click": "click", "click_point": "click_point", "type": "type", "fill": "type", "type_text": "type", "hover": "hover", "select": "select",
    "select_option": "select", "scroll": "scroll", "key_press": "key_press", "press": "key_press", "keyboard": "key_press", "goto_url": "goto_url",
    "goto": "goto_url", "navigate": "goto_url", "go_back": "go_back", "back": "go_back", "go_forward": "go_forward", "forward": "go_forward",
    "request_user_input": "request_user_input", "ask_user": "request_user_input", "ask": "request_user_input", "stop": "stop", "done": "stop",
    "finish": "stop", "noop": "noop", "wait": "noop",
}
MOST_ACTIONS = 8

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_MARK = re.compile(r'\\.|["{}\[\]]', re.S)


def find_json(raw: str | None) -> str | None:
    """The first JSON container in a reply, with missing closers added if that makes it valid."""
    text = (raw or "").strip()
    if m := _FENCE.search(text):
        text = m[1].strip()
    begin = re.search(r"[{\[]", text)
    if begin is None:
        return None
    body, open_, quoted = text[begin.start():], [], False
    for m in _MARK.finditer(body):
        c = m[0]
        if c == '"':
            quoted = not quoted
        elif quoted or c[0] == "\\":
            continue
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        else:
            if open_ and open_[-1] == c:
                open_.pop()
            if not open_:
                return body[: m.end()]
    closed = body + '"' * quoted + "".join(reversed(open_))
    try:
        json.loads(closed, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return None
    return closed


@F.pandas_udf(StringType())
def extracted_json(raw: pd.Series) -> pd.Series:
    return raw.map(find_json)


def _text(v: Column, path: str) -> Column:
    """A string member with something in it; null for any other."""
    own = F.try_variant_get(v, path, "string")
    return F.when((F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING") & (F.trim(own) != ""), own)


def actions(replies: DataFrame, raw: str = "reply") -> DataFrame:
    """``replies`` with ok, error, n_actions, action (the first one's type) and target.

    A reply may hold {"actions": [..]}, {"action": {..}}, {"action": [..]}, {"steps": [..]}
    or an action itself. Any action that lacks what its type needs fails the reply."""
    v = F.try_parse_json(extracted_json(F.col(raw)))
    rows = replies.withColumn("__v", v)
    listed = lambda path: F.try_variant_get("__v", path, "array<variant>")
    own = F.coalesce(listed("$.actions"), listed("$.action"), listed("$.steps"), listed("$"))
    inner = F.try_variant_get("__v", "$.action", "variant")
    is_object = lambda x: F.schema_of_variant(x).startswith("OBJECT")
    records = F.when(own.isNotNull(), F.slice(own, 1, MOST_ACTIONS)).when(is_object(inner), F.array(inner)).when(is_object(F.col("__v")), F.array("__v"))
    rows = rows.withColumn("__records", records)

    def problem(a: Column) -> Column:
        kind = _kind(a)
        target = F.coalesce(_text(a, "$.target"), _text(a, "$.element_id"))
        number = lambda p: F.try_variant_get(a, p, "double")
        value = lambda *paths: F.coalesce(*[F.try_variant_get(a, p, "variant").cast("string") for p in paths])
        return (
            F.when(_text(a, "$.type").isNull(), "no_type").when(kind.isNull(), "unknown_type")
            .when((kind == "click") & target.isNull(), "no_target").when((kind == "type") & target.isNull(), "no_target")
            .when(kind.isin("hover", "select") & _text(a, "$.target").isNull(), "no_target")
            .when((kind == "type") & value("$.value", "$.text").isNull(), "no_value").when((kind == "select") & value("$.option", "$.value").isNull(), "no_value")
            .when((kind == "click_point") & (F.coalesce(number("$.point.x"), number("$.x")).isNull() | F.coalesce(number("$.point.y"), number("$.y")).isNull()), "no_point")
            .when((kind == "key_press") & F.coalesce(_text(a, "$.keys"), _text(a, "$.key")).isNull(), "no_keys").when((kind == "goto_url") & _text(a, "$.url").isNull(), "no_url")
        )

    first = F.get("__records", F.lit(0))
    error = (
        F.when(F.col("__v").isNull(), "no_json").when(F.col("__records").isNull(), "no_record").when(F.size("__records") == 0, "empty")
        .otherwise(F.get(F.filter(F.transform("__records", problem), lambda p: p.isNotNull()), F.lit(0)))
    )
    out = rows.withColumn("error", error)
    ok = F.col("error").isNull()
    return out.withColumns({
        "ok": ok, "n_actions": F.when(ok, F.size("__records")).otherwise(F.lit(0)), "action": F.when(ok, _kind(first)),
        "target": F.when(ok, F.coalesce(_text(first, "$.target"), _text(first, "$.element_id"))),
    }).drop("__v", "__records")


def _kind(a: Column) -> Column:
    """The action's type by its alias; null for an unknown one."""
    said = F.regexp_replace(F.lower(_text(a, "$.type")), r"[\s-]", "_")
    return F.element_at(F.create_map(*[F.lit(x) for p in ALIASES.items() for x in p]), said)


# A plan's longest goal, step and site, and the most steps.
GOAL_CHARS, STEP_CHARS, SITE_CHARS, MOST_STEPS = 300, 180, 120, 6


def plan_of(raw: Column) -> Column:
    """struct(goal, steps, site) of a planner's reply: from the first brace to the last."""
    bare = F.regexp_replace(raw, r"```(?:json)?", "")
    v = F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1))
    steps = F.filter(F.try_variant_get(v, "$.steps", "array<string>"), lambda s: F.trim(s) != "")
    site = F.trim(F.try_variant_get(v, "$.site", "string"))
    return F.struct(
        F.substring(F.try_variant_get(v, "$.goal", "string"), 1, GOAL_CHARS).alias("goal"), F.slice(F.transform(steps, lambda s: F.substring(s, 1, STEP_CHARS)), 1, MOST_STEPS).alias("steps"),
        F.when((site != "") & (F.lower(site) != "null"), F.substring(site, 1, SITE_CHARS)).alias("site"),
    )
