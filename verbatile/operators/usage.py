"""Logs of coding assistants: events to calls, tasks, timelines and reports. Rows are JSON lines (file, line, value) or tables of them.

Lines that are no JSON are left out. Null sessions are one session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatile.functions import display

ATTRS = "struct<content:string,response:string,model:string,debugName:string,userRequest:string,details:string,inputTokens:bigint,cachedTokens:bigint,outputTokens:bigint,reasoningTokens:bigint,copilotUsageNanoAiu:bigint,ttft:bigint>"
EVENT = f"type string, sid string, ts bigint, dur bigint, status string, name string, attrs {ATTRS}"


def events(lines: DataFrame) -> DataFrame:
    """file, line and the fields of each JSON line that has a type."""
    d = lines.select("file", "line", F.from_json("value", EVENT).alias("e"))
    return d.where("e.type IS NOT NULL").select("file", "line", "e.*")


def model_requests(logged: DataFrame) -> DataFrame:
    """One row per model call but those that make titles: file, call_index and its counters."""
    a = F.col("attrs")
    d = logged.where((F.col("type") == "llm_request") & ~F.coalesce(a["debugName"] == "title", F.lit(False)))
    number = lambda k: F.coalesce(a[k], F.lit(0))
    cached = F.least(number("inputTokens"), number("cachedTokens"))
    return d.select(
        "file", F.row_number().over(Window.partitionBy("file").orderBy("line")).alias("call_index"), display.iso_millis(F.col("ts")).alias("timestamp"),
        F.coalesce(F.nullif(a["model"], F.lit("")), F.lit("(unknown)")).alias("model"), number("inputTokens").alias("input_tokens"), cached.alias("cached_input_tokens"),
        (number("inputTokens") - cached).alias("fresh_input_tokens"), number("outputTokens").alias("output_tokens"),
        (number("inputTokens") + number("outputTokens")).alias("total_tokens"), (number("copilotUsageNanoAiu") / F.lit(1_000_000_000)).alias("aiu"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
    )


def active_file(request: Column) -> Column:
    """The file that a request says is open: of its text, or of the texts of a JSON array."""
    text = F.coalesce(F.array_join(F.from_json(request, "array<struct<text:string>>")["text"], "\n"), request)
    found = F.trim(F.regexp_extract(text, r"The user's current file is (.*?)(?:\.\s*\n|\n)", 1))
    return F.when(found != "", found)


def sessions(logged: DataFrame) -> DataFrame:
    """One row per file that has a user's message and a model call: prompt, active file, models, calls, tool calls, counters, errors,
    seconds. Sessions without either are no tasks."""
    calls = model_requests(logged)
    of_calls = calls.groupBy("file").agg(
        F.count(F.lit(1)).alias("model_calls"), F.array_join(F.array_sort(F.collect_set("model")), ", ").alias("models"),
        *[F.sum(c).alias(c) for c in ("input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")], F.sum("aiu").alias("aiu"),
    )
    said = F.when((F.col("type") == "user_message") & (F.col("attrs.content") != ""), F.struct("line", F.col("attrs.content").alias("v")))
    asked = F.when((F.col("type") == "llm_request") & ~F.coalesce(F.col("attrs.debugName") == "title", F.lit(False)), F.struct("line", F.col("attrs.userRequest").alias("v")))
    whole = logged.groupBy("file").agg(
        F.min(said)["v"].alias("prompt"), F.min(asked)["v"].alias("request"), F.count(F.when(F.col("type") == "tool_call", 1)).alias("tool_calls"),
        F.count(F.when(F.col("status") != "ok", 1)).alias("errors"), ((F.max("ts") - F.min("ts")) / F.lit(1000)).alias("seconds"), F.min("ts").alias("began"),
    )
    d = whole.where("prompt IS NOT NULL").join(of_calls, "file")
    return d.select("file", display.prompt_preview(F.col("prompt")).alias("prompt"), active_file(F.col("request")).alias("active_file"), display.iso_millis(F.col("began")).alias("began"), "seconds", "tool_calls", "errors", *of_calls.columns[1:])


def timeline(logged: DataFrame, most: int = 350) -> DataFrame:
    """file, nth, time, step, details, status, duration of what a reader of a session wants to see; model turns are numbered."""
    kind, a = F.col("type"), F.col("attrs")
    by_time = Window.partitionBy("file").orderBy("ts", "line")
    d = logged.where(kind.isin("user_message", "tool_call", "agent_response") | (kind == "llm_request") & ~F.coalesce(a["debugName"] == "title", F.lit(False)))
    turn = F.sum(F.when(kind == "llm_request", 1).otherwise(0)).over(by_time)
    step = F.when(kind == "user_message", "User prompt").when(kind == "llm_request", F.concat(F.lit("Model turn "), turn.cast("string"))).when(kind == "tool_call", "Tool").otherwise("Agent response")
    said = F.coalesce(display.collapsed(a["response"]), F.lit(""))
    details = (
        F.when(kind == "user_message", F.substring(F.coalesce(display.collapsed(a["content"]), F.lit("")), 1, most))
        .when(kind == "llm_request", F.coalesce(a["model"], F.lit("(unknown)"))).when(kind == "tool_call", F.coalesce("name", F.lit("(unknown tool)")))
        .otherwise(F.when(F.length(said) > most, F.concat(F.substring(said, 1, most), F.lit("…"))).otherwise(said))
    )
    timed = kind.isin("llm_request", "tool_call")
    d = d.select("file", "ts", "line", step.alias("step"), details.alias("details"), F.when(kind == "user_message", "—").otherwise(F.coalesce("status", F.when(timed, "unknown").otherwise("—"))).alias("status"), F.when(timed, F.concat(F.format_number(F.coalesce("dur", F.lit(0)), 0), F.lit(" ms"))).otherwise("—").alias("duration"))
    d = d.where((F.col("step") != "Agent response") | (F.col("details") != ""))
    return d.select("file", F.row_number().over(by_time).alias("nth"), display.iso_millis(F.col("ts")).alias("time"), "step", "details", "status", "duration")


def parent_edges(nodes: DataFrame, key: str, order: str, node: str) -> DataFrame:
    """nodes with parent: the node before it, null for the first."""
    return nodes.withColumn("parent", F.lag(node).over(Window.partitionBy(key).orderBy(order)))


def buckets(lines: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """One row per bucket of a JSON map of rate limits that says how much of it is used."""
    kind = "map<string, struct<used_percent:double, window_minutes:bigint, resets_in_seconds:bigint>>"
    d = lines.select(*keep, F.explode(F.from_json(json, kind)).alias("bucket", "v"))
    none = lambda c: F.nullif(F.col(c), F.lit(0))
    return d.where("v.used_percent IS NOT NULL").select(*keep, "bucket", F.col("v.used_percent").alias("used_percent"), none("v.window_minutes").alias("window_minutes"), none("v.resets_in_seconds").alias("resets_in_seconds"))


def valid_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that asked a model something."""
    return tasks.where((F.coalesce("model_calls", F.lit(0)) > 0) & F.col("prompt").isNotNull())


def calls_of(calls: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """The calls whose keys, all of them, some task has."""
    return calls.join(tasks.select(*keys).distinct(), keys, "left_semi")


def unfinished(tasks: DataFrame, status: str = "status", began: str = "began") -> DataFrame:
    """Tasks that aren't completed (null: not), the latest first."""
    return tasks.where(~F.coalesce(F.col(status) == "completed", F.lit(False))).orderBy(F.desc(began))


def histogram(values: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """bin (from 0), low, n: counts in bins of equal width between least and greatest value; the greatest is in the last bin, and
    equal values are all in bin 0. Nulls are left out."""
    d = values.where(F.col(column).isNotNull())
    ends = d.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    met = d.crossJoin(F.broadcast(ends))  # one row
    return met.groupBy(at.alias("bin"), (F.col("lo") + at * width).alias("low")).agg(F.count(F.lit(1)).alias("n"))


def blocks(texts: DataFrame, marker: str, id_col: str = "file", text_col: str = "text") -> DataFrame:
    """id_col, nth (from 1), block: a log cut before each match of marker at a line's beginning; what stands before the first is left
    out."""
    parts = F.split(F.col(text_col), f"(?m)(?=^(?:{marker}))")
    d = texts.select(id_col, F.posexplode(parts).alias("at", "block")).where(F.col("block").rlike(f"(?m)\\A(?:{marker})"))
    return d.select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("at")).alias("nth"), "block")


def first_findings(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first rows of each key by order; none if most is 0 or less."""
    if most <= 0:
        return rows.limit(0)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("__v_nth", nth).where(F.col("__v_nth") <= most).drop("__v_nth")
