"""Registered queries: assistants' logs, labels, dates and counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbatile.functions import display
from verbatile.operators import usage
from verbatile.plans.catalog import query, read


def literal(v: str | None) -> str:
    """A string as SQL; line feeds as chr(10)."""
    return "NULL" if v is None else "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in v.split("\n")) + ")"


def choice(cases: list[str | None], number: str) -> str:
    """SQL for the case whose place is number modulo their count."""
    return f"([{', '.join(map(literal, cases))}])[({number} % {len(cases)} + 1)::INT]"


def chosen(cases: list[str | None], number: str) -> Column:
    return F.get(F.array(*[F.lit(c).cast("string") for c in cases]), (F.col(number) % len(cases)).cast("int"))


# Dates, durations, numbers

@query("""SELECT o_orderkey,
CASE WHEN x >= 1e9 THEN printf('%.2fB', x / 1e9) WHEN x >= 1e6 THEN printf('%.2fM', x / 1e6) WHEN x >= 1e3 THEN printf('%.1fK', x / 1e3) ELSE printf('%.0f', x) END AS short,
CASE WHEN o_orderkey % 7 = 0 THEN '—' ELSE printf('%.1f%%', (o_orderkey % 100 + 0.27)) END AS share,
printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS clock,
CASE WHEN s < 1 THEN '0 ms' WHEN s < 60 THEN printf('%.1f s', s::DOUBLE) WHEN s < 3600 THEN printf('%.1f m', s / 60) ELSE printf('%.1f h', s / 3600) END AS spoken,
printf('%02d:%02d:%02d.%03d', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) AS vtt, printf('%d:%02d:%02d.%02d', h // 360000, h // 6000 % 60, h // 100 % 60, h % 100) AS ass,
(128000 * s // 8)::BIGINT AS bytes
FROM (SELECT o_orderkey, o_totalprice * 1.000713 * 10 ** (o_orderkey % 7)::INT AS x, (o_orderkey * 37 % 100000)::BIGINT AS s0, s0 - (s0 % 3 = 0 AND s0 > 60)::INT AS s, (o_orderkey * 37037)::BIGINT AS m, (o_orderkey * 3703 + (o_orderkey % 2))::BIGINT AS h FROM orders)""")
def number_formats(spark, sf_dir):
    s = (F.col("o_orderkey") * 37) % 100000
    s = s - F.when((s % 3 == 0) & (s > 60), 1).otherwise(0)  # no ties of rounding, which the two engines break differently
    d = read(spark, sf_dir, "orders").withColumn("x", F.col("o_totalprice") * 1.000713 * F.pow(F.lit(10.0), F.col("o_orderkey") % 7))
    return d.select(
        "o_orderkey", display.short_number(F.col("x")).alias("short"), display.percent(F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 100 + 0.27) / 100)).alias("share"),
        display.clock(s + 0.5).alias("clock"), display.spoken_duration(s.cast("double")).alias("spoken"), display.vtt_time(F.col("o_orderkey") * 37037 / 1000).alias("vtt"),
        display.ass_time((F.col("o_orderkey") * 3703 + F.col("o_orderkey") % 2) / 100).alias("ass"), display.size_of_stream(F.lit(128000), s).alias("bytes"),
    )


TIMES = ["2024-03-01T10:00:00Z", "2024-03-01T12:30:00+02:00", "2024-03-01T10:00:07.250Z", "2024-03-01", "not a time", None, "2024-02-29T23:59:59-05:30"]


@query(f"""WITH t AS (SELECT event_id, {choice(TIMES, 'event_id')} AS a, {choice(TIMES, '(event_id // 7)')} AS b FROM events),
m AS (SELECT *, CASE WHEN contains(a, ':') THEN epoch_us(try_cast(a AS TIMESTAMPTZ)) END AS x, CASE WHEN contains(b, ':') THEN epoch_us(try_cast(b AS TIMESTAMPTZ)) END AS y FROM t)
SELECT event_id, coalesce(regexp_matches(a, '(Z|[+-][0-9][0-9]:[0-9][0-9])$'), false) AS offset_told, CASE WHEN x IS NULL OR y IS NULL THEN NULL ELSE greatest(0, (y - x) / 1e6) END AS seconds,
strftime(make_timestamp((1700000000000 + event_id * 250) * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 4 = 0 THEN '' ELSE '.' || lpad((event_id * 250 % 1000)::VARCHAR, 3, '0') || '000' END || 'Z' AS iso,
strftime(ts + INTERVAL '5 hours 30 minutes', '%b %d %H:%M') AS shown
FROM m JOIN events USING (event_id)""")
def time_functions(spark, sf_dir):
    d = read(spark, sf_dir, "events").withColumns({"a": chosen(TIMES, "event_id"), "n": F.floor(F.col("event_id") / 7)}).withColumn("b", chosen(TIMES, "n"))
    whole = lambda c: F.when(F.contains(c, F.lit(":")), c)  # noqa: E731  times, not days
    return d.select(
        "event_id", display.has_offset(F.col("a")).alias("offset_told"), display.seconds_between(whole(F.col("a")), whole(F.col("b"))).alias("seconds"),
        display.iso_millis(F.lit(1700000000000) + F.col("event_id") * 250).alias("iso"), display.shown_time(F.col("ts").cast("timestamp_ntz"), "Asia/Kolkata").alias("shown"),
    )


PROMPTS = ["Please  fix the\n build. Then run it again. ", "Can you tell me? Yes! ", "short. But this goes on! And on", None, "  ", "i need you to " + "rename everything " * 8, "What is this about here? A test."]
PATHS = ["/home/a/repo/", "C:\\work\\site", "", None, "plain", "/srv/x/y/z"]


@query(f"""WITH p AS (SELECT conv_id, turn, {choice(PROMPTS, '(conv_id + turn)')} AS t, {choice(PATHS, '(conv_id + turn)')} AS w, role FROM conversations),
c AS (SELECT *, nullif(trim(regexp_replace(t, '\\s+', ' ', 'g')), '') AS x FROM p),
l AS (SELECT *, trim(CASE WHEN starts_with(lower(x), 'please ') THEN x[8:] WHEN starts_with(lower(x), 'can you ') THEN x[9:] WHEN starts_with(lower(x), 'i need you to ') THEN x[15:] ELSE x END) AS y FROM c),
s AS (SELECT *, list_min(list_filter([instr(y, '. '), instr(y, '? '), instr(y, '! ')], lambda q: q > 16)) AS stop FROM l),
f AS (SELECT *, CASE WHEN stop IS NULL THEN y ELSE y[:stop] END AS z FROM s),
n AS (SELECT *, regexp_replace(coalesce(w, ''), '[/\\\\]+$', '') AS v FROM f),
q AS (SELECT *, CASE WHEN length(z) <= 90 THEN z ELSE rtrim(z[:89]) || '…' END AS title, CASE WHEN v = '' THEN '(unknown)' ELSE regexp_extract(v, '([^/\\\\]*)$', 1) END AS project FROM n)
SELECT conv_id, turn, title, substr(x, 1, 500) AS preview, project,
CASE WHEN trim(coalesce(title, '')) <> '' THEN title ELSE 'noon · ' || project || ' · Task ' || turn || ' · ' || right('session-' || (100000 + conv_id), 6) END AS label FROM q""")
def prompt_labels(spark, sf_dir):
    d = read(spark, sf_dir, "conversations").withColumn("n", F.col("conv_id") + F.col("turn"))
    d = d.select("conv_id", "turn", chosen(PROMPTS, "n").alias("t"), chosen(PATHS, "n").alias("w"))
    d = d.select("conv_id", "turn", display.prompt_title(F.col("t")).alias("title"), display.prompt_preview(F.col("t")).alias("preview"), display.project_of(F.col("w")).alias("project"))
    session = F.concat(F.lit("session-"), (F.col("conv_id") + 100000).cast("string"))
    return d.withColumn("label", display.task_label(F.col("title"), F.lit("noon"), F.col("project"), F.col("turn"), session))


RECORDS = ['{"input_tokens": 5, "output_tokens": -3, "total_tokens": "8"}', '{"input_tokens": "x"}', "[1]", None, '{"cached_input_tokens": 2, "reasoning_output_tokens": 4, "input_tokens": 3}']


@query(f"""WITH r AS (SELECT event_id, {choice(RECORDS, 'event_id')} AS r FROM events)
SELECT event_id, greatest(0, coalesce(try_cast(r->>'$.input_tokens' AS BIGINT), 0)) AS input_tokens, greatest(0, coalesce(try_cast(r->>'$.cached_input_tokens' AS BIGINT), 0)) AS cached_input_tokens,
greatest(0, coalesce(try_cast(r->>'$.output_tokens' AS BIGINT), 0)) AS output_tokens, greatest(0, coalesce(try_cast(r->>'$.reasoning_output_tokens' AS BIGINT), 0)) AS reasoning_output_tokens,
greatest(0, coalesce(try_cast(r->>'$.total_tokens' AS BIGINT), 0)) AS total_tokens FROM r""")
def usage_records(spark, sf_dir):
    d = read(spark, sf_dir, "events").withColumn("r", chosen(RECORDS, "event_id"))
    return d.select("event_id", display.usage_counters(F.col("r")).alias("u")).select("event_id", "u.*")


LIMITS = ['{"primary": {"used_percent": 12.5, "window_minutes": 300}, "secondary": {"used_percent": 3, "window_minutes": 0, "resets_in_seconds": 60}}', '{"primary": {"window_minutes": 5}}', "no", None]


@query(f"""WITH r AS (SELECT event_id, try_cast({choice(LIMITS, 'event_id')} AS JSON) AS j FROM events),
k AS (SELECT event_id, unnest(['primary', 'secondary']) AS bucket, j FROM r)
SELECT event_id, bucket, (json_extract_string(j, '$.' || bucket || '.used_percent'))::DOUBLE AS used_percent, nullif((json_extract_string(j, '$.' || bucket || '.window_minutes'))::BIGINT, 0) AS window_minutes,
nullif((json_extract_string(j, '$.' || bucket || '.resets_in_seconds'))::BIGINT, 0) AS resets_in_seconds FROM k WHERE json_extract_string(j, '$.' || bucket || '.used_percent') IS NOT NULL""")
def rate_limits(spark, sf_dir):
    return usage.buckets(read(spark, sf_dir, "events").withColumn("r", chosen(LIMITS, "event_id")), "r", ["event_id"])


# Sessions of an assistant, made from conversations: each turn logs a message or a model call.

LOG = """l AS (SELECT conv_id::VARCHAR AS file, turn AS line, role, text, conv_id, turn, 1700000000000 + conv_id * 100000 + turn * 1500 AS ts,
CASE WHEN role = 'user' THEN 'user_message' WHEN turn % 4 = 3 THEN 'tool_call' ELSE 'llm_request' END AS type, CASE WHEN turn % 5 = 4 THEN 'error' ELSE 'ok' END AS status,
CASE WHEN turn % 6 = 5 THEN 'title' END AS debug, 'm' || (turn % 3) AS model, (100 + turn)::BIGINT AS input_tokens, (90 + 4 * turn)::BIGINT AS cached, (7 * turn)::BIGINT AS output_tokens, (conv_id * 1000)::BIGINT AS nano FROM conversations),
c AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS call_index FROM l WHERE type = 'llm_request' AND debug IS NULL)"""


def logged(spark, sf_dir):
    turn = F.col("turn")
    kind = F.when(F.col("role") == "user", "user_message").when(turn % 4 == 3, "tool_call").otherwise("llm_request")
    call = kind == "llm_request"
    attrs = F.struct(
        F.when(kind == "user_message", F.col("text")).alias("content"), F.when(call, F.concat(F.lit("m"), (turn % 3).cast("string"))).alias("model"),
        F.when(call & (turn % 6 == 5), "title").alias("debugName"), F.when(call, turn + 100).alias("inputTokens"), F.when(call, turn * 4 + 90).alias("cachedTokens"),
        F.when(call, turn * 7).alias("outputTokens"), F.when(call, F.col("conv_id") * 1000).alias("copilotUsageNanoAiu"),
        F.when(call, F.concat(F.lit("x\nThe user's current file is /src/f"), F.col("conv_id").cast("string"), F.lit(".py.\nmore"))).alias("userRequest"),
    )
    event = F.struct(kind.alias("type"), F.col("conv_id").cast("string").alias("sid"), (F.lit(1700000000000) + F.col("conv_id") * 100000 + turn * 1500).alias("ts"), F.when(turn % 5 == 4, "error").otherwise("ok").alias("status"), F.lit(1234567).alias("dur"), F.when(turn % 4 == 3, "grep").alias("name"), attrs.alias("attrs"))
    lines = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file"), turn.alias("line"), F.to_json(event).alias("value"))
    broken = lines.groupBy("file").agg(F.max("line").alias("line")).select("file", (F.col("line") + 1).alias("line"), F.lit("{not json").alias("value"))
    return usage.events(lines.unionByName(broken))


@query(f"""WITH {LOG} SELECT file, call_index, model, input_tokens, least(input_tokens, cached) AS cached_input_tokens, input_tokens - least(input_tokens, cached) AS fresh_input_tokens, output_tokens,
input_tokens + output_tokens AS total_tokens, nano / 1e9 AS aiu, status FROM c""")
def assistant_calls(spark, sf_dir):
    return usage.model_requests(logged(spark, sf_dir)).drop("timestamp")


@query(f"""WITH {LOG}, s AS (SELECT file, count(*) AS model_calls, string_agg(DISTINCT model, ', ' ORDER BY model) AS models, sum(input_tokens)::BIGINT AS input_tokens, sum(least(input_tokens, cached))::BIGINT AS cached_input_tokens,
sum(output_tokens)::BIGINT AS output_tokens, sum(input_tokens + output_tokens)::BIGINT AS total_tokens FROM c GROUP BY 1),
w AS (SELECT file, min(conv_id) AS id, arg_min(text, line) FILTER (role = 'user' AND text <> '') AS prompt, count(*) FILTER (type = 'tool_call') AS tool_calls, count(*) FILTER (status = 'error') AS errors, (max(ts) - min(ts)) / 1000 AS seconds FROM l GROUP BY 1)
SELECT file, substr(trim(regexp_replace(prompt, '\\s+', ' ', 'g')), 1, 500) AS prompt, '/src/f' || id || '.py' AS active_file, seconds, tool_calls, errors, model_calls, models, input_tokens, cached_input_tokens, output_tokens, total_tokens
FROM w JOIN s USING (file) WHERE prompt IS NOT NULL""")
def assistant_sessions(spark, sf_dir):
    return usage.valid_tasks(usage.sessions(logged(spark, sf_dir))).drop("began", "aiu")


@query(f"""WITH {LOG}, t AS (SELECT * FROM l WHERE NOT (type = 'llm_request' AND debug IS NOT NULL)),
n AS (SELECT *, sum((type = 'llm_request')::INT) OVER (PARTITION BY file ORDER BY ts, line) AS turn_no, row_number() OVER (PARTITION BY file ORDER BY ts, line) AS nth FROM t)
SELECT file, nth, CASE type WHEN 'user_message' THEN 'User prompt' WHEN 'tool_call' THEN 'Tool' ELSE 'Model turn ' || turn_no END AS step,
CASE type WHEN 'user_message' THEN substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 350) WHEN 'tool_call' THEN 'grep' ELSE model END AS details,
CASE type WHEN 'user_message' THEN '—' ELSE status END AS status, CASE type WHEN 'user_message' THEN '—' ELSE '1,234,567 ms' END AS duration,
lag(nth) OVER (PARTITION BY file ORDER BY nth) AS parent FROM n""")
def assistant_timeline(spark, sf_dir):
    return usage.parent_edges(usage.timeline(logged(spark, sf_dir)).drop("time"), "file", "nth", "nth")


@query(f"""WITH {LOG}, k AS (SELECT file, model FROM c GROUP BY ALL HAVING sum(output_tokens) > 20) SELECT c.file, call_index, c.model FROM c SEMI JOIN k ON k.file = c.file AND k.model = c.model""")
def calls_of_tasks(spark, sf_dir):
    calls = usage.model_requests(logged(spark, sf_dir)).select("file", "call_index", "model", "output_tokens")
    return usage.calls_of(calls, calls.groupBy("file", "model").agg(F.sum("output_tokens").alias("n")).where("n > 20"), ["file", "model"]).drop("output_tokens")


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'open' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'Visual Studio' ELSE 'VS Code' END AS ide, o_totalprice, o_orderdate FROM orders),
u AS (SELECT *, row_number() OVER (PARTITION BY ide ORDER BY o_orderkey) AS nth FROM t WHERE status IS DISTINCT FROM 'completed') SELECT o_orderkey, status, CASE WHEN ide <> 'Visual Studio' THEN o_totalprice END AS aiu FROM u WHERE nth <= 40""")
def unfinished_tasks(spark, sf_dir):
    d = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "open").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "Visual Studio").otherwise("VS Code").alias("ide"), "o_totalprice", "o_orderdate")
    left = usage.first_findings(usage.unfinished(d, "status", "o_orderdate"), "ide", "o_orderkey", 40)
    return left.select("o_orderkey", "status", F.when(F.col("ide") != "Visual Studio", F.col("o_totalprice")).alias("aiu"))


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 60)), 59)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1""")
def price_histogram(spark, sf_dir):
    return usage.histogram(read(spark, sf_dir, "lineitem"), "l_extendedprice").drop("low")


@query("""WITH t AS (SELECT doc_id, 'head' || chr(10) || regexp_replace(text, '(?m)^', 'BEGIN ', 'g') AS t FROM documents), l AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM t),
x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS place FROM l)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS nth, length(line)::BIGINT AS n FROM x WHERE starts_with(line, 'BEGIN ')""")
def log_blocks(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("head\n"), F.regexp_replace("text", "(?m)^|(?<=\n)$", "BEGIN ")).alias("text"))
    return usage.blocks(d, "BEGIN ", "doc_id").select("doc_id", "nth", F.length(F.regexp_replace("block", "\n$", "")).cast("bigint").alias("n"))


@query("SELECT url, regexp_extract(url, '([^/]*)$', 1) AS name, CASE WHEN starts_with(url, 'http:/') THEN regexp_replace(url, '^http:/', '') ELSE regexp_extract(url, '([^/]*)$', 1) END AS below FROM pages")
def portable_paths(spark, sf_dir):
    d = read(spark, sf_dir, "pages")
    return d.select("url", display.portable_path(F.col("url"), F.lit("/elsewhere/")).alias("name"), display.portable_path(F.regexp_replace("url", "/", "\\\\"), F.lit("http:\\")).alias("below"))


