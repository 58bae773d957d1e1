"""Event rollups over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.catalog.registry import query
from evispark.functions import arrays as A
from evispark.operators import events as E
from evispark.session import table


@query(
    "sliding_request_count",
    "T1",
    """WITH e AS (SELECT epoch_us(ts) AS us FROM events), d AS (SELECT us, count(*) AS n FROM e GROUP BY us)
       SELECT us, n AS requests, sum(n) OVER (ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)::BIGINT AS in_window,
              sum(n) OVER (ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) > 20 AS over_limit FROM d""",
)
def sliding_request_count(spark, sf):
    return E.sliding_counts(table(spark, sf, "events"), seconds=3600, limit=20)


@query(
    "request_admissions",
    "T1",
    """WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) AS us, row_number() OVER (ORDER BY epoch_us(ts), event_id) - 1 AS i FROM events),
       a AS (SELECT i, event_id, us, us AS admitted_us FROM e WHERE i < 20
             UNION ALL SELECT e.i, e.event_id, e.us, greatest(e.us, a.admitted_us + 21600000000) FROM a JOIN e ON e.i = a.i + 20)
       SELECT event_id, us, admitted_us, admitted_us - us AS waited_us FROM a""",
)
def request_admissions(spark, sf):
    """At most 20 events in six hours, so that many of them wait."""
    return E.admissions(table(spark, sf, "events"), ["event_id"], seconds=21_600, limit=20)


STEPS_SQL = """steps AS (SELECT user_id AS task_id, 'n' || (json_extract_string(props, '$.k')::INT % 6) AS node, event_id AS seq, ts,
   CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'status' ELSE CASE WHEN value > 30 THEN 'clear' ELSE 'done' END END AS action,
   'processing-' || (json_extract_string(props, '$.k')::INT % 3) AS status FROM events)"""


def task_events(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("task_id"),
        F.concat(F.lit("n"), (k % 6).cast("string")).alias("node"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(kind.isin("view", "click"), F.lit("start"))
        .when(kind == "purchase", F.lit("done"))
        .when(kind == "signup", F.lit("status"))
        .otherwise(F.when(F.col("value") > 30, F.lit("clear")).otherwise(F.lit("done")))
        .alias("action"),
        F.concat(F.lit("processing-"), (k % 3).cast("string")).alias("status"),
    )


@query(
    "task_progress",
    "T2",
    f"""WITH {STEPS_SQL}, c AS (SELECT task_id, max(seq) FILTER (WHERE action = 'clear') AS cleared FROM steps GROUP BY task_id),
        l AS (SELECT s.* FROM steps s JOIN c USING (task_id) WHERE cleared IS NULL OR seq > cleared),
        d AS (SELECT task_id, node, min(seq) AS f, max(seq) AS z FROM l WHERE action = 'done' GROUP BY ALL),
        r AS (SELECT l.task_id, l.node, min(seq) AS since FROM l LEFT JOIN d ON d.task_id = l.task_id AND d.node = l.node WHERE action = 'start' AND (z IS NULL OR seq > z) GROUP BY ALL)
        SELECT t.task_id, coalesce((SELECT string_agg(node, '|' ORDER BY since) FROM r WHERE r.task_id = t.task_id), '') AS running_list,
               coalesce((SELECT string_agg(node, '|' ORDER BY f) FROM d WHERE d.task_id = t.task_id), '') AS done_list,
               coalesce((SELECT max_by(status, seq) FROM l WHERE l.task_id = t.task_id AND action = 'status'), '') AS status FROM (SELECT DISTINCT task_id FROM l) t""",
)
def task_progress(spark, sf):
    out = E.task_progress(task_events(spark, sf))
    return out.withColumns({c: A.join(F.col(c)) for c in ("running_list", "done_list")})


@query(
    "session_answers",
    "T3",
    """SELECT conv_id AS session_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS answer,
              CASE WHEN bool_or(turn = 5) THEN CASE WHEN conv_id % 2 = 0 THEN 'final' ELSE 'error' END ELSE 'open' END AS outcome,
              count(*) FILTER (WHERE role = 'assistant') AS n_deltas, max(turn) > 5 AND bool_or(turn = 5) AS after_end
       FROM (SELECT conv_id, turn, text, CASE WHEN turn = 5 THEN 'end' ELSE role END AS role FROM conversations) GROUP BY conv_id""",
)
def session_answers(spark, sf):
    turn = F.col("turn")
    kind = (
        F.when(turn == 5, F.when(F.col("conv_id") % 2 == 0, F.lit("final")).otherwise(F.lit("error")))
        .when(F.col("role") == "assistant", F.lit("delta"))
        .otherwise(F.lit("progress"))
    )
    events = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), turn.alias("seq"), kind.alias("event"), F.col("text").alias("payload")
    )
    out = E.session_answers(events)
    return out.withColumn("after_end", F.coalesce("after_end", F.lit(False)))


SPANS_SQL = """spans AS (SELECT user_id AS trace_id, 's' || (json_extract_string(props, '$.k')::INT % 4) AS step, ts, event_id AS seq,
   CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'start' WHEN 'error' THEN 'fail' ELSE 'finish' END AS kind FROM events)"""


def spans(spark, sf):
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("trace_id"),
        F.concat(F.lit("s"), (k % 4).cast("string")).alias("step"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when(kind.isin("view", "click"), F.lit("start")).when(kind == "error", F.lit("fail")).otherwise(F.lit("finish")).alias("kind"),
    )


@query(
    "step_durations",
    "T4,A9",
    f"""WITH {SPANS_SQL}, p AS (SELECT *, lag(kind) OVER w AS pk, lag(ts) OVER w AS pts FROM spans WINDOW w AS (PARTITION BY trace_id, step ORDER BY ts, seq))
        SELECT trace_id, step, seq, ((epoch_us(ts) - epoch_us(pts)) // 1000)::BIGINT AS duration_ms, kind = 'fail' AS failed FROM p WHERE kind <> 'start' AND pk = 'start'""",
)
def step_durations(spark, sf):
    return E.step_durations(spans(spark, sf))


STATES_SQL = """states AS (SELECT user_id AS task_id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'running' END AS status FROM events)"""


def states(spark, sf):
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", F.lit("queued"))
        .when(kind == "error", F.lit("failed"))
        .when(kind == "purchase", F.lit("succeeded"))
        .otherwise(F.lit("running"))
    )
    return table(spark, sf, "events").select(
        F.col("user_id").alias("task_id"), "ts", F.col("event_id").alias("seq"), status.alias("status")
    )


@query(
    "latest_task_status",
    "T6",
    f"WITH {STATES_SQL} SELECT task_id, max_by(status, (ts, seq)) AS status, epoch_us(max(ts)) AS updated_us, count(*) AS n_events FROM states GROUP BY task_id",
)
def latest_task_status(spark, sf):
    out = E.latest_status(states(spark, sf))
    return out.select("task_id", "status", E.micros("updated_at").alias("updated_us"), "n_events")


@query(
    "illegal_status_changes",
    "T6",
    f"""WITH {STATES_SQL}, p AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY task_id ORDER BY ts, seq), '') AS f FROM states)
        SELECT task_id, seq, f AS from_status, status AS to_status FROM p
        WHERE (f || '>' || status) NOT IN ('>queued', 'queued>running', 'queued>failed', 'running>succeeded', 'running>failed')""",
)
def illegal_status_changes(spark, sf):
    return E.illegal_transitions(states(spark, sf))


@query(
    "task_attempts",
    "T7",
    f"""WITH {STATES_SQL}, c AS (SELECT task_id, count(*) FILTER (WHERE status = 'running') AS r, count(*) FILTER (WHERE status = 'failed') AS f FROM states GROUP BY task_id)
        SELECT task_id, r AS n_attempts, f AS n_failures, greatest(0, r - 1) AS n_retries, r - 1 > 3 AS over_retry_limit FROM c""",
)
def task_attempts(spark, sf):
    return E.attempts(states(spark, sf))
