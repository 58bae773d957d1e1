"""Task, step, session and request events in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.operators.ranking import row_numbers

# Fixed values.
WINDOW_SECONDS = 60
MAX_REQUESTS = 3000
TASK_STATES = ("queued", "running", "succeeded", "failed")
ALLOWED_STEPS = (("queued", "running"), ("queued", "failed"), ("running", "succeeded"), ("running", "failed"))
MAX_RETRIES = 3
SLICE_SECONDS = 86_400


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a time stamp with or without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


def sliding_counts(requests: DataFrame, seconds: int = WINDOW_SECONDS, limit: int = MAX_REQUESTS, ts: str = "ts") -> DataFrame:
    """Requests in the last ``seconds`` at every moment with a request; the far edge is open.

    All requests form one stream, so it is cut into windows of that length: a moment is counted in its
    own window, where the moments of the window before leave one by one, each that length after it came.
    So a running sum gives every count, however many moments a window holds. Moments are added up
    first, so a hot window holds distinct time stamps, not requests.
    """
    width = seconds * 1_000_000
    moments = requests.groupBy(micros(ts).alias("us")).agg(F.count("*").alias("n"))
    own, us, n = F.floor(F.col("us") / width).cast("long"), F.col("us"), F.col("n")
    came = F.struct(own.alias("slot"), us.alias("us"), n.alias("change"))
    left = F.struct((own + 1).alias("slot"), (us + width).alias("us"), (-n).alias("change"))
    slot = Window.partitionBy("slot")
    so_far = F.sum("change").over(slot.orderBy("us").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.sum(F.when(F.col("change") < 0, -F.col("change")).otherwise(0)).over(slot)
    counted = moments.select(F.inline(F.array(came, left))).withColumn("in_window", before + so_far).where("change > 0")
    return counted.select(
        "us", F.col("change").alias("requests"), "in_window", (F.col("in_window") > limit).alias("over_limit")
    )


def admissions(requests: DataFrame, key: list[str], seconds: int = WINDOW_SECONDS, limit: int = MAX_REQUESTS, ts: str = "ts", run: int = 100_000) -> DataFrame:
    """When a limiter lets each request in: ``key`` columns, us, admitted_us and waited_us (long).

    At most ``limit`` admissions lie within any ``seconds``; a request beyond them waits for the oldest to expire, in order of
    arrival (then of ``key``). So request i comes in at the later of its arrival and ``seconds`` after request i - limit. Along
    a chain of requests ``limit`` apart that is a running maximum of arrival - place * seconds. A chain is cut into runs of ``run``
    requests: each run hands its maximum to the later ones, so a chain of any length is dealt over many tasks.
    """
    width = seconds * 1_000_000
    arrived = requests.select(*key, micros(ts).alias("us"))
    placed = row_numbers(arrived, ["us", *key], "_i")
    chain = (F.col("_i") % limit).alias("_chain")
    place = F.floor(F.col("_i") / limit)
    rows = placed.select(*key, "us", chain, place.alias("_place"), F.floor(place / run).alias("_run"), (F.col("us") - place * width).alias("_early"))
    tops = rows.groupBy("_chain", "_run").agg(F.max("_early").alias("_top"))
    before = Window.partitionBy("_chain").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("_chain", "_run", F.max("_top").over(before).alias("_carried"))
    within = Window.partitionBy("_chain", "_run").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.greatest(F.max("_early").over(within), F.col("_carried"))
    admitted = rows.join(carried, ["_chain", "_run"]).withColumn("admitted_us", latest + F.col("_place") * width)
    return admitted.select(*key, "us", "admitted_us", (F.col("admitted_us") - F.col("us")).alias("waited_us"))


def task_progress(events: DataFrame) -> DataFrame:
    """State per task after all events: nodes running and done, in order, and the last status.

    ``events``: task_id, node, action (start, done, status, clear), status, seq. A node runs when it was
    started after it was last done; done nodes keep the order of their first completion. Events before
    the last ``clear`` do not count.
    """
    cleared = events.groupBy("task_id").agg(F.max(F.when(F.col("action") == "clear", F.col("seq"))).alias("_cleared"))
    live = events.join(cleared, "task_id").where(F.col("_cleared").isNull() | (F.col("seq") > F.col("_cleared")))
    steps = live.where(F.col("action").isin("start", "done"))
    done = steps.groupBy("task_id", "node").agg(
        F.min(F.when(F.col("action") == "done", F.col("seq"))).alias("first_done"),
        F.max(F.when(F.col("action") == "done", F.col("seq"))).alias("last_done"),
    )
    running = (
        steps.where("action = 'start'")
        .join(done, ["task_id", "node"])
        .where(F.col("last_done").isNull() | (F.col("seq") > F.col("last_done")))
        .groupBy("task_id", "node")
        .agg(F.min("seq").alias("since"))
    )
    in_order = lambda at: F.transform(F.array_sort(F.collect_list(F.struct(at, "node"))), lambda x: x["node"])
    done_lists = done.where("first_done IS NOT NULL").groupBy("task_id").agg(in_order("first_done").alias("done_list"))
    run_lists = running.groupBy("task_id").agg(in_order("since").alias("running_list"))
    status = live.where("action = 'status'").groupBy("task_id").agg(F.max_by("status", "seq").alias("status"))
    none = F.array().cast("array<string>")
    return (
        live.select("task_id")
        .distinct()
        .join(done_lists, "task_id", "left")
        .join(run_lists, "task_id", "left")
        .join(status, "task_id", "left")
        .select(
            "task_id",
            F.coalesce("running_list", none).alias("running_list"),
            F.coalesce("done_list", none).alias("done_list"),
            F.coalesce("status", F.lit("")).alias("status"),
        )
    )


def session_answers(events: DataFrame) -> DataFrame:
    """Per session: the deltas joined in order, how it ended, and whether anything followed the end.

    ``events``: session_id, seq, event (ready, progress, delta, final, error), payload.
    """
    kind = F.col("event")
    ends = kind.isin("final", "error")
    return events.groupBy("session_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(kind == "delta", F.struct("seq", "payload")))), lambda x: x["payload"]
            ),
            "",
        ).alias("answer"),
        F.coalesce(F.min_by("event", F.when(ends, F.col("seq"))), F.lit("open")).alias("outcome"),
        F.count_if(kind == "delta").alias("n_deltas"),
        (F.max("seq") > F.min(F.when(ends, F.col("seq")))).alias("after_end"),
    )


def with_previous(events: DataFrame, key: list[str], columns: list[str], slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Add ``previous``, the struct of ``columns`` of the event before, per key by (ts, seq).

    A key may hold a large share of all events, so its history is cut into time slices: the window runs
    per key and slice, and the last event of the slice before is handed over from an aggregate that has
    one row per key and slice.
    """
    at = [*key, "_slice"]
    sliced = events.withColumn("_slice", F.floor(micros("ts") / (slice_seconds * 1_000_000)))
    value = F.struct(*columns)
    near = F.lag(value).over(Window.partitionBy(*at).orderBy("ts", "seq"))
    ends = sliced.groupBy(*at).agg(F.max_by(value, F.struct("ts", "seq")).alias("_end"))
    carried = ends.select(*at, F.lag("_end").over(Window.partitionBy(*key).orderBy("_slice")).alias("_carried"))
    return (
        sliced.withColumn("_near", near)
        .join(carried, at)
        .withColumn("previous", F.coalesce("_near", "_carried"))
        .drop("_slice", "_near", "_carried")
    )


def step_durations(events: DataFrame) -> DataFrame:
    """Finish events paired with the start right before them in the same trace and step.

    ``events``: trace_id, step, ts, kind (start, finish, fail), seq.
    """
    paired = with_previous(events, ["trace_id", "step"], ["kind", "ts"]).select(
        "*", F.col("previous.kind").alias("_kind"), F.col("previous.ts").alias("_ts")
    )
    return paired.where(F.col("kind").isin("finish", "fail") & (F.col("_kind") == "start")).select(
        "trace_id",
        "step",
        "seq",
        F.floor((micros("ts") - micros("_ts")) / 1000).alias("duration_ms"),
        (F.col("kind") == "fail").alias("failed"),
    )


def latest_status(events: DataFrame, key: str = "task_id") -> DataFrame:
    return events.groupBy(key).agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"),
        F.max("ts").alias("updated_at"),
        F.count("*").alias("n_events"),
    )


def illegal_transitions(events: DataFrame, key: str = "task_id", allowed=ALLOWED_STEPS, first: str = "queued") -> DataFrame:
    """Status changes outside the allowed pairs; a task must begin in the first state."""
    pairs = with_previous(events, [key], ["status"]).withColumn(
        "from_status", F.coalesce("previous.status", F.lit(""))
    )
    legal = (F.col("from_status") == "") & (F.col("status") == first)
    for a, b in allowed:
        legal = legal | ((F.col("from_status") == a) & (F.col("status") == b))
    return pairs.where(~legal).select(key, "seq", "from_status", F.col("status").alias("to_status"))


def attempts(events: DataFrame, key: str = "task_id", max_retries: int = MAX_RETRIES) -> DataFrame:
    """Runs per task and what is left of the retry allowance."""
    runs = F.count_if(F.col("status") == "running")
    return events.groupBy(key).agg(
        runs.alias("n_attempts"),
        F.count_if(F.col("status") == "failed").alias("n_failures"),
        F.greatest(F.lit(0), runs - 1).alias("n_retries"),
        (runs - 1 > max_retries).alias("over_retry_limit"),
    )


def failure_reason(message: Column, error_type: Column, detail: Column) -> Column:
    from evispark.functions.text import error_summary

    return error_summary(message, error_type, detail)
