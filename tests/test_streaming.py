import pytest
from pyspark.sql import functions as F

from evispark.operators import events as B
from evispark.streaming import jobs as J


@pytest.fixture
def paths(tmp_path):
    return lambda name: str(tmp_path / name)


def collect_stream(df, checkpoint, mode="update"):
    rows = []
    J.run_available(df, lambda batch, _: rows.extend(batch.collect()), checkpoint, mode)
    return rows


def split_to(df, folder, n=3):
    """Write in several files so that the stream sees several batches."""
    for i in range(n):
        df.where(F.col("seq") % n == i).coalesce(1).write.mode("append").parquet(folder)


def task_events(spark, sf):
    from evispark.catalog.events import task_events as make

    return make(spark, sf)


def test_task_progress_matches_batch(spark, sf, paths):
    events = task_events(spark, sf).where("action <> 'clear'")
    # One file per range of seq, oldest first, so that order holds across batches.
    bound = events.select(F.percentile("seq", F.lit(0.5))).first()[0]
    events.where(F.col("seq") <= bound).coalesce(1).write.parquet(paths("in"))
    source = J.read_events(spark, paths("in"), events.schema, 1)
    collect_stream(J.task_progress(source, 90 * J.STATE_TTL_MS), paths("ck"))
    events.where(F.col("seq") > bound).coalesce(1).write.mode("append").parquet(paths("in"))
    later = {r.task_id: r for r in collect_stream(J.task_progress(source, 90 * J.STATE_TTL_MS), paths("ck"))}
    want = {r.task_id: r for r in B.task_progress(events).collect()}
    assert later
    for task, row in later.items():
        assert (row.running_list, row.done_list, row.status) == (want[task].running_list, want[task].done_list, want[task].status)


def test_latest_status_matches_batch(spark, sf, paths):
    from evispark.catalog.events import states

    events = states(spark, sf)
    split_to(events, paths("in"))
    source = J.read_events(spark, paths("in"), events.schema, 1)
    last = {r.task_id: (r.status, r.n_events) for r in collect_stream(J.latest_status(source), paths("ck"))}
    want = {r.task_id: (r.status, r.n_events) for r in B.latest_status(events).collect()}
    assert last == want


def test_session_answers_close_after_the_gap(spark, paths):
    rows = [
        ("s1", 1, "progress", "", "2024-01-01 00:00:00"),
        ("s1", 2, "delta", "Hel", "2024-01-01 00:00:01"),
        ("s1", 3, "delta", "lo", "2024-01-01 00:00:02"),
        ("s1", 4, "final", "", "2024-01-01 00:00:03"),
        ("s2", 5, "delta", "open", "2024-01-02 00:00:00"),
    ]
    df = spark.createDataFrame(rows, "session_id string, seq int, event string, payload string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(paths("in"))
    out = collect_stream(J.session_answers(J.read_events(spark, paths("in"), df.schema)), paths("ck"), "append")
    assert [(r.session_id, r.answer, r.outcome) for r in out] == [("s1", "Hello", "final")]


def test_request_rates_and_late_rows(spark, paths):
    rows = [(1, "2024-01-01 00:00:10"), (2, "2024-01-01 00:00:20"), (3, "2024-01-01 03:00:00")]
    df = spark.createDataFrame(rows, "seq int, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(paths("in"))
    source = J.read_events(spark, paths("in"), df.schema)
    out = collect_stream(J.request_rates(source, slide_seconds=60), paths("ck"), "append")
    assert [r.requests for r in out] == [2]


@pytest.mark.parametrize("within, found", [("10 minutes", [(1, 1500, False)]), ("1 day", [(1, 1500, False), (2, 1_740_000, True)])])
def test_durations_join_within_the_interval(spark, paths, within, found):
    s = spark.createDataFrame([("t", "a", 1, "2024-01-01 00:00:00"), ("t", "a", 2, "2024-01-01 00:01:00")], "trace_id string, step string, run int, ts string").withColumn("ts", F.to_timestamp("ts"))
    f = spark.createDataFrame([("t", "a", 1, "2024-01-01 00:00:01.5", False), ("t", "a", 2, "2024-01-01 00:30:00", True)], "trace_id string, step string, run int, ts string, failed boolean").withColumn("ts", F.to_timestamp("ts"))
    s.coalesce(1).write.parquet(paths("s"))
    f.coalesce(1).write.parquet(paths("f"))
    joined = J.step_durations(J.read_events(spark, paths("s"), s.schema), J.read_events(spark, paths("f"), f.schema), within)
    assert sorted((r.run, r.duration_ms, r.failed) for r in collect_stream(joined, paths("ck"), "append")) == found


def test_incremental_import_takes_each_file_once(spark, tmp_path, paths):
    from evispark.plans.ingest import incremental_import

    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# A\n\nfirst body")
    incremental_import(spark, str(folder), paths("table"), paths("ck"))
    (folder / "b.md").write_text("# B\n\nsecond body")
    (folder / "c.txt").write_text("ignored")
    incremental_import(spark, str(folder), paths("table"), paths("ck"))
    rows = spark.read.parquet(paths("table")).select("file_title", "content").collect()
    assert sorted((r.file_title, r.content) for r in rows) == [("a", "# A\n\nfirst body"), ("b", "# B\n\nsecond body")]


def test_sliding_counts_against_brute_force(spark):
    us = [0, 10, 10, 59_999_999, 60_000_000, 60_000_010, 125_000_000]
    df = spark.createDataFrame([(u,) for u in us], "u long").select(F.timestamp_micros("u").alias("ts"))
    got = {r.us: (r.requests, r.in_window) for r in B.sliding_counts(df, 60, 3).collect()}
    assert got == {u: (us.count(u), sum(u - 60_000_000 < v <= u for v in us)) for u in us}


@pytest.mark.parametrize("run", [3, 100_000])
def test_admissions_against_a_plain_limiter(spark, run):
    import random

    rng = random.Random(6)
    rows = sorted((rng.randrange(0, 400_000_000), i) for i in range(400)) + [(390_000_000, 1000 + i) for i in range(150)]
    rows.sort()
    df = spark.createDataFrame([(i, u) for u, i in rows], "id int, u long").select("id", F.timestamp_micros("u").alias("ts")).repartition(3)
    admitted, want = [], {}
    for k, (u, i) in enumerate(rows):
        now = max(u, admitted[k - 7] + 10_000_000) if k >= 7 else u
        admitted.append(now)
        want[i] = (u, now, now - u)
    got = {r.id: (r.us, r.admitted_us, r.waited_us) for r in B.admissions(df, ["id"], 10, 7, run=run).collect()}
    assert got == want
    assert all(sum(v - 10_000_000 < x <= v for x in admitted) <= 7 for v in admitted)
    assert B.admissions(df.where("false"), ["id"], 10, 7).collect() == []


def test_outlines_of_any_depth_in_one_scan(spark):
    import json

    from evispark.operators import research as R

    deep = {"node_id": "0", "children": []}
    for i in range(1, 60):
        deep = {"node_id": str(i), "children": [deep, {"node_id": f"{i}b"}]}
    rows = [("a", json.dumps([deep])), ("b", "[]"), ("c", None), ("d", "no json"), ("e", '[{"node_id": 7, "children": null}, null]'), ("f", '{"node_id": "x"}')]
    nodes = R.outline_nodes(spark.createDataFrame(rows, "k string, o string"), "k", "o")
    got = nodes.collect()
    assert sum(r.k == "a" for r in got) == 119 and max(r.depth for r in got) == 60
    assert {(r.node_id, r.parent_id, r.is_leaf) for r in got if r.k == "a" and r.depth == 60} == {("0", "1", True), ("1b", "1", True)}
    assert sorted((str(r.node_id), r.path) for r in got if r.k == "e") == [("7", [0]), ("None", [1])]
    assert {r.k for r in got} == {"a", "e"}
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Union" not in plan


def test_nodes_after_events_equal_a_plain_fold():
    import random

    import pandas as pd

    rng = random.Random(12)
    for _ in range(300):
        done, running = rng.sample("abcd", rng.randrange(4)), rng.sample("abcde", rng.randrange(4))
        rows = [(rng.choice("abcdef"), rng.choice(["start", "done", "status"])) for _ in range(rng.randrange(12))]
        want_done, want_running = list(done), list(running)
        for node, action in rows:
            if action == "start" and node not in want_running:
                want_running.append(node)
            elif action == "done":
                want_running = [n for n in want_running if n != node]
                want_done = want_done if node in want_done else [*want_done, node]
        assert J._nodes_after(pd.DataFrame(rows, columns=["node", "action"]), done, running) == (want_done, want_running)
