"""Imports that die on the way, and those that come again."""

import pytest

from evispark.operators import chunk_table as K
from evispark.operators import ledger as L
from evispark.plans.ingest import import_batch, rejects_path


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, file_title string, md_content string")


def contents(df):
    return sorted((r.file_title, r.chunk_index, r.content) for r in df.collect())


FIRST = (("/in/a.md", "a", "# A\n\nold a"), ("/in/b.md", "b", "# B\n\nold b"))
SECOND = (("/in/a.md", "a", "# A\n\nnew a"), ("/in/c.md", "c", "# C\n\nnew c"), ("/in/x.md", "x" * 600, "# X\n\ntext"), ("/in/y.md", "y", " "))
OLD = [("a", 0, "# A\n\nold a"), ("b", 0, "# B\n\nold b")]
NEW = [("a", 0, "# A\n\nnew a"), ("b", 0, "# B\n\nold b"), ("c", 0, "# C\n\nnew c")]


@pytest.mark.parametrize("dies_in", ["publish_rejects", "publish_buckets", "_note"])
def test_a_killed_import_is_completed_once(spark, tmp_path, monkeypatch, dies_in):
    target = str(tmp_path / "chunks")
    import_batch(spark, docs(spark, *FIRST), target, 4)
    assert contents(spark.read.parquet(target)) == OLD

    def killed(spark, path, *more):
        if dies_in != "_note" or more[0] == "published":
            raise RuntimeError("killed")
        return note(spark, path, *more)

    note = L._note
    with monkeypatch.context() as m:
        m.setattr(L, dies_in, killed)
        with pytest.raises(RuntimeError, match="killed"):
            import_batch(spark, docs(spark, *SECOND), target, 4)
    # Committed, so readers of the ledger see all of it already.
    assert contents(L.read_committed(spark, target)) == NEW
    for _ in range(2):
        outcome = import_batch(spark, docs(spark, *reversed(SECOND)), target, 4)
        assert {r.path: r.accepted for r in outcome.collect()} == {"/in/a.md": True, "/in/c.md": True, "/in/x.md": False, "/in/y.md": False}
        assert contents(spark.read.parquet(target)) == contents(L.read_committed(spark, target)) == NEW
        assert sorted(r.path for r in spark.read.parquet(rejects_path(target)).collect()) == ["/in/x.md", "/in/y.md"]
    assert L.pending(spark, target) == []


def test_an_import_killed_before_its_entry_changes_nothing(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "chunks")
    import_batch(spark, docs(spark, *FIRST), target, 4)
    with monkeypatch.context() as m:
        m.setattr(L, "_note", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            import_batch(spark, docs(spark, *SECOND), target, 4)
    assert contents(spark.read.parquet(target)) == contents(L.read_committed(spark, target)) == OLD
    # Another batch comes first; what was staged in vain is forgotten.
    import_batch(spark, docs(spark, ("/in/d.md", "d", "text d"), ("/in/z.md", "z", "")), target, 4)
    import_batch(spark, docs(spark, *SECOND), target, 4)
    assert contents(spark.read.parquet(target)) == [*NEW, ("d", 0, "text d")]
    assert sorted(r.path for r in spark.read.parquet(rejects_path(target)).collect()) == ["/in/x.md", "/in/y.md", "/in/z.md"]


def test_the_same_batch_later_is_imported_again(spark, tmp_path):
    target = str(tmp_path / "chunks")
    for batch in (FIRST, SECOND, FIRST):
        import_batch(spark, docs(spark, *batch), target, 4)
    assert contents(spark.read.parquet(target)) == [*OLD, ("c", 0, "# C\n\nnew c")]
    assert [r.entry for r in L.entries(spark, target, "published").orderBy("entry").collect()] == [0, 1, 2]


def test_a_table_of_other_columns_is_left_alone(spark, tmp_path):
    target = str(tmp_path / "chunks")
    old = spark.createDataFrame([("n", 1)], "item_name string, n int")
    old.write.parquet(target)
    import_batch(spark, docs(spark, *FIRST), target, 4)
    assert spark.read.parquet(target).collect() == old.collect()
    assert contents(spark.read.parquet(f"{target}_v2")) == OLD
    import_batch(spark, docs(spark, *SECOND), target, 4)
    assert contents(spark.read.parquet(f"{target}_v2")) == NEW
    other = str(tmp_path / "both")
    old.write.parquet(other)
    old.write.parquet(f"{other}_v2")
    with pytest.raises(ValueError, match="differ"):
        import_batch(spark, docs(spark, *FIRST), other, 4)


def test_nothing_accepted(spark, tmp_path):
    target = str(tmp_path / "chunks")
    outcome = import_batch(spark, docs(spark, ("/in/y.md", "y", " ")), target, 4)
    assert [(r.path, r.accepted) for r in outcome.collect()] == [("/in/y.md", False)]
    assert L.read_committed(spark, target) is None
    import_batch(spark, docs(spark, *FIRST), target, 4)
    assert contents(K.in_buckets(spark.read.parquet(target), [0, 1, 2, 3])) == OLD
