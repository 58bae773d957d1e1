"""The pipeline's stages against plain versions of what they promise, on the smallest tables and on planted rows."""

import hashlib
import random
from collections import Counter

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from evispark.llm.toxicity import score_documents, train
from tests.llm.brute import alike, dedup, shingles, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def planted():
    rng = random.Random(4)

    def text(n):
        return " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))

    base, passage = text(80), text(60)
    rows = [(i, text(40) + "\n" + text(30)) for i in range(10, 40)]
    rows += [(50, base), (51, base), (52, base.replace(" ", "  ")), (53, base + " more"), (60, text(50) + "\n" + passage), (61, text(50) + "\n" + passage)]
    return [*rows, (70, None), (71, ""), (70, None)]


def test_near_duplicates_leave_one_of_each_group(spark, sf):
    rows = planted()
    kept = pipeline.drop_near_duplicates(spark, frame(spark, rows), sf)
    assert kept.columns == COLUMNS
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i not in (51, 52, 53))


def test_near_duplicates_are_rows_not_ids(spark, sf):
    rng = random.Random(9)
    a, b, c, clean = (" ".join(f"v{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(None, a), (None, a), (None, a + " x"), (None, b), (7, b + " y"), (1, c), (2, c + " z"), (2, clean), (None, None), (None, "")]
    rows += [(9, "one two"), (9, "one two")]
    got = Counter((r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, frame(spark, rows).repartition(3), sf).collect())
    first = min((a, a + " x"), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert got == Counter([(None, first), (7, b + " y"), (1, c), (2, clean), (None, None), (None, ""), (9, "one two")])


def test_stages_with_clashing_names_and_empty_tables(spark, sf):
    """Extra columns named as working columns come back as they were; an empty table stays one."""
    extra = ["_name", "name", "row", "_own_digest", "hits", "group"]
    docs = frame(spark, planted()).select("*", *(F.lit(c).alias(c) for c in extra))
    for stage in (pipeline.drop_repeated_lines, pipeline.drop_near_duplicates, pipeline.drop_contaminated):
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns and {tuple(r[c] for c in extra) for r in kept.collect()} == {tuple(extra)}
        assert stage(spark, docs.filter("false"), sf).collect() == []
    assert pipeline.pack(spark, docs.filter("false"), sf).collect() == []


def test_lines_that_repeat_go(spark, sf):
    rows = planted()
    left = {k[0]: v for k, v in dedup({(i, hashlib.md5((t or "").encode()).hexdigest(), t) for i, t in rows}).items()}
    kept = pipeline.drop_repeated_lines(spark, frame(spark, rows), sf)
    assert kept.columns == COLUMNS
    got = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    gone = {i for i, t in rows if t and not left[i]}
    assert gone == {51, 52, 53} and set(got) == {i for i, _ in rows} - gone
    assert all(got[i] == (left[i], len(left[i])) for i in got if i not in (70, 71))
    assert got[70] == (None, None) and got[71] == ("", 0)


def test_copies_of_which_blank_lines_are_left_go(spark, sf):
    rng = random.Random(8)
    parts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(20)) for _ in range(3)]
    rows = [(1, "\n\n".join(parts)), (2, "\n\n".join(parts)), (3, "\n\t\r\n \n".join(parts)), (4, "\n\n\n"), (5, "\n\n".join(parts) + "\n\nnew")]
    got = {r.doc_id: r.text for r in pipeline.drop_repeated_lines(spark, frame(spark, rows), sf).collect()}
    assert got == {1: rows[0][1], 4: "\n\n\n", 5: "\n\n\nnew"}


def test_contaminated_documents_go_and_clean_ones_stay(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("length(text) > 60").first()["text"]
    rows = [*planted(), (80, "before\n" + item.upper() + " after"), (81, " ".join(item.split()[:3]))]
    kept = pipeline.drop_contaminated(spark, frame(spark, rows), sf)
    assert kept.columns == COLUMNS and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i != 80)


def test_toxic_documents_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = pipeline.drop_toxic(spark, docs, sf)
    assert kept.columns == COLUMNS
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [i for i, t in labels.items() if t == 0]
    assert sum(i in ids for i in clean) >= 0.98 * len(clean)


def test_toxic_documents_are_those_the_model_calls_so(spark, tmp_path):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        body = ["".join(rng.choice("abcdefghi") for _ in range(2)) for _ in range(rng.randrange(20, 200))]
        if i % 5 == 0:
            for _ in range(4):
                body.insert(rng.randrange(len(body)), rng.choice(["Vilewordly", "grimslur!", "badterm"]))
        rows.append((i, " ".join(body)))
        labels.append((i, int(i % 5 == 0)))
    docs = frame(spark, [*rows, (1000, None), (None, "badterm grimslur"), (0, "a plain text of the same id")])
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    whole = docs.select(F.struct("doc_id", "text").alias("row"), "text")
    scored = [(r.row.doc_id, r.row.text, r.predicted) for r in score_documents(whole, model, id_col="row").select("row", "predicted").collect()]
    kept = Counter((r.doc_id, r.text) for r in pipeline.drop_toxic(spark, docs, str(tmp_path)).collect())
    assert kept == Counter((i, t) for i, t, p in scored if p == 0)
    gone = Counter((r.doc_id, r.text) for r in docs.collect()) - kept
    toxic = {i for i, t in labels if t}
    assert gone and sum(i in toxic for i, _ in gone) >= 0.95 * len(toxic) and (None, "badterm grimslur") in gone
    assert (0, "a plain text of the same id") in kept and (1000, None) in kept


def test_packed_pieces_make_whole_texts_without_conflicts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    pieces, bins = {}, {}
    for r in pipeline.pack(spark, docs, sf).collect():
        pieces.setdefault(r.doc_id, {})[r.piece] = r
        if r.n_words:
            bins.setdefault(r.bin_id, []).append(r)
    by = {r.doc_id: r for r in rows}
    assert set(pieces) == set(by) and any(len(p) > 1 for p in pieces.values())
    for i, p in pieces.items():
        whole = "".join(p[k].text for k in range(len(p)))
        assert whole == ((by[i].text or "") if len(p) == 1 else by[i].text.lstrip(" \t\n\v\f\r"))
    for held in bins.values():
        held.sort(key=lambda r: r.bin_offset)
        assert held[0].bin_offset == 0 and held[-1].bin_offset + held[-1].n_words <= 2048
        assert all(x.bin_offset + x.n_words == y.bin_offset for x, y in zip(held, held[1:], strict=False))
        for value in ([by[r.doc_id].source for r in held if by[r.doc_id].source is not None], [by[r.doc_id].text for r in held]):
            assert len(set(value)) == len(value)


def test_run(spark, sf):
    out = pipeline.run(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert out and {r.doc_id for r in out} <= set(docs)
    assert all(len(words(r.text)) == r.n_words for r in out)
    whole = {}
    for r in out:
        whole.setdefault(r.doc_id, []).append(shingles(r.text))
    single = [s[0] for s in whole.values() if len(s) == 1 and s[0]]
    assert not any(alike(a, b) for k, a in enumerate(single) for b in single[:k])
