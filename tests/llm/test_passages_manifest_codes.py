"""Substring dedup, Merkle manifest and vector codes against plain Python, on awkward small tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.llm import substring_dedup, vector_codes
from evispark.llm.merkle import digest, field, fold, merkle_manifest
from evispark.llm.substring_dedup import drop_repeated_passages, run_hashes, words_of
from evispark.llm.vector_codes import Codebook, compressed

DOCS = "doc_id long, text string, block long, slice long, marks binary, kept string, n_words long"


def removed(rows, size):
    """rows of (id, text): what stays of each, by definition."""
    first = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - size + 1 if i is not None else 0):
            window = tuple(words[k : k + size])
            first[window] = min(i, first.get(window, i))
    out = Counter()
    for i, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - size + 1 if i is not None else 0):
            if first[tuple(words[k : k + size])] < i:
                gone |= set(range(k, k + size))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
        out[i, len(words), len(gone), None if text is None else kept] += 1
    return out


def passages():
    rng = random.Random(3)

    def text(n):
        return " ".join(rng.choice(["Aa", "aa", "bé", "c c", "x" * 9000, "d"]) + str(rng.randrange(40)) for _ in range(n))

    shared, licence = text(80), text(51)
    rows = [(i, f"{text(rng.randrange(60))}\n{shared}\t{text(rng.randrange(60))}") for i in range(5, 45)]
    rows += [(i, licence) for i in range(60, 90)] + [(i, text(rng.randrange(120))) for i in range(100, 120)]
    rows += [(None, shared), (None, None), (-4, None), (1, ""), (2, " \n\t "), (3, " ".join(["same"] * 300)), (4, " ".join(["same"] * 49))]
    rows += [(60, licence), (7, shared), (7, shared.upper()), (200, text(2_000) + " " + shared), (-9, licence + " more"), (201, " ".join(shared.split()))]
    return rows


def test_passages(spark, monkeypatch):
    rows = passages()
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 200_000)
    for size, bits in ((50, 22), (7, 8)):
        monkeypatch.setattr(substring_dedup, "SLICE_BITS", bits)
        docs = spark.createDataFrame([(i, t, k, k, b"", "x", 0) for k, (i, t) in enumerate(rows)], DOCS).repartition(5)
        got = drop_repeated_passages(docs, window=size)
        assert got.columns == ["doc_id", "n_words", "n_removed", "kept"]
        assert Counter(tuple(r) for r in got.collect()) == removed(rows, size)
    assert drop_repeated_passages(docs.filter("false")).collect() == []
    named = docs.select(F.col("doc_id").alias("n"), F.col("text").alias("doc_id"))
    assert drop_repeated_passages(named, id_col="n", text_col="doc_id").filter("n_removed > 0").count() > 30


def test_runs_of_words_hash_alike_only_if_equal():
    import pyarrow as pa

    rng = random.Random(5)
    text = " ".join(rng.choice("ab") for _ in range(3000))
    words, bounds = words_of(pa.array(["", text, None, "a" * 5000 + "b", "b" + "a" * 5000]))
    assert bounds.tolist() == [0, 0, 3000, 3000, 3001, 3002] and len({*words.tolist()}) == 4
    parts = text.split()
    for size in (1, 2, 7, 50):
        hashes = run_hashes(words[:3000], size, substring_dedup._PAIR[0])
        seen = {}
        for k, h in enumerate(hashes.tolist()):
            assert seen.setdefault(h, parts[k : k + size]) == parts[k : k + size]
        assert len(hashes) == 3000 - size + 1 and len(seen) == len({*(" ".join(parts[k : k + size]) for k in range(len(hashes)))})


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, fanout):
    """The top and each leaf's proof, as (left, right) by level."""
    proofs, spots, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, at in enumerate(spots):
            start = at // fanout * fanout
            proofs[k].append(("".join(level[start:at]), "".join(level[at + 1 : start + fanout])))
        level = [sha(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
        spots = [at // fanout for at in spots]
    return level[0], proofs


@pytest.mark.parametrize("fanout", [2, 3, 20])
def test_manifest(spark, fanout):
    rng = random.Random(fanout)
    sizes = {None: 3, "": 1, "a": 700, "b": 256, "é": 257, "z": 5, "A": 2}
    rows = [(g, rng.randrange(300) if rng.random() < 0.98 else None, sha(str(rng.random()))) for g, n in sizes.items() for _ in range(n)]
    rows += [("a", 7, sha("same"))] * 4 + [("z", 9, None)]
    table = spark.createDataFrame([(*r, "root", 1, 2) for r in rows], "group string, at long, leaf string, root string, n long, block long").repartition(3)
    out = merkle_manifest(table, leaf_col="leaf", group_col="group", order_cols=["at"], fanout=fanout)
    assert out.columns == ["row", "subroot", "root", "proof"]
    got = out.select("row.*", "subroot", F.col("root").alias("top"), "proof", fold(F.coalesce("row.leaf", F.lit("")), F.col("proof")).alias("folded"))
    groups = {}
    for g, at, leaf in rows:
        groups.setdefault(g, []).append((at is not None, at or 0, leaf or ""))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: tree([leaf for *_, leaf in sorted(groups[g])], fanout) for g in names}
    top, upper = tree([made[g][0] for g in names], fanout)
    want = Counter()
    for g, more in zip(names, upper, strict=True):
        for (known, at, leaf), proof in zip(sorted(groups[g]), made[g][1], strict=True):
            want[g, at if known else None, leaf, made[g][0], top, tuple(proof + more)] += 1
    found = got.collect()
    assert Counter((r.group, r.at, r.leaf or "", r.subroot, r.top, tuple(map(tuple, r.proof))) for r in found) == want
    assert all(r.folded == top for r in found)


def test_manifest_of_little(spark):
    one = spark.createDataFrame([("g", 1, "x")], "lang string, doc_id long, leaf string")
    (row,) = merkle_manifest(one, leaf_col="leaf", group_col="lang", order_cols=["doc_id"]).collect()
    assert (row.subroot, row.root, row.proof) == ("x", "x", [])
    assert merkle_manifest(one.filter("false"), leaf_col="leaf", group_col="lang", order_cols=["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        merkle_manifest(one, leaf_col="leaf", group_col="lang", order_cols=["doc_id"], fanout=1)


def test_manifest_finds_what_changed(spark):
    docs = spark.createDataFrame([(i, f"t{i}é" if i % 5 else None) for i in range(40)], "doc_id long, text string")
    leaf = digest(field(F.col("doc_id")), field(F.col("text")))
    kept = merkle_manifest(docs.select("doc_id", leaf.alias("leaf"), F.lit(None).alias("lang")), leaf_col="leaf", group_col="lang", order_cols=["doc_id"])
    now = docs.withColumn("text", F.when(F.col("doc_id") == 12, "changed").otherwise(F.col("text"))).select("doc_id", leaf.alias("now"))
    checked = kept.select("row.*", "root", "proof").join(now, "doc_id").filter(fold(F.col("now"), F.col("proof")) != F.col("root"))
    assert [r.doc_id for r in checked.collect()] == [12]
    assert docs.filter("doc_id = 5").select(leaf).first()[0] == sha("1:5", "-")


def codes(rows, parts, entries, rounds):
    """rows of (id, vector): codes, errors and codebooks by definition."""
    width = max(len(v) for _, v in rows)
    size = max(1, -(-width // parts))
    whole = [[int(np.floor(x * 4096)) for x in v] + [0] * (size * parts - len(v)) for _, v in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))[:entries]
    books = [[whole[k][p * size : (p + 1) * size] for k in order] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for v in whole:
                part = v[p * size : (p + 1) * size]
                held.setdefault(nearest(p, part)[1], []).append(part)
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])]
    found = [[nearest(p, v[p * size : (p + 1) * size]) for p in range(parts)] for v in whole]
    return [([k for _, k in f], sum(d for d, _ in f)) for f in found], books


@pytest.mark.parametrize(("dimensions", "parts", "entries"), [(16, 8, 16), (6, 4, 3)])
def test_codes(spark, dimensions, parts, entries, monkeypatch):
    rng = random.Random(dimensions)
    monkeypatch.setattr(vector_codes, "CHUNK", 50)
    monkeypatch.setattr(vector_codes, "REMEMBERED", 60)
    good = [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(dimensions)]) for i in range(3, 190)]
    good += [(500 + i, good[4][1]) for i in range(90)] + [(600, [0.0] * dimensions), (None, [0.5] * dimensions), (601, []), (602, [1.0, -1.0])]
    good += [(700, good[9][1])] * 3
    bad = [(1, None), (2, [None] * dimensions), (900, [float("nan")] * dimensions), (901, [float("-inf")] + [0.0] * (dimensions - 1)), (902, [1.0, None])]
    schema = "id long, vector array<float>, code string, error int, whole string, row int"
    table = spark.createDataFrame([(i, v, "c", 1, "w", k) for k, (i, v) in enumerate(good + bad)], schema).repartition(4)
    out, books = compressed(table, id_col="id", vector_col="vector", keep=["error", "row"], parts=parts, entries=entries, rounds=4)
    assert out.columns == ["row", "code", "error"]
    want, wanted = codes(good, parts, entries, 4)
    assert [b.tolist() for b in books] == wanted
    assert Counter((r.id, tuple(r.code), r.error) for r in out.select("row.id", "code", "error").collect()) == Counter(
        (i, tuple(c), e) for (i, _), (c, e) in zip(good, want, strict=True)
    )
    none, no_books = compressed(table.filter("id < 3"), id_col="id", vector_col="vector")
    assert none.collect() == [] and no_books == []


def test_cells_keep_what_is_nearest():
    rng = np.random.default_rng(2)
    entries = rng.integers(-3000, 3000, (16, 4))
    for bits in (0, 5, 9, 14):
        book = Codebook(entries, bits)
        parts = rng.integers(-4000, 4000, (500, 4))
        distance = ((parts[:, None, :] - entries) ** 2).sum(2)
        for _ in range(2):
            best, least = book.nearest(parts)
            assert (best == distance.argmin(1)).all() and (least == distance.min(1)).all()
        assert bits > 9 or book.candidates(parts).sum() < parts.shape[0] * 16
    # Two cells with one hash: the second keeps all entries.
    book.cells += 1
    assert book.candidates(parts).all()
