"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import base64
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.llm import line_dedup, packing, secrets, toxicity, warc
from evispark.llm.decontamination import contamination, decontaminate
from evispark.llm.embedding_join import near_duplicates
from evispark.llm.graph import components
from evispark.llm.line_dedup import dedup_lines
from evispark.llm.line_index import bitmaps, may_match
from evispark.llm.ngram_join import ngram_jaccard_join
from evispark.llm.pairs import with_sets
from evispark.llm.sharding import assign_shards
from evispark.llm.url_filter import judge_urls
from tests.llm.brute import alike, dedup, segments, shingles, smallest_reachable, words

SCHEMA = "doc_id long, text string, source string, node long, key string, n int"


def text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, base, share):
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in base.split(" "))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = text(rng, 120)
    out = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, "a b c d"), (7, "a b c d e"), (None, base), (None, None)]
    out += [(100 + i, edited(rng, base, 0.03)) for i in range(40)] + [(200 + i, base.upper()) for i in range(5)]
    out += [(300 + i, text(rng, rng.randrange(5, 60), 40)) for i in range(40)] + [(900, text(rng, 30_000, 10**7))]
    out += [(400 + i, base + "\n" + text(rng, 50) + "\nlicensed to all under the terms of this short line\n\n" + text(rng, 30)) for i in range(12)]
    return out + [(101, out[10][1]), (4, "one"), (4, "one")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None if k % 7 == 0 else f"s{k % 3}", k, "k", 1) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 3), (None, 4), (9, 8), (8, 7), (7, 6), (6, 5), (5, 10)] + [(50, i) for i in range(100, 160)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys((1, 2, 3), 1), **dict.fromkeys(range(5, 11), 5), 50: 50, **dict.fromkeys(range(100, 160), 50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_join(docs, rows, empty):
    sets = [shingles(t) for _, t in rows]
    reach = smallest_reachable([i for i, _ in rows], lambda i, j: alike(sets[i], sets[j]))
    want = Counter((i, len(s), c if s else i) for (i, _), s, c in zip(rows, sets, reach, strict=True))
    assert counted(ngram_jaccard_join(docs)) == want
    assert ngram_jaccard_join(empty).collect() == []


def test_line_dedup(docs, rows, empty):
    keys = {(i, hashlib.md5((t or "").encode()).hexdigest(), t) for i, t in rows}
    left = dedup(keys)
    want = Counter()
    for i, t in rows:
        kept = left[i, hashlib.md5((t or "").encode()).hexdigest(), t]
        n = len(t.split("\n")) if t is not None else 0
        gone = n - len(kept.split("\n")) if t is not None and (kept or t) else 0
        gone = n if t and not kept and n == sum(bool(words(x)) for x in t.split("\n")) else gone
        want[i, None if t is None else kept, n, gone] += 1
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert counted(got.select("doc_id", "text", "n_lines", "n_removed")) == want
    assert dedup_lines(empty).collect() == []


def test_edited_lines(spark):
    """Lines with more and more words changed, around the threshold, some of them copies of copies."""
    rng = random.Random(11)
    lines = [text(rng, n, 10**6) for n in (4, 7, 30, 30, 90, 400)]
    for _ in range(150):
        base = rng.choice(lines)
        lines.append(edited(rng, base, rng.choice([0.02, 0.05, 0.1, 0.14, 0.2])))
    rows = [(i, "\n".join(rng.sample(lines, 3))) for i in range(60)] + [(100, "a b c d e f g"), (101, "g f e d c b a"), (102, "a b c d e f")]
    left = dedup({(i, hashlib.md5(t.encode()).hexdigest(), t) for i, t in rows})
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.text for r in got.collect()} == {k[0]: t for k, t in left.items()}
    one = text(rng, 30, 10**6)
    pair = spark.createDataFrame([(1, one), (2, one.replace(one.split()[9], "other", 1))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in dedup_lines(pair).collect()} == {1: 0, 2: 1}


def test_postings_that_may_match():
    """Against every pair of a run, with sets drawn close to each other and sizes beyond two bytes."""
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2**63, k, dtype=np.uint64) for k in (3, 12, 40, 70_000)]
    sets = []
    for _ in range(60):
        own = base[rng.integers(len(base))].copy()
        swap = rng.random(len(own)) < rng.choice([0.0, 0.1, 0.3])
        own[swap] = rng.integers(0, 2**63, int(swap.sum()), dtype=np.uint64)
        sets.append(np.unique(own))
    bounds = np.cumsum([0, *map(len, sets)])
    low, high = bitmaps(np.concatenate(sets), bounds)
    sizes, places = np.diff(bounds), rng.integers(0, 3, len(sets))
    many = np.array([1, 2, 7, 20, 30])
    start = np.repeat(np.cumsum(many) - many, many)
    got = may_match(start, np.repeat(many, many), sizes, places, low, high, 75)
    want = []
    for i in range(len(sets)):
        passed = False
        for j in range(len(sets)):
            if i != j and start[i] == start[j]:
                n, m = int(sizes[i]), int(sizes[j])
                differ = (int(low[i]) ^ int(low[j])).bit_count() + (int(high[i]) ^ int(high[j])).bit_count()
                common = len(np.intersect1d(sets[i], sets[j]))
                assert differ <= n + m - 2 * common
                room = min(n - places[i], m - places[j])
                passed |= 175 * differ <= 25 * (n + m) and 100 * n >= 75 * m and 100 * m >= 75 * n and 175 * room >= 75 * (n + m)
        want.append(passed)
    assert got.tolist() == want and any(want) and not all(want)


def test_a_run_of_many_sizes_is_not_compared_with_itself(monkeypatch):
    """Length and position alone tell almost all of these apart; their bitmaps are not even read."""
    rng = np.random.default_rng(5)
    sizes = np.arange(100, 4100)
    low, high = (rng.integers(0, 2**bits, len(sizes), dtype=np.uint64) for bits in (63, 32))
    read, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: read.append(x.size) or count(x))
    may_match(np.zeros(len(sizes), np.int64), np.full(len(sizes), len(sizes)), sizes, sizes // 7 + 1, low, high, 75)
    assert sum(read) < len(sizes) ** 2 / 20


def test_unlike_lines_of_near_bitmaps_move_no_token_sets(spark, monkeypatch):
    rng = random.Random(13)
    bases = [text(rng, 110, 10**6).split(" ") for _ in range(20)]
    lines = [" ".join(w for w in base if not k or rng.random() >= 0.34) for base in bases for k in range(12)]
    rows = list(enumerate(lines))
    compared = []

    def counting(pairs, nodes):
        compared.append(pairs.count())
        return with_sets(pairs, nodes)

    monkeypatch.setattr(line_dedup, "with_sets", counting)
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = dedup({(i, hashlib.md5(t.encode()).hexdigest(), t) for i, t in rows})
    assert got == {k[0]: t for k, t in left.items()}
    assert sum(compared) < 20  # 40 by bitmaps of 96 bits alone


def test_decontamination(spark, empty):
    item = "the quick brown fox jumps over the lazy dog again and again until night"
    bench = spark.createDataFrame([(2, item), (10, "Tiny-item"), (3, None), (4, "!!"), (None, "nobody knows"), (2, item)], "item_id long, text string")
    rows = [
        (1, f"Before: {item.upper().replace(' ', '; ')}. After"), (2, "a tiny ITEM here, tiny item"), (3, None), (4, ""), (5, "clean words only"),
        (6, " ".join(item.split()[:9])), (7, "nobody knows"), (8, ("pad " * 20_000) + item), (8, "clean"), (None, "tiny item"), (5, "clean words only"),
    ]
    docs = spark.createDataFrame([(i, t, "x", 1, "k", 2) for i, t in rows], SCHEMA)
    got = {(r.doc_id, r.digest): r for r in contamination(docs, bench).collect()}

    def row(i, t):
        return got[i, hashlib.md5((t or "").encode()).hexdigest()]

    assert (row(*rows[0]).n_words, row(*rows[0]).n_hit, row(*rows[0]).items) == (16, 14, ["2"])
    assert (row(*rows[1]).n_hit, row(*rows[1]).items) == (4, ["10"])
    assert all(not row(*rows[k]).contaminated and row(*rows[k]).n_hit == 0 for k in (2, 3, 4, 5, 8))
    assert row(*rows[6]).contaminated and row(*rows[6]).items == []
    assert (row(*rows[7]).n_words, row(*rows[7]).n_hit) == (20_014, 14)
    assert row(*rows[9]).items == ["10"]
    assert contamination(docs, bench).count() == len(rows)
    assert sorted(r.text for r in decontaminate(docs, bench).filter("doc_id IS NOT NULL AND text <> ''").collect()) == sorted(
        ["clean words only", "clean words only", "clean", rows[5][1]]
    )
    spans = {r.doc_id: r.text for r in decontaminate(docs, bench, remove="spans").filter("doc_id < 8").collect()}
    assert spans[1] == "Before. After" and spans[2] == "a here" and spans[3] is None and spans[4] == ""
    none = bench.filter("false")
    assert not any(r.contaminated for r in contamination(docs, none).collect())
    assert contamination(empty, bench).collect() == [] and contamination(empty, none).collect() == []


def test_embedding_join(spark):
    rng = random.Random(3)
    rows = [(1, None), (2, []), (3, [0.0] * 8), (4, [1.0, None] + [0.0] * 6), (5, [math.nan] * 8), (6, [math.inf] + [0.0] * 7), (7, [1.0, 0.0]), (8, [2.0, 0.0])]
    base = [rng.gauss(0, 1) for _ in range(8)]
    for i in range(150):
        scale = rng.choice((0.05, 0.12, 0.3, 2.0))
        rows.append((100 + i, [b * 3 + rng.gauss(0, scale * 3) for b in base]))
    rows += [(400 + i, rows[20][1]) for i in range(5)] + [(None, rows[20][1]), (9, [-x for x in base])]

    def good(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(i, j):
        a, b = rows[i][1], rows[j][1]
        if not good(a) or not good(b) or len(a) != len(b):
            return False
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)) >= 0.95

    n = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    reach = smallest_reachable([i for i, _ in rows], linked)
    want = Counter((i, k, c, i == c if i is not None else None) for (i, _), k, c in zip(rows, n, reach, strict=True))
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, vec string")
    assert counted(near_duplicates(frame)) == want
    assert near_duplicates(frame.filter("false")).collect() == []


def test_embedding_join_with_pivots(spark, monkeypatch):
    from evispark.llm import embedding_join

    for name, value in (("CELL_ROWS", 16), ("BLOCK_COLUMNS", 32), ("CHUNK", 8)):
        monkeypatch.setattr(embedding_join, name, value)
    test_embedding_join(spark)


def test_embedding_join_has_pivots_in_small_tables(spark, monkeypatch):
    from evispark.llm import embedding_join

    chosen, choose = [], embedding_join.choose_pivots
    monkeypatch.setattr(embedding_join, "choose_pivots", lambda sample, k: chosen.append(choose(sample, k)) or chosen[-1])
    test_embedding_join(spark)
    assert max(len(p) for p in chosen) > 8


def test_url_filter(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("a.example.org", "/en/12", "allow"), ("com", "", "block"), (None, "/", "block"), ("org", "/", "allow")]
    urls = [
        (1, None), (2, ""), (3, "no scheme.org/"), (4, "http://EXAMPLE.org/es/x?y#z"), (5, "http://a.example.org/en/12/"), (6, "http://a.example.org/en/13"),
        (7, "http://notexample.org/en/1"), (8, "http://example.org"), (9, "x://com?/de/"), (10, "http://sub.com#/"), (11, "http://u@example.org:80/es/"), (4, "http://EXAMPLE.org/es/x?y#z"),
        (12, "http://example.org/" + "long/" * 5000),
    ]
    frame = spark.createDataFrame([(i, u, "mine", "mine") for i, u in urls], "page_id long, url string, host string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = judge_urls(frame, table)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    seen = {r.page_id: (r.host, r.path[:20], r.rule, r.verdict) for r in got.collect()}
    assert got.count() == len(urls)
    assert seen[1] == seen[2] == ("", "", None, "allow") and seen[3] == ("", "", None, "allow")
    assert seen[4] == ("example.org", "/es/x", "example.org/es/", "block")
    assert seen[5][2:] == ("a.example.org/en/12", "allow") and seen[6][2:] == ("example.org/en/1", "block")
    assert seen[7][2:] == ("org/", "allow") and seen[8] == ("example.org", "", None, "allow")
    assert seen[9] == ("com", "", "com", "block") and seen[10] == ("sub.com", "", "com", "block")
    assert seen[11][2] is None and seen[12][2:] == ("org/", "allow")
    assert {r.verdict for r in judge_urls(frame, table.filter("false"), default="block").collect()} == {"block"}
    assert judge_urls(frame.filter("false"), table).collect() == []


def test_clashing_names(spark):
    """Columns named as the operators' own ones come back as they were."""
    names = ["_best", "_host", "_path", "row", "_hits", "_own_digest", "hits", "own_digest", "hit_id"]
    item = "the quick brown fox jumps over the lazy dog again"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "clean", *names), (2, f"a {item} b", *names), (None, None, *names)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns and counted(kept) == Counter([(1, "clean", *names), (None, None, *names)])
    spans = decontaminate(docs, bench, remove="spans")
    assert spans.columns == docs.columns and counted(spans) == Counter([(1, "clean", *names), (2, "a b", *names), (None, None, *names)])
    urls = spark.createDataFrame([(1, "http://a.b.org/x", *names), (2, "http://" + "s." * 16_000 + "org/y", *names)], "page_id long, url string, " + ", ".join(f"{c} string" for c in names))
    rules = spark.createDataFrame([("b.org", "/", "block"), ("org", "/y", "block")], "host string, path string, verdict string")
    got = judge_urls(urls, rules).collect()
    assert Counter((r.page_id, r.rule, r.verdict) for r in got) == Counter([(1, "b.org/", "block"), (2, "org/y", "block")])
    assert all([r[c] for c in names] == names for r in got)


def test_sharding(docs, rows, empty):
    got = assign_shards(docs, [1.0, 2.0, 0.0, 1.0]).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode()) + 16) for i, t in rows)
    assert {r.text_crc32 for r in got} == {zlib.crc32((t or "").encode()) for _, t in rows}
    by_key = {}
    for r in got:
        assert by_key.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.shard in (0, 1, 3) and r.grown_shard in (r.shard, 4)
    for shard in (0, 1, 3):
        own = sorted((r.slot, r.doc_id is not None, r.doc_id or 0) for r in got if r.shard == shard)
        assert [s for s, *_ in own] == list(range(len(own))) and own == sorted(own, key=lambda o: o[1:])
    assert assign_shards(empty, [1.0, 1.0]).collect() == []
    with pytest.raises(ValueError):
        assign_shards(docs, [0.0])


def test_shards_follow_their_weights(spark):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = assign_shards(keys, [1.0, 3.0], grow_by=4.0)
    share = {(r.shard, r.grown_shard): r["count"] / 4000 for r in got.groupBy("shard", "grown_shard").count().collect()}
    assert abs(share[0, 0] + share[0, 2] - 0.25) < 0.03 and abs(share[0, 2] + share[1, 2] - 0.5) < 0.03


def test_packing(docs, rows, empty):
    got = packing.pack_documents(docs, capacity=100, texts=True).collect()
    texts = {(i, hashlib.md5((t or "").encode()).hexdigest()): t for i, t in rows}
    want = Counter()
    for i, t in rows:
        n = len(words(t))
        for k in range(max(1, math.ceil(n / 100))):
            want[i, k, k * 100, min(100, n - k * 100)] += 1
    assert Counter((r.doc_id, r.piece, r.start_word, r.n_words) for r in got) == want
    used = {}
    for r in got:
        assert (r.bin_id is None) == (r.n_words == 0)
        if r.n_words:
            assert words(r.text) and len(words(r.text)) == r.n_words
            used.setdefault(r.bin_id, []).append(r)
    for own in used.values():
        own.sort(key=lambda r: r.bin_offset)
        end = 0
        for r in own:
            assert r.bin_offset == end
            end += r.n_words
        assert end <= 100
        assert len({words(r.text)[0] + str(r.n_words) + str(r.doc_id) for r in own}) == len(own)
    assert len(texts) and packing.pack_documents(empty, texts=True).collect() == []


def test_best_fit_against_a_search_of_all_bins():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 60)
        sizes = [rng.randrange(1, 50) for _ in range(n)]
        sources = [rng.choice([None, "a", "b", "c", "d", "e"]) for _ in range(n)]
        clusters = [rng.choice([None, *range(20)]) for _ in range(n)]
        bins = []
        want = {}
        for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
            fits = [
                (50 - sum(sizes[j] for j in b), k) for k, b in enumerate(bins)
                if 50 - sum(sizes[j] for j in b) >= sizes[i]
                and all(sources[i] is None or sources[j] != sources[i] for j in b)
                and all(clusters[i] is None or clusters[j] != clusters[i] for j in b)
            ]
            k = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append([])
            want[i] = (k, sum(sizes[j] for j in bins[k]))
            bins[k].append(i)
        assert packing.best_fit(sizes, sources, clusters, 50) == [want[i] for i in range(n)]


def test_maximal_segments_against_their_definition():
    rng = random.Random(11)
    for _ in range(300):
        n = rng.randrange(0, 25)
        scores = [rng.choice([-0.5, -0.5, -0.5, 1.0, 2.25, 0.75, -1.75]) for _ in range(n)]
        marked = [(i, s) for i, s in enumerate(scores) if s != -0.5]
        got = [(round(s, 6), b, e) for s, b, e in toxicity.maximal_segments(marked, -0.5)]
        want = [(round(s, 6), b, e) for s, b, e in segments(scores)]
        assert sum(s for s, _, _ in got) == pytest.approx(sum(s for s, _, _ in want))
        assert max((s for s, _, _ in got), default=0) == pytest.approx(max((s for s, _, _ in want), default=0))
        assert all(a[2] <= b[1] for a, b in zip(got, got[1:], strict=False))


def test_toxicity(spark, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        body = [f"w{rng.randrange(300)}".replace("0", "o").translate(str.maketrans("123456789", "abcdefghi")) for _ in range(rng.randrange(20, 200))]
        if toxic:
            for _ in range(4):
                body.insert(rng.randrange(len(body)), rng.choice(["Vilewordly", "grimslur!", "badterm"]))
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "123 !!"), (None, "badterm grimslur"), (0, rows[0][1]), (1003, "plain " * 30_000 + "badterm grimslur badterm vilewordly")]
    docs = spark.createDataFrame([(i, t, "s", 1, "k", 1) for i, t in rows], SCHEMA)
    frame = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 3)], "doc_id long, toxic int")
    model = toxicity.train(docs, frame)
    got = toxicity.score_documents(docs, model).collect()
    truth = dict(labels)
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    out = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(out) > 80 and sum(r.predicted == truth[r.doc_id] for r in out) / len(out) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    rest = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 1000}
    assert [rest[i].predicted for i in (1000, 1001, 1002, None, 1003)] == [0, 0, 0, 1, 1]
    assert rest[1003].passages[0].end == 30_004
    none = toxicity.train(docs, frame.filter("toxic = 0"))
    assert {r.predicted for r in toxicity.score_documents(docs, none).collect()} == {0}
    assert toxicity.score_documents(empty, model).collect() == []


def test_secrets(spark, empty):
    shared, own, key = "Zx81kQ0pLm93vT77", "Qp7Hd93kLs0Vb2Xn", "AKIA" + "Q7R2T9WX0ZL4B6C8"
    rows = [
        (1, f'API_KEY = "{shared}"', "a"), (2, f"apikey:{shared} é token={own}", "b"), (3, f"é {key} deadbeefdeadbeef01", "c"), (4, None, "a"), (5, "", None),
        (6, "password: short token=token=abcdefghijkl", "a"), (7, f"Secret : '{own}'", "b"), (2, f"apikey:{shared} é token={own}", "b"), (8, "x" * 100_000 + f" passwd={own}", "b"),
    ]
    docs = spark.createDataFrame([(i, t, s, 1, "k", 1) for i, t, s in rows], SCHEMA)
    got = secrets.scan_secrets(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_assign, by[1].live_spans) == (1, []) and [tuple(s) for s in by[1].examples] == [("assign", 0, 27)]
    assert [tuple(s) for s in by[2].live_spans] == [("live", 32, 48)]
    assert (by[3].n_access, by[3].n_hex) == (1, 1) and [tuple(s) for s in by[3].base_spans] == [("access", 2, 22), ("hex", 23, 41)]
    assert by[4].base_spans == [] == by[5].live_spans
    assert [tuple(s) for s in by[6].base_spans] == [("assign", 16, 40)]
    assert by[7].n_assign == 1 and [tuple(s) for s in by[8].live_spans] == [("live", 100_008, 100_024)]
    assert secrets.scan_secrets(empty).collect() == []


def test_secrets_count_repositories_and_copies_of_a_text_once(spark):
    rng = random.Random(5)
    example, copied, spread, few = "Zx81kQ0pLm93vT77", "Qp7Hd93kLs0Vb2Xn", "Rt5Yw02mNc84zKq1", "Hb6Jf19xVd37sGa4"
    rows = [(i, f"{text(rng, 30)} token={example} {text(rng, 10)}", "a") for i in range(20)]  # different texts of one owner
    rows += [(20 + i, f"{text(rng, 30)} token={few}", "a") for i in range(3)]
    leak = f"{text(rng, 200)} secret={copied} {text(rng, 200)}"
    rows += [(30, leak, "a"), (31, leak, "b"), (32, leak + " and a word", "c"), (33, f"{text(rng, 30)} token={copied}", "b")]
    rows += [(40 + i, leak, "b") for i in range(10)]
    told = f"{text(rng, 200)} passwd={spread} {text(rng, 200)}"
    rows += [(60, told, "a"), (61, told, "b"), (62, f"{text(rng, 30)} token={spread}", "c")]
    docs = spark.createDataFrame([(i, t, s, 1, "k", 1) for i, t, s in rows], SCHEMA).repartition(3)
    got = secrets.scan_secrets(docs).collect()
    live = {i for i, t, _ in rows if copied in t or few in t}
    assert {r.doc_id for r in got if r.live_spans} == live
    assert {r.doc_id for r in got if r.examples} == {i for i, _, _ in rows} - live
    more = secrets.scan_secrets(docs, max_live_repos=20).filter("doc_id < 20").collect()
    assert all(r.live_spans and not r.examples for r in more) and len(more) == 20


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/\r\nX: y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (4, "u", ""), (5, "v", "x" * 3_000_000), (None, "w", "<p>é</p>"), (1, None, "<p>é</p>"), (6, "q", "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(i, u, h, 9, "z") for i, u, h in rows], "page_id long, url string, html string, path int, records string").repartition(2)
    got = warc.round_trip(pages, folder=f"file://{tmp_path}/a", archive_bytes=500).collect()
    sizes = {i: len((h or "").encode()) for i, _, h in rows}
    assert Counter((r.page_id, r.payload_bytes) for r in got) == Counter((i, sizes[i]) for i, _, _ in rows)
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[3].record_type, by[3].refers_to, by[None].refers_to) == ("response", "revisit", 1, 1)
    assert (by[2].record_type, by[4].record_type, by[4].refers_to) == ("response", "revisit", 2)
    assert by[5].payload_digest == base64.b32encode(hashlib.sha1(b"x" * 3_000_000).digest()).decode()
    assert by[3].url == "http://a/%0D%0AX: y" and by[1].url is None
    big = warc.round_trip(pages, folder=f"file://{tmp_path}/b", least_bytes=10).collect()
    assert {r.page_id: r.record_type for r in big}[4] == "response"
    assert warc.round_trip(pages.filter("false"), folder=f"file://{tmp_path}/c").collect() == []


def test_warc_reader_rejects_damage():
    good = warc.record("response", [("WARC-Record-ID", "<urn:x-page:1>")], b"abc")
    assert [b for _, b in warc.read_records(io.BytesIO(good * 3))] == [b"abc"] * 3
    plain = zlib.decompress(good, 31)
    for bad in (plain.replace(b"abc\r\n", b"abd\r\n"), plain.replace(b"Length: 3", b"Length: 4"), b"junk"):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(packer.compress(bad) + packer.flush())))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good + good[:-3])))


def test_base_patterns_are_the_stated_ones():
    rng = random.Random(1)
    stated = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for _ in range(300):
        t = "".join(rng.choice(["tOken", "passwd", "API_KEY", "apikey", "=", ":", " ", '"', "'", "\n", "é", "abcdef0123456789", "AKIA", "Q9Z8", "0", "ſecret", "x"]) for _ in range(40))
        want = [("assign", m.start(), m.end()) for m in stated.finditer(t) if len(m[2]) >= 12]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert Counter(f[:3] for f in secrets.candidates(t)) == Counter(want)
