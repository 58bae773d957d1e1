"""Toxicity by maximum-scoring segments.

Training counts, over a bounded sample of labelled documents, in how many toxic and clean ones each word and each word
beginning occurs. A beginning's share of toxic documents has a Dirichlet prior centred on the share of the next shorter
beginning, and so on down to the overall share; words too rare to count are thus judged by how they begin. Words with
significant log-odds score them, all other words a small cost, so that clean text loses score on average. One linear scan
of each text finds every maximal segment of positive score (Ruzzo and Tompa). On clean text the best segment's score has
an extreme-value distribution with parameters K and lambda, fitted to the clean training documents; a document's evidence
is the sum of -ln(expected number of such segments by chance) over its significant ones, and a logistic curve turns it into a
probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm.durable import durable

WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 4, 12  # beginnings counted, in letters; a whole word also counts, as "word$"


@dataclass(frozen=True)
class Model:
    """scores: log-odds by beginning (whole words end in "$"); other: score of any other word; K and lambda of the
    extreme-value law; slope and offset of the logistic curve."""

    scores: dict[str, float]
    other: float
    k: float
    lam: float
    slope: float
    offset: float


def beginnings(word: str) -> list[str]:
    """From the shortest to the whole word."""
    return [word[:i] for i in range(SHORTEST, min(len(word), LONGEST) + 1)] + [word + "$"]


def word_score(word: str, scores: dict[str, float]) -> float:
    """Of the longest scored beginning; 0 if none."""
    for part in reversed(beginnings(word)):
        if part in scores:
            return scores[part]
    return 0.0


class Scanner:
    """Scores words by a model, remembering those seen; forgets all when that grows large (it is only a memory)."""

    def __init__(self, scores: dict[str, float], other: float):
        self.scores, self.other, self.seen = scores, other, {}

    def segments(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        """Number of words, and (score, first word, one past the last) of all maximal scoring segments."""
        words = WORD.findall((text or "").lower())
        seen, marked = self.seen, []
        for i, w in enumerate(words):
            s = seen.get(w)
            if s is None:
                if len(seen) > 500_000:
                    seen.clear()
                s = seen[w] = word_score(w, self.scores)
            if s:
                marked.append((i, s))
        return len(words), maximal_segments(marked, self.other)


def maximal_segments(marked: list[tuple[int, float]], other: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments of a sequence that is ``other`` (below 0) but at the marked places.

    Keeps disjoint candidates with the running sums at their left and right; a new positive score joins every candidate
    back to the nearest one that began lower, if its own right sum is higher. Each candidate is joined once, and the way
    back follows links past candidates known not to begin lower, so the work is linear in the marked places.
    """
    left: list[float] = []
    right: list[float] = []
    begin: list[int] = []
    end: list[int] = []
    link: list[int] = []  # nearest candidate before with a lower left sum, or -1
    total, at = 0.0, 0
    for place, score in marked:
        total += other * (place - at)
        at = place + 1
        before, total = total, total + score
        if score <= 0:
            continue
        lo, hi, start = before, total, place
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = link[j]
            if j < 0 or right[j] >= hi:
                left.append(lo)
                right.append(hi)
                begin.append(start)
                end.append(place + 1)
                link.append(j)
                break
            lo, start = left[j], begin[j]
            for column in (left, right, begin, end, link):
                del column[j:]
    return [(r - lo, b, e) for lo, r, b, e in zip(left, right, begin, end, strict=True)]


def evidence(n: int, segments: list[tuple[float, int, int]], k: float, lam: float) -> float:
    """Sum of -ln(E) over segments whose expected number by chance, E = K n exp(-lambda score), is below 1."""
    if not segments:
        return 0.0
    chance = math.log(k * max(n, 1))
    return sum(max(0.0, lam * s - chance) for s, _, _ in segments)


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text modulo 5 is 0."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "utf-8")) % 5 == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, toxic and clean documents with it, toxic and clean occurrences of it as a whole word)."""
    for batch in batches:
        docs, uses = (Counter(), Counter()), (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = Counter(WORD.findall((text or "").lower()))
            docs[toxic].update({p for w in own for p in beginnings(w)})
            for w, n in own.items():
                uses[toxic][w + "$"] += n
        parts = list({**docs[0], **docs[1]})
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.string()), *(pa.array([c[p] for p in parts], pa.int64()) for c in (docs[1], docs[0], uses[1], uses[0]))],
            names=["part", "toxic_docs", "clean_docs", "toxic_uses", "clean_uses"],
        )


def log_odds(counts: list[tuple[str, int, int]], share: float, *, strength: float, least: float, z: float) -> dict[str, float]:
    """Significant log-odds of parts, given (part, toxic documents, clean documents), each part after its beginnings."""
    posterior: dict[str, float] = {}
    scores: dict[str, float] = {}
    base = math.log(share / (1 - share))
    for part, toxic, clean in sorted(counts, key=lambda c: (len(c[0].rstrip("$")), c[0].endswith("$"))):
        word = part.rstrip("$")
        known = beginnings(word)
        above = next((posterior[p] for p in reversed(known[: known.index(part)]) if p in posterior), share)
        # A beginning's documents include this part's own, so its share may only say so much in advance.
        above = min(max(above, share / 10), (1 + share) / 2)
        t, c = toxic + strength * above, clean + strength * (1 - above)
        posterior[part] = t / (t + c)
        odds = math.log(t / c) - base
        if abs(odds) >= least and abs(odds) >= z * math.sqrt(1 / t + 1 / c):
            scores[part] = odds
        elif any(p in scores for p in known[: known.index(part)]) and abs(odds) < least:
            scores[part] = 0.0  # not like its beginning
    return scores


def _gumbel(scores: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """K and lambda of P(best score > s) = 1 - exp(-K n exp(-lambda s)) by maximum likelihood; documents without a
    segment only say that theirs is below the smallest score found."""
    some = scores > 0
    if some.sum() < 10:
        return 0.01, 1.0
    floor = scores[some].min()

    def fit(lam: float) -> tuple[float, float]:
        weight = (n[some] * np.exp(-lam * scores[some])).sum() + (n[~some] * math.exp(-lam * floor)).sum()
        k = some.sum() / weight
        return some.sum() * math.log(k * lam) - lam * scores[some].sum() - some.sum(), k

    best = max((fit(lam)[0], lam) for lam in np.linspace(0.2, 3.0, 141).tolist())[1]
    return fit(best)[1], best


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, lightly regularised so that separable data stay finite."""
    design, w = np.c_[x, np.ones(len(x))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 40_000, min_docs: int = 5, strength: float = 2.0, least: float = 1.5, z: float = 4.0) -> Model:
    """A model from labelled documents outside the held-out fifth.

    ``max_rows`` bounds the sample, in expectation: if there are more labelled rows, those with the smallest id hashes are
    taken. Everything brought to the driver comes from that sample: the parts in ``min_docs`` documents or more, and each
    document's best score. Rows with a null id or a label other than 0 and 1 are ignored; without both labels the model
    calls nothing toxic.
    """
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).filter("_id IS NOT NULL AND toxic IN (0, 1)")
    usable = usable.filter(~held_out(F.col("_id"))).dropDuplicates(["_id"])
    total = usable.count()
    if total > max_rows:
        usable = usable.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    sample = durable(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(usable), "_id").select("text", "toxic").distinct())
    n = dict.fromkeys((0, 1), 0) | {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n[0] or not n[1]:
        return Model({}, -1.0, 1.0, 1.0, 0.0, -5.0)
    columns = ("toxic_docs", "clean_docs", "toxic_uses", "clean_uses")
    counts = sample.mapInArrow(_count, "part string, toxic_docs long, clean_docs long, toxic_uses long, clean_uses long")
    counts = durable(counts.groupBy("part").agg(*(F.sum(c).alias(c) for c in columns)))
    frequent = counts.filter(F.col("toxic_docs") + F.col("clean_docs") >= min_docs)
    parts = frequent.select("part", "toxic_docs", "clean_docs").toArrow().to_pylist()
    scores = log_odds([(p["part"], p["toxic_docs"], p["clean_docs"]) for p in parts], n[1] / (n[0] + n[1]), strength=strength, least=least, z=z)
    uses = counts.filter("part LIKE '%$'").select("part", "toxic_uses", "clean_uses")

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([word_score(p[:-1], scores) for p in batch.column(0).to_pylist()])
            t, c = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in (t.sum(), c.sum(), t[s > 0].sum(), c[s > 0].sum(), (c * s).sum())], names=list("abcde"))

    a, b, c, d, e = uses.mapInArrow(masses, "a double, b double, c double, d double, e double").agg(*(F.sum(x) for x in "abcde")).first()
    # Of ratios of likelihoods; clean text must lose score on average.
    other = min(math.log(max(1 - c / max(a, 1), 1e-6) / max(1 - d / max(b, 1), 1e-6)), -2 * max(e, 0) / max(b, 1), -1e-4)
    scanned = sample.mapInArrow(lambda it: _best(it, scores, other), "toxic int, n long, scores array<double>").toArrow()
    toxic, words = scanned["toxic"].to_numpy(), scanned["n"].to_numpy()
    found = [[(s, 0, 0) for s in row] for row in scanned["scores"].to_pylist()]
    best = np.array([max((s for s, _, _ in row), default=0.0) for row in found])
    k, lam = _gumbel(best[toxic == 0], np.maximum(words[toxic == 0], 1))
    x = np.array([evidence(m, row, k, lam) for m, row in zip(words.tolist(), found, strict=True)])
    slope, offset = _logistic(x, toxic.astype(float))
    return Model(scores, other, k, lam, slope, offset)


def _best(batches: Iterator[pa.RecordBatch], scores: dict[str, float], other: float) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(scores, other)
    for batch in batches:
        rows = [scanner.segments(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array([n for n, _ in rows], pa.int64()), pa.array([[s for s, _, _ in segments] for _, segments in rows], pa.list_(pa.float64()))], names=["toxic", "n", "scores"]
        )


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, held_out (boolean), score (double, 0 to 1), predicted (int: score >= 0.5), n_words
    (long), evidence (double) and passages (array of score, start and end word of each significant segment).

    Only the text decides the score. Null, empty and wordless texts have no evidence. Repeated rows give repeated results,
    a null id counts as the empty text in held_out, an empty table gives an empty result, and other columns are not looked
    at. Whole texts are scanned.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    chance = model.k

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.scores, model.other)
        for batch in batches:
            words, totals, passages = [], [], []
            for text in batch.column(2).to_pylist():
                n, segments = scanner.segments(text)
                floor = math.log(chance * max(n, 1)) / model.lam
                words.append(n)
                totals.append(evidence(n, segments, model.k, model.lam))
                passages.append([{"score": s, "start": b, "end": e} for s, b, e in segments if s > floor])
            x = np.array(totals, float)
            p = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(words, pa.int64()), pa.array(x),
                 pa.array(passages, pa.list_(pa.struct([("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])))],
                names=["_id", "held_out", "score", "predicted", "n_words", "evidence", "passages"],
            )

    rows = docs.select(F.col(id_col).alias("_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    out = f"_id {kind}, held_out boolean, score double, predicted int, n_words long, evidence double, passages array<struct<score:double,start:int,end:int>>"
    return rows.mapInArrow(scan, out).withColumnRenamed("_id", id_col)
