"""Plain Python versions of what the operators return."""

import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOW))


def shingles(text, size=5):
    w = words(text)
    if len(w) >= size:
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def alike(a, b, percent=75):
    common = len(a & b)
    return bool(a and b) and 100 * common >= percent * (len(a) + len(b) - common)


def smallest_reachable(ids, linked):
    """ids and linked(i, j) over positions: of each position the smallest known id that links reach."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    known = {}
    for i, value in enumerate(ids):
        if value is not None:
            known[find(i)] = min(value, known.get(find(i), value))
    return [known.get(find(i)) for i in range(len(ids))]


def dedup(rows):
    """rows of (id, digest, text), distinct: the text without lines that match an earlier one."""
    seen, out = [], {}
    for key in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        kept = []
        for line in (key[2] or "").split("\n"):
            s = shingles(line, 1)
            if not any(alike(s, t) for t in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out[key] = "\n".join(kept)
    return out


def segments(scores):
    """All maximal scoring segments by definition: take the best, shortest first, then both sides of it."""
    found = []

    def split(lo, hi):
        best = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += scores[b]
                if total > 1e-12 and (best is None or total > best[0] + 1e-12 or total > best[0] - 1e-12 and b + 1 - a < best[2] - best[1]):
                    best = (total, a, b + 1)
        if best:
            found.append(best)
            split(lo, best[1])
            split(best[2], hi)

    split(0, len(scores))
    return sorted(found, key=lambda f: f[1])
