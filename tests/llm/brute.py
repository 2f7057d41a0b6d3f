"""Plain versions of the operators' definitions, for comparisons on small tables."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None, k: int) -> frozenset:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def components(ids, links) -> dict:
    """Smallest id that each id can reach."""
    above = {i: i for i in ids}

    def top(i):
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        above[b] = a
    return {i: top(i) for i in ids}


def near_duplicates(docs: dict, k: int, percent: int) -> dict:
    """doc_id -> (n_shingles, component_id)."""
    sets = {i: shingles(t, k) for i, t in docs.items()}
    by_set: dict = {}
    for i in sorted(sets):
        if sets[i]:
            by_set.setdefault(sets[i], []).append(i)
    links = [(own[0], other) for own in by_set.values() for other in own[1:]]
    rows = list(by_set)
    holding: dict = {}
    for n, s in enumerate(rows):
        for x in s:
            holding.setdefault(x, []).append(n)
    for n, s in enumerate(rows):
        shared = Counter(m for x in s for m in holding[x] if m > n)
        for m, both in shared.items():
            if 100 * both >= percent * (len(s) + len(rows[m]) - both):
                links.append((by_set[s][0], by_set[rows[m]][0]))
    found = components(docs, links)
    return {i: (len(sets[i]), found[i]) for i in docs}


def near_vectors(rows: list, threshold: float) -> dict:
    """vec_id -> (n_links, component_id) of rows (vec_id, vector, label)."""
    usable = [
        (i, np.array(v, np.float64), g)
        for i, v, g in rows
        if g is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links, n = [], Counter()
    for a in range(len(usable)):
        for b in range(a):
            (i, x, g), (j, y, h) = usable[a], usable[b]
            if g == h and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    found = components([r[0] for r in rows], links)
    return {i: (n[i], found[i]) for i in found}


def statistics(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed


def _chi2(x: float, dof: int) -> float:
    from math import exp, factorial

    return 1 - exp(-x / 2) * sum((x / 2) ** i / factorial(i) for i in range(dof // 2))


def _quantile(q: float, dof: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, dof) < q else (low, mid)
    return high


def outlier_distances(x: np.ndarray, floors: tuple, support: float = 0.75, steps: int = 12) -> np.ndarray:
    """Squared distances by the minimum covariance determinant of the rows of x, from the three starts."""
    ridge = np.diag(np.square(floors))
    lowest = lambda v, q: np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]
    far = lambda y, m, c: np.einsum("ij,jk,ik->i", y - m, np.linalg.inv(c), y - m)
    cov = lambda y: np.cov(y, rowvar=False, bias=True)
    middle = np.array([lowest(c, 0.5) for c in x.T])
    width = np.maximum([1.4826 * lowest(np.abs(c - m), 0.5) for c, m in zip(x.T, middle)], floors)
    z = (x - middle) / width
    length = np.linalg.norm(z, axis=1, keepdims=True)
    units = np.divide(z, length, out=np.zeros_like(z), where=length > 0)
    shapes = [np.eye(len(floors))] + [cov(y) + np.diag(np.square(floors / width)) for y in (np.tanh(z), units)]
    p = len(floors)
    scale = support / _chi2(_quantile(support, p), p + 2)
    best = None
    for shape in shapes:
        m, c = middle, shape * np.outer(width, width)
        for _ in range(steps):
            d = far(x, m, c)
            inner = x[d <= lowest(d, support)]
            m, c = inner.mean(0), cov(inner) * scale + ridge
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0] - 1e-9:
            best = det, m, c
    inner = x[far(x, *best[1:]) <= _quantile(0.975, p)]
    return far(x, inner.mean(0), cov(inner) * 0.975 / _chi2(_quantile(0.975, p), p + 2) + ridge)


def licence_windows(text: str | None, window: int = 64, step: int = 48, wrapped: int = 100) -> list:
    """Word lists of the windows of a text's distinct paragraphs, comment marks off."""
    mark = re.compile(r"(?:/\*+|\*+/?|//+!?|#+|--+|;+|%+|<!--|\.\.|(?i:rem|dnl)\b)[ \t\r]*")
    lines = []
    for line in (text or "").split("\n"):
        line = line.lstrip(" \t\r")
        while m := mark.match(line):
            line = line[m.end() :]
        lines.append(line)
    blocks, before = [], 0
    for line in lines:
        if blocks and 0 < before <= wrapped and 0 < len(line) <= wrapped:
            blocks[-1] += " " + line
        else:
            blocks.append(line)
        before = len(line)
    out = []
    for p in dict.fromkeys(blocks if blocks == lines else blocks + lines):
        words = re.findall(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*", p.lower())
        starts = range(0, max(1, len(words) - (window - step)), step)
        out += [words] if 0 < len(words) <= window else [words[a : a + window] for a in starts] if words else []
    return out


def licences(text: str | None, vocabulary: dict, weights: np.ndarray, bias: np.ndarray, heat: float, least: float, classes: list, templates: dict) -> str | None:
    """Families that the classifier gives a window and a template confirms."""
    pairs = lambda w: {" ".join(w[i : i + 2]) for i in range(max(1, len(w) - 1))}
    shapes = {f: [pairs(re.findall(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*", t.lower())) for t in ts] for f, ts in templates.items() if f != "unknown"}
    owners = Counter(x for ts in shapes.values() for x in set().union(*ts))
    found = set()
    for w in licence_windows(text):
        grams = {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
        z = bias + sum((weights[:, vocabulary[g]] for g in grams if g in vocabulary), np.zeros(len(bias)))
        odds = np.exp((z - z.max()) / heat)
        unknown = classes.index("unknown")
        if 1 - odds[unknown] / odds.sum() > least and not re.search(r"\b(?:not|never|no longer)(?: be| been| yet)? (?:licensed|released|distributed|dedicated|available)\b", " ".join(w)):
            family = max((z[i], c) for i, c in enumerate(classes) if c != "unknown")[1]
            own = pairs(w)
            if any(len(t & own) >= 0.6 * len(t) and any(owners[x] == 1 for x in t & own) for t in shapes[family]):
                found.add(family)
    if "bsd" in found:
        found.remove("bsd")
        if "bsd-3-clause" not in found:
            found.add("bsd-2-clause")
    return ",".join(sorted(found)) or None
