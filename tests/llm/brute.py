"""Brute-force versions of the operators, over rows as Python lists."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def warc(pages):
    """page_id -> (bytes, digest, type, refers_to)"""
    body = {p: (h or "").encode() for p, h in pages}
    largest = {}
    for p, b in body.items():
        largest[b] = max(p, largest.get(b, p))
    out = {}
    for p, b in body.items():
        told = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out[p] = (len(b), told, "response", None) if largest[b] == p else (len(b), told, "revisit", largest[b])
    return out


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def nearest(rows, asked, k):
    """query id -> [(id, distance)]"""
    ids = np.array([i for i, v in rows if usable(v)])
    x = np.array([v for _, v in rows if usable(v)], dtype=np.float64)
    out = {}
    for q, v in zip(ids, x):
        if asked(q):
            d = np.sqrt(((x - v) ** 2).sum(1))
            order = np.lexsort((ids, d))
            out[int(q)] = [(int(ids[i]), float(d[i])) for i in order if ids[i] != q][:k]
    return out


def components(ids, pairs):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def linked_vectors(rows, least):
    """id -> (links, component)"""
    ids = [i for i, v in rows if usable(v)]
    x = np.array([v for _, v in rows if usable(v)], dtype=np.float64).reshape(len(ids), -1)
    n = np.sqrt((x * x).sum(1))
    cos = (x @ x.T) / (n[:, None] * n[None])
    pairs = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(cos >= least, 1)))]
    count, root = Counter(a for p in pairs for a in p), components([i for i, _ in rows], pairs)
    return {i: (count[i], root[i]) for i, _ in rows}


def without_repeats(docs, size):
    """doc id -> (words, removed, kept text)"""
    lists = {d: words(t) for d, t in docs}
    seen = Counter()
    for w in lists.values():
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])] += 1
    out = {}
    for d, w in lists.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def linked_texts(docs, n, least):
    """doc id -> (class, links, component)"""
    sets, first = {}, {}
    for d, t in docs:
        w = words(t)
        k = min(n, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        if w:
            first[t] = min(d, first.get(t, d))
    owners = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            owners[g].append(d)
    common = Counter()
    for g, ds in owners.items():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[min(a, b), max(a, b)] += 1
    pairs = [(a, b) for (a, b), c in common.items() if c >= least * (len(sets[a]) + len(sets[b]) - c) - 1e-12]
    count, root = Counter(a for p in pairs for a in p), components(list(sets), pairs)
    texts = dict(docs)
    return {d: (first.get(texts[d], d) if sets[d] else d, count[d], root[d]) for d in sets}


def targets(sizes, weights, share, most):
    """The same law by small steps: fill all sources in proportion to their weights until the budget is spent."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out = share * sum(sizes.values()), dict.fromkeys(order, 0.0)
    while left > 1e-9:
        open_ = [s for s in order if out[s] < most * sizes[s] - 1e-12]
        if not open_:
            break
        step = min([left / sum(w[s] for s in open_)] + [(most * sizes[s] - out[s]) / w[s] for s in open_])
        for s in open_:
            out[s] += step * w[s]
        left -= step * sum(w[s] for s in open_)
    return out


def token_rows(docs, encode, end):
    """doc id -> (start, n, crc) in ascending doc_id order"""
    out, at = {}, 0
    for d, t in sorted(docs, key=lambda r: r[0]):
        ids = np.array([*encode(t or ""), end], dtype="<u4")
        out[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    return out


def merkle(rows, fan=8):
    """``(doc_id, leaf, subroot, root, proof digest, folded root, verified)`` of rows (doc_id, source, lang, n_chars, text)."""
    told = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    item = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for d, s, lang, n, t in rows:
        low = t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        now = low if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else t
        leaf, changed = (told(*map(item, (d, s, lang, n, x))) for x in (t, now))
        groups[lang].append((d is not None, d or 0, leaf, changed, d))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([told(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
        return levels

    def siblings(levels, i):
        out = []
        for level in levels[:-1]:
            first = i // fan * fan
            out.append((level[first:i], level[i + 1 : first + fan]))
            i //= fan
        return out

    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([leaf for _, _, leaf, _, _ in sorted(groups[x], key=lambda g: g[:4])]) for x in langs}
    top, out = tree([trees[x][-1][0] for x in langs]), []
    for k, lang in enumerate(langs):
        for i, (_, _, leaf, changed, d) in enumerate(sorted(groups[lang], key=lambda g: g[:4])):
            proof = siblings(trees[lang], i) + siblings(top, k)
            folded = changed
            for left, right in proof:
                folded = told(*left, folded, *right)
            out.append((d, leaf, trees[lang][-1][0], top[-1][0], told(*[x for a, b in proof for x in a + b]), folded, folded == top[-1][0]))
    return out


def whitening(rows, components=8):
    """Directly from the covariance: ``(ids, n, deviations, whitened, explained)`` of rows (id, vector)."""
    kept = [(i, v) for i, v in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    x = np.array([[int(np.floor(1024 * e)) + 100_000 for e in v] for _, v in kept], dtype=np.int64)
    n, sums = len(x), [int(s) for s in x.sum(0)]
    deviation = [sum((n * int(e) - s) ** 2 for e, s in zip(row, sums)) for row in x]
    y = x - np.array(sums) / n
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return [i for i, _ in kept], n, deviation, y @ vectors / np.sqrt(values), values / np.trace(cov)
