"""Plain Python versions of the operators, from their contracts alone."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def decontam(docs: list[tuple], items: list[tuple], size: int = 10) -> dict:
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))

    wins: dict[tuple, set] = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add(str(i))
    sizes = {len(k) for k in wins}
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if ids := wins.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= ids
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def substrings(docs: list[tuple], size: int = 35) -> list[tuple]:
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[p : p + size]) for w in words for p in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = set()
        for p in range(len(w) - size + 1):
            if seen[tuple(w[p : p + size])] > 1:
                gone |= set(range(p, p + size))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


def simhash(text: str | None) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints: list[tuple[int, int]], most: int = 2) -> dict[int, int]:
    """doc_id to the smallest doc_id reachable."""
    by = defaultdict(list)
    for d, f in prints:
        by[f].append(d)
    keys = sorted(by)
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (a ^ b).bit_count() <= most]
    return reachable([d for d, _ in prints], [(by[f][0], d) for f in keys for d in by[f]] + [(by[a][0], by[b][0]) for a, b in pairs])


def reachable(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest id that each is linked to."""
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, e in links:
        x, y = root(d), root(e)
        parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def similar(docs: list[tuple], size: int = 5, least: float = 0.8) -> dict[int, int]:
    """doc_id to the smallest doc_id reachable over shingle sets of the similarity."""
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}
    ids = list(sets)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    return reachable(ids, near)
