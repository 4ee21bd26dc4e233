"""Brute-force versions of the contracts, in plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def ws_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def az(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def _covered(seqs: list, width: int) -> list[list[bool]]:
    count = Counter(tuple(s[i : i + width]) if not isinstance(s, bytes) else s[i : i + width] for s in seqs for i in range(len(s) - width + 1))
    out = []
    for s in seqs:
        mask = [False] * len(s)
        for i in range(len(s) - width + 1):
            if count[tuple(s[i : i + width]) if not isinstance(s, bytes) else s[i : i + width]] > 1:
                mask[i : i + width] = [True] * width
        out.append(mask)
    return out


def words_removed(docs: list[tuple], width: int = 35) -> list[tuple]:
    words = [ws_words(t) for _, t in docs]
    return [(d, len(w), sum(m), sha(" ".join(x for x, y in zip(w, m) if not y))) for (d, _), w, m in zip(docs, words, _covered(words, width))]


def bytes_removed(docs: list[tuple], width: int = 400) -> list[tuple]:
    data = [(t or "").encode() for _, t in docs]
    out = []
    for (d, _), b, m in zip(docs, data, _covered(data, width)):
        runs = sum(1 for i, x in enumerate(m) if x and (i == 0 or not m[i - 1]))
        out.append((d, len(b), sum(m), runs, sha(bytes(x for x, y in zip(b, m) if not y))))
    return out


def shingle_set(text: str | None, k: int) -> frozenset:
    w = ws_words(az(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def near(docs: list[tuple], k: int, percent: int) -> list[tuple]:
    sets = [shingle_set(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    index = defaultdict(list)
    for i, s in enumerate(sets):
        hits = Counter(j for x in s for j in index[x])
        for j, n in hits.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in s:
            index[x].append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", az(text or ""))


def contaminated(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    windows = defaultdict(set)
    for i, t in items:
        w = item_words(t)
        if w:
            size = min(10, len(w))
            for a in range(len(w) - size + 1):
                windows[tuple(w[a : a + size])].add(i)
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w = item_words(t)
        mask, ids = [False] * len(w), set()
        for size in sizes:
            for a in range(len(w) - size + 1):
                if found := windows.get(tuple(w[a : a + size])):
                    ids |= found
                    mask[a : a + size] = [True] * size
        out.append((d, len(w), sum(mask), len(ids), sha(",".join(sorted(map(str, ids)))), any(mask)))
    return out


def base_counts(docs: list[tuple]) -> list[tuple]:
    out = []
    for d, t in docs:
        w = ws_words(t)
        lines, seen, dup = (t or "").split("\n"), set(), 0
        for x in lines:
            if ws_words(x):
                dup += x in seen
                seen.add(x)
        g = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        many, mask = Counter(g), [False] * len(w)
        for i, x in enumerate(g):
            if many[x] > 1:
                mask[i : i + 8] = [True] * 8
        n = len(w)
        out.append((d, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, sum(mask), n < 20 or 100 * sum(mask) > 30 * n))
    return out
