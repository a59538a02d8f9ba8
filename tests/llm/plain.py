"""Plain versions of the text operators, for small tables only."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def shingle_set(text: str | None, k: int = 5) -> set:
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def near_duplicates(docs: list[tuple]) -> set[tuple]:
    """(id, n_shingles, component_id) by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                low, high = sorted((find(i), find(j)), key=lambda v: (v is not None, v or 0))
                parent[high] = low
    return sorted(((i, len(x), find(i)) for i, x in sets), key=str)


def repeated_bytes(docs: list[tuple], length: int = 100) -> set[tuple]:
    """(id, n_bytes, n_removed, n_spans, kept_sha256); docs in order."""
    seen, out = set(), set()
    for i, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            window = raw[at : at + length]
            if window in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(window)
        spans = sum(1 for j in range(len(raw)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.add((i, len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone, strict=True) if not g))))
    return out


def normal(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", (text or "").translate(LOWER)).strip(" ")


def least_distance(item: str, text: str) -> int:
    """Edits from the item to the nearest substring of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def line_dedup(docs: list[tuple]) -> set[tuple]:
    """(id, n_lines, n_dropped, kept_sha256)."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for n, (_, text) in enumerate(docs):
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(n)
    keeper = {k: max(docs[n][0] for n in v) for k, v in holders.items() if len(v) >= 3}
    out = set()
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), i) == i]
        out.add((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out
