"""Periodic runs of words by Kolpakov and Kucherov: stretches that repeat with a period and no neighbour extends.

A text's words are factorised from left to right by a suffix automaton: each factor is the longest stretch that began
earlier as well. A run that crosses a factor's start, or touches it, reaches back at most twice the factor before and once
this one; Main's algorithm finds these by common extensions on both sides of the start. Any other run lies inside
its factor and is copied from the factor's earlier occurrence.

Runs of at least LEAST words repeat a window of LEAST / 2 words, and such windows cover each word of them. So texts
without a repeated window have no run, and elsewhere the algorithm works on the covered stretches alone: the result is
that of the whole text.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graincast.llm.common import map_arrow, table, with_columns

#: Words that a run has at least; even. It also has two periods at least.
LEAST = 12
_MIX = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]  # start, end, period


def factors(word: list[int]) -> list[tuple[int, int]]:
    """(length, earlier start) of each factor; a new word is a factor of its own without one (-1).

    The earlier occurrence may overlap the factor. The automaton's states know the end of their first occurrence.
    """
    follow: list[dict[int, int]] = [{}]
    link, size, first, last = [-1], [0], [-1], 0
    for i, w in enumerate(word):
        new = len(size)
        follow.append({})
        size.append(size[last] + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and w not in follow[p]:
            follow[p][w] = new
            p = link[p]
        if p >= 0:
            q = follow[p][w]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(size)
                follow.append(dict(follow[q]))
                size.append(size[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and follow[p].get(w) == q:
                    follow[p][w] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    found, i = [], 0
    while i < len(word):
        state, n = 0, 0
        while i + n < len(word):
            after = follow[state].get(word[i + n])
            if after is None or first[after] - n >= i:
                break
            state, n = after, n + 1
        found.append((n, first[state] - n + 1) if n else (1, -1))
        i += n or 1
    return found


def extensions(s: list[int]) -> list[int]:
    """For each place, how many words from there on equal the beginning (Z function)."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(word: list[int], low: int, cut: int, high: int, found: dict[tuple[int, int], int], least: int) -> None:
    """Main's algorithm: puts the runs of ``word[low:high]`` that contain or touch ``cut`` into ``found``, by their ends the smallest period.

    What goes on beyond ``low`` or ``high`` isn't maximal here and is found at another cut.
    """
    x, y, n = word[low:cut], word[cut:high], len(word)
    back = x[::-1]
    both = [*y, -1, *x, *y]
    forward_y, forward_x = extensions(y), extensions(both)  # of y with y, and of y with x + y
    mirror = [*back, -1, *y[::-1], *back]
    back_x, back_y = extensions(back), extensions(mirror)  # of x's end with x, and with x + y

    def put(start: int, end: int, period: int) -> None:
        if end - start < max(least, 2 * period) or (start > 0 and word[start - 1] == word[start - 1 + period]) or (end < n and word[end] == word[end - period]):
            return
        if found.get((start, end), period) >= period:
            found[start, end] = period

    for q in range(1, len(y) + 1):  # a whole period from the cut on
        right = forward_y[q] if q < len(y) else 0
        left = back_y[len(x) + 1 + len(y) - q] if x else 0
        if left + right >= q:
            put(cut - left, cut + q + right, q)
    for q in range(1, len(x) + 1):  # a whole period before the cut
        right = forward_x[len(y) + 1 + len(x) - q] if y else 0
        left = back_x[q] if q < len(x) else 0
        if left + right >= q:
            put(cut - q - left, cut + right, q)


def runs(word: list[int], least: int = LEAST) -> list[Run]:
    """All runs of ``least`` words or more as (start, end, smallest period), in order."""
    found: dict[tuple[int, int], int] = {}
    starts: list[Run] = []  # what ``found`` has, in order of starts
    at, before = 0, 0
    for size, earlier in [*factors(word), (0, -1)]:
        if at:
            new: dict[tuple[int, int], int] = {}
            crossing(word, max(0, at - 2 * before - size), at, at + size, new, least)
            for (start, end), period in new.items():
                if (start, end) not in found:
                    bisect.insort(starts, (start, end, period))
                found[start, end] = min(period, found.get((start, end), period))
        if earlier >= 0:
            moved, end_at = at - earlier, at + size
            place = bisect.bisect_left(starts, (earlier + 1, 0, 0))
            while place < len(starts) and starts[place][0] + moved < end_at - 1:
                start, end, period = starts[place]
                if end + moved < end_at and (start + moved, end + moved) not in found:
                    found[start + moved, end + moved] = period
                    bisect.insort(starts, (start + moved, end + moved, period))  # after this place
                place += 1
        at, before = at + size, size
    return sorted((start, end, period) for (start, end), period in found.items())


def covered(word: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The stretches of words that lie in windows which ``word`` (their hashes) has twice or more. Clashes only add some."""
    n = len(word) - window + 1
    if n < 2:
        return []
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        sums = sums * _MIX + word[k : k + n]
    order = np.sort(sums)
    same = order[1:] == order[:-1]
    if not same.any():
        return []
    twice = np.isin(sums, order[1:][same])
    edge = np.zeros(len(word) + 1, dtype=np.int64)
    edge[:n] += twice
    edge[window:] -= twice
    inside = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)
    steps = np.diff(inside)
    return list(zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True))


def text_runs(word: list[bytes], least: int = LEAST) -> list[Run]:
    """The runs of a text's words."""
    if len(word) < least:
        return []
    found = []
    for a, b in covered(np.fromiter(map(hash, word), np.int64, len(word)).view(np.uint64), least // 2):
        if b - a >= least:
            number: dict[bytes, int] = {}
            found += [(a + s, a + e, p) for s, e, p in runs([number.setdefault(w, len(number)) for w in word[a:b]], least)]
    return found


def seeded(word: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the contract's own repeats: in a tenth of the documents what follows a place is periodic. A null id has none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not word:
        return word
    g, n = h // 10, len(word)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*word[:a], *(word[a + i % p] for i in range(n - a))]


def collapsed(word: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without what any run has after its first period."""
    if not found:
        return word
    edge = [0] * (len(word) + 1)
    for start, end, period in found:
        edge[start + period] += 1
        edge[end] -= 1
    kept, depth = [], 0
    for w, step in zip(word, edge, strict=False):
        depth += step
        if not depth:
            kept.append(w)
    return kept


def words(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8."""
    return (text or b"").split()


def find(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with ``runs`` (start, length and period in words, in order) and ``collapsed`` text for ``text``.

    Rows are judged one by one, so repeated rows and ids and empty tables need nothing special. Null, empty and blank texts
    have no runs and collapse to the empty text. Own columns of these names are replaced. Memory is in proportion to the
    stretches of one text that repeat.
    """
    docs = docs.drop("runs", "collapsed")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        found, texts = [], []
        for text in part["text"].cast(pa.binary()).to_pylist():
            word = words(text)
            here = text_runs(word, least)
            found.append([{"start": s, "length": e - s, "period": p} for s, e, p in here])
            texts.append(b" ".join(collapsed(word, here)))
        return [pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())]

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    return map_arrow(docs, with_columns(("runs", "collapsed"), lambda: make, drop=("text",)), ", ".join([*rest, "runs array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed string"]))


def _digest(part: pa.RecordBatch) -> list[pa.Array]:
    counts, best, run_sha, text_sha = [], ([], [], [], []), [], []
    for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), strict=True):
        word = seeded(words(text), doc_id)
        found = text_runs(word)
        start, end, period = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=(None, None, None))
        longest = (start, end - start, period, 1000 * (end - start) // period) if found else (None,) * 4
        counts.append(len(found))
        for column, x in zip(best, longest, strict=True):
            column.append(x)
        run_sha.append(hashlib.sha256("".join(f"{s},{e - s},{p}\n" for s, e, p in found).encode()).hexdigest())
        text_sha.append(hashlib.sha256(b" ".join(collapsed(word, found))).hexdigest())
    return [pa.array(c, pa.int64()) for c in (counts, *best)] + [pa.array(c, pa.string()) for c in (run_sha, text_sha)]


def op11_word_runs(spark, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, after the contract's own repeats are put in. See ``find`` for odd rows; a null doc_id gets no repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    schema = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    return map_arrow(docs, with_columns(made, lambda: _digest, drop=("text",)), schema)
