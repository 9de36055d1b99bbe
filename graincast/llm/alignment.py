"""Cross-tokenizer alignment: tokens of two vocabularies over the same bytes, by bitsets of token ends.

A text with a blank before it is cut where a blank that isn't its last character follows what isn't white space. No token of either vocabulary goes
over such a cut (checked for the pieces of the second; the first one's pattern begins a piece there), so the units
between cuts are encoded by themselves and a unit that comes again isn't encoded again. For a batch of new units the places
where tokens end are bits of packed 64-bit words, one bitset a vocabulary. Their AND has the shared cuts, their OR
the ends of links: between two neighbouring ends one token of each side overlaps. Ranks (popcounts before a place) map
such a place to the numbers of its tokens.

Links of an id pair are counted over all texts in one pass; a second one reads the counts. The counts are as many as
there are pairs of ids that meet, so they go to the tasks in parts of at most PART_PAIRS, one pass a part.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graincast.llm.bpe import LEAF, Codec, vocabulary_path
from graincast.llm.common import ROW, map_arrow, materialize, numbered, slices, table, with_columns

#: Pairs whose counts a task holds at a time (17 bytes each); more of them take further passes.
PART_PAIRS = 2_000_000
#: A task forgets its units when it has so many, or so many characters and tokens of them.
MOST_UNITS, MOST_HELD = 400_000, 16 << 20
#: A pair as one number: first id times this plus second id.
SECOND = 1 << 20
_CUT = re.compile(r"(?<=\S) (?!\Z)")
_BLANK = "▁"


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The second vocabulary: a sentencepiece file that adds a blank before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.base = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.base.id_to_piece(i) for i in range(self.base.get_piece_size())]
        if any(_BLANK in n.lstrip(_BLANK) for n in names):
            raise ValueError(f"{path}: a piece goes over the begin of a word")
        self.bytes_of = [bytes([int(n[3:5], 16)]) if self.base.is_byte(i) else n.replace(_BLANK, " ").encode() for i, n in enumerate(names)]


@functools.lru_cache(maxsize=2)
def encoders(first: str, second: str) -> tuple[Codec, Pieces]:
    return Codec(first), Pieces(second)


def plain_ids(codec: Codec, text: str) -> list[int]:
    """Token ids, with special tokens' names as plain text; long pieces by their trees."""
    if len(text) <= LEAF:
        return codec.base.encode_ordinary(text)
    ids: list[int] = []
    for m in codec.pieces.finditer(text):
        data = m.group().encode()
        ids += codec.tree(data, LEAF) if len(data) > LEAF else codec.single(data)
    return ids


class Ends:
    """A packed bitset over bytes, with the number of bits before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Ends:
        bits = np.zeros((size + 64) // 64 * 64, dtype=bool)
        bits[places] = True
        return cls(np.packbits(bits, bitorder="little").view(np.uint64))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Bits below each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """The places of all bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


@functools.lru_cache(maxsize=2)
def tables(first: str, second: str) -> tuple[list[np.ndarray], np.ndarray, int]:
    """Bytes of each token of both vocabularies, and all ids as text with what may follow: , or | in the first, then comma, ; or line end in the second; and how many the first has."""
    codec, pieces = encoders(first, second)
    names = [[str(i) + mark for i in range(len(side.bytes_of))] for side, marks in ((codec, ",|"), (pieces, ",;\n")) for mark in marks]
    return [np.array([len(t) for t in side.bytes_of], dtype=np.int64) for side in (codec, pieces)], np.array([n for part in names for n in part], dtype=object), len(codec.bytes_of)


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(ids), np.int64, sum(map(len, ids)))


class Aligned:
    """Units side by side: their tokens, cuts and links."""

    def __init__(self, texts: list[str], first: str, second: str):
        """``texts`` are units without the blank before them."""
        (codec, pieces), (widths, self.names, self.most_first) = encoders(first, second), tables(first, second)
        joined = [b" " + t.encode() for t in texts]
        whole = b"".join(joined)
        plain = not any(t[-1:].isspace() or len(t) > LEAF for t in texts)
        a = [codec.base.encode_ordinary(whole.decode())] if plain else [plain_ids(codec, " " + t) for t in texts]
        b = pieces.base.encode(texts, num_threads=1)
        spelt = lambda side, ids: b"".join(map(side.bytes_of.__getitem__, itertools.chain.from_iterable(ids)))
        self.good = np.ones(len(texts), dtype=bool)
        if spelt(codec, a) != whole or spelt(pieces, b) != whole:  # then which?
            a = [plain_ids(codec, " " + t) for t in texts]
            for i, t in enumerate(joined):
                if spelt(codec, [a[i]]) != t or spelt(pieces, [b[i]]) != t:
                    a[i], b[i], joined[i], self.good[i] = [], [], b"", False
        self.first, self.second = _flat(a), _flat(b)
        starts = np.cumsum([0, *map(len, joined)])  # bytes before each unit
        ends = [Ends.of(np.cumsum(w[ids]) - 1, int(starts[-1])) for w, ids in zip(widths, (self.first, self.second), strict=True)]  # a token's bit is its last byte
        shared, any_end = Ends(ends[0].words & ends[1].words), Ends(ends[0].words | ends[1].words)
        self.n_first, self.n_second = (np.diff(e.rank(starts)) for e in ends)
        last = any_end.select()
        #: Links as numbers of ids; they are in order, so a unit's links stand together.
        self.pairs = self.first[ends[0].rank(last)] * SECOND + self.second[ends[1].rank(last)]
        self.link_at, self.group_at = any_end.rank(starts), shared.rank(starts)
        cuts = shared.select()
        self.cut_first, self.cut_second = (e.rank(cuts) + 1 for e in ends)

    def groups(self) -> list[str]:
        """Each unit's groups as text, decimal ids; none for units that don't align."""
        n_second = len(self.names) - 2 * self.most_first
        a, b = self.first.copy(), self.second + 2 * self.most_first
        a[self.cut_first - 1] += self.most_first
        b[self.cut_second - 1] += n_second // 3
        b[self.cut_second[self.group_at[1:][self.good] - 1] - 1] += n_second // 3
        out = np.empty(len(a) + len(b), dtype=np.int64)
        # a group's tokens of the second vocabulary follow those of the first
        before = [np.repeat(there, np.diff(here, prepend=0)) for here, there in ((self.cut_first, np.concatenate([[0], self.cut_second[:-1]])), (self.cut_second, self.cut_first))]
        out[np.arange(len(a)) + before[0]] = a
        out[np.arange(len(b)) + before[1]] = b
        told = iter("".join(self.names[out].tolist()).split("\n"))
        return [next(told) if g else "" for g in self.good.tolist()]


def units(text: str | None) -> list[str]:
    """The units of a text, each without the blank before it; none for null and the empty text."""
    return _CUT.split(text) if text else []


class _Numbers(dict):
    """Numbers for what is looked up, in order; ``new`` is what wasn't there."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        self[unit] = n = len(self)
        return n


class Known:
    """Units met so far by number, with what is kept of each; all are forgotten when they are too many."""

    def __init__(self, keep):
        self.keep = keep
        self.begin()

    def begin(self) -> None:
        self.number, self.held = _Numbers(), 0
        self.odd = np.zeros(0, dtype=bool)  # units after which a blank doesn't cut
        self.keep(None)

    def look_up(self, texts: list[str | None]) -> list[np.ndarray]:
        """Numbers of each text's units; new units go to ``keep``, in order of their numbers."""
        if len(self.number) > MOST_UNITS or self.held > MOST_HELD:
            self.begin()
        found = [self._numbers(text.split(" ")) if text else self._numbers([]) for text in texts]
        self.odd = np.concatenate([self.odd, np.array([not u or u[-1].isspace() for u in self.number.new], dtype=bool)])
        again = [i for i, f in enumerate(found) if len(f) and (self.odd[f[:-1]].any() or texts[i].endswith(" "))]
        kept = len(self.number.new)
        for i in again:
            found[i] = self._numbers(units(texts[i]))
        self.odd = np.concatenate([self.odd, np.array([not u or u[-1].isspace() for u in self.number.new[kept:]], dtype=bool)])
        if self.number.new:
            self.held += sum(map(len, self.number.new))
            self.keep(self.number.new)
            self.number.new = []
        return found

    def _numbers(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))


def _pair_counts(first: str | None, second: str | None):
    """For ``mapInArrow``: (pair, n) of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = first or vocabulary_path(), second or piece_path()
        links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def keep(new: list[str] | None) -> None:
            if new is None:
                links.clear()
            else:
                x = Aligned(new, *paths)
                links.append((x.good, x.pairs, np.diff(x.link_at)))

        known = Known(keep)
        for batch in batches:
            told: dict[int, int] = {}
            for part in slices([batch]):
                found = known.look_up(part["text"].to_pylist())
                good = np.concatenate([x[0] for x in links]) if links else np.zeros(0, dtype=bool)
                used = [f for f in found if len(f) and good[f].all()]
                times = np.bincount(np.concatenate(used), minlength=len(good)) if used else np.zeros(len(good), dtype=np.int64)
                at, all_pairs, all_times = 0, [], []
                for _, pairs, n_links in links:
                    of_link = np.repeat(times[at : at + len(n_links)], n_links)
                    at += len(n_links)
                    seen = of_link > 0
                    all_pairs.append(pairs[seen])
                    all_times.append(of_link[seen])
                if all_pairs:
                    pairs, where = np.unique(np.concatenate(all_pairs), return_inverse=True)
                    counts = np.bincount(where, weights=np.concatenate(all_times)).astype(np.int64)
                    for p, n in zip(pairs.tolist(), counts.tolist(), strict=True):
                        told[p] = told.get(p, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(told), pa.int64()), pa.array(list(told.values()), pa.int64())], ["pair", "n"])

    return run


def pair_counts(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """``first_id, second_id, n, best`` of all pairs linked in ``text``: how many links hold a pair, and whether that is the most for its second id (ties are)."""
    counts = map_arrow(docs.select("text"), _pair_counts(first, second), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    rows = counts.select(F.expr(f"pair div {SECOND}").alias("first_id"), F.expr(f"pair % {SECOND}").alias("second_id"), "n")
    # a second id meets as many first ids as the first vocabulary has at most
    return rows.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("second_id")))


def _part(counts: DataFrame, part: int, parts: int):
    """The counts of the pairs whose second id falls to ``part``, sorted by pair: as arrays, for the tasks."""
    mine = counts.filter(F.col("second_id") % parts == part).select((F.col("first_id") * SECOND + F.col("second_id")).alias("pair"), "n", "best").toArrow()
    order = np.argsort(pairs := mine["pair"].to_numpy())
    return pairs[order], mine["n"].to_numpy()[order], mine["best"].to_numpy()[order].astype(np.int64)


def _digest(first: str | None, second: str | None, sent, whole: bool):
    """For ``with_columns``: a row's links among the sent pairs, and, if ``whole``, what doesn't hang on counts."""

    def begin():
        paths = first or vocabulary_path(), second or piece_path()
        pairs, n, best = sent.value
        #: of each unit: tokens of both, groups, links, best links, sum of counts, and whether it aligns
        rows: list[np.ndarray] = []
        told: list[str] = []

        def keep(new: list[str] | None) -> None:
            if new is None:
                rows.clear()
                told.clear()
                return
            x = Aligned(new, *paths)
            at = np.searchsorted(pairs, x.pairs)
            hit = np.zeros(len(at), dtype=bool)
            if len(pairs):
                at = np.minimum(at, len(pairs) - 1)
                hit = pairs[at] == x.pairs
            over = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[x.link_at])
            n_best, n_sum = (over(np.where(hit, v[at], 0)) if len(pairs) else over(np.zeros(len(at), dtype=np.int64)) for v in (best, n))
            rows.append(np.stack([x.n_first, x.n_second, np.diff(x.group_at), np.diff(x.link_at), n_best, n_sum, x.good.astype(np.int64)], axis=1))
            if whole:
                told.extend(x.groups())

        known = Known(keep)

        def make(part: pa.RecordBatch) -> list[pa.Array]:
            found = known.look_up(part["text"].to_pylist())
            values = np.concatenate(rows) if rows else np.zeros((0, 7), dtype=np.int64)
            rows[:] = [values]
            sums, sha = [], []
            for numbers in found:
                mine = values[numbers]
                good = len(mine) > 0 and mine[:, 6].all()
                sums.append(mine[:, :6].sum(axis=0) if good else np.zeros(6, dtype=np.int64))
                sha.append(hashlib.sha256(";".join(map(told.__getitem__, numbers.tolist())).encode()).hexdigest() if good and whole else "")
            columns = np.array(sums, dtype=np.int64).reshape(len(found), 6).T
            return [*(pa.array(c) for c in columns), pa.array(sha, pa.string())]

        return make

    return begin


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def align(docs: DataFrame, first: str | None = None, second: str | None = None, part_pairs: int = PART_PAIRS) -> DataFrame:
    """``docs`` with COLUMNS for ``text``.

    Null and empty texts, and texts that a vocabulary doesn't give back byte by byte, have no tokens: zeros and ''. Rows count for
    themselves, repeated ones too; an empty table gives none. Own columns of these names are
    replaced. Whole texts are read, a batch of rows at a time.
    Counts beyond ``part_pairs`` are read in parts by the second id, and rows put together again by their place.
    """
    spark, docs = docs.sparkSession, docs.drop(*COLUMNS)
    counts = materialize(pair_counts(docs, first, second), "pairs")
    parts = max(1, -(-counts.count() // part_pairs))
    rows = docs if parts == 1 else numbered(docs)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"), *(f"{c} bigint" for c in COLUMNS[:-1]), "groups_sha256 string"])

    def told(part: int) -> DataFrame:
        given = rows if part == 0 else rows.select("text", *ROW)
        kind = schema if part == 0 else ", ".join([*(f"{c} bigint" for c in (*ROW, *COLUMNS[:-1])), "groups_sha256 string"])
        sent = spark.sparkContext.broadcast(_part(counts, part, parts))
        return map_arrow(given, with_columns(COLUMNS, _digest(first, second, sent, part == 0), drop=("text",)), kind)

    out = told(0)
    if parts == 1:
        return out
    rest = functools.reduce(DataFrame.unionByName, (told(p).select(*ROW, "n_best", "count_sum") for p in range(1, parts)))
    rest = rest.groupBy(*ROW).agg(F.sum("n_best").alias("more_best"), F.sum("count_sum").alias("more_sum"))
    out = out.join(rest, list(ROW))
    sums = {"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")}
    return out.withColumns(sums).drop(*ROW, "more_best", "more_sum")


def op12_bitset_alignment(spark, sf_dir: str) -> DataFrame:
    """Alignment of every document's tokens in the two vocabularies, with corpus-wide counts of its links. See ``align`` for odd rows."""
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))
