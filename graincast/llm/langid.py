"""Language ID with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors,
permuted by their places; a text's vector bundles (adds) its trigrams' vectors; a language's prototype bundles
its training texts, each scaled to length 1. A text gets the language whose prototype has the largest cosine.
Prototypes and texts are compared after the prototypes' mean is taken out, so what all languages share
doesn't decide.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincast.llm.common import map_arrow, slices, table, with_columns

DIM = 512
#: About so many labelled texts of each language are learnt from: a share of them by hash of the id.
TRAIN_ROWS = 3000
SEED = 20_011
UNKNOWN = "und"
#: Unrelated vectors have cosines of deviation 1 / sqrt(DIM); a learnt language lies this many deviations off ...
NOISE = 3.4
#: ... in texts of this many trigrams.
SURE_GRAMS = 40

_LETTERS = None


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; every run of others is one 32, also before and after the text."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where(_LETTERS[points], points, 32)
    space = points == 32
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return points[keep]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Vectors:
    """Trigram vectors, made once each; a byte an entry, as workers keep them."""

    def __init__(self, dim: int = DIM, seed: int = SEED, most: int = 60_000):
        self.dim, self.seed, self.most = dim, seed, most
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.rows = np.empty((4096, self.dim), dtype=np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng([self.seed, code]).choice(np.array([-1, 1], dtype=np.float32), self.dim).astype(np.int8)
        return self.letters[code]

    def row(self, gram: int) -> int:
        i = self.at.get(gram)
        if i is None:
            i = self.at[gram] = len(self.at)
            if i >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            a, b, c = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
            self.rows[i] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
        return i

    def bundle(self, text: str) -> tuple[np.ndarray, int]:
        """The text's vector, length 1 (or 0 without trigrams), and the number of its trigrams."""
        codes = _codes(text).astype(np.uint64)
        grams, counts = np.unique(codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:], return_counts=True)
        if len(self.at) + len(grams) > self.most:  # bounds memory whatever the scripts
            self.clear()
        rows = [self.row(g) for g in grams.tolist()]
        v = np.zeros(self.dim, dtype=np.float32)
        for i in range(0, len(rows), 2048):  # bounds memory for long texts
            v += counts[i : i + 2048].astype(np.float32) @ self.rows[rows[i : i + 2048]].astype(np.float32)
        return v / max(float(np.linalg.norm(v)), 1e-12), int(counts.sum())


def _sums(dim: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = Vectors(dim, seed), {}
        for batch in slices(batches):
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + vectors.bundle(text)[0].astype(np.float64)
        rows = [(lang, i, float(x)) for lang, v in sums.items() for i, x in enumerate(v)]
        if rows:
            lang, at, x = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(at, pa.int32()), pa.array(x, pa.float64())], ["lang", "at", "x"])

    return run


def learn(labelled: DataFrame, key: str = "doc_id", rows: int = TRAIN_ROWS, dim: int = DIM, seed: int = SEED) -> dict[str, list[float]]:
    """Prototypes from ``text`` and ``lang``: a map of languages to vectors, on the driver.

    Learns from about ``rows`` texts of each language: those whose hashed ``key`` is below rows / count. What
    is gathered is ``dim`` sums a language, so its size doesn't depend on the number of texts. Rows without
    text, letters or lang are left out.
    """
    usable = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in labelled.filter(F.col("lang").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, rows / n)))])
    u = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = usable.filter(u < F.try_element_at(share, F.col("lang"))).select("text", "lang")
    sums = map_arrow(sample, _sums(dim, seed), "lang string, at int, x double").groupBy("lang", "at").agg(F.sum("x").alias("x"))
    found: dict[str, list[float]] = {}
    for lang, at, x in sums.collect():
        found.setdefault(lang, [0.0] * dim)[at] = x
    return dict(sorted(found.items()))


def _predict(prototypes: dict[str, list[float]], dim: int, seed: int, text_column: str, made: Sequence[str], keep_text: bool):
    langs = list(prototypes)
    p = np.array([prototypes[x] for x in langs], dtype=np.float64).reshape(len(langs), dim)
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    mean = p.mean(axis=0) if len(langs) > 1 else np.zeros(dim)
    q = p - mean
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

    def begin():
        vectors = Vectors(dim, seed)

        def make(part: pa.RecordBatch) -> list[pa.Array]:
            best, scores, known = [], [], []
            for text in part[text_column].to_pylist():
                if not langs or not has_letter(text):
                    best.append(UNKNOWN)
                    scores.append(0.0)
                    known.append(False)
                    continue
                whole, grams = vectors.bundle(text)
                v = whole.astype(np.float64) - mean
                near = q @ (v / max(float(np.linalg.norm(v)), 1e-12))
                i = int(np.argmax(near))  # ties: the first by name
                best.append(langs[i])
                scores.append(float(min(1.0, max(0.0, near[i]))))
                known.append(bool((p @ whole).max() >= NOISE / np.sqrt(dim) * min(1.0, grams / SURE_GRAMS)))
            return [pa.array(best, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.bool_())]

        return make

    return with_columns(made, begin, drop=() if keep_text else (text_column,))


def predict(docs: DataFrame, prototypes: dict[str, list[float]], dim: int = DIM, seed: int = SEED, text: str = "text", made: Sequence[str] = ("lang_pred", "score", "known"), keep_text: bool = False) -> DataFrame:
    """``docs`` with ``text`` exchanged for (or, if ``keep_text``, beside) the columns ``made``: language, score, and whether it is like a learnt language at all.

    The whole text is read, nothing else is. Null texts, texts without a letter and all texts if nothing was
    learnt get ``und``, 0 and false. Texts too short for a trigram of letters are compared by the trigrams they
    have with the blanks around them. A text is like no learnt language if its best cosine, before the mean is taken out, is below
    NOISE deviations of what unrelated vectors have by chance; below SURE_GRAMS trigrams that bound falls in proportion.
    """
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{n}` {t}" for n, t in zip(made, ("string", "double", "boolean"), strict=True))])
    return map_arrow(docs, _predict(prototypes, dim, seed, text, list(made), keep_text), schema)


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def op8_hd_langid(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from those that aren't held out. A null doc_id is the empty text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = learn(docs.filter(~held_out(F.col("doc_id"))))
    found = predict(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
