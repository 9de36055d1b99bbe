"""Quality rules with distribution divergence from language references.

A text's histogram over character classes and its histogram over the language's common words are compared
with the language's own by Jensen-Shannon distance. Texts too short for a histogram are not judged by it.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graincast.llm.common import materialize, merged, slices, table

SHINGLE = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Common words of a language: those on the most of its texts.
COMMON_WORDS = 40
#: Words that a task counts before it tells what it has.
HELD_WORDS = 200_000
#: Texts with fewer words than these aren't judged by that histogram.
MIN_WORDS_CLASSES = 12
MIN_WORDS_COMMON = 40
#: The largest Jensen-Shannon distances (base 2, 0 to 1) that are kept.
#: Classes get CLASS_SLACK / sqrt(n_words) on top, as short texts stray further by chance.
MAX_CLASS_DISTANCE = 0.12
CLASS_SLACK = 0.5
#: References are summed again this often over the texts within this distance of them.
TRIMS = 2
TRIM_DISTANCE = 0.15
MAX_WORD_DISTANCE = 0.45

SYMBOLS = "#*$%&|<>"
#: Digits are left out: numbers belong to no language.
CLASSES = ("lower", "upper", "space", "punctuation", "symbol", "control", "latin", "greek", "cyrillic", "east asian", "other")
#: Blocks of code points beyond ASCII, by class; what is in none is "other".
BLOCKS = {
    "control": [(0x80, 0xA0), (0x200B, 0x2010), (0xFEFF, 0xFF00)],
    "punctuation": [(0xA0, 0xC0), (0x2010, 0x2070), (0x3000, 0x3040)],
    "latin": [(0xC0, 0x250), (0x1E00, 0x1F00)],
    "greek": [(0x370, 0x400), (0x1F00, 0x2000)],
    "cyrillic": [(0x400, 0x530)],
    "east asian": [(0x1100, 0x1200), (0x2E80, 0x3000), (0x3040, 0xA4D0), (0xAC00, 0xD7B0), (0xF900, 0xFB00), (0x20000, 0x33480)],
}


@functools.lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """Class of each code point; len(CLASSES) for digits, which have none."""
    t = np.full(0x110000, CLASSES.index("other"), dtype=np.uint8)
    for name, blocks in BLOCKS.items():
        for low, end in blocks:
            t[low:end] = CLASSES.index(name)
    for b in range(128):
        c = chr(b)
        name = "lower" if c.islower() else "upper" if c.isupper() else "space" if c in " \t\n\r\x0b\x0c" else "symbol" if c in SYMBOLS else "control" if b < 32 or b == 127 else "punctuation"
        t[b] = len(CLASSES) if c.isdigit() else CLASSES.index(name)
    return t


def histogram(text: str) -> np.ndarray:
    """Code points of each class."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount(_class_table()[points], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two histograms; 1 if either is empty."""
    if p.sum() <= 0 or q.sum() <= 0:
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    kl = lambda x: float(np.sum(np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0.0)))
    return float(np.sqrt(max(0.0, (kl(p) + kl(q)) / 2)))


def base_counts(text: str | None) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at ASCII white space only
    blanks = sum(data.count(b) for b in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
    seen: set[bytes] = set()
    dup_lines = 0
    for line in data.split(b"\n"):
        if line.strip():  # strips ASCII white space only
            dup_lines += line in seen
            seen.add(line)
    grams = list(zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    repeat = 0
    if len(set(grams)) < len(grams):
        often, until = Counter(grams), 0
        for i, g in enumerate(grams):
            if often[g] > 1:
                repeat += i + SHINGLE - max(i, until)
                until = i + SHINGLE
    return len(words), len(text) - blanks, sum(text.count(c) for c in SYMBOLS), dup_lines, repeat, words


def _bare(word: bytes) -> bytes:
    return word.strip(b".,;:!?\"'()").lower()


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def told() -> pa.RecordBatch:
        rows = [(lang, w.decode("utf-8", "replace"), n) for lang, c in counts.items() for w, n in c.items() if w]
        counts.clear()
        lang, word, n = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    for batch in slices(batches):
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(set(map(_bare, set(text.encode("utf-8", "surrogatepass").split()))))
            if sum(map(len, counts.values())) > HELD_WORDS:  # bounds memory; what is told twice is summed after
                yield told()
    yield told()


def common_words(docs: DataFrame, words: int = COMMON_WORDS) -> dict[str, list[str]]:
    """The words on the most texts of each language, over all its texts: ``words`` a language reach the driver."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    by_word = known.mapInArrow(_common, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    found: dict[str, list[str]] = {}
    for r in by_word.withColumn("turn", turn).filter(F.col("turn") <= words).orderBy("lang", "turn").collect():
        found.setdefault(r["lang"], []).append(r["word"])
    return found


FEATURES = "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, classes array<int>, common array<int>"
TRIMMED = f"{FEATURES}, class_distance double, word_distance double"


def _features(common: dict[str, list[str]]):
    index = {lang: {w.encode(): i for i, w in enumerate(ws)} for lang, ws in common.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, classes, hits = [], [], []
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                *base, words = base_counts(text)
                counts.append(base)
                classes.append(histogram(text or "").tolist())
                known = index.get(lang, {})
                found = [0] * (len(known) + 1)
                if known:
                    for word, n in Counter(words).items():
                        found[known.get(_bare(word), -1)] += n
                hits.append(found)
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(5)]
            arrays = [batch["doc_id"], batch["lang"], *columns, pa.array(classes, pa.list_(pa.int32())), pa.array(hits, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"])

    return run


def references(features: DataFrame) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Histograms of each language's classes and common words, summed over all its texts at once; a row for each (language, cell) reaches the driver."""
    both = F.array(*[F.struct(F.lit(i).alias("of"), F.col(c).alias("cells")) for i, c in enumerate(("classes", "common"))])
    cells = features.filter(F.col("lang").isNotNull()).select("lang", F.explode(both).alias("h")).select("lang", "h.of", F.posexplode("h.cells").alias("at", "n"))
    found: tuple[dict[str, dict[int, int]], ...] = ({}, {})
    for lang, of, at, n in cells.groupBy("lang", "of", "at").agg(F.sum("n").alias("n")).collect():
        found[of].setdefault(lang, {})[at] = n
    return tuple({lang: np.array([c.get(i, 0) for i in range(max(c) + 1)], dtype=float) for lang, c in x.items()} for x in found)


def _judge(by_class: dict, by_word: dict, whole: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = zip(batch["lang"].to_pylist(), batch["n_words"].to_pylist(), batch["classes"].to_pylist(), batch["common"].to_pylist(), strict=True)
            near, word = [], []
            for lang, n, classes, common in rows:
                c, w = None, None
                if by_class and n >= MIN_WORDS_CLASSES:
                    h = np.array(classes, dtype=float)
                    c = js_distance(h, by_class[lang]) if lang in by_class else min(js_distance(h, r) for r in by_class.values())
                if lang in by_word and n >= MIN_WORDS_COMMON:
                    w = js_distance(np.array(common, dtype=float), by_word[lang])
                near.append(c)
                word.append(w)
            names = [x for x in batch.schema.names if whole or x not in ("lang", "classes", "common")]
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in names), pa.array(near, pa.float64()), pa.array(word, pa.float64())], [*names, "class_distance", "word_distance"])

    return run


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, ``base_failed``, ``class_distance``, ``word_distance`` and ``kept`` of ``doc_id, text, lang``.

    Null texts count as empty and fail the base rule. A text whose lang is null or has no reference is held
    against the nearest language's character classes, and not judged by words. A distance is null where the
    text is too short for it. Texts are read once; references are sums over all texts.
    """
    given = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    features = materialize(given.mapInArrow(merged(_features(common_words(given))), FEATURES), "quality")
    by_class, by_word = references(features)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    out = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, class_distance double, word_distance double"
    for _ in range(TRIMS):
        # junk shifts the first references: sum again over the texts that are near them
        near = features.mapInArrow(merged(_judge(by_class, by_word, True)), TRIMMED).filter(~failed)
        near = near.filter((F.col("class_distance") <= TRIM_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE))
        classes, common = references(near)
        by_class, by_word = by_class | classes, by_word | common
    judged = features.mapInArrow(merged(_judge(by_class, by_word)), out)
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE + CLASS_SLACK / F.sqrt(F.greatest("n_words", F.lit(1)))) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & near)


def op3_divergence_quality(spark, sf_dir: str) -> DataFrame:
    """Quality verdict on every document."""
    return judge(table(spark, sf_dir, "documents"))
