"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words, trained in numpy.

A word's input is the sum of a vector for the word and of vectors for its character n-grams (with marks at its ends), so
new words are judged by their letters. Windows of WINDOW words, half overlapping, cover the whole text; two recurrent
layers read a window in both directions, attention weighs their states, and the pooled state gives a logit. A text's
score is that of its worst window. Training knows texts' labels only: after a first epoch over windows at
random, a text stands for itself by its worst window so far, and unlabelled ones by one more at random.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincast.llm.common import map_arrow, table, with_columns

#: The sample to learn from: so many texts a label at most, of so many characters at most.
TRAIN_ROWS, TRAIN_CHARS = 2000, 20_000
#: Words of a window and from one to the next.
WINDOW, STEP = 48, 24
#: Sizes of input vectors, of a direction's state and of attention.
DIM, HIDDEN, ATTENTION = 16, 8, 8
#: Characters of n-grams; words and n-grams of fewer sample texts than KNOWN_IN have no vector.
GRAMS, KNOWN_IN = (3, 4, 5), 3
EPOCHS, BATCH, DROP, SEED = 8, 128, 0.3, 13
#: Words are cut to pieces of so many characters.
LONGEST = 32
#: A task forgets its words when it has so many.
MOST_WORDS = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Hashes whose first so many bits no known feature has aren't searched for.
SIEVE = 22


def words(text: str | None) -> list[str]:
    """Lower-case words; long ones in pieces of LONGEST characters."""
    found = (text or "").lower().split()
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]


def bare(word: str) -> str:
    """A word without what isn't letters or digits around it; a word of marks stays."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b] or word


def features(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each bare word's features, side by side, and how many a word has; the first is the word itself."""
    marked = ["\x02" + w + "\x03" for w in found]
    sizes = np.array([len(w) for w in marked], dtype=np.int64)
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    which, place = np.repeat(np.arange(len(marked)), sizes), np.arange(len(code)) - np.repeat(starts, sizes)
    power = np.cumprod(np.full(int(sizes.max(initial=1)), _MIX), dtype=np.uint64)
    hashes, owners = [np.add.reduceat(code * power[place], starts)], [np.arange(len(marked))]
    left = np.repeat(starts + sizes, sizes) - np.arange(len(code))  # characters from here to the word's end
    for n in GRAMS:
        gram = np.full(max(0, len(code) - n + 1), n, dtype=np.uint64)
        for k in range(n):
            gram = (gram ^ code[k : k + len(gram)]) * _MIX
        ok = left[: len(gram)] >= n
        hashes.append(gram[ok])
        owners.append(which[: len(gram)][ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")  # the word itself stays first
    return np.concatenate(hashes)[order], np.bincount(owner, minlength=len(marked))


@dataclass
class Bags:
    """Rows of the vectors that each word sums, with weights: row 0 (nothing) first, so that no bag is empty."""

    row: np.ndarray
    weight: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, found: list[str], keys: np.ndarray) -> Bags:
        hashes, n = features(found)
        likely = np.zeros(1 << SIEVE, dtype=bool)
        likely[keys >> np.uint64(64 - SIEVE)] = True
        known = likely[hashes >> np.uint64(64 - SIEVE)]
        place = np.zeros(len(hashes), dtype=np.int64)
        place[known] = np.searchsorted(keys, hashes[known])
        known &= place < len(keys)
        known[known] = keys[place[known]] == hashes[known]
        weight = np.repeat(1 / np.sqrt(np.maximum(n - 1, 1)), n)
        weight[np.cumsum(n) - n] = 1.0
        owner = np.concatenate([np.arange(len(n)), np.repeat(np.arange(len(n)), n)[known]])
        order = np.argsort(owner, kind="stable")
        row = np.concatenate([np.zeros(len(n), dtype=np.int64), place[known] + 1])[order]
        return cls(row, np.concatenate([np.zeros(len(n)), weight[known]])[order].astype(np.float32), np.searchsorted(owner[order], np.arange(len(n) + 1)))

    def some(self, chosen: np.ndarray) -> Bags:
        n = self.at[chosen + 1] - self.at[chosen]
        at = np.concatenate([[0], np.cumsum(n)])
        inside = np.repeat(self.at[chosen] - at[:-1], n) + np.arange(at[-1])
        return Bags(self.row[inside], self.weight[inside], at)

    def sums(self, vectors: np.ndarray) -> np.ndarray:
        if len(self.at) < 2:
            return np.zeros((0, vectors.shape[1]), dtype=np.float32)
        return np.add.reduceat(vectors[self.row] * self.weight[:, None], self.at[:-1], axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """The weights. ``keys`` are the hashes of known features, in order; ``vectors`` has one row more, the first is zero."""

    keys: np.ndarray
    vectors: np.ndarray
    net: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, keys: np.ndarray, rng: np.random.Generator) -> Network:
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        vectors = normal(0.05, len(keys) + 1, DIM)
        vectors[0] = 0
        return cls(keys, vectors, {
            "into": normal(DIM**-0.5, 2, DIM, 3 * HIDDEN), "bias": np.zeros((2, 3 * HIDDEN), np.float32), "turn": normal(HIDDEN**-0.5, 2, HIDDEN, 3 * HIDDEN),
            "look": normal((2 * HIDDEN) ** -0.5, 2 * HIDDEN, ATTENTION), "heed": normal(ATTENTION**-0.5, ATTENTION), "out": normal((2 * HIDDEN) ** -0.5, 2 * HIDDEN), "base": np.zeros(1, np.float32),
        })

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """What the gates get from each word: (direction, words, gates)."""
        return np.stack([x @ self.net["into"][d] + self.net["bias"][d] for d in (0, 1)])

    def forward(self, given: np.ndarray, which: np.ndarray, real: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logits of windows: ``which`` (windows, WINDOW) are words of ``given``, ``real`` marks what isn't padding."""
        n, width = len(which), which.shape[1]
        states = np.empty((width, n, 2 * HIDDEN), dtype=np.float32)
        steps: list[list[tuple]] = [[], []]
        for d in (0, 1):
            turn, h, mine = self.net["turn"][d], np.zeros((n, HIDDEN), dtype=np.float32), given[d]
            for t in range(width) if d == 0 else range(width - 1, -1, -1):
                x, u = mine[which[:, t]], h @ turn
                gates = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                reset, update = gates[:, :HIDDEN], gates[:, HIDDEN:] * real[:, t, None]
                new = np.tanh(x[:, 2 * HIDDEN :] + reset * u[:, 2 * HIDDEN :])
                if trace is not None:
                    steps[d].append((t, h, reset, gates[:, HIDDEN:], update, new, u[:, 2 * HIDDEN :]))
                h = h + update * (new - h)
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        seen = np.tanh(states @ self.net["look"])
        heed = np.where(real.T, seen @ self.net["heed"], -1e9)
        heed = np.exp(heed - heed.max(axis=0))
        heed /= heed.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", heed, states)
        if trace is not None:
            trace.update(states=states, seen=seen, heed=heed, pooled=pooled, steps=steps)
        return pooled @ self.net["out"] + self.net["base"][0]

    def backward(self, x: np.ndarray, which: np.ndarray, real: np.ndarray, trace: dict, d_logit: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradients of the words' inputs ``x`` and of the weights."""
        net, states, seen, heed = self.net, trace["states"], trace["seen"], trace["heed"]
        grads = {k: np.zeros_like(v) for k, v in net.items()}
        grads["out"], grads["base"] = trace["pooled"].T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pooled = d_logit[:, None] * net["out"]
        d_states = heed[:, :, None] * d_pooled
        d_heed = np.einsum("tnh,nh->tn", states, d_pooled)
        d_score = heed * (d_heed - (heed * d_heed).sum(axis=0)) * real.T
        grads["heed"] = np.einsum("tn,tna->a", d_score, seen)
        d_seen = d_score[:, :, None] * net["heed"] * (1 - seen**2)
        grads["look"] = np.einsum("tnh,tna->ha", states, d_seen)
        d_states = d_states + d_seen @ net["look"].T
        d_given = np.zeros((which.shape[1], len(which), 6 * HIDDEN), dtype=np.float32)
        for d in (0, 1):
            turn, d_h = net["turn"][d], np.zeros((len(which), HIDDEN), dtype=np.float32)
            for t, h, reset, gate, update, new, u in reversed(trace["steps"][d]):
                d_h = d_h + d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN]
                d_new = d_h * update * (1 - new**2)
                d_reset = d_new * u * reset * (1 - reset)
                d_update = d_h * (new - h) * real[:, t, None] * gate * (1 - gate)
                into = np.concatenate([d_reset, d_update, d_new], axis=1)
                d_given[t, :, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN] = into
                back = np.concatenate([d_reset, d_update, d_new * reset], axis=1)
                grads["turn"][d] += h.T @ back
                d_h = d_h * (1 - update) + back @ turn.T
        flat, order = which.T.ravel(), np.argsort(which.T.ravel(), kind="stable")
        used, first = np.unique(flat[order], return_index=True)
        d_rows = np.zeros((len(x), 6 * HIDDEN), dtype=np.float32)
        d_rows[used] = np.add.reduceat(d_given.reshape(-1, 6 * HIDDEN)[order], first, axis=0)
        d_x = np.zeros_like(x)
        for d in (0, 1):
            part = d_rows[:, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN]
            grads["into"][d], grads["bias"][d] = x.T @ part, part.sum(axis=0)
            d_x += part @ net["into"][d].T
        return d_x, grads


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of so many words side by side: the first word of each window, its words' number, and its text. The last window ends with the text."""
    many = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STEP)), 0)
    text = np.repeat(np.arange(len(sizes)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    own = np.minimum(nth * STEP, np.maximum(sizes[text] - WINDOW, 0))
    return (np.cumsum(sizes) - sizes)[text] + own, np.minimum(sizes[text], WINDOW), text


def _spread(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of windows (padded with the window's first) and what isn't padding."""
    step = np.arange(WINDOW)
    real = step < n[:, None]
    return flat[first[:, None] + np.where(real, step, 0)], real


def logits(network: Network, given: np.ndarray, flat: np.ndarray, first: np.ndarray, n: np.ndarray, at_once: int = 1024) -> np.ndarray:
    """Logits of all windows, some at a time: bounds memory for long texts."""
    parts = [network.forward(given, *_spread(flat, first[i : i + at_once], n[i : i + at_once])) for i in range(0, len(first), at_once)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.float32)


def known_features(found: list[str], numbered: list[np.ndarray]) -> np.ndarray:
    """Hashes, in order, of the features of at least KNOWN_IN texts; texts are numbers of the words ``found``."""
    used = [np.unique(ids) for ids in numbered]
    word, text = np.concatenate(used), np.repeat(np.arange(len(used)), [len(u) for u in used])
    order = np.argsort(word, kind="stable")
    # a word of enough texts settles its features; the others' texts are counted apart
    n_texts = np.bincount(word, minlength=len(found))
    begins = np.cumsum(n_texts) - n_texts
    hashes, n = features(found)
    owner = np.repeat(np.arange(len(found)), n)
    keys, which = np.unique(hashes, return_inverse=True)
    often = np.zeros(len(keys), dtype=bool)
    often[which[n_texts[owner] >= KNOWN_IN]] = True
    rest = np.flatnonzero(~often[which])
    pair_key = np.repeat(which[rest], n_texts[owner[rest]])
    at = np.repeat(begins[owner[rest]], n_texts[owner[rest]])
    nth = np.arange(len(at)) - np.repeat(np.cumsum(n_texts[owner[rest]]) - n_texts[owner[rest]], n_texts[owner[rest]])
    pairs = np.unique(pair_key * len(used) + text[order][at + nth])
    often |= np.bincount(pairs // len(used), minlength=len(keys)) >= KNOWN_IN
    return keys[often]


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network | None:
    """A network from texts and labels 0 or 1, the same in each run; none without words of both labels."""
    told = [(w, y) for t, y in zip(texts, labels, strict=True) if (w := words(t))]
    y = np.array([y for _, y in told], dtype=np.float32)
    if not (y == 1).any() or not (y == 0).any():
        return None
    rng = np.random.default_rng(seed)
    number = Words()
    numbered = [np.array([number[w] for w in ws], dtype=np.int64) for ws, _ in told]
    network = Network.fresh(known_features(list(number.plain), numbered), rng)
    bags = Bags.of(list(number.plain), network.keys)
    flat, sizes = np.concatenate(numbered), np.array([len(x) for x in numbered])
    first, width, text = windows(sizes)
    begins = np.searchsorted(text, np.arange(len(sizes) + 1))
    weight = np.where(y == 1, max(1.0, min(5.0, float((y == 0).sum() / (y == 1).sum()))), 1.0).astype(np.float32)
    squares = {k: np.full_like(v, 1e-6) for k, v in network.net.items()}
    row_squares = np.full(len(network.vectors), 1e-6, dtype=np.float32)
    pick = lambda: begins[:-1] + (rng.random(len(sizes)) * np.diff(begins)).astype(np.int64)
    for epoch in range(epochs):
        chosen, of = pick(), np.arange(len(sizes))
        if epoch:
            found = logits(network, network.inputs(bags.sums(network.vectors)), flat, first, width)
            order = np.lexsort((found, text))
            clean = np.flatnonzero(y == 0)
            chosen, of = np.concatenate([order[begins[1:] - 1], chosen[clean]]), np.concatenate([of, clean])
        mixed = rng.permutation(len(chosen))
        for i in range(0, len(mixed), BATCH):
            now = mixed[i : i + BATCH]
            which, real = _spread(flat, first[chosen[now]], width[chosen[now]])
            used, which = np.unique(which, return_inverse=True)
            which = which.reshape(len(now), WINDOW)
            mine = bags.some(used)
            mine.weight = mine.weight * (rng.random(len(mine.weight)) >= DROP) / np.float32(1 - DROP)
            x, trace = mine.sums(network.vectors).astype(np.float32), {}
            p = _sigmoid(network.forward(network.inputs(x), which, real, trace))
            d_logit = ((p - y[of[now]]) * weight[of[now]] / len(now)).astype(np.float32)
            d_x, grads = network.backward(x, which, real, trace, d_logit)
            for k, g in grads.items():
                squares[k] += g * g
                network.net[k] -= 0.05 * g / np.sqrt(squares[k])
            order = np.argsort(mine.row, kind="stable")
            rows, at = np.unique(mine.row[order], return_index=True)
            owner = np.repeat(np.arange(len(used)), np.diff(mine.at))
            g = np.add.reduceat((d_x[owner] * mine.weight[:, None])[order], at, axis=0)
            row_squares[rows] += (g * g).mean(axis=1)
            network.vectors[rows] -= 0.1 * g / np.sqrt(row_squares[rows])[:, None]
            network.vectors[0] = 0
    return network


class Words(dict):
    """Numbers of words, equal for equal bare words; ``new`` are the bare words that weren't there, in order of their numbers."""

    def __init__(self):
        self.plain: dict[str, int] = {}
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        key = bare(word)
        n = self.plain.get(key)
        if n is None:
            self.plain[key] = n = len(self.plain)
            self.new.append(key)
        self[word] = n
        return n


def _judge(sent, text: str):
    def begin():
        network = sent.value
        number, held = Words(), np.zeros((2, 1 << 14, 3 * HIDDEN), dtype=np.float32)

        def make(part: pa.RecordBatch) -> list[pa.Array]:
            nonlocal number, held
            rows = part[text].to_pylist()
            if network is None:
                return [pa.array(np.zeros(len(rows)))]
            if len(number) > MOST_WORDS:
                number = Words()
            numbers = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in map(words, rows)]
            new, at = number.new, len(number.plain) - len(number.new)
            if len(number.plain) > held.shape[1]:
                grown = np.zeros((2, 2 * len(number.plain), 3 * HIDDEN), dtype=np.float32)
                grown[:, :at] = held[:, :at]
                held = grown
            for i in range(0, len(new), 1 << 15):  # bounds memory
                few = new[i : i + (1 << 15)]
                held[:, at + i : at + i + len(few)] = network.inputs(Bags.of(few, network.keys).sums(network.vectors))
            number.new = []
            first, n, of = windows(np.array([len(x) for x in numbers], dtype=np.int64))
            scores = np.zeros(len(rows))
            found = logits(network, held, np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64), first, n)
            np.maximum.at(scores, of, _sigmoid(found.astype(np.float64)))
            return [pa.array(scores)]

        return make

    return begin


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> DataFrame:
    """Ids, texts and labels to learn from: the ``rows`` labelled ids of each label with the least hashes, of texts of ``chars`` characters at most.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic. Null ids, texts and labels are left out; an id labelled
    both ways counts as toxic, one with several texts gives the least.
    """
    given = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    least = [given.filter(F.col("toxic") == y).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows) for y in (0, 1)]
    few = least[0].unionByName(least[1])  # 2 x rows at most
    found = docs.filter(F.col("text").isNotNull() & (F.char_length("text") <= chars)).join(F.broadcast(few), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def learn(few: DataFrame) -> Network | None:
    """The network from a ``sample`` (None if it lacks a label), whose rows are bounded: one task trains it, as the driver has other work for its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "toxic")), strict=True)), key=lambda r: r[0])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1] for r in rows], [r[2] for r in rows]))], pa.binary())], ["network"])

    made = map_arrow(few.repartition(1), run, "network binary").first()
    return pickle.loads(made["network"]) if made else None


def judge(docs: DataFrame, network: Network | None, text: str = "text", made: str = "score") -> DataFrame:
    """``docs`` with ``made`` for ``text``: 0 to 1, the worst of the text's windows.

    Only the text is read, and all of it. Null, empty and blank texts score 0, and all do without a network. Rows are
    judged one by one, so repeated rows agree. An own column ``made`` is replaced.
    """
    docs = docs.drop(made)
    sent = docs.sparkSession.sparkContext.broadcast(network)
    kept = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text), f"`{made}` double"])
    return map_arrow(docs, with_columns((made,), _judge(sent, text), drop=(text,)), kept)


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def op13_gru_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labelled ones that aren't held out. A null doc_id is the empty text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    found = judge(docs, learn(sample(docs, labels)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
