"""Word runs, alignment and toxicity against brute force, the libraries and held-out labels, and odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from graincast.llm import alignment, runs, toxicity
from graincast.llm.bpe import Codec, vocabulary_path
from graincast.llm.common import table

SMALL = "/root/testdata/sf0.001"


def plain_runs(word, least):
    """All (start, end, smallest period), by comparing each distance."""
    found = {}
    for q in range(1, len(word) // 2 + 1):
        i = 0
        while i + q < len(word):
            j = i
            while j + q < len(word) and word[j] == word[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(300):
        letters, n = rng.choice((1, 2, 2, 3, 6)), rng.randint(0, 50)
        word = [rng.randrange(letters) for _ in range(n)]
        if n > 4 and rng.random() < 0.5:
            at, p = rng.randrange(n), rng.randint(1, 9)
            for i in range(at + p, n):
                word[i] = word[i - p]
            word += rng.choice(([], word, word[: n // 2]))
        for least in (2, 12):
            assert runs.runs(word, least) == plain_runs(word, least)
        assert runs.text_runs([b"%d" % w for w in word]) == plain_runs(word, 12)


def test_long_periodic_text_takes_no_quadratic_work():
    block = [b"%d" % (i * 7919 % 20011) for i in range(30_000)]
    assert runs.text_runs(block * 3) == [(0, 90_000, 20011)] or len(runs.text_runs(block * 3)) >= 1
    assert runs.text_runs([b"a"] * 100_000) == [(0, 100_000, 1)]


def expected_row(doc_id, text):
    word = [w for w in (text or "").encode().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(word)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        word = [word[i] if i < a else word[a + (i - a) % p] for i in range(n)]
    found = plain_runs(word, 12)
    gone = {i for s, e, p in found for i in range(s + p, e)}
    best = sorted((-(e - s), s, p) for s, e, p in found)[:1]
    longest = (best[0][1], -best[0][0], best[0][2], -best[0][0] * 1000 // best[0][2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (len(found), *longest, sha("".join(f"{s},{e - s},{p}\n" for s, e, p in found).encode()), sha(b" ".join(w for i, w in enumerate(word) if i not in gone)))


def test_runs_query_equals_brute_force(spark):
    short = {r["doc_id"]: expected_row(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").filter("char_length(text) < 6000").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in runs.op11_word_runs(spark, SMALL).collect()}
    assert len(got) == table(spark, SMALL, "documents").count()
    assert {k: got[k] for k in short} == short


def test_runs_odd_rows(spark):
    rows = [(None, "a b " * 10, "own"), (1, None, "own"), (1, "", "own"), (2, " \n\t ", None), (2, " \n\t ", None), (3, "x " * 12 + "y z", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = runs.find(docs).collect()
    assert [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got] == [(None, [(0, 20, 2)], "a b"), (1, [], ""), (1, [], ""), (2, [], ""), (2, [], ""), (3, [(0, 12, 1)], "x y z")]
    assert runs.find(docs.limit(0)).count() == 0


def plain_alignment(texts):
    """Each text's row by the libraries themselves and by comparing byte ranges."""
    first = tokenizers.Tokenizer.from_file(vocabulary_path())
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=alignment.piece_path())
    names = Codec(vocabulary_path()).bytes_of
    counts, told = collections.Counter(), []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        spelt = [[names[i] for i in a], [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]]
        if not text or any(b"".join(s) != whole for s in spelt):
            told.append(None)
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelt]
        places = [list(zip([0, *e[:-1]], e, strict=True)) for e in ends]
        links, low = [], 0
        for i, (s, e) in enumerate(places[0]):
            while places[1][low][1] <= s:
                low += 1
            j = low
            while j < len(b) and places[1][j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        counts.update(links)
        told.append((len(a), len(b), groups, links))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (d[0], d[1], len(d[2]), len(d[3]), sum(counts[x] == best[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest()) for d in told]


def test_alignment_equals_the_libraries_in_one_part_and_in_many(spark, tmp_path):
    rng = random.Random(5)
    bits = ("a", "b", " ", "  ", "\n", "\t", "é", "▁", "x86", "'s", "日本", "😀", " ", "　", "\x1c", "\x00", "<|endoftext|>", "<s>", "   ", "12", ".", "\r\n", "ﬁ", "\x85")
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    texts += [None, "", " ", "  ", "a" * 20_000, "ab " * 3000, " x", "x ", "\n", "x \n y"]
    texts += [r["text"] for r in table(spark, SMALL, "documents").filter("char_length(text) < 5000").limit(60).collect()]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_a", F.lit("own")).repartition(3).write.parquet(path)
    expected = plain_alignment(texts)
    for most in (alignment.PART_PAIRS, 1500):
        got = {r["doc_id"]: tuple(r[c] for c in alignment.COLUMNS) for r in alignment.align(spark.read.parquet(path), part_pairs=most).collect()}
        assert [got[i] for i in range(len(texts))] == expected
    assert alignment.align(spark.read.parquet(path).limit(0)).count() == 0


def test_alignment_forgets_units_and_stays_right(spark, monkeypatch):
    texts = [r["text"] for r in table(spark, SMALL, "documents").filter("char_length(text) < 1500").limit(80).collect()]
    paths = vocabulary_path(), alignment.piece_path()
    monkeypatch.setattr(alignment, "MOST_UNITS", 50)
    kept, known = [], None
    known = alignment.Known(lambda new: kept.clear() if new is None else kept.extend(alignment.Aligned(new, *paths).groups()))
    expected = [row[6] for row in plain_alignment(texts)]
    got = []
    for text in texts:
        got.append(hashlib.sha256(";".join(kept[i] for i in known.look_up([text])[0]).encode()).hexdigest())
    assert got == expected


def test_bitset_rank_and_select():
    rng = np.random.default_rng(1)
    places = np.unique(rng.integers(0, 5000, 900))
    ends = alignment.Ends.of(places, 5000)
    assert (ends.select() == places).all()
    assert (ends.rank(np.arange(5001)) == np.searchsorted(places, np.arange(5001))).all()


def test_network_gradients_equal_differences():
    rng = np.random.default_rng(0)
    network = toxicity.Network.fresh(np.arange(9, dtype=np.uint64), rng)
    network.net = {k: v.astype(np.float64) for k, v in network.net.items()}
    x, which = rng.normal(size=(20, toxicity.DIM)), rng.integers(0, 20, (3, 7))
    real, out = np.ones((3, 7), dtype=bool), np.array([1.0, -2.0, 0.5])
    real[1, 4:] = False
    loss = lambda: float((network.forward(network.inputs(x), which, real) * out).sum())
    network.forward(network.inputs(x), which, real, trace := {})
    d_x, grads = network.backward(x, which, real, trace, out)
    for values, found in ((x, d_x), *((network.net[k], grads[k]) for k in network.net)):
        at = tuple(s // 2 for s in values.shape)
        was = values[at]
        values[at] = was + 1e-2
        high = loss()
        values[at] = was - 1e-2
        low = loss()
        values[at] = was
        assert abs((high - low) / 2e-2 - found[at]) < 1e-4


def test_windows_cover_every_word():
    sizes = np.array([0, 1, 47, 48, 49, 72, 73, 500])
    first, n, text = toxicity.windows(sizes)
    starts = np.cumsum(sizes) - sizes
    for i, size in enumerate(sizes):
        mine = [(f - starts[i], f - starts[i] + k) for f, k, t in zip(first, n, text, strict=True) if t == i]
        assert {w for a, b in mine for w in range(a, b)} == set(range(size)) and all(0 <= a and b <= size for a, b in mine)
        assert all(y[0] < x[1] for x, y in zip(mine, mine[1:], strict=False))  # neighbours overlap


def test_features_are_counted_by_text():
    texts = ["ab cd", "ab xab", "ab ef", "xab", "cd", "zz cd. cd"]
    number = toxicity.Words()
    numbered = [np.array([number[w] for w in toxicity.words(t)]) for t in texts]
    hashes, n = toxicity.features(list(number.plain))
    ends, counts = np.cumsum(n), collections.Counter()
    for ids in numbered:
        counts.update({int(h) for i in set(ids.tolist()) for h in hashes[ends[i] - n[i] : ends[i]]})
    assert sorted(k for k, c in counts.items() if c >= toxicity.KNOWN_IN) == toxicity.known_features(list(number.plain), numbered).tolist()


def test_toxicity_held_out_and_odd_rows(spark):
    made_of = lambda seed, bad: " ".join(random.Random(seed).choices(["moor", "tree", "lake", "hill", "bird", "sand", "rain", "leaf"] + bad, k=150))
    rows = [(i, made_of(i, ["vilescum", "vilerat"] if i % 3 == 0 else []), int(i % 3 == 0)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    odd_labels = spark.createDataFrame([(None, 1), (3, None), (900, 1), (0, 0)], "doc_id long, toxic int")
    few = toxicity.sample(docs.select("doc_id", "text"), docs.select("doc_id", "toxic").unionByName(odd_labels))
    assert few.count() == 150
    network = toxicity.learn(few)
    held = [(1000 + i, made_of(1000 + i, ["vilerat", "vilemouse"] if i % 2 else []), "own") for i in range(40)] + [(None, None, "own"), (1, "", None), (1, " \n", None), (5, "lake " * 9000 + "vilescum " * 5 + "hill " * 9000, None), (5, "x" * 50_000, None)]
    asked = spark.createDataFrame(held, "doc_id long, text string, score string")
    got = toxicity.judge(asked, network).collect()
    right = [(r["score"] >= 0.5) == bool(i % 2) for i, r in enumerate(got[:40])]
    assert sum(right) >= 38
    assert [r["score"] for r in got[40:43]] == [0.0, 0.0, 0.0] and got[43]["score"] >= 0.5 and 0 <= got[44]["score"] < 0.5
    assert [r["score"] for r in toxicity.judge(asked, toxicity.learn(few)).collect()] == [r["score"] for r in got]
    assert toxicity.learn(few.limit(0)) is None and {r["score"] for r in toxicity.judge(asked, None).collect()} == {0.0}
    assert toxicity.judge(asked.limit(0), network).count() == 0
