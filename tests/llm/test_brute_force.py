"""Verdicts, fingerprints, languages, components and pipeline stages against plain Python, with null and repeated ids and odd columns."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as cp
from graincast.llm import bpe, common, extraction, fingerprints, langid, neardup, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EN, DE = ["the", "cat", "and", "dog", "went", "with", "that", "thing", "over", "there"], ["und", "der", "hund", "ging", "nicht", "mit", "dem", "schönen", "ding", "über"]


def spoken(words, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# quality


def js(p, q):
    p, q = np.array(p, float), np.array(q, float)
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    entropy = lambda x: -sum(v * math.log2(v) for v in x if v > 0)
    return math.sqrt(max(0.0, entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2))


def class_of(c):
    if c in "0123456789":
        return None
    if c in "#*$%&|<>":
        return "symbol"
    if c in " \t\n\r\x0b\x0c":
        return "space"
    o = ord(c)
    if o < 128:
        return "lower" if c.islower() else "upper" if c.isupper() else "control" if o < 32 or o == 127 else "punctuation"
    return next((k for k, blocks in quality.BLOCKS.items() if any(a <= o < b for a, b in blocks)), "other")


def verdicts(docs):
    bare = lambda w: w.strip(".,;:!?\"'()").lower()
    held = collections.defaultdict(collections.Counter)
    for _, text, lang in docs:
        if text is not None and lang is not None:
            held[lang].update({bare(w) for w in WORD.findall(text)} - {""})
    common_ = {lang: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON_WORDS]] for lang, c in held.items()}
    feats = []
    for i, text, lang in docs:
        words = WORD.findall(text or "")
        by = collections.Counter(class_of(c) for c in text or "")
        hits = collections.Counter(bare(w) for w in words)
        known = common_.get(lang, [])
        word = [hits[w] for w in known]
        grams = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        repeat = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
        failed = len(words) < 10 or 100 * len(repeat) > 20 * len(words)
        feats.append((i, lang, len(words), failed, [by[k] for k in quality.CLASSES], [*word, len(words) - sum(word)]))

    def sums(at, rows):
        out = {}
        for f in rows:
            if f[1] is not None:
                out[f[1]] = [a + b for a, b in itertools.zip_longest(out.get(f[1], []), f[at], fillvalue=0)]
        return out

    classes, words = sums(4, feats), sums(5, feats)

    def distances(f):
        c = None if f[2] < quality.MIN_WORDS_CLASSES or not classes else js(f[4], classes[f[1]]) if f[1] in classes else min(js(f[4], r) for r in classes.values())
        return c, js(f[5], words[f[1]]) if f[1] in words and f[2] >= quality.MIN_WORDS_COMMON else None

    for _ in range(quality.TRIMS):
        near = [f for f in feats if not f[3] and (d := distances(f))[0] is not None and d[0] <= quality.TRIM_DISTANCE and (d[1] or 0) <= quality.MAX_WORD_DISTANCE]
        classes, words = classes | sums(4, near), words | sums(5, near)
    out = {}
    for f in feats:
        c, w = distances(f)
        out[f[0]] = not f[3] and (c or 0) <= quality.MAX_CLASS_DISTANCE + quality.CLASS_SLACK / math.sqrt(max(1, f[2])) and (w or 0) <= quality.MAX_WORD_DISTANCE
    return out


def test_quality_verdicts(spark, monkeypatch):
    r = random.Random(4)
    docs = [(i, spoken(EN if i % 2 else DE, r.randint(5, 90), i), "en" if i % 2 else "de") for i in range(80)]
    docs += [(80 + i, "".join(r.choice("#$%&<>|*abXYZ    0123日本語бфγδ\x01") for _ in range(150)), "en") for i in range(3)]
    docs += [(90, None, "en"), (91, "", None), (92, spoken(EN, 50, 1), None), (93, spoken(DE, 60, 2), "en"), (94, "same words here now " * 30, "de"), (95, spoken(EN, 12, 3), "xx")]
    monkeypatch.setattr(quality, "HELD_WORDS", 20)
    got = {x["doc_id"]: x["kept"] for x in rows_of(quality.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string")))}
    want = verdicts(docs)
    assert got == want and 20 < sum(want.values()) < 85 and not any(want[i] for i in (80, 81, 82, 93, 94))


# fingerprints


def oph(text):
    mask, signed = (1 << 64) - 1, lambda x: x - (1 << 64) if x >> 63 else x
    del signed
    chain = lambda xs, width=8, seed=42: seed if not xs else chain(xs[1:], width, xxhash.xxh64(xs[0].to_bytes(width, "little"), seed=seed).intdigest())
    words = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in WORD.findall(text)]
    if not words:
        return "0" * 256
    grams = {chain(words[i : i + 5]) for i in range(len(words) - 4)} or {chain(words)}
    bins = {}
    for g in grams:
        bins[g & 255] = min(bins.get(g & 255, mask), g >> 16)
    start, step = fingerprints.probes()
    out = ""
    for i in range(256):
        donor = i if i in bins else next(j for k in range(256) if (j := (start[i] + step[i] * k) & 255) in bins)
        x = donor << 48 | bins[donor]
        out += "0123456789abcdef"[xxhash.xxh64(i.to_bytes(4, "little"), seed=chain([x])).intdigest() & 15]
    return out


def test_fingerprints_by_hand(spark):
    texts = ["", "one", "a b c d", "é ü 日本 x y z", spoken(EN, 40, 1), spoken(DE, 900, 2), spoken(EN, 3000, 3)]
    got = rows_of(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("f", fingerprints.fingerprint(F.col("t"))))
    assert {r["i"]: r["f"] for r in got} == {i: oph(t) for i, t in enumerate(texts)}
    pair = spark.createDataFrame([(oph(texts[5]), oph(texts[5][:3000] + " " + texts[4]))], "a string, b string")
    a, b = pair.first()
    same = sum(x == y for x, y in zip(a, b, strict=True))
    assert pair.select(fingerprints.likeness("a", "b")).first()[0] == pytest.approx(max(0.0, (same / 256 - 1 / 16) / (15 / 16)))


# languages


def profile(text):
    codes = [32]
    for c in text.lower() + " ":
        if c.isalpha():
            codes.append(ord(c))
        elif codes[-1] != 32:
            codes.append(32)
    letter = lambda c: np.random.default_rng([langid.SEED, c]).choice(np.array([-1, 1], dtype=np.float32), langid.DIM).astype(float)
    v = sum((np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)), np.zeros(langid.DIM))
    return v / max(np.linalg.norm(v), 1e-12)


def test_languages_by_hand(spark):
    rows = [(i, spoken(EN if i % 2 else DE, 12, i), "en" if i % 2 else "de") for i in range(30)]
    ask = [(i, spoken(EN if i % 3 else DE, 4 + i, 100 + i)) for i in range(20)]
    known = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in rows_of(langid.predict(spark.createDataFrame(ask, "doc_id long, text string"), known))}
    p = np.array([sum(profile(t) for _, t, x in rows if x == lang) for lang in ("de", "en")])
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    q = p - p.mean(axis=0)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    for i, text in ask:
        v = profile(text) - p.mean(axis=0)
        cos = q @ (v / np.linalg.norm(v))
        assert got[i]["lang_pred"] == ("de", "en")[int(cos.argmax())] and got[i]["score"] == pytest.approx(max(0.0, cos.max()), abs=1e-5) and got[i]["known"]


def test_unlearnt_languages_and_junk(spark):
    rows = [(i, spoken(EN if i % 2 else DE, 60, i), "en" if i % 2 else "de") for i in range(60)]
    r = random.Random(8)
    junk = ["Съешь же ещё этих мягких французских булок да выпей чаю, потом ещё раз.", "Η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί και φεύγει.", "快速的棕色狐狸跳过懒狗。" * 8]
    junk += [" ".join("".join(r.choice(letters) for _ in range(7)) for _ in range(40)) for letters in ("qxzjkvwy", "бвгджз", "あいうえお")]
    fine = [spoken(EN, 3, 1), spoken(DE, 400, 2), "and", "mit dem hund"]
    table = spark.createDataFrame(rows + [(100 + i, t, None) for i, t in enumerate(junk)] + [(200 + i, t, None) for i, t in enumerate(fine)], "doc_id long, text string, lang string")
    kept = {x["doc_id"] for x in rows_of(cp.language(spark, table, ""))}
    assert kept == {*range(60), *range(200, 204)}


# near-duplicates


def components(docs):
    """Component of each row: rows of one table are documents, whatever their ids."""
    sets = []
    for _, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(docs)))
    for a, b in itertools.combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            comp = [comp[a] if x == comp[b] else x for x in comp]
    return sets, comp


def varied(words, n, seed, every):
    base = spoken(words, n, seed).split()
    return [" ".join([*base[:k], f"w{seed}x{k}", *base[k + 1 :]]) for k in range(0, n, every)]


def join_rows(spark, run):
    """Rows that the joins of ``run`` made."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    total, ran = 0, store.executionsList(before, 10_000)
    for i in range(ran.size()):
        values, nodes = store.executionMetrics(ran.apply(i).executionId()), store.planGraph(ran.apply(i).executionId()).allNodes()
        for n in (nodes.apply(k) for k in range(nodes.size())):
            for m in (n.metrics().apply(k) for k in range(n.metrics().size())):
                if "Join" in n.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


def test_components_look_links_up_about_once(spark):
    r = random.Random(3)
    ids = r.sample(range(1 << 40), 340)
    pairs = [(a, b) for a in ids[:40] for b in ids[40:]]
    found = []
    made = join_rows(spark, lambda: found.extend(neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert {(x["node"], x["comp"]) for x in found} == {(i, min(ids)) for i in ids}
    assert len(pairs) < made < 3 * len(pairs)


def test_components_of_paths_stars_and_loops(spark):
    r = random.Random(5)
    turns = [x for p in zip(range(1000, 1040), range(1099, 1059, -1), strict=True) for x in p]
    pairs = [*itertools.pairwise(range(100)), *itertools.pairwise(turns), *((-500, i) for i in range(200, 260)), *((i, 2999) for i in range(2000, 2060)), (7000, 7000), *((r.randrange(5000, 5200), r.randrange(5000, 5200)) for _ in range(120))]
    forest = neardup.Forest()
    for a, b in pairs:
        if not forest.joined(a, b):
            forest.join(a, b)
    got = {x["node"]: x["comp"] for x in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: forest.root(x) for p in pairs for x in p}


@pytest.mark.parametrize("short,block,shingles", [(16, 512, 1 << 20), (2, 5, 300)])
def test_components_of_repeated_and_null_ids(spark, monkeypatch, short, block, shingles):
    monkeypatch.setattr(neardup, "SHORT", short)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    vocabulary = [f"v{i}" for i in range(400)]
    a, b = varied(vocabulary, 90, 1, 3), varied(vocabulary, 70, 2, 4)
    shared = spoken(vocabulary, 60, 3)
    mixed = [f"{shared} {spoken(vocabulary, 10 + k, 50 + k)}" for k in range(30)]
    docs = [(1, a[0]), (1, b[0]), (2, a[1]), (3, b[1]), (None, a[2]), (None, "quite alone"), (None, None), (7, ""), (8, "x y"), (8, "X y"), (None, "x y")]
    docs += [(10 + i, t) for i, t in enumerate(a[3:] + b[2:] + mixed)] + [(10, a[3])]
    got = rows_of(neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)))
    sets, comp = components(docs)
    least = {c: min((docs[k][0] for k in range(len(docs)) if comp[k] == c and docs[k][0] is not None), default=None) for c in comp}
    want = collections.Counter((i, len(s), (i if not s else least[c]), (least[c] is None or i == least[c]) if s else True) for (i, _), s, c in zip(docs, sets, comp, strict=True))
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want


# pipeline

ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, copies int, n_dropped int, known string, key string, post long, `first` int, node long, size int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    a, b = varied(EN + DE + [f"n{i}" for i in range(300)], 80, 5, 2), [spoken(EN, 50, 40 + k) for k in range(20)]
    texts = [(1, a[0]), (1, b[0]), (1, b[0]), (2, a[1]), (None, a[2]), (None, b[1]), (None, b[1]), (None, None), (3, ""), (4, "12 !")] + [(10 + i, f"{t}\nthe line of the site") for i, t in enumerate(b[2:])]
    rows = [(i, t, "en", ["s", "t", None][k % 3] if k < 10 else "s", len(t or ""), 0.5, "zz", 7, 9, "k", "y", 3, 1, 5, 6) for k, (i, t) in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, ODD).repartition(2).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_keep_rows_and_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    told = common.materialize(cp.language(spark, docs, odd), "t")
    given, left = rows_of(docs), rows_of(told)
    letters = [r for r in given if r["text"] and re.search("[a-z]", r["text"])]
    key = lambda r: tuple(map(str, r.values()))
    assert sorted(map(key, left)) == sorted(map(key, letters)) and told.columns == docs.columns
    lined = common.materialize(cp.lines(spark, told, odd), "t")
    assert lined.columns == docs.columns and lined.count() == len(letters)
    for r in rows_of(lined):
        assert "line of the site" not in r["text"] and (r["n_dropped"], r["score"]) == (9, 0.5) and r["n_chars"] == len(r["text"])
    single = common.materialize(cp.near_dedup(spark, lined, odd), "t")
    kept = [(r["doc_id"], r["text"]) for r in rows_of(single)]
    _, comp = components([(r["doc_id"], r["text"]) for r in rows_of(lined)])
    assert single.columns == docs.columns and len(kept) == len(set(comp)) and len(set(components(kept)[1])) == len(kept)
    assert kept.count((None, [t for i, t in kept if i is None][0])) == 1
    mixed = cp.mix(spark, single, odd)
    out = collections.Counter((r["doc_id"], r["text"]) for r in rows_of(mixed))
    assert mixed.columns == docs.columns and set(out) <= set(kept) and max(out.values()) <= 2
    tokens = rows_of(cp.encode(spark, mixed, odd))
    assert len(tokens) == sum(out.values()) and all(len(r["ids"]) == r["n_tokens"] for r in tokens)


def test_pipeline_of_odd_rows_and_of_none(spark, odd, tmp_path):
    assert cp.run(spark, odd).count() > 10
    spark.createDataFrame([], ODD).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


# the rest


def test_join_beyond_the_broadcast_bound(spark):
    big = spark.createDataFrame([(k, i) for k in ("a", "b", None) for i in range(50)], "k string, i int")
    small = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "k string, v int")
    want = collections.Counter((k, {"a": 1, None: 2}.get(k)) for k in ("a", "b", None) for _ in range(50))
    for limit in (0, 1 << 20):
        assert collections.Counter((r["k"], r["v"]) for r in rows_of(common.join_small(big, small, "k", F.col("i"), limit))) == want


def test_unsplit_text_is_encoded_about_once():
    r, mine = random.Random(2), bpe.codec(bpe.vocabulary_path())
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    from tokenizers import Tokenizer

    tok, before = Tokenizer.from_file(bpe.vocabulary_path()), mine.encoded
    assert mine.encode(text) == tok.encode(text, add_special_tokens=False).ids and mine.encoded - before < 1.05 * len(text)
    for letters in ("ab", "aeinrst", "é日a", "!?#-", " \n", "12"):
        for leaf in (8, 33, 200):
            t = "".join(r.choice(letters) for _ in range(1500))
            assert mine.encode(t, leaf) == tok.encode(t, add_special_tokens=False).ids


def pages(body, n=6):
    made = [f"<html><body><div class=k1><a href=/>Home</a> <a href=/x>News</a></div>{body.replace('@', f'{i} of its own, told at length and nowhere else')}<div class=k2>Fine print that all pages share, at length</div></body></html>" for i in range(n)]
    w = extraction.induce(made)
    return extraction.extract(made[1], extraction.wrapper_of(w) if w else None)


OWN = "1 of its own, told at length and nowhere else"


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_articles_of_small_hosts(n):
    made = [pages("<article><h1>T@</h1><p>The full notice of the day.</p><p>P @</p></article>", max(2, n))]
    assert made == [f"T{OWN}\nThe full notice of the day.\nP {OWN}"]


def test_slots_decide_without_names():
    assert pages("<div class=k3><h2>H @</h2><p>P @</p><p>More @</p></div>") == f"H {OWN}\nP {OWN}\nMore {OWN}"


def test_two_mains_nested_articles_and_depth():
    assert pages("<main><p>A @</p></main><div class=ad>x</div><main><p>B @</p></main>") == f"A {OWN}\nB {OWN}"
    assert pages("<main><article><h1>Main</h1><p>P @</p></article><section class=comments><article><p>Reader @</p></article></section><aside><article>Rel @</article></aside></main>") == f"Main\nP {OWN}"
    assert pages("<div>" * 450 + "<article><p>P @</p></article>" + "</div>" * 450 + "<div>x</div>") == f"P {OWN}"


def test_surrogates_need_a_key_and_follow_names(spark):
    rows = [(1, "Frau Anna Bell met Anna Bell, not Anna Bellini."), (2, "Frau Bell"), (3, "Herr Bell"), (4, "Anna Bell")]
    with pytest.raises(ValueError):
        pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = {r["doc_id"]: r["text"] for r in rows_of(pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k"))}
    name = re.match(r"Frau (\S+) (\S+) met \1 \2, not Anna Bellini\.$", got[1])
    assert name and got[2] == f"Frau {name[2]}" and got[3] == f"Herr {name[2]}" and got[4] == "Anna Bell" and "Bell" != name[2]
    other = {r["doc_id"]: r["text"] for r in rows_of(pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "another"))}
    assert other[1] != got[1]
