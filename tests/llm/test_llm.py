"""The corpus operators against brute force on small tables with nulls, blanks, ties, repeats and odd columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from graincast.llm import bpe, extraction, fingerprints, langid, mixing, neardup, pii, quality, sharding, site_lines
from graincast.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, `__site` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "to", "in"]) if r.random() < 0.4 else "".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    base = prose(120, 1)
    words = base.split()
    out = [base, base, " ".join(["x", *words[1:]]), None, "", " \n\t ", "one two", "One two", "é" * 50, "<b> 1 | 2", prose(9000, 2)]
    out += [" ".join(words[:i] + [f"w{i}"] + words[i + 1 :]) for i in range(0, 120, 5)]
    out += [prose(60, s) + "\nsame line here" for s in range(20, 45)]
    return [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(t or ""), "s", "t") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    pages = [(i, f"http://h.example.com/{i}", f"<html><head><title>t</title></head><body><nav><a>m</a></nav><div><p>Shared notice text.</p></div><article><h1>T{i}</h1><p>a &amp; b{i}<p>c{i}\n d</article><footer>f</footer></body></html>") for i in range(12)]
    pages += [(12, None, None), (13, "x", ""), (14, "http://h.example.com", "plain < text"), (15, "http://z.example.com", "<div>" * 3000 + "deep")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_shards(spark, sf, docs):
    rows = sharding.op1_rendezvous_shards(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = (docs[r["doc_id"]][1] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 8, zlib.crc32(t)) and r["grown_shard"] in (r["shard"], 24)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_weighted_shards(spark):
    n = collections.Counter(r["shard"] for r in sharding.shard(spark.range(4000), "id", [1.0, 3.0]).collect())
    assert 2.5 < n[1] / n[0] < 3.6


def test_mix(spark, sf):
    rows = mixing.op5_mix_sources(spark, sf).collect()
    again = mixing.op5_mix_sources(spark, sf).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    targets = {r["source"]: r["target"] for r in rows}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows)) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert all(r["target"] <= 2 * r["source_size"] + 1e-6 for r in rows)


def test_site_lines(spark):
    rows = [(i, f"l{i}\n common \n", "s") for i in range(20)] + [(20, None, "s"), (21, "common", None), (22, "common", "t")]
    got = {r["doc_id"]: r for r in site_lines.drop_site_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), "source").collect()}
    assert got[3]["text"] == "l3\n" and got[3]["n_dropped"] == 1 and got[20]["text"] is None and got[21]["text"] == got[22]["text"] == "common"


def test_quality_counts(spark, sf, docs):
    for r in quality.op3_divergence_quality(spark, sf).collect():
        t = docs[r["doc_id"]][1] or ""
        w = WORD.findall(t)
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeat))
        assert not (r["base_failed"] and r["kept"])


def exact_components(docs):
    sets = {}
    for i, t, *_ in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            lo, hi = sorted((comp[a], comp[b]))
            comp = {k: lo if v == hi else v for k, v in comp.items()}
    return sets, comp


@pytest.mark.parametrize("short,block", [(16, 512), (2, 4)])
def test_near_duplicates(spark, sf, docs, monkeypatch, short, block):
    monkeypatch.setattr(neardup, "SHORT", short)
    monkeypatch.setattr(neardup, "BLOCK", block)
    sets, comp = exact_components(docs)
    for r in neardup.op4_minhash_inverted_join(spark, sf).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])


def test_fingerprints(spark, sf, docs):
    got = {r["doc_id"]: r for r in fingerprints.op7_oph_fingerprints(spark, sf).collect()}
    texts = [t or "" for _, t, *_ in docs]
    for i, t in enumerate(texts):
        cut, after = len(t) // 4, texts[(i + 1) % len(texts)]
        edited = t[: len(t) - cut] + after[:cut]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[0]["near_next"] == 1.0 and got[6]["near_next"] < 0.3
    assert got[3]["fingerprint"] == "0" * 256


def test_language(spark):
    en, de = "the cat and the dog went with that thing", "und der hund ging nicht mit dem schönen ding"
    rows = [(i, (en if i % 2 else de) + f" {i}", "en" if i % 2 else "de") for i in range(40)]
    known = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    ask = spark.createDataFrame([(1, "the dog went"), (2, "der hund"), (3, None), (4, "12 !"), (5, "")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.predict(ask, known).orderBy("doc_id").collect()] == ["en", "de", "und", "und", "und"]


def test_bpe_equals_library():
    from tokenizers import Tokenizer

    tok, mine, r = Tokenizer.from_file(bpe.vocabulary_path()), bpe.codec(bpe.vocabulary_path()), random.Random(5)
    parts = ["'s", "'", "re", " ", "  ", "\n", "a", "é", "日", "1", "!", "<|endoftext|>", "<|", "|>", "\xa0"]
    texts = ["", "a" * 3000, " " * 999 + "x", "<|endoftext|>" * 60, prose(900, 3)] + ["".join(r.choice(parts) for _ in range(600)) for _ in range(60)]
    for text, leaf in itertools.product(texts, (97, 300)):
        want = tok.encode(text, add_special_tokens=False).ids
        assert mine.encode(text, leaf) == want and mine.decode(want) == tok.decode(want, skip_special_tokens=False)


def test_extraction(spark, sf):
    got = {r["page_id"]: r["text"] for r in extraction.op2_wrapper_extract(spark, sf).collect()}
    assert got[3] == "T3\na & b3\nc3 d" and got[12] == got[13] == "" and got[14] == "plain < text" and got[15] == "deep"
    pages = [f"<div><p>Shared notice</p></div><div class=x><p>own {i}</p></div>" for i in range(6)]
    assert extraction.extract(pages[2], extraction.wrapper_of(extraction.induce(pages))) == "own 2"


def test_surrogates(spark):
    rows = [(1, "a.b@c.example.com +1 (017) 555-7713 10.1.2.3 9807915762804490"), (2, "A.B@c.example.com Frau Anna Bell"), (3, None), (4, ""), (5, "no entity")]
    got = {r["doc_id"]: r for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    mail = got[1]["text"].split()[0]
    assert got[2]["text"].startswith(mail) and "Frau" in got[2]["text"] and "Bell" not in got[2]["text"]
    assert re.fullmatch(r"\S+@example\.org \+1 \(\d{3}\) \d{3}-\d{4} \d+(\.\d+){3} \d{16}", got[1]["text"]) and got[3]["text"] is None and got[5]["text"] == "no entity"
    many = spark.range(3000).select(F.lpad(F.col("id").cast("string"), 16, "0").alias("v"))
    assert many.select(pii.surrogate(F.col("v"), "k")).distinct().count() == 3000


def test_surrogates_of_many_entities(spark):
    """So many one-word names that some clash under every salt, and an address whose surrogate is another: those are drawn again."""
    name = F.concat(F.lit("Mr. X"), F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "abcdefghij"))
    taken = spark.range(1).select(pii.surrogate(F.lit("10.0.0.1"), "k")).first()[0]
    pair = [(-1, "10.0.0.1"), (-2, taken)]
    many = spark.range(25_000, numPartitions=4).select(F.col("id").alias("doc_id"), name.alias("text")).union(spark.createDataFrame(pair, "doc_id long, text string"))
    given = {r["doc_id"]: r["text"] for r in many.collect()}
    made = {r["doc_id"]: r["text"] for r in pii.replace(many, "k").select("doc_id", "text").collect()}
    assert len(made) == len(given) == len(set(made.values())) and not set(made.values()) & set(given.values())


def test_surrogate_layouts(spark):
    secrets = ["9233A8EC" * 4 + "9329B", "9233a8ec" * 4 + "9329b", "AKIA" + "Q7" * 8]
    phones = ["(555) 123-4567", "555-123-4567", "+1-555-123-4567", "+49 30 1234567", "+4930123456789", "1 (555) 123-4567"]
    names = ["Ms. Anna Bell", "Frau Anna Bell", "Ms. Bell", "Herr Otto Bell"]
    plain = ["on 2024-05-06 at 12:30", "pages 100-200 of 3000", "version 1.2.3", "the token is here", "key: value"]
    texts = [*secrets, *phones, *names, "api_key=q1W2e3R4t5Y6u7", *plain]
    got = [r["text"] for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert all(a != b and len(a) == len(b) for a, b in zip(texts[:9], got[:9], strict=True))
    assert got[0].isupper() and got[0].lower() == got[1] and got[13].startswith("api_key=") and got[13] != texts[13] and got[14:] == plain
    assert all(re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b) for a, b in zip(phones, got[3:9], strict=True)) and got[3][1:4] == got[4][:3] == got[5][3:6]
    anna, frau, bell, otto = (x.split()[1:] for x in got[9:13])
    assert anna == frau and anna[-1:] == bell == otto[-1:] and anna[0] != otto[0] and "Bell" not in " ".join(got)


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as cp

    out = cp.run(spark, sf).collect()
    kept = {r["doc_id"] for r in out}
    _, comp = exact_components([d for d in docs if d[1]])
    assert kept and not kept & {3, 4, 5} and all(comp[i] == i for i in kept if len(docs[i][1]) > 300 and i < 35)
    text = spark.read.parquet(f"{sf}/documents.parquet")
    staged = cp.language(spark, text, sf)
    assert staged.columns == text.columns and cp.lines(spark, staged, sf).columns == text.columns
