"""Wrapper induction: what names may say, lists of links, very deep and very wide pages, matching against brute force."""

import json
import random
import time

import pytest

from graincast.llm import extraction


def pages(extra, article=False):
    body = "<body><nav><a href=/>Home</a></nav>{0}<div class=post><h1>Title {1}</h1>{2}<p>text number {1} with words of its own {3}</p></div>{4}<footer>(c) site</footer></body>"
    return [body.format("<article>" if article else "<div id=wrap>", i, extra.replace("%", str(i)), i * 7, "</article>" if article else "</div>") for i in range(6)]


def text_of(given, nth=2):
    wrapper = extraction.induce(given)
    return extraction.extract(given[nth], extraction.wrapper_of(wrapper) if wrapper else None)


@pytest.mark.parametrize("article", (False, True))
@pytest.mark.parametrize(
    "extra,shown",
    [
        ('<div class="related-work"><p>work %</p></div>', "work 2"), ('<div class="share-price"><p>price %</p></div>', "price 2"), ('<div id="social-history"><p>history %</p></div>', "history 2"),
        ("<ul><li><a href=x>linked one %</a></li><li><a href=y>linked two %</a></li></ul>", "linked one 2\nlinked two 2"), ('<div class="ad">buy %</div>', None), ('<div class="ad-box">buy %</div>', None), ('<div id="cookie-notice">we keep % cookies</div>', None), ('<div class="comments"><p>reader %</p></div>', None),
    ],
)
def test_a_name_tells_only_if_all_its_parts_do(extra, shown, article):
    own = "text number 2 with words of its own 14"
    assert text_of(pages(extra, article)) == "\n".join(x for x in ("Title 2", shown, own) if x)


def test_very_deep_and_very_wide_pages():
    deep = ["<div>" * 100_000 + f"<p>own {i}</p>" + "</div>" * 100_000 for i in range(2)]
    assert text_of(deep, 1) == "own 1"
    began = time.time()
    wide = ["<body><div>" + "".join(f"<h2>head {i} {k}</h2><p>paragraph {i} {k}</p>" for k in range(10_000 + 40 * i)) + "</div></body>" for i in range(2)]
    assert text_of(wide, 1) == "\n".join(f"head 1 {k}\nparagraph 1 {k}" for k in range(10_040)) and time.time() - began < 60


def tree(rng, depth):
    g = extraction.Group(rng.choice("abc"), "")
    if depth:
        for _ in range(rng.randint(0, 3)):
            g.kids.append(tree(rng, depth - 1))
    return g


def best(xs, ys):
    """Most matched nodes of two forests, trying everything; lists of the same labels are matched as they stand."""
    if not xs or not ys:
        return 0
    if [x.label for x in xs] == [y.label for y in ys]:
        return sum(1 + best(x.kids, y.kids) for x, y in zip(xs, ys, strict=True))

    def some(xs, ys):
        if not xs or not ys:
            return 0
        found = max(some(xs[1:], ys), some(xs, ys[1:]))
        return max(found, 1 + best(xs[0].kids, ys[0].kids) + some(xs[1:], ys[1:])) if xs[0].label == ys[0].label else found

    return some(xs, ys)


def test_matching_equals_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        a, b = tree(rng, 3), tree(rng, 3)
        n, pairs = extraction.match(a, b)
        assert n == best(a.kids, b.kids) == len(list(extraction.flat(pairs))) and all(x.label == y.label for x, y in extraction.flat(pairs))


def test_lists_in_line():
    rng = random.Random(4)
    for _ in range(300):
        xs, ys = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        found = extraction.in_line(xs, ys)
        assert all(xs[i] == ys[j] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))
    assert extraction.in_line(list("abab"), list("ababab")) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert extraction.in_line(list("xabcy"), list("xbcy")) == [(0, 0), (2, 1), (3, 2), (4, 3)]


def test_repeated_pages_and_odd_rows(spark):
    rows = [(1, "https://h.example.com/1", p) for p in pages("")[:3]] + [(1, "https://h.example.com/1", pages("")[0]), (2, None, None), (3, "", ""), (None, "https://h.example.com/x", "<p>loose")]
    given = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "url")
    got = extraction.extract_pages(given).collect()
    assert len(got) == len(rows) and sorted(r["text"] for r in got if r["page_id"] in (2, 3)) == ["", ""]
    assert len({r["text"] for r in got if r["page_id"] == 1}) == 3 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert extraction.extract_pages(given.limit(0)).count() == 0


BASE = "<body>{2}<div class=k1><div class=k2><h2>Head {0}</h2><p>told on page {0} at length, with words {1} of its own</p>{3}</div></div></body>"


def host_pages(spark, n, around):
    """``n`` pages of a host through Spark: their texts by number, and the pages."""
    made = [BASE.format(i, i * 7, *around(i)) for i in range(n)]
    rows = spark.createDataFrame([(i, f"https://w.example.com/{i}", p) for i, p in enumerate(made)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in extraction.extract_pages(rows).collect()}, rows


def own(i):
    return f"Head {i}\ntold on page {i} at length, with words {i * 7} of its own"


def test_template_is_counted_over_all_pages_of_a_host(spark):
    rare = {0, 1, 2, 77, 140}  # notices that five of 150 pages have, in a node of their own
    got, rows = host_pages(spark, 150, lambda i: ("<div class=k0>All pages say this</div>", "<section class=k5><p>Subscribers only, says this line</p></section>" if i in rare else ""))
    assert got == {i: own(i) for i in range(150)}
    html = [r["html"] for r in rows.collect()]
    given = rows.selectExpr("lower('w.example.com') as host", "html")
    assert [json.loads(r["wrapper"]) for r in extraction.wrappers(given.union(given)).collect()] == [json.loads(extraction.induce(html))]


def test_a_text_on_half_of_the_pages_is_no_template(spark):
    for k in range(12):
        half = set(random.Random(k).sample(range(24), 12))
        html = [BASE.format(f"{i} of {k}", i * 7, "", f"<blockquote>{'Half say so' if i in half else f'{i} says so'}</blockquote>") for i in range(24)]
        wrapper = extraction.wrapper_of(extraction.induce(html))
        assert all(("Half say so" in extraction.extract(html[i], wrapper)) == (i in half) for i in range(24))
    got, _ = host_pages(spark, 24, lambda i: ("", f"<blockquote>{'Half say so' if i % 2 else f'{i} says so'}</blockquote>"))
    assert got == {i: own(i) + ("\nHalf say so" if i % 2 else f"\n{i} says so") for i in range(24)}


def test_many_shapes_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(extraction, "FOLD", 3)
    body = lambda i: "".join(f"<{t}>{t} {i} {k} told here</{t}>" for k, t in enumerate(random.Random(i).choices(("h3", "p", "pre", "blockquote"), k=6)))
    around = lambda i: (f"<div class=only{i}>Nobody else has {i}</div><div class=k0>All pages say this</div>", body(i))
    got, _ = host_pages(spark, 60, around)
    assert all("All pages say this" not in t and all(line in t for line in own(i).split("\n")) and t.count("told here") == 6 for i, t in got.items()) and len(got) == 60


def test_merged_shapes_fit_in_whole():
    rng = random.Random(5)
    for _ in range(100):
        shapes = [extraction.preorder(tree(rng, 3))[0] for _ in range(5)]
        for s in shapes:
            s[0][1] = "#root"
        whole = extraction.tree_of(json.loads(extraction.fold(map(json.dumps, shapes))))
        for s in shapes:
            assert len(set(extraction.align(whole, s))) == len(s) and min(extraction.align(whole, s)) == 0
