"""MinHash near-dedup by a signature-coordinate inverted join.

Equal shingle sets are one class. A class posts itself under its 64 (coordinate, value) pairs; values held by one
class alone are dropped, so what is left of a signature are its live posts, and two classes collide exactly in the
live posts they share. Two that collide T times share one of the rarest live - T + 1 of either (prefix), and a class
with fewer than T live posts has no partner, so long lists are skipped in merging. In a short list every pair is
tried, in a long one each member with a few centres; collisions are counted on the whole live posts and pairs with
T or more of fitting sizes are confirmed on full sets. Then the long lists that aren't one component yet are gone
through in tasks of two blocks, cut by set size so that only sizes that can reach the likeness meet. Confirming
tasks get each text once and return forests of links; no list is multiplied out into rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincast.llm.common import BROADCAST_BYTES, join_small, map_arrow, materialize, slices, table, value_bytes

SHINGLE = 5
PERCENT = 75
COORDINATES = 64
#: A pair of likeness 0.75 agrees in 48 of 64 coordinates on average (deviation 3.5); it misses 32 in 4.6 of a million cases.
MATCHES = 32
#: In lists of at most this length every pair is tried at once.
SHORT = 16
#: Members of a longer list that the others are tried with first.
CENTRES = 3
#: The rows of a larger class of equal sets aren't shuffled to it.
HOT_ROWS = 1000
#: A task's block has about so many members and shingles at most (one longer text is a block's all the same).
BLOCK = 512
BLOCK_SHINGLES = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_DRAW = np.random.default_rng(97)
_A = _DRAW.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _DRAW.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each of 64 multiply-add hashes, 32 bits each."""
    low = np.full(COORDINATES, np.uint64((1 << 64) - 1))
    for i in range(0, len(hashes), 2048):  # bounds memory for long texts
        low = np.minimum(low, (hashes[i : i + 2048, None] * _A + _B).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def _key(hashes: np.ndarray) -> bytes:
    return hashlib.md5(hashes.tobytes()).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, signs = [], [], []
        for part in slices([batch.select(["text"])]):
            for text in part["text"].to_pylist():
                s = shingles(text)
                sizes.append(len(s))
                keys.append(_key(s) if len(s) else None)
                signs.append(signature(s).view(np.int32) if len(s) else None)
        rest = [n for n in batch.schema.names if n != "text"]
        made = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in rest), *made], [*rest, "n_shingles", "key", "sign"])


def classes_of(signed: DataFrame, row: Sequence[str] = ()) -> DataFrame:
    """A row for each different set: ``node`` (its number), ``key``, ``held`` (rows), ``n``, ``sign``, and ``least``, its first row: null ids last, then by ``doc_id``, ``row`` and ``text_hash``.

    A class is numbered by its smallest id; where ids are null or repeated, so that two classes have the same, by a hash of its key.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *row, "text_hash")).alias("least")
    found = signed.filter(F.col("key").isNotNull()).groupBy("key").agg(least, F.count(F.lit(1)).alias("held"), F.first("n_shingles").alias("n"), F.first("sign").alias("sign"))
    found = materialize(found, "classes")
    named = found.filter(~F.col("least.unnamed")).select(F.col("least.doc_id").alias("shared"))
    shared = materialize(named.groupBy("shared").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("shared"), "shared")
    if not shared.limit(1).count():
        return found.withColumn("node", F.coalesce("least.doc_id", F.xxhash64("key")))
    both = found.join(shared, F.col("least.doc_id") == F.col("shared"), "left")
    plain = ~F.col("least.unnamed") & F.col("shared").isNull()
    return materialize(both.withColumn("node", F.when(plain, F.col("least.doc_id")).otherwise(F.xxhash64("key"))).drop("shared"), "numbered-classes")


def live_posts(classes: DataFrame) -> DataFrame:
    """``node, n, posts``: the live posts, rarest first, of each class that has T or more."""
    place = F.shiftleft(F.col("pos").cast("long"), 32)
    posts = classes.select("node", F.posexplode("sign").alias("pos", "value")).select("node", place.bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("post"))
    often = posts.groupBy("post").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    live = posts.join(often, "post").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "post"))).alias("by"))  # 64 a class at most
    live = live.filter(F.size("by") >= MATCHES).select("node", F.col("by.post").alias("posts"))
    return live.join(classes.select("node", "n"), "node").select("node", "n", "posts")


def prefix(posts: Column) -> Column:
    return F.slice(posts, F.lit(1), F.size(posts) - (MATCHES - 1))


def components(links: DataFrame) -> DataFrame:
    """``node, comp``: the smallest node reachable, for the nodes of ``links`` (a, b).

    Each round hooks every node to its smallest neighbour below it, follows the hooks to their roots and goes on with the links between
    different roots alone. So links are looked up about once, not once a round, and two rounds at least halve the nodes.
    """
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    comp = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node"))
    edges = edges.filter("a < b")
    while True:
        roots = _roots(materialize(edges.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node"), "hooks"))
        comp = materialize(comp.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "comp")
        hooked = edges.join(roots.withColumnRenamed("node", "b"), "b").select("a", F.col("root").alias("to"))  # each b has a neighbour below it
        hooked = hooked.join(roots.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("root", "a").alias("a"), "to").filter("a <> to")
        edges = materialize(hooked.select(F.least("a", "to").alias("a"), F.greatest("a", "to").alias("b")).distinct(), "edges")
        if not edges.limit(1).count():
            return comp


def _roots(hooks: DataFrame) -> DataFrame:
    """``node, root``: where the hooks (node, root) of each node end."""
    while True:
        above = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
        fresh = materialize(hooks.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "hooks")
        hooks = fresh.select("node", "root")
        if not fresh.filter("moved").limit(1).count():
            return hooks


def _fits(a: Column, b: Column) -> Column:
    """Sizes that a likeness of PERCENT allows."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def close_pairs(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """``a, b, hits`` of the pairs with fitting sizes and T collisions or more."""
    one, other = (live.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("posts").alias(f"posts_{x}")) for x in "ab")
    both = pairs.join(one, "a").join(other, "b").filter(_fits(F.col("n_a"), F.col("n_b")))
    return both.select("a", "b", F.size(F.array_intersect("posts_a", "posts_b")).alias("hits")).filter(F.col("hits") >= MATCHES)


def _texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``wanted`` (node, ...) with ``key`` and ``text``; a wanted row may come with equal texts of other keys, which tasks leave out."""
    places = wanted.join(classes.select("node", "key", F.col("least.doc_id").alias("doc_id"), F.col("least.text_hash").alias("text_hash")), "node")
    ids = materialize(places.select("text_hash").distinct(), "wanted")
    some = docs.join(F.broadcast(ids) if value_bytes(ids) <= BROADCAST_BYTES else ids, "text_hash", "left_semi")
    return some.join(places, (some.text_hash == places.text_hash) & some.doc_id.eqNullSafe(places.doc_id)).select(*wanted.columns, "key", "text")


def _blocks(n: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _part(node: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(node), parts).cast("int")


class Forest:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    def joined(self, x: int, y: int) -> bool:
        return self.root(x) == self.root(y)

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)


def alike(p: np.ndarray, q: np.ndarray) -> bool:
    if 100 * min(len(p), len(q)) < PERCENT * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= PERCENT * (len(p) + len(q) - both)


def _sets(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
    out: dict[int, np.ndarray] = {}
    for node, key, text in zip(pdf["node"].tolist(), pdf["key"], pdf["text"], strict=True):
        if node not in out:
            s = shingles(text)
            if _key(s) == key:
                out[node] = s
    return out


def _confirm(members: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    sets, forest, links = _sets(members), Forest(), []
    for a, b in pairs.sort_values(["hits", "a", "b"], ascending=[False, True, True])[["a", "b"]].itertuples(index=False):
        if not forest.joined(a, b) and alike(sets[a], sets[b]):
            forest.join(a, b)
            links.append((a, b))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def confirmed(close: DataFrame, live: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links that join what the ``close`` pairs (a, b, hits) of the likeness join.

    Tasks hold connected groups of pairs, so a text travels once: small groups are dealt to bins of a block's size,
    a large group is cut by the blocks of its pairs' ends.
    """
    group = components(close)
    sizes = group.join(live.select("node", "n"), "node").groupBy("comp").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("shingles"))
    sizes = materialize(sizes.withColumn("parts", _blocks(F.col("held"), F.col("shingles"))), "groups")
    bins = sizes.filter("parts = 1").agg(_blocks(F.sum("held"), F.sum("shingles"))).first()[0] or 1
    dealt = close.join(group.select(F.col("node").alias("a"), "comp"), "a").join(sizes, "comp")
    i, j = _part(F.col("a"), F.col("parts")), _part(F.col("b"), F.col("parts"))
    large = F.when(F.col("parts") > 1, F.col("comp")).alias("large")
    turn = F.when(F.col("parts") > 1, F.lit(0)).otherwise(_part(F.col("comp"), F.lit(bins))).alias("bin")
    dealt = materialize(dealt.select(large, turn, F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), "a", "b", "hits"), "close-dealt")
    task = ("large", "bin", "i", "j")
    ends = dealt.select(*[F.col(c).alias(c) for c in task], F.explode(F.array("a", "b")).alias("node")).distinct()
    return _texts(ends, classes, docs).groupBy(*task).cogroup(dealt.groupBy(*task)).applyInPandas(_confirm, "a bigint, b bigint")


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b``: links between class numbers that make the components of near-duplicates."""
    live = materialize(live_posts(classes), "live")
    posts = materialize(live.select("node", F.explode(prefix(F.col("posts"))).alias("post")), "posts")
    # only long lists are looked up, so no hot list is dealt to one task by its post
    lists = materialize(posts.groupBy("post").agg(F.count(F.lit(1)).alias("len")).filter(F.col("len") > SHORT), "lists")
    marked = join_small(posts, lists, "post", F.col("node"))
    short = marked.filter("len is null").select("node", "post")
    long = materialize(marked.filter("len is not null").select("node", "post"), "long")
    other = short.withColumnRenamed("node", "b")
    tried = short.withColumnRenamed("node", "a").join(other, "post").filter("a < b").select("a", "b").union(stars(long, CENTRES)).distinct()
    close = materialize(close_pairs(tried, live), "close")
    found = materialize(confirmed(close, live, classes, docs), "links")
    placed = long.join(components(found), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = materialize(placed, "placed")
    mixed = materialize(placed.groupBy("post").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y"), "mixed")
    open_ = materialize(join_small(placed, mixed, "post", F.col("node")).filter("x is not null").select("post", "node", "comp"), "open")
    if not open_.limit(1).count():
        return found
    return found.union(materialize(_open_links(open_, live, classes, docs), "links"))


def stars(members: DataFrame, centres: int) -> DataFrame:
    """``a, b``: each member of a list with the list's members of least hash, one for each of ``centres`` seeds."""
    picked = [F.min(F.struct(F.xxhash64("node", F.lit(nth)).alias("turn"), "node"))["node"].alias(f"c{nth}") for nth in range(centres)]
    found = members.groupBy("post").agg(*picked).select("post", F.array_distinct(F.array(*[f"c{nth}" for nth in range(centres)])).alias("centres"))
    tried = join_small(members, materialize(found, "centres"), "post", F.col("node")).select("node", F.explode("centres").alias("centre"))
    return tried.filter("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def _open_links(open_: DataFrame, live: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between the members of long lists that aren't one component yet.

    Lists that share members form a cluster. Its members are cut into size classes, each 4/3 times the last, and
    those by hash into blocks. Two members of the likeness are in one size class or in neighbours, so
    only such blocks meet, two in a task: collisions are counted for all, and pairs of different components with T
    or more are confirmed, most collisions first, unless links found meanwhile join them.
    """
    cluster = components(stars(open_.select("node", "post"), 1))
    members = open_.select("node", "comp").distinct().join(cluster.select("node", F.col("comp").alias("cluster")), "node").join(live, "node")
    members = materialize(members.withColumn("size", F.floor(F.ln("n") / math.log(100 / PERCENT) + 1e-9).cast("int")), "members")
    sizes = materialize(members.groupBy("cluster", "size").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("parts")), "sizes")
    near = lambda by, name: sizes.select("cluster", (F.col("size") + by).alias("size"), F.col("parts").alias(name))
    known = sizes.join(near(-1, "above"), ["cluster", "size"], "left").join(near(1, "below"), ["cluster", "size"], "left")
    placed = members.join(known, ["cluster", "size"]).withColumn("own", _part(F.col("node"), F.col("parts")))
    of = lambda parts: F.when(parts.isNotNull(), F.sequence(F.lit(0), parts - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda size, i, size2, j: F.struct(size.alias("size"), i.alias("i"), size2.alias("size2"), j.alias("j"))
    s, own = F.col("size"), F.col("own")
    within = F.transform(of(F.col("parts")), lambda q: task(s, F.least(own, q), s, F.greatest(own, q)))
    above = F.transform(of(F.col("above")), lambda q: task(s, own, s + 1, q))
    below = F.transform(of(F.col("below")), lambda q: task(s - 1, q, s, own))
    dealt = placed.select("cluster", "node", "comp", "posts", F.struct("size", "own").alias("at"), F.explode(F.concat(within, above, below)).alias("task"))
    dealt = dealt.select("cluster", "task.*", F.col("at.size").alias("at_size"), F.col("at.own").alias("at"), "node", "comp", "posts")
    return _texts(dealt, classes, docs).groupBy("cluster", "size", "i", "size2", "j").applyInPandas(_block_links, "a bigint, b bigint")


def _dense(posts: pd.Series) -> np.ndarray:
    """Live posts by coordinate; where a class has none, a number that no other class has there."""
    out = -1 - np.arange(len(posts), dtype=np.int64)[:, None].repeat(COORDINATES, axis=1)
    for row, p in enumerate(posts):
        p = np.asarray(p, dtype=np.int64)
        out[row, p >> 32] = p & 0xFFFFFFFF
    return out


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    if pdf["comp"].nunique() < 2:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    first = pdf.iloc[0]
    sets = _sets(pdf)
    pdf = pdf.drop_duplicates("node").sort_values("node", ignore_index=True)
    left = np.flatnonzero((pdf["at_size"] == first["size"]) & (pdf["at"] == first["i"]))
    right = np.flatnonzero((pdf["at_size"] == first["size2"]) & (pdf["at"] == first["j"]))
    dense, nodes, comp = _dense(pdf["posts"]), pdf["node"].tolist(), pdf["comp"].to_numpy()
    hits = np.zeros((len(left), len(right)), dtype=np.uint8)
    for c in range(COORDINATES):
        hits += dense[left, c][:, None] == dense[right, c][None, :]
    hits[(comp[left][:, None] == comp[right][None, :])] = 0
    p, q = np.nonzero(hits >= MATCHES)
    order = np.argsort(-hits[p, q].astype(np.int16), kind="stable")
    forest, links = Forest(), []
    for x, y in zip(left[p[order]].tolist(), right[q[order]].tolist(), strict=True):
        at, to = int(comp[x]), int(comp[y])
        if not forest.joined(at, to) and alike(sets[nodes[x]], sets[nodes[y]]):
            forest.join(at, to)
            links.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def near_duplicates(docs: DataFrame, row: Sequence[str] = ()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of ``doc_id, text``, a row for each row.

    Null texts and texts without words have 0 shingles and are alone. Rows are documents, also where ids are
    repeated or null: each is linked by its own text, and a component's id is its smallest id that isn't null. A row
    of null id is kept only if its whole component has none; all rows of the component's id are kept. Columns ``row``
    that tell rows apart are carried along, and then ``first`` is true for one row of each component.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row, "text").withColumn("text_hash", F.xxhash64("text"))
    carried = "".join(f"{c} bigint, " for c in row)
    signed = materialize(map_arrow(given, _sign, f"doc_id bigint, {carried}text_hash bigint, n_shingles bigint, key binary, sign array<int>"), "signed")
    classes = classes_of(signed, row)
    comp = components(links(given, classes))
    linked = classes.select("node", "key", "least").join(comp, "node")
    low = linked.groupBy("comp").agg(F.min("least").alias("low"))
    by_class = classes.select("key", "least", "held").join(linked.join(low, "comp").select("key", "low"), "key", "left")
    by_class = by_class.select("key", F.coalesce("low", "least").alias("low"), "held")
    # the rows of a hot class stay where they are; the others go to their class
    hot = materialize(by_class.filter(F.col("held") > HOT_ROWS).drop("held"), "hot")
    marked = join_small(signed.select("doc_id", *row, "text_hash", "n_shingles", "key"), hot, "key", F.xxhash64("doc_id", *row))
    rest = marked.filter("low is null").drop("low").join(by_class.filter(F.col("held") <= HOT_ROWS).drop("held"), "key", "left")
    out = marked.filter("low is not null").unionByName(rest)
    out = out.withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("low.doc_id")))
    kept = F.when(F.col("component_id").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    one = [F.coalesce(F.col("low") == F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *row, "text_hash"), F.lit(True)).alias("first")] if row else []
    return out.select("doc_id", *row, "n_shingles", "component_id", kept.alias("kept"), *one)


def op4_minhash_inverted_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
