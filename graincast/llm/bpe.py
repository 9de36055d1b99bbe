"""BPE encoding and decoding by tree concatenation.

A long text is cut where a blank after what isn't one begins a word: a piece (the unit that merges never leave) surely
begins there, so tokens of the parts stand side by side. A long piece that nothing splits is cut into leaves of bytes,
leaves are encoded in parallel, and neighbours are joined pairwise up a tree: at a join a window of tokens around
the cut is encoded again and grows until its first token is the left side's and its last one the right side's own.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graincast.llm.common import map_arrow, table, with_columns

#: Texts of more code points, and pieces of more bytes, than this are cut.
LEAF = 8192
#: First width of a join's window, in tokens on each side; it doubles.
WINDOW = 8
#: Threads of a task for the leaves of one text.
THREADS = 2


@functools.lru_cache(maxsize=1)
def _threads() -> ThreadPoolExecutor:
    return ThreadPoolExecutor(THREADS)


def _word_blank(text: str, at: int) -> int:
    """The first place from ``at`` on where a blank follows what isn't white space; the end if there is none."""
    while (at := text.find(" ", at)) >= 0:
        if at and not text[at - 1].isspace():
            return at
        at += 1
    return len(text)


@functools.lru_cache(maxsize=4)
def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest for 256 and on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = _byte_letters()
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        merged = [vocab[m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in spec["model"]["merges"]]
        if merged != sorted(merged) or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: not a plain byte-level BPE with ids in the order of merges")
        self.base = tiktoken.Encoding("graincast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.bytes_of = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            self.bytes_of[i] = token
        self.special = added
        #: Bytes that went through ``single`` so far.
        self.encoded = 0
        self.has_special = lambda text: any(t in text for t in added)
        self.names = [str(i) for i in range(len(self.bytes_of))]
        import regex

        self.pieces = regex.compile(public_tokenizers.PATTERN)

    def leaf(self, text: str) -> list[int]:
        return self.base.encode(text, allowed_special="all") if self.has_special(text) else self.base.encode_ordinary(text)

    def starts(self, text: str) -> list[int]:
        """Piece starts of a text, in code points; an added token is a piece."""
        if not self.has_special(text):
            return [m.start() for m in self.pieces.finditer(text)]
        found, at = [], 0
        while at < len(text):
            hits = [(text.find(t, at), t) for t in self.special if text.find(t, at) >= 0]
            end, token = min(hits, default=(len(text), ""))
            found += [at + m.start() for m in self.pieces.finditer(text[at:end])]
            if token:
                found.append(end)
            at = end + len(token)
        return found

    def single(self, piece: bytes) -> list[int]:
        """Tokens of one piece, which merges don't leave."""
        self.encoded += len(piece)
        return self.base._core_bpe.encode_single_piece(piece)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of a piece from those of its halves.

        The last tokens of the left and the first of the right are encoded again together. If the window's first token is
        the left's own and its last one the right's own, each pair of neighbours in the whole is a pair that some encoding
        has, and then the whole is the encoding. If a side disagrees, the window doubles.
        """
        k = WINDOW
        while True:
            i, j = max(0, len(left) - k), min(k, len(right))
            window = self.single(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            k *= 2

    def tree(self, piece: bytes, leaf: int) -> list[int]:
        """Tokens of one long piece: its leaves in parallel (the encoder holds no lock), then joined pairwise."""
        level = list(_threads().map(self.single, [piece[i : i + leaf] for i in range(0, len(piece), leaf)]))
        while len(level) > 1:
            paired = list(_threads().map(self.join, level[::2], level[1::2]))
            level = paired + level[len(paired) * 2 :]
        return level[0]

    def unsplit(self, text: str, leaf: int) -> list[int]:
        """Tokens of a text in which no blank begins a word: piece by piece, long pieces by their trees."""
        starts, ids = self.starts(text), []
        for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
            piece = text[a:b]
            if piece in self.special:
                ids.append(self.special[piece])
            elif len(data := piece.encode()) > leaf:
                ids += self.tree(data, leaf)
            else:
                ids += self.single(data)
        return ids

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        """Token ids of a text. One of over ``leaf`` code points is cut at blanks that begin a word; what is longer without any goes by trees."""
        if len(text) <= leaf:
            return self.leaf(text)
        cuts = [0]
        while len(text) - cuts[-1] > leaf:
            cuts.append(_word_blank(text, cuts[-1] + leaf))
            if cuts[-1] == len(text):
                break
        parts = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) if a < b]
        # unsplit parts wait for threads themselves, so they don't take one
        found = [_threads().submit(self.leaf, part) if len(part) <= 2 * leaf else None for part in parts]
        return list(itertools.chain.from_iterable(self.unsplit(part, leaf) if f is None else f.result() for part, f in zip(parts, found, strict=True)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _digest(path: str | None):
    def make(part: pa.RecordBatch) -> list[pa.Array]:
        c = codec(path or vocabulary_path())
        counts, ids_sha, text_sha = [], [], []
        for text in part["text"].to_pylist():
            ids = c.encode(text or "")
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(c.names.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    return with_columns(("n_tokens", "ids_sha256", "decoded_sha256"), lambda: make, drop=("text",))


def _encode(path: str | None):
    def make(part: pa.RecordBatch) -> list[pa.Array]:
        c = codec(path or vocabulary_path())
        return [pa.array([np.array(c.encode(t or ""), dtype=np.int32) for t in part["text"].to_pylist()], pa.list_(pa.int32()))]

    return with_columns(("ids",), lambda: make, drop=("text",))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``text`` exchanged for ``ids``; null texts give no tokens. ``path`` is the vocabulary on each executor."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    return map_arrow(docs, _encode(path), ", ".join([*kept, "ids array<int>"]))


def op9_bpe_tree(spark, sf_dir: str) -> DataFrame:
    """Digests of the tokens of every document and of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return map_arrow(docs, _digest(None), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
