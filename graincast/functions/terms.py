"""Lists of terms in texts by one automaton: the plan has one function however long the list is."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to so many terms a list is spelt out as conditions, which stay in the JVM; the result is the same.
SPELT_OUT = 32


class Automaton:
    """Aho and Corasick's: one pass over a text finds all terms in it. States are numbers; each has its letters, its fallback and its terms."""

    def __init__(self, terms: tuple[str, ...]):
        self.follow: list[dict[str, int]] = [{}]
        self.back, self.ends = [0], [frozenset[int]()]
        for number, term in enumerate(terms):
            state = 0
            for letter in term:
                if letter not in self.follow[state]:
                    self.follow[state][letter] = len(self.follow)
                    self.follow.append({})
                    self.back.append(0)
                    self.ends.append(frozenset())
                state = self.follow[state][letter]
            self.ends[state] |= {number}
        level = list(self.follow[0].values())
        while level:
            below = []
            for state in level:
                for letter, after in self.follow[state].items():
                    at = self.back[state]
                    while at and letter not in self.follow[at]:
                        at = self.back[at]
                    self.back[after] = self.follow[at].get(letter, 0)
                    self.ends[after] |= self.ends[self.back[after]]
                    below.append(after)
            level = below

    def found(self, text: str) -> set[int]:
        """Numbers of the terms in a text."""
        state, seen = 0, set(self.ends[0])
        for letter in text:
            while state and letter not in self.follow[state]:
                state = self.back[state]
            state = self.follow[state].get(letter, 0)
            if self.ends[state]:
                seen |= self.ends[state]
        return seen


@functools.lru_cache(maxsize=8)
def automaton(terms: tuple[str, ...]) -> Automaton:
    return Automaton(terms)


def count_terms(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """How many of the terms are parts of ``text``, repeated ones as often as they are listed; 0 for null."""
    given = tuple(terms)
    if len(given) <= SPELT_OUT:
        return sum((F.coalesce(text.contains(t), F.lit(False)).cast("int") for t in given), F.lit(0))

    @F.arrow_udf(T.IntegerType())
    def counted(texts: pa.Array) -> pa.Array:
        one = automaton(given)
        return pa.array([len(one.found(t)) if t is not None else 0 for t in texts.to_pylist()], pa.int32())

    return counted(text)
