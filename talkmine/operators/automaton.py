"""Many words found in many texts at once: Aho-Corasick automata of bounded size.

One pass over a text finds all words of an automaton, however many they are.  The words
are broadcast up to `AUTOMATON_LETTERS`; a larger list is dealt to several automata, each
of which passes over the texts in turn.  A Python worker builds an automaton once and keeps it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of the words of one automaton, about; a letter takes some 40 bytes of a task's memory.
AUTOMATON_LETTERS = 4_000_000


class Words:
    """A list of words that is sent as it is and becomes an automaton where it is used."""

    def __init__(self, words: list[str]):
        self.words, self.built = words, None

    def __reduce__(self):
        return Words, (self.words,)

    def spans(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """Start and end of every occurrence of every word within `start` and `end`."""
        if not self.words:
            return []
        if self.built is None:
            self.built = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for word in self.words:
                self.built.add_word(word)
            self.built.make_automaton()
        return [(last - n + 1, last + 1) for last, n in self.built.iter(text, start, end)]


def automata(words: DataFrame) -> Iterator[Words]:
    """The distinct words of the one column of `words`, null and empty ones aside, as one list
    or more; the driver holds one at a time."""
    words = words.toDF("word").filter("word <> ''").distinct()
    letters = words.agg(F.sum(F.length("word"))).first()[0] or 0
    n = max(1, math.ceil(letters / AUTOMATON_LETTERS))
    for k in range(n):
        own = words.filter(F.pmod(F.xxhash64("word"), F.lit(n)) == k) if n > 1 else words
        yield Words(sorted(own.toArrow().column("word").to_pylist()))


def leftmost_longest(spans: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Of overlapping spans the first, and of those that start together the longest."""
    at = 0
    for start, end in sorted(spans, key=lambda x: (x[0], -x[1])):
        if start >= at:
            yield start, end
            at = end


def longest_at_each(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest span of each start, in order."""
    return sorted({start: end for start, end in sorted(spans)}.items())


def words_in(text: Column, words: Sequence[str]) -> Column:
    """Which of a fixed list of `words` a text holds, each once, in the order of the list."""
    shared, place = Words(list(words)), {w: k for k, w in enumerate(words)}

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({t[a:b] for a, b in shared.spans(t, 0, len(t))}, key=place.get) for t in texts], dtype="object")

    return held(F.coalesce(text, F.lit("")))
