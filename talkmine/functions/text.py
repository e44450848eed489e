"""Text measures and repairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what a topic keeps of a text.
NON_TOPIC = "[^一-龥a-zA-Z0-9]"


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping, case-sensitive occurrences of a literal word."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))
    return F.floor(gone / F.lit(len(word))).cast("long")


def total_occurrences(text: Column, words: Sequence[str]) -> Column:
    """Occurrences of all words, each counted apart, so that one word within another
    counts twice."""
    total = F.lit(0).cast("long")
    for w in words:
        total = total + occurrences(text, w)
    return total


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring letters and digits; of one, itself."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), NON_TOPIC, "")
    pairs = F.array_distinct(F.regexp_extract_all(clean, F.lit("(?=(..))"), F.lit(1)))  # one pass, however long the text
    return F.when(F.length(clean) == 0, F.array().cast("array<string>")).when(F.length(clean) == 1, F.array(clean)).otherwise(pairs)


#: Whether a code point is kept as topic; the last place stands for all beyond the plane.
_TOPIC = np.zeros(0x10000, dtype=bool)
for _first, _last in ("一龥", "az", "AZ", "09"):
    _TOPIC[ord(_first) : ord(_last) + 1] = True


def _pair_codes(text: str) -> bytes:
    kept = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = kept[_TOPIC[np.minimum(kept, 0xFFFF)]]
    return (np.unique(kept[:-1] << 16 | kept[1:]) if len(kept) > 1 else kept).tobytes()


@F.pandas_udf(T.BinaryType())
def bigram_codes(texts: pd.Series) -> pd.Series:
    """The set of `bigrams` as sorted 32-bit numbers: two code points of 16 bits."""
    return pd.Series([_pair_codes(x or "") for x in texts], dtype="object")


def set_overlap(a: Column, b: Column) -> Column:
    """Shared members as a share of the smaller set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def bigram_similarity(a: Column, b: Column) -> Column:
    return set_overlap(bigrams(a), bigrams(b))


def form_similarity(a: Column, b: Column) -> Column:
    """Half edit distance, .3 shared characters, .2 lengths in proportion."""
    most, least = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    chars = lambda s: F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    union = F.size(F.array_union(chars(a), chars(b)))
    shared = F.when(union > 0, F.size(F.array_intersect(chars(a), chars(b))) / union).otherwise(0.0)
    edit = F.when(most > 0, 1 - F.levenshtein(a, b) / most).otherwise(0.0)
    return 0.5 * edit + 0.3 * shared + 0.2 * F.when(most > 0, least / most).otherwise(0.0)


def token_estimate(chars: Column, per_char: float = 0.6) -> Column:
    return F.floor(F.lit(per_char) * chars).cast("long")


def fix_words(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Replace wrong words, the longest first, one after another."""
    for wrong, right in sorted(pairs, key=lambda p: -len(p[0])):
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def fix_line(line: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """The same for what follows a leading [..] stamp."""
    stamp = F.regexp_extract(line, r"^(\[[^\]]*\]\s*)", 1)
    return F.concat(stamp, fix_words(F.substr(line, F.length(stamp) + 1, F.length(line)), pairs))


def plain(text: Column) -> Column:
    """Without rich tokens, punctuation and blanks."""
    bare = F.regexp_replace(text, r"<\|[^|]*\|>", "")
    return F.regexp_replace(bare, r"[\p{P}\p{S}\s]+", "")
