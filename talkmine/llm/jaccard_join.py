"""N-gram Jaccard join by signature trees over blocks of shared prefix shingles.

Two sets of similarity t or more share a shingle among the first n - ceil(t n) + 1
of each, in any order of shingles that all documents use.  Here the order is by hash with
frequent shingles last.  Documents that share such a shingle form a block.  Within
a block a signature tree holds OR-combined bitmaps and size ranges, and a dual
traversal prunes pairs of nodes whose greatest possible overlap is too small.  A block
of one leaf needs no tree: its pairs are tested at once.  A block of more than
`BLOCK_ROWS` members is many tasks'.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bits import bloom, passes
from .components import components
from .staging import stage, texts

WORDS = 3
#: Similarity in hundredths.
SIMILARITY = 90
#: Shingles in the prefixes of so many rows are frequent; so many at most are put last
#: (the most frequent ones; others keep their place, which changes no result).
FREQUENT = 64
FREQUENT_AT_MOST = 500_000
#: Shingles that are counted, in hundredths of a prefix.
PROBE = 130
#: Coarse bitmaps hold one in four shingles and half a bit or more for each of the set's,
#: fine ones all shingles and a bit or more for each, rich ones two bits or more, small sets
#: up to four: (one in, bits a shingle, bits a shingle while the bitmap is of at most so many
#: bits, most bits).
COARSE = (4, 0.5, 0.5, 0, 1 << 14)
FINE = (1, 1, 1, 0, 1 << 18)
RICH = (1, 2, 4, 1 << 11, 1 << 18)
LEAST_BITS = 64
#: Blocks of more members are compared by stars first; others are one leaf.
WHOLE_BLOCK = 8
#: Members of a block that one task holds; larger blocks are split.
BLOCK_ROWS = 1024
#: Tables of a row for each split block are broadcast up to so many rows, and joined beyond.
BROADCAST_ROWS = 500_000
#: Tasks that the rows of a frequent shingle are dealt to when it is looked for.
SPREAD = 64
#: Pairs whose bitmaps are compared at once.
AT_ONCE = 1 << 14
#: Pairs of a block, or of several, that a task of a later round holds before it sifts or gives them out.
PAIRS_AT_ONCE = 1 << 16
#: Members of a leaf and children of a node.
LEAF = 16
FAN = 4
#: Bytes of a text that are hashed at once, and the smallest table of powers.
SEGMENT = 1 << 18
SMALL = 1 << 17
#: Primes and bases of the two polynomials that hash a word.
_MODULI = (2147483647, 2147483629)
_BASES = (1103515245, 1664525423)
_BLANK = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
_IS_BLANK = np.isin(np.arange(256), _BLANK)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Rows, and bytes of forms, that a task hands out at once.
OUT_ROWS = 2048
OUT_BYTES = 1 << 23

_SETS = "doc_id long, text_hash long, k long, k2 long, n int, bits binary, fine binary, probe array<long>"
_PREFIXES = "shingle long, part int, n int, k long"


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    """A fixed random value of each byte for both polynomials; capitals share those of
    small letters."""
    table = np.random.default_rng(2024).integers(1, min(_MODULI), (2, 256), dtype=np.uint64)
    table[:, 65:91] = table[:, 97:123]
    table[:, _BLANK] = 0
    return table


@lru_cache(maxsize=2)
def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse modulo its prime."""
    found = []
    for p, base in zip(_MODULI, _BASES):
        both = []
        for b in (base, pow(base, -1, p)):
            own = np.ones(n, np.uint64)
            size = 1
            while size < n:  # the powers so far, shifted
                own[size : 2 * size] = own[: min(size, n - size)] * np.uint64(pow(b, size, p)) % np.uint64(p)
                size *= 2
            both.append(own)
        found.append(tuple(both))
    return found


def word_hashes(text: str | np.ndarray) -> np.ndarray:
    """62-bit hashes of the words of a text, given as such or as its UTF-8 bytes: two
    polynomials of byte values modulo primes, from running sums over the whole text and
    shifted to the place of the word.  Long texts are taken by segments that end at blanks."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if isinstance(text, str) else text
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        if end < len(data):
            blanks = np.flatnonzero(_IS_BLANK[data[at:end]])
            while not len(blanks) and end < len(data):  # a word longer than a segment
                blanks, end = np.flatnonzero(_IS_BLANK[data[end : end + SEGMENT]]) + (end - at), min(len(data), end + SEGMENT)
            end = at + int(blanks[-1]) + 1 if len(blanks) else len(data)
        part = data[at:end]
        blank = np.ones(len(part) + 2, bool)
        np.take(_IS_BLANK, part, out=blank[1:-1])
        turns = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = turns[::2], turns[1::2]
        if len(starts):
            whole = np.zeros(len(starts), np.uint64)
            for values, p, (up, down) in zip(_byte_values(), _MODULI, _powers(max(SMALL, 1 << (len(part) - 1).bit_length()))):
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(values[part] * up[: len(part)] % np.uint64(p), out=sums[1:])
                whole = whole << np.uint64(31) | (sums[ends] - sums[starts]) % np.uint64(p) * down[starts] % np.uint64(p)
            parts.append(whole)
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles(text: str | np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are runs of other than ASCII white space with A-Z lower-cased; a text of
    fewer words is one shingle, one without words has none.
    """
    w = word_hashes(text)
    if not len(w):
        return np.zeros(0, np.int64)
    size = min(words, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - size + 1, size, np.uint64)
        for j in range(size):
            h = (h ^ w[j : len(w) - size + 1 + j]) * _MIX
            h ^= h >> np.uint64(29)
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        h ^= h >> np.uint64(31)
    own = h.view(np.int64)
    own.sort()
    new = np.ones(len(own), bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    return own[new]


def set_key(own: np.ndarray, seed: int) -> tuple[int, int]:
    """Two independent 64-bit keys of a set."""
    import xxhash

    data = own.tobytes()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(xxhash.xxh3_64_intdigest(data, seed)), signed(xxhash.xxh64_intdigest(data, seed))


def prefix_length(n: int, similarity: int) -> int:
    return n - -(-similarity * n // 100) + 1


def prefix(own: np.ndarray, frequent: np.ndarray, rank: np.ndarray, similarity: int) -> np.ndarray:
    """The first shingles of a set: infrequent ones by hash, then frequent ones by rank and
    those of equal rank by hash, so that all sets share one order."""
    need, found = prefix_length(len(own), similarity), []
    if not len(frequent):
        return own[:need]
    for at in range(0, len(own), 2 * need):
        part = own[at : at + 2 * need]
        light = part[frequent[np.minimum(np.searchsorted(frequent, part), len(frequent) - 1)] != part]
        found.append(light)
        if sum(map(len, found)) >= need:
            return np.concatenate(found)[:need]
    light = np.concatenate(found)
    heavy = np.setdiff1d(own, light, assume_unique=True)
    return np.concatenate([light, heavy[np.lexsort((heavy, rank[np.searchsorted(frequent, heavy)]))]])[:need]


def signature(own: np.ndarray, kind: tuple = COARSE) -> np.ndarray:
    """The bitmap of a set's sampled shingles, as 64-bit words."""
    one_in, per, per_small, small, most = kind
    size, wanted = LEAST_BITS, max(per * len(own), min(per_small * len(own), small))
    while size < wanted and size < most:
        size *= 2
    sampled = own[(own >> 7) % one_in == 0] if one_in > 1 else own
    bits = np.zeros(size, bool)
    bits[(sampled >> 24) & (size - 1)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of half the size: the same places modulo the half."""
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


def _values(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text or binary value, as views of the column's own memory."""
    if not len(column):
        return
    _, at, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for begin, end in zip(at, at[1:]):
        yield data[begin:end]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, OUT_ROWS):
            yield batch.slice(at, OUT_ROWS)


def _longs(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def _read_sets(seed: int, words: int, similarity: int):
    names = [c.split()[0] for c in _SETS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keys, sizes, coarse, fine, probes = [], [], [], [], []
            for text in _values(batch.column("text")):
                own = shingles(text, words)
                keys.append(set_key(own, seed))
                sizes.append(len(own))
                coarse.append(signature(own).tobytes())
                fine.append(signature(own, FINE).tobytes())
                probes.append(own[: prefix_length(len(own), similarity) * PROBE // 100].copy() if len(own) else own)
            k = np.array(keys, np.int64)
            ends = pa.array(np.r_[0, np.cumsum([len(x) for x in probes])].astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(sizes, pa.int32()),
                pa.array(coarse, pa.binary()), pa.array(fine, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(probes))),
            ], names)

    return run


def _read_prefixes(seed: int, words: int, similarity: int, shared):
    """(shingle, part, n, k); the rows of a frequent shingle are dealt to parts from 1 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = shared.value
        for batch in _slices(batches):
            met, keys, sizes, firsts = set(), [], [], []
            for text in _values(batch.column("text")):
                own = shingles(text, words)
                k = set_key(own, seed)[0]
                if len(own) and k not in met:
                    met.add(k)
                    keys.append(k)
                    sizes.append(len(own))
                    firsts.append(prefix(own, frequent, rank, similarity).copy())
            if keys:
                times = [len(x) for x in firsts]
                s, k, n = np.concatenate(firsts), np.repeat(np.array(keys, np.int64), times), np.repeat(np.array(sizes, np.int32), times)
                heavy = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s if len(frequent) else np.zeros(len(s), bool)
                yield _longs(shingle=s, part=np.where(heavy, 1 + k % SPREAD, 0).astype(np.int32), n=n, k=k)

    return run


def _shared(batches: Iterator[pd.DataFrame], similarity: int = 0) -> Iterator[pd.DataFrame]:
    """The rows, once each, of shingles that two classes or more have, and of all frequent
    ones, from rows in order; a task holds one batch and one row.

    With a `similarity`, rows of a shingle come by size n, and one stays only if the next smaller
    or larger class is near enough in size; if these are not, no other is.
    """
    held, sent = None, False
    for frame in batches:
        rows = frame[["shingle", "part", "n", "k"] if similarity else ["shingle", "part", "k"]].to_numpy(np.int64)
        if not len(rows):
            continue
        if held is not None:
            rows = np.concatenate([held, rows])
        rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]]
        same = rows[1:, 0] == rows[:-1, 0]
        if similarity:
            same &= 100 * rows[:-1, 2] >= similarity * rows[1:, 2]
        keep = np.r_[False, same] | np.r_[same, False] | (rows[:, 1] > 0)
        if sent:  # the row that was held has been given out
            sent, keep[0] = bool(keep[-1]) or len(rows) == 1, False
        else:
            sent = bool(keep[-1])
        held = rows[-1:]
        if keep.any():
            yield pd.DataFrame({"shingle": rows[keep, 0], "k": rows[keep, -1]})


class Bitmaps:
    """Bitmaps of sets by their size.  Similar sets differ in size by less than a factor of
    two, so their bitmaps are of one size or the next; the larger ones are folded."""

    def __init__(self, n: np.ndarray, bits: list[bytes], similarity: int):
        self.n, self.similarity = n, similarity
        self.sizes = np.fromiter(map(len, bits), np.int64, len(bits))
        self.row, self.wide, self.slack = np.zeros(len(bits), np.int64), {}, np.zeros(len(bits), np.int64)
        for z in np.unique(self.sizes):
            at = np.flatnonzero(self.sizes == z)
            self.wide[int(z)] = own = np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), -1)
            self.row[at], self.slack[at] = np.arange(len(at)), n[at] - np.bitwise_count(own).sum(axis=1, dtype=np.int64)

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of sets can be similar: their sizes are in proportion, and the bits in
        common with what bitmaps can't tell reach the needed overlap."""
        swap = self.sizes[i] > self.sizes[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        x, y = self.n[i], self.n[j]
        found = 100 * np.minimum(x, y) >= self.similarity * np.maximum(x, y)
        need = -(-self.similarity * (x + y) // (100 + self.similarity))
        for z, own in self.wide.items():
            for times in (1, 2):
                at = np.flatnonzero(found & (self.sizes[i] == z) & (self.sizes[j] == times * z))
                step = max(1, AT_ONCE * 64 // int(z))
                for part in (at[k : k + step] for k in range(0, len(at), step)):
                    other = self.wide[times * z][self.row[j[part]]]
                    slack = self.slack[j[part]]
                    if times == 2:
                        other = folded(other)
                        slack = y[part] - np.bitwise_count(other).sum(axis=1, dtype=np.int64)
                    common = np.bitwise_count(own[self.row[i[part]]] & other).sum(axis=1, dtype=np.int64)
                    found[part] = common + np.minimum(self.slack[i[part]], slack) >= need[part]
        return found


def _leaf_pairs(starts: np.ndarray, sizes: np.ndarray, k: np.ndarray, n: np.ndarray, bits: np.ndarray, similarity: int) -> np.ndarray:
    """Pairs (k, other) of members of blocks of one leaf that can be similar, once each."""
    left, right = [], []
    for size in range(2, WHOLE_BLOCK + 1):
        own = starts[sizes == size]
        for i, j in zip(*np.triu_indices(size, 1)):
            left.append(own + i)
            right.append(own + j)
    left, right = np.concatenate(left), np.concatenate(right)
    fits = 100 * np.minimum(n[left], n[right]) >= similarity * np.maximum(n[left], n[right])
    names, first, which = np.unique(k, return_index=True, return_inverse=True)
    a, b = which[left[fits]], which[right[fits]]
    code = np.unique(np.minimum(a, b) * len(names) + np.maximum(a, b))
    a, b = code // len(names), code % len(names)
    used, place = np.unique(np.r_[a, b], return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    keep = Bitmaps(n[first[used]], list(bits[first[used]]), similarity).possible(a, b)
    return np.stack([names[used[a[keep]]], names[used[b[keep]]]], axis=1)


class Level:
    """Members of a block with bitmaps of one size."""

    def __init__(self, at: np.ndarray, bits: np.ndarray, block: Block):
        order = np.lexsort((bits[:, 0], block.group[at], block.n[at]))
        self.at, self.bits = at[order], bits[order]
        self.n, self.group = block.n[self.at], block.group[self.at]
        #: how many of a set its bitmap can't tell: not sampled, or of a bit that another one set
        self.slack = self.n - np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)

    def tree(self) -> Node:
        nodes = [Node(self, np.arange(k, min(k + LEAF, len(self.at)))) for k in range(0, len(self.at), LEAF)]
        while len(nodes) > 1:
            nodes = [Node(self, np.concatenate([x.own for x in nodes[k : k + FAN]]), nodes[k : k + FAN]) for k in range(0, len(nodes), FAN)]
        return nodes[0]


class Node:
    """Members under a combined bitmap, a size range and the greatest slack."""

    __slots__ = ("own", "bits", "low", "high", "slack", "group", "children")

    def __init__(self, level: Level, own: np.ndarray, children=()):
        self.own, self.children = own, children
        self.bits = np.bitwise_or.reduce(level.bits[own], axis=0)
        self.low, self.high, self.slack = level.n[own].min(), level.n[own].max(), level.slack[own].max()
        groups = level.group[own]
        self.group = groups[0] if (groups == groups[0]).all() else None


class Block:
    """The members of a block, by the size of their bitmaps.

    Similar sets differ in size by less than a factor of two, so their bitmaps are of
    one size or the next; the larger ones are folded for comparison.
    """

    def __init__(self, n: np.ndarray, bits: list[bytes], group: np.ndarray, similarity: int):
        self.n, self.group, self.similarity = n, group, similarity
        sizes = np.fromiter(map(len, bits), np.int64, len(bits))
        own = {int(z): np.flatnonzero(sizes == z) for z in np.unique(sizes)}
        wide = {z: np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), -1) for z, at in own.items()}
        self.levels = [(Level(at, wide[z], self), Level(own[2 * z], folded(wide[2 * z]), self) if 2 * z in own else None) for z, at in own.items()]

    def _need(self, n) -> np.ndarray:
        """Least overlap of two similar sets of `n` shingles together."""
        return -(-self.similarity * n // (100 + self.similarity))

    def beyond(self, a: Level, i: np.ndarray, b: Level, j: np.ndarray) -> np.ndarray:
        """How far the greatest possible overlap of pairs of members lies beyond the needed
        one; under 0 where they can't be similar."""
        x, y = a.n[i], b.n[j]
        common = np.bitwise_count(a.bits[i] & b.bits[j]).sum(axis=1, dtype=np.int64)
        fits = 100 * np.minimum(x, y) >= self.similarity * np.maximum(x, y)
        return np.where(fits, common + np.minimum(a.slack[i], b.slack[j]) - self._need(x + y), -1)

    def _meet(self, a: Node, b: Node) -> bool:
        """Whether some pair of two nodes can be similar: sizes in proportion, groups not
        one, and the bits in common with the slack reach what the least sizes need."""
        if 100 * min(a.high, b.high) < self.similarity * max(a.low, b.low):
            return False
        if a.group is not None and a.group == b.group:
            return False
        common = int(np.bitwise_count(a.bits & b.bits).sum())
        return common + min(a.slack, b.slack) >= self._need(a.low + b.low)

    def _traverse(self, a: Level, b: Level) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        todo = [(a.tree(), b.tree())] if a is not b else [(root := a.tree(), root)]
        while todo:
            x, y = todo.pop()
            if x.group is not None if x is y else not self._meet(x, y):
                continue
            if not x.children and not y.children:
                i, j = np.triu_indices(len(x.own), 1) if x is y else map(np.ravel, np.indices((len(x.own), len(y.own))))
                i, j = x.own[i], y.own[j]
                over = np.where(a.group[i] != b.group[j], self.beyond(a, i, b, j), -1)
                keep = over >= 0
                if keep.any():
                    yield a.at[i[keep]], b.at[j[keep]], over[keep]
            elif x is y:
                todo += [(u, v) for k, u in enumerate(x.children) for v in x.children[k:]]
            elif x.children and (not y.children or len(x.own) >= len(y.own)):
                todo += [(u, y) for u in x.children]
            else:
                todo += [(x, v) for v in y.children]

    def dual(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of members that can be similar and are of different groups, and how far
        beyond the needed overlap each may be."""
        for own, above in self.levels:
            yield from self._traverse(own, own)
            if above is not None:
                yield from self._traverse(own, above)

    def stars(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the most typical member with the others that can be similar, of the most
        typical that is left with the rest, and so on: no more pairs than members."""
        for own, above in self.levels:
            left, first = np.arange(len(own.at)), True
            while len(left) > 1 or (first and above is not None):
                bits = np.unpackbits(own.bits[left].view(np.uint8), axis=1)
                usual = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(left)).view(np.uint64)
                centre = left[np.bitwise_count(own.bits[left] ^ usual).sum(axis=1, dtype=np.int64).argmin()]
                if first and above is not None:
                    j = np.arange(len(above.at))
                    keep = self.beyond(own, np.full(len(j), centre), above, j) >= 0
                    yield np.full(int(keep.sum()), own.at[centre]), above.at[j[keep]]
                rest, first = left[left != centre], False
                keep = self.beyond(own, np.full(len(rest), centre), own, rest) >= 0
                yield np.full(int(keep.sum()), own.at[centre]), own.at[rest[keep]]
                left = rest[~keep]


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows sorted by shingle and part, in whole blocks, and where blocks begin and end."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        cuts = _cuts(frame)
        held = frame.iloc[cuts[-2] :] if len(cuts) > 1 else frame
        if len(cuts) > 2:
            yield frame.iloc[: cuts[-2]], cuts[:-1]
    if held is not None and len(held):
        yield held, _cuts(held)


def _digest(members: np.ndarray) -> bytes:
    """128 bits that tell the members of a block, so that a task remembers little of each."""
    return hashlib.blake2b(np.ascontiguousarray(members), digest_size=16).digest()


def _cuts(frame: pd.DataFrame) -> np.ndarray:
    keys = frame[["shingle", "x", "y"]].to_numpy(np.int64)
    return np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True]) if len(keys) else np.zeros(1, np.int64)


def _pair_frame(pairs: list[np.ndarray]) -> np.ndarray:
    """Pairs in order of their keys, once each."""
    both = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    return np.unique(np.sort(both, axis=1), axis=0)


def _first_round(similarity: int):
    """(shingle null, k, other, null): pairs that can be similar, all of a block of one leaf and
    stars of a larger one; (shingle, k, null, n): the members of larger and of split blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[bytes] = set()
        for frame, cuts in _blocks(batches):
            s, k, n, bits = frame["shingle"].to_numpy(), frame["k"].to_numpy(), frame["n"].to_numpy(np.int64), frame["bits"].to_numpy()
            split, guest = frame["x"].to_numpy() > 0, frame["guest"].to_numpy()
            starts, sizes = cuts[:-1], np.diff(cuts)
            pairs = [_leaf_pairs(starts, sizes, k, n, bits, similarity)]
            for a, b in zip(starts[sizes > WHOLE_BLOCK], cuts[1:][sizes > WHOLE_BLOCK]):
                if (own := _digest(k[a:b])) not in met:  # the same members give the same pairs
                    met.add(own)
                    block = Block(n[a:b], list(bits[a:b]), np.arange(b - a), similarity)
                    pairs += [np.stack([k[a + i], k[a + j]], axis=1) for i, j in block.stars() if len(i)]
            both = _pair_frame(pairs)
            if len(both):
                yield pd.DataFrame({"shingle": pd.array([None] * len(both), "Int64"), "k": both[:, 0], "other": pd.array(both[:, 1], "Int64"), "n": pd.array([None] * len(both), "Int32")})
            member = (np.repeat(sizes > WHOLE_BLOCK, sizes) | split) & ~guest
            if member.any():
                yield pd.DataFrame({"shingle": pd.array(s[member], "Int64"), "k": k[member], "other": pd.array([None] * int(member.sum()), "Int64"), "n": pd.array(n[member], "Int32")})

    return run


def _gathered(chunks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same rows in chunks of `PAIRS_AT_ONCE` or little more."""
    held, n = [], 0
    for chunk in chunks:
        held.append(chunk)
        n += len(chunk[0])
        if n >= PAIRS_AT_ONCE:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _likeliest(ends: np.ndarray, other: np.ndarray, over: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each end the row that lies furthest over, then of least key."""
    order = np.lexsort((k[other], -over, ends))
    order = order[np.r_[True, ends[order][1:] != ends[order][:-1]]]
    return ends[order], other[order], over[order]


def _found(pairs: list[np.ndarray], more: list[int]) -> pd.DataFrame:
    both, m = _pair_frame(pairs), len(more)
    n = len(both)
    return pd.DataFrame({
        "a": pd.array([*both[:, 0], *[None] * m], "Int64"), "b": pd.array([*both[:, 1], *[None] * m], "Int64"), "shingle": pd.array([*[None] * n, *more], "Int64"),
    })


def _later_round(similarity: int, nearest: bool):
    """Pairs (a, b) of a block's dual traversal between groups that are not yet connected.

    `nearest`: for each member the likeliest one only, and the shingle of each block that
    has more (a and b null); else all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[bytes] = set()
        for frame, cuts in _blocks(batches):
            s, k, n, bits, root = frame["shingle"].to_numpy(), frame["k"].to_numpy(), frame["n"].to_numpy(np.int64), frame["bits"].to_numpy(), frame["root"].to_numpy()
            pairs, more, held = [], [], 0
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a < 2 or (own := _digest(k[a:b])) in met:
                    continue
                met.add(own)
                best = (np.zeros(0, np.int64),) * 3
                for i, j, over in _gathered(Block(n[a:b], list(bits[a:b]), root[a:b], similarity).dual()):
                    if nearest:
                        best = _likeliest(np.r_[best[0], i, j], np.r_[best[1], j, i], np.r_[best[2], over, over], k[a:b])
                        continue
                    pairs.append(np.stack([k[a + i], k[a + j]], axis=1))
                    held += len(i)
                    if held >= PAIRS_AT_ONCE:
                        yield _found(pairs, more)
                        pairs, held = [], 0
                if len(best[0]):
                    pairs.append(np.stack([k[a + best[0]], k[a + best[1]]], axis=1))
                    more.append(s[a])
            if pairs:
                yield _found(pairs, more)

    return run


def _sift(similarity: int):
    """The pairs whose fine bitmaps allow similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = len(batch)
            maps = Bitmaps(np.r_[batch["xn"], batch["yn"]].astype(np.int64), [*batch["x"], *batch["y"]], similarity)
            yield batch.loc[maps.possible(np.arange(m), np.arange(m, 2 * m)), ["a", "b"]]

    return run


def _chosen(seed: int, words: int, shared, form):
    """(k, form of the set) of the documents that may be chosen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, met, keys, forms, held = batch.column("doc_id").cast(pa.int64()), set(), [], [], 0
            ids = pd.Series(pd.arrays.IntegerArray(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
            for may, text in zip(passes(shared.value, ids), _values(batch.column("text"))):
                if not may or not len(own := shingles(text, words)) or (k := set_key(own, seed)[0]) in met:
                    continue
                met.add(k)
                keys.append(k)
                forms.append(form(own).tobytes())
                held += len(forms[-1])
                if held >= OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(forms, pa.binary())], ["k", "form"])
                    keys, forms, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(forms, pa.binary())], ["k", "form"])

    return run


def _verify(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_values(batch.column("x")), _values(batch.column("y"))):
                x, y = x.view(np.int64), y.view(np.int64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _rich(own: np.ndarray) -> np.ndarray:
    return signature(own, RICH)


def _forms(rows: DataFrame, sets: DataFrame, keys: DataFrame, how: tuple, form) -> DataFrame:
    """(k, form of the set) of the classes `keys`, made again from a document of each.

    A bit table of bounded size finds these documents, so that no other text is moved.
    """
    seed, words, _ = how
    one_of = sets.join(keys, "k", "left_semi").groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    shared = rows.sparkSession.sparkContext.broadcast(bloom(stage(one_of, "chosen"), "doc_id"))
    made = rows.mapInArrow(_chosen(seed, words, shared, form), "k long, form binary")
    return made.join(keys, "k", "left_semi").dropDuplicates(["k"])


def _links(rows: DataFrame, sets: DataFrame, maps: DataFrame, pairs: DataFrame, how: tuple) -> DataFrame:
    """The pairs (a, b) whose sets are similar: fine bitmaps prune, and exact sets are
    counted for the pairs that are left."""
    fine = lambda k, x: maps.select(F.col("k").alias(k), F.col("n").alias(f"{x}n"), F.col("fine").alias(x))
    left = pairs.join(fine("a", "x"), "a").join(fine("b", "y"), "b").select("a", "b", "x", "xn", "y", "yn").mapInPandas(_sift(how[2]), "a long, b long")
    left = stage(left, "sifted")
    keys = left.select(F.col("a").alias("k")).unionByName(left.select(F.col("b").alias("k"))).distinct()
    own = stage(_forms(rows, sets, keys, how, np.asarray), "own")
    xs, ys = own.select(F.col("k").alias("a"), F.col("form").alias("x")), own.select(F.col("k").alias("b"), F.col("form").alias("y"))
    return stage(left.join(xs, "a").join(ys, "b").select("a", "b", "x", "y").mapInArrow(_verify(how[2]), "a long, b long"), "links")


def _small(df: DataFrame, tag: str) -> DataFrame:
    """A staged table, broadcast if it is of `BROADCAST_ROWS` at most."""
    df = stage(df, tag)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _parts(count: Column) -> Column:
    return F.ceil(count / BLOCK_ROWS).cast("int")


def _part_of(parts: Column) -> Column:
    return (1 + F.pmod(F.xxhash64("k"), parts)).cast("int")


def _dealt(blocks: DataFrame) -> DataFrame:
    """Rows of the first round: split blocks go to parts 1 and on by a hash, and two members
    of each such block are guests in every part, so that stars of all parts share centres."""
    counts = blocks.groupBy("shingle").agg(F.count(F.lit(1)).alias("n__s"), F.min("k").alias("c1"), F.max("k").alias("c2"))
    split = _small(counts.filter(F.col("n__s") > BLOCK_ROWS), "split")
    rows = blocks.join(split, "shingle", "left")
    parts, own = _parts(F.col("n__s")), _part_of(_parts(F.col("n__s")))
    to = F.when(F.col("n__s").isNull(), F.array(F.lit(0))).when(F.col("k").isin(F.col("c1"), F.col("c2")), F.sequence(F.lit(1), parts)).otherwise(F.array(own))
    rows = rows.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("x", F.explode(to))
    return rows.select("shingle", "x", F.lit(0).alias("y"), "k", (F.col("x") != F.col("own")).alias("guest"))


def _near_others(rows: DataFrame, similarity: int) -> DataFrame:
    """The rows (shingle, k, n, root) of whole blocks whose next smaller or larger one of another
    root is near enough in size; others are like none of another root."""
    found = rows
    for name, by in (("smaller", [F.col(c).asc() for c in ("n", "root", "k")]), ("larger", [F.col(c).desc() for c in ("n", "root", "k")])):
        w = Window.partitionBy("shingle").orderBy(*by)
        turn = F.when(F.lag("root").over(w) != F.col("root"), F.lag("n").over(w))
        so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = found.withColumn("turn", turn).withColumn(name, F.last("turn", ignorenulls=True).over(so_far))
    near = (100 * F.col("smaller") >= similarity * F.col("n")) | (100 * F.col("n") >= similarity * F.col("larger"))
    return found.filter(F.coalesce(near, F.lit(False))).select(*rows.columns)


def _open(members: DataFrame, roots: DataFrame, similarity: int) -> DataFrame:
    """Rows (shingle, x, y, k, root) of the blocks that hold more than one component; of those
    that are not split, members that can be similar to one of another component by size.

    Of a split block, the members of its most frequent component form parts and the others
    parts of their own; each pair of parts but two of that component is one task's.
    """
    rooted = members.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    each = rooted.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("m"))
    blocks = stage(each.groupBy("shingle").agg(F.sum("m").alias("all"), F.max_by("root", "m").alias("main"), F.max("m").alias("most"), F.count(F.lit(1)).alias("roots")).filter("roots > 1"), "mixed")
    split = _small(blocks.filter(F.col("all") > BLOCK_ROWS), "split")
    rest = rooted.join(split.select("shingle"), "shingle", "left_anti").join(blocks.select("shingle"), "shingle", "left_semi")
    rest = _near_others(rest.select("shingle", "k", "n", "root"), similarity).select("shingle", F.lit(0).alias("x"), F.lit(0).alias("y"), "k", "root")
    rows = rooted.join(split, "shingle")
    p, q = _parts(F.col("most")), _parts(F.col("all") - F.col("most"))
    rows = rows.withColumns({"p": p, "q": q, "is_main": F.col("root") == F.col("main")})
    pair = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    own_p, own_q = _part_of(F.col("p")), F.col("p") + _part_of(F.col("q"))
    with_others = F.transform(F.sequence(F.lit(1), F.col("q")), lambda j: pair(own_p, F.col("p") + j))
    with_main = F.transform(F.sequence(F.lit(1), F.col("p")), lambda i: pair(i, own_q))
    among = F.transform(F.sequence(F.lit(1), F.col("q")), lambda j: pair(F.least(own_q, F.col("p") + j), F.greatest(own_q, F.col("p") + j)))
    rows = rows.withColumn("to", F.explode(F.when(F.col("is_main"), with_others).otherwise(F.concat(with_main, among))))
    return rest.unionByName(rows.select("shingle", "to.x", "to.y", "k", "root"))


def _classes(docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """doc_id, text_hash, n, root of every row; rows of one root are one component, and rows
    without words have none."""
    spark = docs.sparkSession
    rows, seed = texts(docs), 0
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    while True:
        sets = stage(hashed.mapInArrow(_read_sets(seed, words, similarity), _SETS), "sets")
        if sets.groupBy("k").agg(F.min("k2").alias("a"), F.max("k2").alias("b")).filter("a <> b").isEmpty():
            break
        seed += 1
    counts = sets.select(F.explode("probe").alias("shingle")).groupBy("shingle").count().filter(F.col("count") >= FREQUENT)
    frequent = counts.orderBy(F.desc("count"), "shingle").limit(FREQUENT_AT_MOST).toArrow().to_pandas().sort_values("shingle")
    shared = spark.sparkContext.broadcast((frequent["shingle"].to_numpy(np.int64), frequent["count"].to_numpy(np.int64)))
    prefixes = rows.mapInArrow(_read_prefixes(seed, words, similarity, shared), _PREFIXES)
    order = ["shingle", "part", "n", "k"]
    blocks = stage(prefixes.repartition("shingle", "part").sortWithinPartitions(*order).mapInPandas(lambda frames: _shared(frames, similarity), "shingle long, k long"), "shared")
    maps = stage(sets.filter("n > 0").groupBy("k").agg(*[F.first(c).alias(c) for c in ("n", "bits", "fine")]), "maps")
    by_block = lambda df: df.repartition("shingle", "x", "y").sortWithinPartitions("shingle", "x", "y", "k")
    dealt = by_block(_dealt(blocks).join(maps.select("k", "n", "bits"), "k"))
    first = stage(dealt.mapInPandas(_first_round(similarity), "shingle long, k long, other long, n int"), "blocks")
    pairs = stage(first.filter("shingle is null").select(F.col("k").alias("a"), F.col("other").alias("b")).distinct(), "pairs")
    how = (seed, words, similarity)
    links = _links(rows, sets, maps, pairs, how)
    roots = stage(components(links), "roots")
    members, tried, rich = first.filter("shingle is not null").drop("other"), pairs, None
    for nearest in (True, False):
        again = stage(_open(members, roots, similarity), "open")
        if again.isEmpty():
            break
        if rich is None:  # later rounds look at no other class
            made = _forms(rows, sets, again.select("k").distinct(), how, _rich).withColumnRenamed("form", "bits")
            rich = stage(made.join(maps.select("k", "n"), "k"), "rich")
        found = by_block(again.join(rich, "k")).mapInPandas(_later_round(similarity, nearest), "a long, b long, shingle long")
        found = stage(found, "found")
        more = stage(found.filter("a is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        # blocks without any likely pair have none later
        members = members.join(found.filter("shingle is not null").select("shingle").distinct(), "shingle", "left_semi")
        if not more.isEmpty():
            links, tried = _links(rows, sets, maps, more, how), tried.unionByName(more)
            # a component so far is the star of its root
            roots = stage(components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")
    whole = sets.select("doc_id", "text_hash", "n", "k").join(roots.withColumnRenamed("node", "k"), "k", "left")
    return whole.select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.coalesce("root", "k")).alias("root"))


def similarity_classes(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents whose shingle sets are
    similar are linked, and a component has the smallest doc_id reachable by links.

    1. Sets are keyed; documents of one set are one class (a key that two different sets
       share makes the keys be drawn again).
    2. Shingles that the prefixes of many rows hold are counted and put last in the order.
    3. Rows of (prefix shingle, class) form blocks; copies of a class in a task count once, and
       shingles of one class only, and classes that no other of the shingle is near in size,
       fall away before bitmaps are joined to the rest.
    4. A first round tests the pairs of blocks of one leaf and takes stars of larger blocks;
       fine bitmaps prune the pairs, and the exact sets of those left decide.
    5. Two more rounds run the dual traversal of larger blocks, under rich bitmaps, between
       members that are not connected yet: first each member's likeliest pair, then all.
       Pairs within a component need no link, since they change no component.
    A block of more than `BLOCK_ROWS` members is split: in the first round by a hash, with two
    centres in common; later by pairs of parts, but for those of one component.

    Null or empty text has an empty set and links with nothing.  Null doc_id: it takes
    part and is passed over in the minimum; a component of such rows alone has a null id.
    Repeated rows are one class.  Empty table: no rows.  Columns other than doc_id and text,
    whatever their names, are not read.
    """
    whole = _classes(docs, words, similarity)
    least = whole.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return whole.join(least, "root", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """One document of each component, with its own columns: the one of smallest doc_id
    (null last), then least hash of its text.

    Rows that repeat a doc_id and text are one document, with the other columns of one of
    them.  Rows without words are linked with nothing and all stay.  Empty table: no rows.
    Columns may have any names but those that begin with near__.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f")
    kept = _classes(docs, words, similarity).filter("n > 0").groupBy("root").agg(first)
    kept = stage(kept.select(F.col("f.doc_id").alias("near__id"), F.col("f.text_hash").alias("near__hash")), "kept")
    rows = docs.withColumn("near__own", F.xxhash64(F.coalesce("text", F.lit(""))))
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = F.col("doc_id").eqNullSafe(F.col("near__id")) & (F.col("near__own") == F.col("near__hash"))
    chosen = rows.filter(~wordless).join(kept, same, "left_semi")
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        chosen = chosen.dropDuplicates(["doc_id", "near__own"])
    return chosen.unionByName(rows.filter(wordless)).select(*docs.columns)
