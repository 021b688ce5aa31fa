"""Words within a few edits of each other, by segmented code blocks.

A word is cut into ``N_SEGMENTS`` segments of nearly equal length. Two edits touch two
segments at most, so at least two of four stand unchanged in the other word, moved by the
insertions and deletions before them. The code of a word is, for each two segments, the hash
of both and of the word's length; the other side is asked for the pieces of each length and
move that two edits allow. Half of the letters must agree in place, so that codes stay as rare as
words are. Words that share a code, and whose bit fingerprints (parity of each character)
differ in at most two bits per edit, are verified by their edit distance.
Segments of short words tell little: words of up to ``SHORT`` characters are
coded by what is left of them after up to two deletions instead, for two words
within two edits have such a rest in common.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.plans.skew import skew_join

N_SEGMENTS = 4
MAX_EDITS = 2
#: Words of up to SHORT characters meet by deletions; those of more than SHORT - MAX_EDITS also have segment codes.
SHORT = 8
_PAIRS = list(combinations(range(N_SEGMENTS), N_SEGMENTS - MAX_EDITS))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + _MIX[2]) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


#: An odd base and its inverse, so that a piece has one hash wherever it stands.
_BASE = 0x100000001B3
_BACK = pow(_BASE, -1, 2**64)


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def _moves() -> list[tuple[int, int, int, int]]:
    """(own length - asked length, number of two segments, move of the first, move of the second) that ``MAX_EDITS`` edits allow.

    An insertion counts to the segment of the character behind it, or to the last one at the end: so what
    stands before the first unchanged segment, between both and behind the second gives the moves, and
    nothing moves where no segment is left for the edits.
    """
    span = range(-MAX_EDITS, MAX_EDITS + 1)
    return [
        (more, k, s, t)
        for more in span
        for k, (i, j) in enumerate(_PAIRS)
        for s in span
        for t in span
        if abs(s) + abs(t - s) + abs(more - t) <= MAX_EDITS and (i > 0 or s == 0) and (j > i + 1 or s == t) and (j < N_SEGMENTS - 1 or t == more)
    ]


_MOVES = _moves()


def _segment_codes(letters: np.ndarray, asked: bool) -> np.ndarray:
    """Codes of words of one length (a row of hashed letters each): their own, or those of the words they ask for."""
    n = letters.shape[1]
    sums = np.zeros((len(letters), n + 1), np.uint64)
    np.cumsum(letters * _powers(n), axis=1, out=sums[:, 1:])
    back = _powers(n + 1, _BACK)
    pieces: dict[tuple[int, int], np.ndarray] = {}

    def piece(at: int, end: int) -> np.ndarray:
        if (at, end) not in pieces:
            pieces[at, end] = _mixed((sums[:, end] - sums[:, at]) * back[at])
        return pieces[at, end]

    out = []
    for more, k, s, t in _MOVES if asked else [(0, k, 0, 0) for k in range(len(_PAIRS))]:
        of = n - more
        (a, b), (c, d) = ((x * of // N_SEGMENTS, (x + 1) * of // N_SEGMENTS) for x in _PAIRS[k])
        if of > SHORT - MAX_EDITS and min(a + s, c + t) >= 0 and max(b + s, d + t) <= n:
            out.append(_mixed(_mixed(piece(a + s, b + s) + np.uint64(len(_PAIRS) * of + k)) ^ piece(c + t, d + t)))
    return np.stack(out, axis=1) if out else np.empty((len(letters), 0), np.uint64)


def code_words(words: list[str], asked: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bit fingerprint of each word, codes, the word of each code); two words within the edits share one of the one's ``asked`` codes and the other's own."""
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = _mixed(points)
    bits = np.zeros(len(words), np.uint64)
    np.bitwise_xor.at(bits, np.repeat(np.arange(len(words)), sizes), np.uint64(1) << (mixed >> np.uint64(58)))
    first, powers = np.cumsum(sizes) - sizes, _powers(SHORT)
    codes, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        letters = mixed[first[rows][:, None] + np.arange(n)]
        own = [_segment_codes(letters, asked)] if n > SHORT - MAX_EDITS else []
        if n <= SHORT:
            for gone in range(min(MAX_EDITS, n) + 1):
                kept = list(combinations(range(n), n - gone))
                keep = np.array(kept, np.int64).reshape(len(kept), n - gone)
                own.append((letters[:, keep] * powers[: n - gone]).sum(axis=2, dtype=np.uint64) + np.uint64(0xA5A5 + n - gone))
        held = np.concatenate(own, axis=1)
        codes.append(held.ravel())
        owners.append(np.repeat(rows, held.shape[1]))
    return bits, np.concatenate(codes), np.concatenate(owners)


def coded_words(words: DataFrame, asked: bool = False) -> DataFrame:
    """``code``, ``word``, ``bits``: one row per word and code; null words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                word = whole.column(0).slice(at, 2000)
                bits, codes, owner = code_words(word.to_pylist(), asked)
                row = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), word.take(row), pa.array(bits.view(np.int64)).take(row)], names=["code", "word", "bits"])

    return words.filter("word is not null").select("word").mapInArrow(run, "code bigint, word string, bits bigint")


def near_words(words: DataFrame, left: str, right: str, max_edits: int = MAX_EDITS) -> DataFrame:
    """``word``, ``other``, ``edits`` (1..max_edits) for words with flag ``left`` and others with flag ``right``.

    ``words`` has one row per distinct ``word`` with the two boolean flags. Every such pair
    comes out once; a null word matches nothing; an empty word is within two edits of
    words of up to two characters. At most ``MAX_EDITS`` edits are covered.
    """
    if not 1 <= max_edits <= MAX_EDITS:
        raise ValueError(f"max_edits must be 1..{MAX_EDITS}")
    a = coded_words(words.filter(left), asked=True).select("code", "word", F.col("bits").alias("bits_a"))
    b = coded_words(words.filter(right)).select("code", F.col("word").alias("other"), F.col("bits").alias("bits_b"))
    close = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= 2 * max_edits
    near = F.abs(F.length("word") - F.length("other")) <= max_edits
    met = skew_join(b, a, ["code"]).filter((F.col("word") != F.col("other")) & near & close)
    # a pair may share several codes
    once = met.select("word", "other").distinct()
    return once.withColumn("edits", F.levenshtein("word", "other", max_edits)).filter("edits > 0").select("word", "other", "edits")
