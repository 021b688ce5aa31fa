"""Encoding texts with a public byte-level BPE vocabulary.

No merge can join two bytes that stand side by side in no token of the vocabulary, so
such a byte pair marks a certain cut (forced boundary). Every cut that also leaves the
splitting pattern unchanged is taken. The fragments between cuts are independent, so
each distinct fragment of a batch is encoded once and the ids of all its places are
gathered from there; a worker keeps the fragments it has met. The ids of a text are those
of its fragments one after the other.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file (token bytes in base64 and rank, one a line); a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker forgets its fragments beyond this many held bytes and ids, and encodes them anew when met again.
HELD = 32_000_000


def joined_pairs(tokens: list[bytes]) -> np.ndarray:
    """256 x 256 table: may byte b follow byte a inside some token."""
    inside = np.zeros((256, 256), bool)
    for token in tokens:
        held = np.frombuffer(token, np.uint8)
        inside[held[:-1], held[1:]] = True
    return inside


def certain_cuts(inside: np.ndarray) -> np.ndarray:
    """256 x 256 table of the byte pairs between which a text may be cut.

    Besides the forced boundary, the pattern must match either side as it does the
    whole: the byte on the left is ASCII and no white space (a run of white space is
    split by what follows it), the one on the right is ASCII white space, a letter or a
    digit (a mark may begin a contraction).
    """
    code = np.arange(256)
    space = ((code >= 9) & (code <= 13)) | (code == 32)
    left = (code < 128) & ~space
    word = ((code >= 48) & (code <= 57)) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))
    return ~inside & left[:, None] & (space | word)[None, :]


class FragmentEncoder:
    """Encoder of whole Arrow batches of texts."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._plain = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._cut = certain_cuts(joined_pairs(list(ranks))).ravel()
        self._known: dict[bytes, np.ndarray] = {}
        self._held = 0

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return self.encode_batch(pa.array([text], pa.string()))[0].as_py()

    def fragments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(the fragments between certain cuts, number of the first fragment of each text and of the end)."""
        texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])  # one buffer from its beginning
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        cut = np.flatnonzero(self._cut[(held[:-1].astype(np.uint16) << 8) | held[1:]]) + 1 + offsets[0] if len(held) > 1 else np.empty(0, np.int64)
        edges = np.unique(np.concatenate([cut, offsets]))
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), data])
        return parts, np.searchsorted(edges, offsets)

    def _ids_of(self, fragment: bytes) -> np.ndarray:
        ids = self._known.get(fragment)
        if ids is None:
            ids = np.array(self._plain.encode_ordinary(fragment.decode("utf-8")), np.int32)
            if self._held > HELD:
                self._known, self._held = {}, 0
            self._known[fragment] = ids
            self._held += len(fragment) + ids.nbytes + 200
        return ids

    def _coded(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(ids of each distinct fragment, the distinct fragment at each place, first place of each text and the end)."""
        parts, first = self.fragments(texts)
        coded = parts.dictionary_encode()
        return [self._ids_of(x) for x in coded.dictionary.to_pylist()], coded.indices.to_numpy(), first

    def encode_batch(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; a null or empty text has none."""
        distinct, place, first = self._coded(texts)
        if not distinct:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1), pa.int32()), pa.array([], pa.int32()))
        sizes = np.array([len(x) for x in distinct], np.int64)
        starts, own = np.cumsum(sizes) - sizes, sizes[place]
        ends = np.concatenate([[0], np.cumsum(own)])
        # position of each id in the joined ids of the distinct fragments
        at = np.repeat(starts[place] - ends[:-1], own) + np.arange(ends[-1])
        return pa.ListArray.from_arrays(pa.array(ends[first], pa.int32()), pa.array(np.concatenate(distinct)[at]))

    def count_batch(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        distinct, place, first = self._coded(texts)
        sizes = np.array([len(x) for x in distinct], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes[place])]) if distinct else np.zeros(1, np.int64)
        return np.diff(ends[first])


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> FragmentEncoder:
    """One encoder per worker process and vocabulary."""
    return FragmentEncoder(vocabulary)


def encode_texts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``ids`` of every document, without special tokens.

    Empty and null texts have an empty list; a null doc_id stays; repeated rows come out
    each; an empty table gives no rows; other columns are ignored. Nothing is shuffled
    and no text is shortened.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), own.encode_batch(part.column(1))], schema=schema)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``n_tokens`` of every document, counted by fragments: no list of ids is made."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.count_batch(part.column(1)), pa.int64())], schema=schema)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")
