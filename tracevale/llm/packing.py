"""Packing of tokenised documents into sequences by best-fit decreasing.

A document is its tokens and an end id. Documents of more than `window` tokens are first cut into full windows and a rest.
Pieces go, longest first, to the open sequence with the least room that still holds them; a segment tree over the
remaining room finds it. Pieces are numbered as they are written out, and packed in groups of about GROUP_PIECES that are
dealt out by a hash of the numbers, so that no repeated row makes a group large; only lengths are dealt out, never tokens
or texts.

Defined cases: a null text is an empty one, and still has its end id; rows that share a doc_id, or have none, are packed
each for itself. Other columns aren't read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

#: Pieces of a group, on average, and sequence ids set apart for each group.
GROUP_PIECES, SPACING = 50_000, 800_000

#: Fixed value: the vocabulary's pattern without what only matters in a run of white space, which needs no look-ahead.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: Fixed value: runs of the pattern's white space that are encoded apart, as its look-ahead needs stack for each character.
LONG_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


class Encoder:
    """Ids of a text as little-endian 32-bit bytes, from a vocabulary of ranks for tiktoken.

    `added` tokens are found inside a text, as `tokenizers` finds them; the names of others are ordinary text. A text
    without runs of white space takes the faster pattern. A long run of white space is a token run of its own, but for its
    last character where more text follows, which goes with that text.
    """

    def __init__(self, path: str, added: tuple[tuple[str, int], ...] = ()):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        self.added = dict(added)
        self.split = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})" if added else "(?!)").split
        self.runs = re.compile(r"\s\s").search
        self.fast, self.full = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens=dict(added)) for p in (PATTERN, public_tokenizers.PATTERN))

    def __call__(self, text: str) -> bytes:
        if LONG_WHITE.search(text):
            parts = (array("I", [self.added[t]]) if t in self.added else self._cut(t) for t in self.split(text))
            return b"".join(x.tobytes() for x in parts)
        return self._whole(text).tobytes()

    def _cut(self, text: str) -> array:
        """Ids of a text without added tokens, long runs of white space apart from the rest."""
        out, at = array("I"), 0
        for run in LONG_WHITE.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self._whole(text[at : run.start()])
            out += array("I", self.fast.encode_ordinary(text[run.start() : end]))
            at = end
        return out + self._whole(text[at:])

    def _whole(self, text: str) -> array:
        by = self.full if self.runs(text) else self.fast
        return array("I", by.encode(text, allowed_special="all") if any(t in text for t in self.added) else by.encode_ordinary(text))


@lru_cache(1)
def encoder(path: str, added: tuple[tuple[str, int], ...]) -> Encoder:
    return Encoder(path, added)


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """(token, id) of the added tokens of a tokenizer's JSON file."""
    with open(path, "rb") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError(f"{path}: added tokens that take what stands around them aren't known here")
    return tuple((t["content"], t["id"]) for t in tokens)


class Room:
    """A segment tree over the remaining room of sequences: its leaves count the open sequences with so much room."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, sequence) with the least room of at least `least`."""
        i, count = least + self.size, self.count
        while not count[i]:
            while i & 1:  # a right child: nothing of this node's parent lies beyond it
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        self._count(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For pieces sorted by falling length: the sequence of each, from 0, and its offset there."""
    room, sequence, offset, n = Room(window), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, length in enumerate(lengths.tolist()):
        found = room.take(length)
        if found:
            left, s = found
        else:
            left, s, n = window, n, n + 1
        sequence[i], offset[i] = s, window - left
        if left > length:
            room.add(left - length, s)
    return sequence, offset


def pieces(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows of each document and its rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, added), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = (encode(text.as_py()) if text.is_valid else b"") + end
                n = len(ids) // 4
                for at in range(0, n, window):
                    part = ids[4 * at : 4 * (at + window)]
                    for column, x in zip(out, (doc_id.as_py(), at, len(part) // 4, zlib.crc32(part), n), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """The columns of `pieces`, sequence_id and offset."""
    parts = materialize(pieces(docs, tokenizer, window, end_id, added).withColumn("no", F.monotonically_increasing_id()))
    groups = max(1, -(-parts.count() // GROUP_PIECES))
    parts = parts.withColumn("group", F.pmod(F.xxhash64("no"), F.lit(groups)).cast("long"))

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = best_fit(t["length"].to_numpy(), window)
        first = t["group"][0].as_py() * SPACING if t.num_rows else 0
        if t.num_rows > SPACING:  # groups are dealt by a hash of distinct numbers, so none comes near it
            raise ValueError("a group has more pieces than there are sequence ids for it")
        return t.drop_columns(["group", "no"]).append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))

    return parts.groupBy("group").applyInArrow(fit, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
