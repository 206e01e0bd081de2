"""Encoding of a corpus with a public byte-level BPE vocabulary, by a pair occurrence index over each batch's distinct pieces."""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie unless a caller names another folder.
TOKENIZERS = "/opt/tokenizers"

#: The public pattern that cuts text into pieces before any merge, and its form for pure ASCII text.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""

#: Distinct pieces that a Python worker remembers before it starts afresh; bounds its memory, not its result.
REMEMBERED = 400_000


def read_merges(path: str) -> tuple[list[int], dict[tuple[int, int], tuple[int, int]]]:
    """Ids of the 256 single bytes, and (left id, right id) -> (rank, merged id), of a tokenizers JSON file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    # The public byte alphabet: printable bytes stand for themselves, the rest follow from code point 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
    return [vocab[alphabet[b]] for b in range(256)], merges


def merge_pieces(pieces: list[bytes], single: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[list[int]]:
    """Token ids of each piece.

    All pieces lie in one array of symbols. An index holds, for each mergeable pair, its positions over all pieces, by
    rank; the least active rank is applied to its whole list, left to right, and the pairs that a merge makes join the lists.
    """
    ids: list[int] = []
    ends: list[int] = []
    for piece in pieces:
        ids.extend(map(single.__getitem__, piece))
        ends.append(len(ids))
        ids.append(-1)  # no pair spans two pieces
    after = list(range(1, len(ids) + 1))
    before = list(range(-1, len(ids) - 1))
    at: dict[int, list[int]] = {}
    active: list[int] = []

    def note(left: int, right: int, i: int) -> None:
        if (found := merges.get((left, right))) is not None:
            places = at.get(found[0])
            if places is None:
                at[found[0]] = [i]
                heapq.heappush(active, found[0])
            else:
                places.append(i)

    for i in range(len(ids) - 1):
        note(ids[i], ids[i + 1], i)
    while active:
        rank = heapq.heappop(active)
        for i in sorted(at.pop(rank)):
            j = after[i]
            if ids[i] < 0 or j >= len(ids):
                continue
            found = merges.get((ids[i], ids[j]))
            if found is None or found[0] != rank:
                continue  # an earlier merge took one of the two
            ids[i], ids[j] = found[1], -2
            after[i] = k = after[j]
            before[k] = i
            note(ids[i], ids[k], i)
            if before[i] >= 0:
                note(ids[before[i]], ids[i], before[i])
    out, start = [], 0
    for end in ends:
        out.append([x for x in ids[start:end] if x >= 0])
        start = end + 1
    return out


class PieceEncoder:
    """Encodes lists of texts; remembers the ids of pieces that it has met."""

    def __init__(self, single: list[int], merges: dict):
        self.single, self.merges = single, merges
        self.ascii, self.full = re.compile(ASCII_PIECES, re.ASCII), regex.compile(PIECES)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.values = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and the ids of all texts in a row. Null and empty texts have no ids."""
        if len(self.known) > REMEMBERED:
            self.forget()
        cut = [(self.ascii if t.isascii() else self.full).findall(t) if t else [] for t in texts]
        fresh = [p for p in dict.fromkeys(p for pieces in cut for p in pieces) if p not in self.known]
        if fresh:
            got = merge_pieces([p.encode("utf-8", "surrogatepass") for p in fresh], self.single, self.merges)
            for p in fresh:
                self.known[p] = len(self.known)
            self.values = np.concatenate([self.values, np.fromiter((x for g in got for x in g), np.int32)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(g) for g in got])])
        which = np.fromiter((self.known[p] for pieces in cut for p in pieces), np.int64)
        n = self.starts[which + 1] - self.starts[which]
        ends = np.cumsum(n)
        took = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[which] - (ends - n), n)
        per_text = np.cumsum([0, *map(len, cut)])
        offsets = np.concatenate([[0], ends])[per_text]
        return offsets, self.values[took]


def vocabulary_path(tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{tokenizer}.json")


def _vocabulary(df: DataFrame, path: str):
    """The merges as a broadcast: their number is fixed by the vocabulary file, whatever the corpus."""
    return df.sparkSession.sparkContext.broadcast(read_merges(path))


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Columns ``id_col`` and ``ids`` (array of int), a row for every row of ``df``.

    Null and empty texts have the empty array; special tokens are neither added nor recognised in a text; null and
    repeated ids stay as they are. Whole texts are encoded, in one pass without a shuffle. Other columns are not read.
    """
    vocabulary = _vocabulary(df, path or vocabulary_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(*vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                offsets, ids = encoder.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, prompts: bool = False) -> DataFrame:
    """Columns ``id_col`` and ``n_tokens`` (int), by the same encoder; the ids never leave the Python worker.

    With ``prompts``, also ``n_loss`` (int): the tokens beyond those of the first line, which an instruction's loss does not bear.
    """
    vocabulary = _vocabulary(df, path or vocabulary_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(*vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                n = np.diff(encoder.encode(texts)[0])
                out = [part.column(0), pa.array(n, pa.int32())]
                if prompts:
                    heads = np.diff(encoder.encode([t.split("\n", 1)[0] if t else None for t in texts])[0])
                    out.append(pa.array(np.maximum(0, n - heads), pa.int32()))
                yield pa.RecordBatch.from_arrays(out, names=["id", "n_tokens", "n_loss"][: len(out)])

    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, n_tokens int" + (", n_loss int" if prompts else "")).withColumnRenamed("id", id_col)
