"""Encoders of text that need no model weights here: hashed features with a linear head, and WordPiece."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import tokens


def hashed_features(text: str, places: int) -> np.ndarray:
    """Places of a text's words, pairs of words, and runs of 3 to 5 characters within words."""
    words = [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() if w]
    grams = [f"w:{w}" for w in words] + [f"b:{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    for w in words:
        marked = f"<{w}>"
        grams += [f"c:{marked[i : i + n]}" for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
    return np.array([xxhash.xxh3_64_intdigest(g) % places for g in grams], np.int64)


def student(embedding: np.ndarray, projection: np.ndarray) -> Callable[[list[str]], np.ndarray]:
    """An encoder from trained tables: mean of the features' rows, tanh, projection, length 1. No words give zeros."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), projection.shape[1]), np.float32)
        for i, text in enumerate(texts):
            at = hashed_features(text or "", len(embedding))
            if len(at):
                v = np.tanh(embedding[at].mean(0)) @ projection
                out[i] = v / max(np.linalg.norm(v), 1e-12)
        return out

    return encode


def hash_vectors(df: DataFrame, text_col: str, dims: int, decimals: int = 9, vector_col: str = "vector") -> DataFrame:
    """``df`` with each text's vector without a model, as :func:`skerry.functions.vector.hash_embedding` has it, in Arrow batches.

    A word's place and weight are looked up once a worker; components are rounded, so that equal texts tie whatever the order of addition.
    """
    remembered = 400_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}

        def place(word: str) -> tuple[int, float]:
            found = known.get(word)
            if found is None:
                if len(known) > remembered:
                    known.clear()
                digest = hashlib.sha256(word.encode("utf-8", "surrogatepass")).digest()
                found = known[word] = (int.from_bytes(digest[:4], "little") % dims, digest[4] / 255 * 2 - 1)
            return found

        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            sizes = np.array([len(words or ()) for words in lists], np.int64)
            pairs = [place(w) for words in lists for w in words or ()]
            at = np.repeat(np.arange(len(lists)), sizes) * dims + np.fromiter((i for i, _ in pairs), np.int64, len(pairs))
            v = np.bincount(at, np.fromiter((x for _, x in pairs), np.float64, len(pairs)), minlength=len(lists) * dims).reshape(-1, dims)
            length = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.round(v / np.where(length > 0, length, 1), decimals) + 0.0
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dims, pa.int32()), pa.array(v.reshape(-1)))
            kept = [i for i, name in enumerate(batch.schema.names) if name != text_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), vectors], names=[*(batch.schema.names[i] for i in kept), vector_col])

    # Words are cut in the JVM; the text itself does not go to Python.
    worded = df.withColumn(text_col, tokens(F.lower(text_col)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text_col)
    return worded.mapInArrow(run, f"{fields}, `{vector_col}` array<double>")


def encode_column(df: DataFrame, text_col: str, encode: Callable[[list[str]], np.ndarray], vector_col: str = "vector") -> DataFrame:
    """``df`` with the vector of each text, in Arrow batches; any encoder of lists of texts may be plugged in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            v = encode(batch.column(at).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.reshape(-1).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, vector_col])

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(vector_col, T.ArrayType(T.FloatType()))])
    return df.mapInArrow(run, schema)


def encode_words(df: DataFrame, words_col: str, encode: Callable[[list[str]], np.ndarray], vectors_col: str = "vectors") -> DataFrame:
    """``df`` with a vector for each word of an array of words: all distinct words of a batch are encoded in one call. Null gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(words_col)).to_pylist()
            known = {w: i for i, w in enumerate(dict.fromkeys(w for words in lists for w in words or ()))}
            found = encode(list(known)) if known else None
            out = [None if words is None else [found[known[w]].tolist() for w in words] for words in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.list_(pa.float32())))], names=[*batch.schema.names, vectors_col])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(vectors_col, T.ArrayType(T.ArrayType(T.FloatType())))]))


def in_windows(encode: Callable[[list[str]], np.ndarray], size: int) -> Callable[[list[str]], np.ndarray]:
    """An encoder of texts of any length from one of at most ``size`` words: the mean over a text's windows, of length 1."""

    def whole(texts: list[str]) -> np.ndarray:
        words = [(t or "").split() for t in texts]
        parts = [" ".join(w[i : i + size]) for w in words for i in range(0, max(1, len(w)), size)]
        counts = np.array([len(range(0, max(1, len(w)), size)) for w in words])
        vectors = encode(parts)
        means = np.add.reduceat(vectors, np.cumsum(counts) - counts, axis=0) / counts[:, None] if len(parts) else np.zeros((0, 1), np.float32)
        length = np.linalg.norm(means, axis=1, keepdims=True)
        return means / np.where(length > 0, length, 1)

    return whole


def word_pieces(text: str, vocabulary: dict[str, int], unknown: str = "[UNK]", longest: int = 100) -> list[int]:
    """Ids by greedy longest match within words; lower case, accents off, punctuation by itself."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    apart = "".join(f" {c} " if unicodedata.category(c)[0] in "PS" else c for c in plain)
    out = []
    for word in apart.split():
        pieces, at = [], 0
        while at < len(word) and len(word) <= longest:
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
            if end is None:
                break
            pieces.append(vocabulary[("##" if at else "") + word[at:end]])
            at = end
        out += pieces if at == len(word) else [vocabulary[unknown]]
    return out


def conformance(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """``<key>, worst, passed``: the greatest difference of any component against a tolerance. ``expected`` has vector, tolerance."""
    both = found.select(key, F.col("vector").alias("got")).join(expected.select(key, "vector", "tolerance"), key)
    worst = F.array_max(F.zip_with("got", "vector", lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    return both.select(key, worst.alias("worst"), F.coalesce((F.size("got") == F.size("vector")) & (worst <= F.col("tolerance")), F.lit(False)).alias("passed"))
