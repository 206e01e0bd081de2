"""Training the student encoder: hashed features of texts and of questions made from them, fitted to a teacher's vectors.

The fit runs on the driver on a bounded sample (a documented parameter); encoding and its evaluation run over all rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.errors import require
from skerry.functions import vector as V
from skerry.functions.text import GROUNDING_STOPWORDS
from skerry.operators import evaluate, knn
from skerry.operators.encode import hashed_features

#: Texts to fit on at most.
MOST_TEXTS = 20_000


def variants(text: str, rng: np.random.Generator) -> list[str]:
    """Questions that a text could answer: a sentence of it, some of its content words, these with one dropped, and with a slip of the pen."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if len(s.split()) >= 3]
    words = [w for w in dict.fromkeys(re.findall(r"\w+", text.lower())) if len(w) >= 4 and w not in GROUNDING_STOPWORDS]
    out = [sentences[rng.integers(len(sentences))]] if sentences else []
    if len(words) >= 3:
        size = min(len(words), 5)
        start = int(rng.integers(len(words) - size + 1))
        some = words[start : start + size]
        gone = int(rng.integers(size))
        out += [" ".join(some), " ".join(w for i, w in enumerate(some) if i != gone), " ".join(slip(w, rng) if i == gone else w for i, w in enumerate(some))]
    return out


def slip(word: str, rng: np.random.Generator) -> str:
    """A word with two neighbouring letters swapped, one lost or one doubled."""
    if len(word) < 4:
        return word
    i = int(rng.integers(1, len(word) - 2))
    return (word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:])[int(rng.integers(3))]


def fit_student(texts: list[str], teacher: np.ndarray, places: int = 1 << 15, hidden: int = 128, epochs: int = 10, batch: int = 128, rate: float = 0.05, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(embedding, projection) of :func:`skerry.operators.encode.student`, by Adagrad on one less the cosine to the teacher's vectors.

    A text trains with its own vector, and so does one question of it, drawn anew in each round.
    """
    rng = np.random.default_rng(seed)
    embedding = rng.normal(scale=0.3, size=(places, hidden))
    projection = rng.normal(scale=hidden**-0.5, size=(hidden, teacher.shape[1]))
    seen_e, seen_p = np.full((places, 1), 1e-6), np.full(projection.shape, 1e-6)
    goal = teacher / np.maximum(np.linalg.norm(teacher, axis=1, keepdims=True), 1e-12)
    own = [hashed_features(t or "", places) for t in texts]
    for _ in range(epochs):
        asked = [hashed_features(v[rng.integers(len(v))], places) if (v := variants(t or "", rng)) else own[i] for i, t in enumerate(texts)]
        order = rng.permutation(2 * len(texts))
        for begin in range(0, len(order), batch):
            some = [(i % len(texts), (own if i < len(texts) else asked)[i % len(texts)]) for i in order[begin : begin + batch]]
            some = [(i, f) for i, f in some if len(f)]
            if not some:
                continue
            flat = np.concatenate([f for _, f in some])
            sizes = np.array([len(f) for _, f in some])
            line = np.repeat(np.arange(len(some)), sizes)
            state = np.tanh(np.add.reduceat(embedding[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None])
            y = state @ projection
            length = np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
            u, v = y / length, goal[[i for i, _ in some]]
            dy = -(v - (u * v).sum(1, keepdims=True) * u) / length / len(some)
            dp, dh = state.T @ dy, (dy @ projection.T) * (1 - state**2) / sizes[:, None]
            seen_p += dp**2
            projection -= rate * dp / np.sqrt(seen_p)
            kinds, at = np.unique(flat, return_inverse=True)
            de = np.zeros((len(kinds), hidden))
            np.add.at(de, at, dh[line])
            seen_e[kinds] += (de**2).mean(1, keepdims=True)
            embedding[kinds] -= rate * de / np.sqrt(seen_e[kinds])
    return embedding.astype(np.float32), projection.astype(np.float32)


def train_student(records: DataFrame, text_col: str, vector_col: str, most: int = MOST_TEXTS, **options) -> tuple[np.ndarray, np.ndarray]:
    """:func:`fit_student` on at most ``most`` records, by a hash of their text."""
    require(0 < most <= MOST_TEXTS, f"1 to {MOST_TEXTS} texts")
    held = records.where(F.col(text_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(text_col).alias("text"), V.doubles(F.col(vector_col)).alias("vector"))
    rows = held.orderBy(F.xxhash64("text"), "text").limit(most).toArrow()
    require(rows.num_rows > 0, "no records to train on")
    return fit_student(rows.column("text").to_pylist(), np.array(rows.column("vector").to_pylist()), **options)


def neighbour_overlap(student: DataFrame, teacher: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """One row ``recall``: of the teacher's k nearest records of each asked one, the share that the student has among its own k.

    ``student`` and ``teacher`` have record_id, vector; ``asked`` record_id.
    """

    def near(vectors: DataFrame) -> DataFrame:
        rows = vectors.select(F.col("record_id").cast("long"), V.normalized(V.doubles(F.col("vector"))).alias("vector"))
        dim = len(rows.first()["vector"])
        return knn.exact_knn(rows.join(asked.select("record_id"), "record_id", "left_semi").withColumnRenamed("record_id", "query_id"), rows, k, dim, skip_self=True)

    return evaluate.recall_at(near(student), near(teacher).select("query_id", "record_id"))
