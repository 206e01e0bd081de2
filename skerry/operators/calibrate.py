"""Calibrating match quality: questions made from records, a logistic fit of their signals, and thresholds."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.errors import require
from skerry.functions.text import GROUNDING_STOPWORDS
from skerry.operators import knn

#: Forms of a question about a title and about words, and the two constants of the sampling sequence.
TEMPLATES = (
    "what is {}", "tell me about {}", "{} explained", "facts about {}", "information about {}", "overview of {}", "history of {}", "definition of {}",
    "who is {}", "where is {}", "why is {} important", "how does {} work",
)
FRAMES = ("{}", "what is known about {}", "which {}", "is anything said about {}")
STEP, SHIFT = 1664525, 1013904223

#: The share of records that whole documents are held out for, and the least and most titles of that.
HELD_SHARE, HELD_LEAST, HELD_MOST = 0.12, 2, 12

#: Words that no question is made of: the stop words of grounding without those that questions are framed with.
PLAIN_STOPWORDS = GROUNDING_STOPWORDS[: GROUNDING_STOPWORDS.index("without") + 1]

#: Questions that are made at most; they are sampled on the driver.
MOST_QUESTIONS = 10_000


class Sequence:
    """The linear congruential sequence modulo 2**32; the same in every run."""

    def __init__(self, seed: int):
        self.state = seed % 2**32

    def __call__(self) -> float:
        """The next number, from 0 to 1."""
        self.state = (self.state * STEP + SHIFT) % 2**32
        return self.state / (2**32 - 1)

    def below(self, n: int) -> int:
        return int(self() * n)


def sequence(seed: int, n: int) -> list[int]:
    """The first n numbers of the sequence."""
    draw, out = Sequence(seed), []
    for _ in range(n):
        draw()
        out.append(draw.state)
    return out


def sampled(size: int, n: int, seed: int) -> list[int]:
    """Up to n different places below ``size``, in the order in which the sequence draws them."""
    draw, out = Sequence(seed), {}
    while len(out) < min(n, size):
        out.setdefault(min(size - 1, draw.below(size)))
    return list(out)


def _at_places(df: DataFrame, order_col: str, places: list[int]) -> list:
    """The rows at some places of an order; only they are collected."""
    numbered = knn.dense_ids(df, order_col, "_place")
    spark = df.sparkSession
    wanted = spark.createDataFrame([(p, i) for i, p in enumerate(places)], "_place long, _nth long")
    return numbered.join(F.broadcast(wanted), "_place").orderBy("_nth").collect()  # MOST_QUESTIONS rows at most


def title_questions(records: DataFrame, title_col: str, n: int, seed: int) -> DataFrame:
    """``text, source_title``: up to n questions about titles that the sequence draws, each in one of the fixed forms or several."""
    require(0 < n <= MOST_QUESTIONS, f"1 to {MOST_QUESTIONS} questions")
    titles = records.select(F.trim(title_col).alias("title")).where("title <> ''").distinct()
    count = titles.count()
    each = min(len(TEMPLATES), max(1, n // max(1, count)))
    out: dict[str, str] = {}
    for i, row in enumerate(_at_places(titles, "title", sampled(count, n, seed))):
        for j in range(each):
            out.setdefault(TEMPLATES[(i + j) % len(TEMPLATES)].replace("{}", row["title"].lower()), row["title"])
    return records.sparkSession.createDataFrame(list(out.items())[:n], "text string, source_title string")


def content_questions(records: DataFrame, id_col: str, text_col: str, n: int, seed: int) -> DataFrame:
    """``text, source_id``: up to n questions of three to five neighbouring content words of records that the sequence draws, in turning frames."""
    require(0 < n <= MOST_QUESTIONS, f"1 to {MOST_QUESTIONS} questions")
    held = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    draw, out, frame = Sequence(seed), {}, 0
    for row in _at_places(held, "id", sampled(held.count(), min(2 * n, MOST_QUESTIONS), seed ^ 0x77AA11)):
        words = list(dict.fromkeys(w for w in re.findall("[a-z0-9']+", (row["text"] or "").lower()) if len(w) >= 4 and w not in PLAIN_STOPWORDS))
        if len(words) < 3 or len(out) >= n:
            continue
        size = min(3 + draw.below(3), len(words))
        start = min(draw.below(max(1, len(words) - size)), len(words) - size)
        text = FRAMES[frame % len(FRAMES)].replace("{}", " ".join(words[start : start + size]))
        frame += 1
        out.setdefault(text, row["id"])
    return records.sparkSession.createDataFrame([(t, int(i)) for t, i in out.items()], "text string, source_id long")


def held_out_titles(records: DataFrame, title_col: str, seed: int) -> DataFrame:
    """``title``: whole documents to hold out, drawn until they cover :data:`HELD_SHARE` of the records; none of fewer than three titles."""
    titled = records.select(F.trim(title_col).alias("title")).where("title <> ''").groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    count, total = titled.count(), records.count()
    out, covered = [], 0
    for row in _at_places(titled, "title", sampled(count, HELD_MOST, seed)) if count > 2 else []:
        if count - len(out) <= 2 or (covered >= max(1, round(total * HELD_SHARE)) and len(out) >= HELD_LEAST):
            break
        out.append((row["title"],))
        covered += row["n"]
    return records.sparkSession.createDataFrame(out, "title string")


def shuffled_letters(text: Column) -> Column:
    """A negative without sense: each word backwards."""
    return F.array_join(F.transform(F.split(text, " "), F.reverse), " ")


#: Pairs of words that the noise is taken from, its percentile, how what is above it is damped, and what a heading's word is worth.
NOISE_PAIRS, NOISE_SHARE, DAMPING, HEADING_WORTH = 400, 0.95, 3, 0.5


def noise_level(words: list[str], vectors: np.ndarray, seed: int) -> float:
    """The similarity that unrelated words reach by chance: a high percentile over drawn pairs, words of one beginning left out.

    ``words`` are a bounded sample of a vocabulary, ``vectors`` theirs, of length 1.
    """
    if len(words) < 2:
        return 0.0
    draw, found = Sequence(seed), []
    wanted = min(NOISE_PAIRS, len(words) * (len(words) - 1) // 2)
    for _ in range(20 * wanted):
        i, j = (min(len(words) - 1, draw.below(len(words))) for _ in range(2))
        a, b = words[i], words[(j + 1) % len(words) if i == j else j]
        if len(found) < wanted and not (a.startswith(b) or b.startswith(a)):
            found.append(float(vectors[i] @ vectors[(j + 1) % len(words) if i == j else j]))
    return sorted(found)[min(len(found) - 1, int(len(found) * NOISE_SHARE))] if found else 0.0


def word_similarity(queries: DataFrame, passages: DataFrame, noise: float = 0.0) -> DataFrame:
    """``query_id, max_sim``: how well a query's best passage has its words by meaning, above the noise; 1 if it has all.

    ``queries`` (query_id, passage_id, words, and weights if they differ), ``passages`` (passage_id, words, and heading if there is one): arrays
    of vectors of length 1. A word counts by its best cosine to the body's words, or to half of the heading's. Both sides of a pair
    are bounded by the words of one question and one passage.
    """
    cosine = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    best = lambda q, c: F.coalesce(F.array_max(F.transform(c, lambda p: cosine(q, p))), F.lit(0.0))
    theirs = passages.select("passage_id", F.col("words").alias("body"), (F.col("heading") if "heading" in passages.columns else F.array().cast("array<array<double>>")).alias("head"))
    each = queries if "weights" in queries.columns else queries.withColumn("weights", F.transform("words", lambda w: F.lit(1.0)))
    both = each.join(theirs, "passage_id").where("size(words) > 0 and size(body) + size(head) > 0")
    above = lambda s: F.lit(0.0) if noise >= 1 else F.pow(F.greatest(F.lit(0.0), (s - noise) / (1 - noise)), F.lit(float(DAMPING)))
    sims = F.zip_with("words", "weights", lambda q, w: w * above(F.greatest(best(q, F.col("body")), best(q, F.col("head")) * HEADING_WORTH)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return both.select("query_id", (total(sims) / total("weights")).alias("sim")).groupBy("query_id").agg(F.max("sim").alias("max_sim"))


@dataclass
class Verdict:
    """A logistic model of standardised features, and the probabilities below which a match is none (``hard``) or weak (``weak``)."""

    features: list[str]
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float
    hard: float
    weak: float


#: Shares of the negatives and positives at which the thresholds stand, the greatest ``hard``, and the least band above it.
OFF_TOPIC, ON_TOPIC, MOST_HARD, LEAST_BAND, MOST_WEAK = 0.95, 0.05, 0.5, 0.08, 0.95


def thresholds(positives: np.ndarray, negatives: np.ndarray) -> tuple[float, float]:
    """(hard, weak): nearly all negatives lie below ``hard``, which a fit that separates too well does not raise above its bound; ``weak``
    stands below nearly all positives, above the negatives as far as the middle positive allows."""
    at = lambda values, share: float(np.sort(values)[min(len(values) - 1, int(share * len(values)))])
    ceiling, floor = at(negatives, OFF_TOPIC), at(positives, ON_TOPIC)
    hard = min(ceiling, MOST_HARD)
    weak = min(max(floor * 0.9, ceiling, hard), max(at(positives, 0.5), hard))
    return hard, min(MOST_WEAK, max(weak, hard + LEAST_BAND))


def fit_verdict(examples: DataFrame, features: list[str], label_col: str, most: int = 50_000, epochs: int = 4000, rate: float = 0.1, penalty: float = 1e-3) -> Verdict:
    """Fit on at most ``most`` examples (a documented bound, by hash), each class weighing alike; thresholds as of :func:`thresholds`."""
    kept = examples.select(*features, label_col).dropna().orderBy(F.xxhash64(*features)).limit(most).toPandas()
    y = kept[label_col].to_numpy(float)
    require(len(set(y)) == 2, "examples of both classes are needed")
    raw = kept[features].to_numpy(float)
    mean, scale = raw.mean(0), np.where(raw.std(0) > 1e-12, raw.std(0), 1.0)
    x = (raw - mean) / scale
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(len(features)), 0.0
    for _ in range(epochs):
        gap = each * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w -= rate * (x.T @ gap + penalty * w)
        b -= rate * gap.sum()
    p = 1 / (1 + np.exp(-(x @ w + b)))
    return Verdict(features, mean.tolist(), scale.tolist(), w.tolist(), float(b), *thresholds(p[y == 1], p[y == 0]))


def student_features(questions: DataFrame, known_words: DataFrame, known_runs: DataFrame) -> DataFrame:
    """``query_id, known_words, known_runs``: shares of a question's words, and of its words' runs of three characters, that training saw.

    Both vocabularies have one column, ``token``.
    """
    words = questions.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))
    runs = words.select("query_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("token") - 2)), lambda i: F.substring(F.col("token"), i, F.lit(3)))).alias("token"))

    def share(tokens: DataFrame, known: DataFrame, name: str) -> DataFrame:
        hit = tokens.join(known.select("token").distinct().withColumn("hit", F.lit(1)), "token", "left")
        return hit.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias(name))

    return share(words, known_words, "known_words").join(share(runs, known_runs, "known_runs"), "query_id")
