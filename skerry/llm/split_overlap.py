"""The same or nearly the same records across splits, by segments of the train texts.

A train text is cut into one segment more than any partner may have edits, so one segment at least stands unbroken in the
partner, moved by no more than the edits before and behind it. The segments are joined with all runs of the held-out texts
whatever their number; parities of letter pairs, which an edit changes by four at most, drop what cannot be near. Candidates
are settled by their exact edit distance; content-defined chunks, cut by a rolling hash, measure the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.near_duplicates import mix
from skerry.session import cut

#: One in so many places is a cut.
CUT_EVERY = 4

#: 64-bit words of the parities of letter pairs.
WORDS = 4

#: Rows of one text on a side that are paired in full; beyond, that side stands by its least id.
EXPAND = 200

TRAIN, VALIDATION, TEST = "train", "validation", "test"


def split_name(split: Column) -> Column:
    name = F.lower(F.regexp_replace(split, r"(?U)^\s+|\s+$", ""))
    return F.when(name.isin("val", "dev"), F.lit(VALIDATION)).when(name.isin(TRAIN, VALIDATION, TEST), name)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def cuts(text: str) -> list[int]:
    """Places between chunks, 0 and the length among them; each depends on the three characters before it only."""
    n = len(text)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if n < 4:
        return [0, n]
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xBF58476D1CE4E5B9) + c[2:] * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    at = np.flatnonzero(h % np.uint64(CUT_EVERY) == 0) + 3
    return [0, *at[at < n].tolist(), n]


def segments_of(n: int) -> tuple[int, int]:
    """Number and compared length of the segments of a train text of ``n`` characters: the longest partner allows n // 9 edits."""
    return n // 9 + 1, n // (n // 9 + 1)


@cache
def widths_of(n: int) -> tuple[int, ...]:
    """Compared lengths of the train texts that may be near a held-out text of ``n`` characters."""
    return tuple(sorted({segments_of(m)[1] for m in range(n - n // 10, n + n // 9 + 1) if m >= 9}))


def overlap_fraction(a: str, b: str) -> float:
    """Length of b's chunks that a holds too, over b's length."""
    x, y = cuts(a), cuts(b)
    own = {a[s:e] for s, e in zip(x, x[1:], strict=False)}
    return sum(e - s for s, e in zip(y, y[1:], strict=False) if b[s:e] in own) / max(1, len(b))


def parities(text: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """n x WORDS: of the letter pairs of each text, whether an odd number falls on each bit. An edit flips four bits at most."""
    bits = 64 * WORDS
    inside = text[:-1] == text[1:]
    at = (mix(codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:])[inside] % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(text[:-1][inside] * bits + at, minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, WORDS)


def _pieces(texts: DataFrame, segments: bool) -> DataFrame:
    """``tid, size, at, nth, digest, p0, ...``: the segments of each text, or all its runs of the lengths that segments may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                norms = batch.column(1).to_pylist()
                size = np.array([len(t) for t in norms], np.int64)
                start = np.cumsum(size) - size
                codes = np.frombuffer("".join(norms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                text = np.repeat(np.arange(len(norms)), size)
                place = np.arange(len(codes)) - start[text]
                odd = parities(text, codes, len(norms))
                wanted = [(segments_of(n)[1],) if segments else widths_of(n) for n in size.tolist()]
                for width in sorted({w for x in wanted for w in x}):
                    has = np.array([width in x for x in wanted])
                    if segments:
                        # The last segment takes what is left over; its first characters are compared as the others' are.
                        counts = np.where(has & (size >= 9), size // 9 + 1, 0)
                        rows = np.repeat(np.arange(len(norms)), counts)
                        nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
                        first = start[rows] + nth * width
                    else:
                        first = np.flatnonzero(has[text] & (place + width <= size[text]))
                        rows, nth = text[first], np.zeros(len(first), np.int64)
                    if not len(first):
                        continue
                    h = np.full(len(first), width, np.uint64)
                    for i in range(width):
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[first + i])
                    columns = [size[rows].astype(np.int32), place[first].astype(np.int32), nth.astype(np.int32), h.view(np.int64), *(odd[rows, i] for i in range(WORDS))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *map(pa.array, columns)], names=["tid", "size", "at", "nth", "digest", *(f"p{i}" for i in range(WORDS))])

    return texts.select("tid", "norm").mapInArrow(run, "tid long, size int, at int, nth int, digest long, " + ", ".join(f"p{i} long" for i in range(WORDS)))


def _candidates(texts: DataFrame) -> DataFrame:
    """``train, held``: distinct pairs of different texts; every pair within the allowed distance is among them."""
    t, h = _pieces(texts.where("in_train"), True).alias("t"), _pieces(texts.where("in_held"), False).alias("h")
    edits = F.floor(F.greatest("t.size", "h.size") / 10)
    longer, moved = F.col("h.size") - F.col("t.size"), F.col("h.at") - F.col("t.at")
    # Some unbroken segment has no more edits before it than segments, and no more behind it than segments are left.
    near = (F.abs(longer) <= edits) & (F.abs(moved) <= F.least("t.nth", edits)) & (F.abs(longer - moved) <= F.least(F.floor(F.col("t.size") / 9) - F.col("t.nth"), edits))
    flips = sum((F.bit_count(F.col(f"t.p{i}").bitwiseXOR(F.col(f"h.p{i}"))) for i in range(WORDS)), F.lit(0))
    # Both sides are many rows a text, which the planner's estimate does not see: merged, not broadcast.
    both = t.hint("merge").join(h.hint("merge"), (F.col("t.digest") == F.col("h.digest")) & near & (flips <= 4 * edits) & (F.col("t.tid") != F.col("h.tid")))
    return both.select(F.col("t.tid").alias("train"), F.col("h.tid").alias("held")).distinct()


def split_overlaps(df: DataFrame, id_col: str = "example_id", text_col: str = "text", split_col: str = "split", expand: int = EXPAND) -> DataFrame:
    """Distinct ``id_a, id_b, split, distance, overlap``: a train row, a validation or test row of equal or nearly equal text.

    Nearly equal are normalised texts whose edit distance is at most a tenth of the longer. ``overlap`` is the share of
    the held-out text that lies in chunks of the train text. Rows without id, known split, or letters and digits do not
    count; an id that is in both splits may pair with itself. Rows of equal text are one text; one with more than
    ``expand`` rows on a side pairs each row of the other side with that side's least id, and its own rows with the other
    side's least id, so every row of an overlapping text comes out. Texts of any length are compared whole. Empty tables
    give no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), split_name(F.col(split_col)).alias("split"), normalised(F.col(text_col)).alias("norm"))
    rows = cut(rows.where("id is not null and split is not null and norm <> ''").distinct())
    in_train = F.col("split") == TRAIN
    texts = rows.groupBy("norm").agg(
        F.min("id").alias("least"),
        F.max(in_train).alias("in_train"),
        F.max(~in_train).alias("in_held"),
        F.min(F.when(in_train, F.col("id"))).alias("train_least"),
        F.min(F.when(~in_train, F.col("id"))).alias("held_least"),
        F.sum(in_train.cast("long")).alias("n_train"),
        F.sum((~in_train).cast("long")).alias("n_held"),
    )
    # A text's own number: its digest, as the least id may be that of two texts where ids repeat.
    texts = cut(texts.withColumn("tid", F.xxhash64("norm")))
    a = texts.select(F.col("tid").alias("train"), F.col("norm").alias("norm_a"))
    b = texts.select(F.col("tid").alias("held"), F.col("norm").alias("norm_b"))
    allowed = "cast(floor(greatest(char_length(norm_a), char_length(norm_b)) / 10) as int)"
    near = _candidates(texts).hint("merge").join(a.hint("merge"), "train").join(b.hint("merge"), "held").withColumn("distance", F.expr(f"levenshtein(norm_a, norm_b, {allowed})"))
    near = near.where("distance >= 0")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = [overlap_fraction(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(share, pa.float64())], names=["train", "held", "distance", "overlap"])

    near = near.select("train", "held", "distance", "norm_a", "norm_b").mapInArrow(measure, "train long, held long, distance int, overlap double")
    same = texts.where("in_train and in_held").select(F.col("tid").alias("train"), F.col("tid").alias("held"), F.lit(0).alias("distance"), F.lit(1.0).alias("overlap"))
    links = cut(near.unionByName(same))
    known = rows.join(texts.select("norm", "tid", "n_train", "n_held", "train_least", "held_least"), "norm")
    left = known.where(in_train).select(F.col("tid").alias("train"), F.col("id").alias("id_a"), (F.col("n_train") > expand).alias("many_a"), (F.col("id") == F.col("train_least")).alias("first_a"))
    right = known.where(~in_train).select(F.col("tid").alias("held"), F.col("id").alias("id_b"), "split", (F.col("n_held") > expand).alias("many_b"), (F.col("id") == F.col("held_least")).alias("first_b"))
    few = links.join(left.where("not many_a or first_a"), "train").join(right.where("not many_b or first_b"), "held")
    # Of a side with many rows the others pair with the other side's first row.
    rest_a = links.join(left.where("many_a and not first_a"), "train").join(right.where("first_b"), "held")
    rest_b = links.join(left.where("first_a"), "train").join(right.where("many_b and not first_b"), "held")
    out = [x.select("id_a", "id_b", "split", "distance", "overlap") for x in (few, rest_a, rest_b)]
    return out[0].unionByName(out[1]).unionByName(out[2]).distinct()


def overlap_report(overlaps: DataFrame, df: DataFrame, id_col: str = "example_id", split_col: str = "split", family_col: str = "family") -> DataFrame:
    """By split and family (source): held-out rows, those that overlap with train, exactly or nearly, and the mean of their greatest overlap."""
    one = overlaps.groupBy("id_b", "split").agg(F.min("distance").alias("distance"), F.max("overlap").alias("overlap"))
    rows = df.select(F.col(id_col).cast("long").alias("id_b"), split_name(F.col(split_col)).alias("split"), F.col(family_col).alias("family"))
    joined = rows.where(F.col("split").isin(VALIDATION, TEST)).join(one, ["id_b", "split"], "left")
    return joined.groupBy("split", "family").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("distance").alias("n_overlapping"),
        F.count(F.when(F.col("distance") == 0, 1)).alias("n_exact"),
        F.round(F.coalesce(F.avg("overlap"), F.lit(0.0)), 6).alias("mean_overlap"),
    )
