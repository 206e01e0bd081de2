"""Bloom filters over vocabularies, kept as tables of set bits, and their union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.errors import require
from skerry.functions.text import fnv1a32

#: Bounds of a filter's size, and bits a word.
LEAST_BITS, MOST_BITS, BITS_A_WORD = 1 << 14, 1 << 21, 32
SEEDS = (0, 0x9E3779B9)


def bloom_bits(n_words: int) -> int:
    """The least power of two that gives each word its bits, within the bounds."""
    bits = LEAST_BITS
    while bits < n_words * BITS_A_WORD and bits < MOST_BITS:
        bits *= 2
    return bits


def build_bloom(words: DataFrame, bits: int, word_col: str = "word") -> DataFrame:
    """``bit``: the set bits, two a word; at most ``bits`` rows, combined before the shuffle."""
    require(LEAST_BITS <= bits <= MOST_BITS, f"a filter has {LEAST_BITS} to {MOST_BITS} bits")
    places = F.array(*[fnv1a32(F.col(word_col), s) % bits for s in SEEDS])
    return words.select(F.explode(places).alias("bit")).distinct()


def union_blooms(blooms: list[tuple[DataFrame, int]]) -> DataFrame:
    require(len({bits for _, bits in blooms}) == 1, "filters of different sizes have no union")
    out = blooms[0][0]
    for other, _ in blooms[1:]:
        out = out.union(other)
    return out.distinct()


def probe(words: DataFrame, bloom: DataFrame, bits: int, word_col: str = "word") -> DataFrame:
    """``word, maybe``: whether both bits of a word are set."""
    require(bits <= MOST_BITS, f"a filter has {MOST_BITS} bits at most")
    each = words.select(F.col(word_col).alias("word"), F.explode(F.array(*[fnv1a32(F.col(word_col), s) % bits for s in SEEDS])).alias("bit"))
    hit = each.join(F.broadcast(bloom.withColumn("hit", F.lit(1))), "bit", "left")  # MOST_BITS rows at most
    return hit.groupBy("word").agg((F.count("hit") == F.count(F.lit(1))).alias("maybe"))
