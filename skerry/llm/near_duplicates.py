"""Near-duplicate records: one-permutation hashing with optimal densification, banded buckets, stars in large buckets, pairs in the rest.

Copies with equal shingle sets are one class first, so a large group of copies costs one signature. A large bucket is cut into stars: members
so near to a hub that they must be near to one another stand by the hub. Every other pair of a bucket is
held against proven bounds by sizes and by parities of shingles, which differ in no more bits than the sets in shingles; what
passes is verified on the whole shingle sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.session import cut

#: Signature: bands of rows; a pair of similarity s shares a bucket with probability 1 - (1 - s**ROWS)**BANDS.
BANDS, ROWS = 24, 3

#: 64-bit words of the parities of a text's shingles.
WORDS = 4

#: Members from which a star's links with one another are not written out among the links, but marked.
EXPAND = 200

#: Members of a group that meet the whole group in one key when it is expanded into its pairs.
PAIRED = 1_000

#: Members of a bucket beyond which look-alikes are set aside as stars (so many are compared in pairs in a second), and the share of them that a round must find to be followed by another.
HOT, WORTH = 2_000, 0.1

#: Distinct words whose hash a Python worker remembers before it starts afresh.
REMEMBERED = 500_000

WORD = re.compile(r"[^\W_]+")

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of the distinct runs of ``width`` words of each text of a batch."""

    def __init__(self, width: int, min_words: int):
        self.width, self.min_words = width, max(min_words, width)
        self.known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        h = self.known.get(word)
        if h is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            h = self.known[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text position, shingle), ordered by both; texts of too few words give none."""
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        words = [w if len(w) >= self.min_words else [] for w in words]
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.fromiter((self._hash(x) for w in words for x in w), np.uint64, int(lengths.sum()))
        text = np.repeat(np.arange(len(texts)), lengths)
        n = len(flat) - self.width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for i in range(self.width):
            h = mix(h + flat[i : n + i] + np.uint64(i + 1))
        inside = text[:n] == text[self.width - 1 :]
        h, text = h[inside], text[:n][inside]
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        return text[first], h[first]


def signatures(text: np.ndarray, shingles: np.ndarray, n: int, bins: int) -> np.ndarray:
    """One-permutation signatures, n x bins. An empty bin takes the value of the first non-empty bin of its own random order of bins."""
    place = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    none = np.uint64(2**32)
    sig = np.full(n * bins, none, np.uint64)
    np.minimum.at(sig, text * bins + place.astype(np.int64), shingles & np.uint64(2**32 - 1))
    full = sig != none
    some = np.zeros(n, bool)
    some[text] = True
    empty = np.flatnonzero(~full & np.repeat(some, bins))
    attempt = 0
    while len(empty):
        attempt += 1
        bin_ = empty % bins
        donor = (mix(bin_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        source = empty - bin_ + donor
        got = full[source]
        sig[empty[got]] = sig[source[got]]
        empty = empty[~got]
    return sig.reshape(n, bins)


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows])
    return keys.view(np.int64)


def parities(text: np.ndarray, shingles: np.ndarray, n: int) -> np.ndarray:
    """n x WORDS: of each text, whether an odd number of shingles falls on each bit."""
    bits = 64 * WORDS
    odd = np.bincount(text * bits + (mix(shingles) % np.uint64(bits)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, WORDS)


def _narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")


def signature_table(df: DataFrame, width: int, min_words: int, bands: int, rows: int) -> DataFrame:
    """``id, h1, h2, keys, size, odd``: 128 bits that stand for the shingle set, the bucket of each band, size and parities of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width, min_words)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                text, h = shingle(part.column(1).to_pylist())
                have, start, size = np.unique(text, return_index=True, return_counts=True)
                if not len(have):
                    continue
                sums = [np.add.reduceat(mix(h + np.uint64(salt)), start).view(np.int64) for salt in (1, 2)]
                keys = bands_of(signatures(text, h, part.num_rows, bands * rows)[have], bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
                odd = pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1) * WORDS, pa.int32()), pa.array(parities(text, h, part.num_rows)[have].reshape(-1)))
                columns = [part.column(0).take(pa.array(have)), pa.array(sums[0]), pa.array(sums[1]), lists, pa.array(size.astype(np.int32)), odd]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "h1", "h2", "keys", "size", "odd"])

    return df.mapInArrow(run, "id long, h1 long, h2 long, keys array<long>, size int, odd array<long>")


def shingle_sets(df: DataFrame, width: int, min_words: int) -> DataFrame:
    """``id, shingles``: the whole set of a text's shingle hashes, cut to 32 bits: two texts are compared, not all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width, min_words)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                text, h = shingle(part.column(1).to_pylist())
                offsets = np.searchsorted(text, np.arange(part.num_rows + 1))
                short = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(short))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "shingles"])

    return df.mapInArrow(run, "id long, shingles array<int>")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``a, b, similarity`` of the pairs that reach ``least``."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def _sets_of(narrow: DataFrame, ids: DataFrame, width: int, min_words: int) -> DataFrame:
    one = narrow.join(ids.hint("merge"), "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    return cut(shingle_sets(one, width, min_words))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def stars(shared: DataFrame, narrow: DataFrame, width: int, min_words: int, threshold: float, hot: int | None = None) -> DataFrame | None:
    """``cls, hub``, or None for no large bucket: members of large buckets (of ``shared``: cls, key, n) whose distance (1 - similarity) from a hub is at most half of what a link may have.

    By the triangle inequality any two of a hub's members are linked, so their pairs need not be compared. In each round the least
    member by hash of each large bucket is its hub; rounds go on while they pay.
    """
    most = HOT if hot is None else hot
    left = shared.where(F.col("n") > most).select("cls", "key")
    found, asked = None, None
    if not left.isEmpty():
        left = cut(left)
    while not left.isEmpty():
        hubs = left.groupBy("key").agg(F.min_by("cls", F.struct(F.xxhash64("cls"), "cls")).alias("hub"))
        met = left.join(hubs, "key").where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
        # What is a hub in one bucket belongs to no other's star in the same round.
        met = cut(met.join(hubs.select(F.col("hub").alias("b")).distinct(), "b", "left_anti"))
        near = _verified(met, _sets_of(narrow, _ends(met), width, min_words), (1 + threshold) / 2)
        new = cut(near.groupBy("b").agg(F.min("a").alias("hub")).select(F.col("b").alias("cls"), "hub"))
        found = new if found is None else cut(found.unionByName(new))
        asked = cut(hubs) if asked is None else cut(asked.unionByName(hubs))
        before = left.count()
        rest = left.join(found, "cls", "left_anti").join(asked.select("key", F.col("hub").alias("cls")), ["key", "cls"], "left_anti")
        large = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key")
        left = cut(rest.join(large, "key", "left_semi"))
        if before - left.count() < WORTH * before:
            break
    return found


def near_duplicate_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, min_words: int = 1, bands: int = BANDS, rows: int = ROWS
) -> tuple[DataFrame, DataFrame]:
    """``members`` (``id, cls, copies``) and ``links`` (``a, b, similarity, star``, a < b) between classes of equal shingle sets.

    A class is named by its least id. Texts of fewer than ``max(min_words, width)`` words, null texts and null ids are in no
    class; rows that repeat an id count once; a very long text is compared whole. Empty tables give no rows. Other columns are
    not read.

    Links are all that were found, but for stars of :data:`EXPAND` members or more: of those each member's link with its hub bears the hub as ``star`` (null in
    other links), and all members of one star are linked with one another by that, which :func:`near_duplicate_pairs` writes out.
    """
    narrow = _narrow(df, id_col, text_col)
    sigs = cut(signature_table(narrow, width, min_words, bands, rows))
    classes = sigs.groupBy("h1", "h2").agg(F.min("id").alias("cls"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.first("odd").alias("odd"), F.count(F.lit(1)).alias("copies"))
    members = sigs.select("id", "h1", "h2").join(classes.select("h1", "h2", "cls", "copies"), ["h1", "h2"]).select("id", "cls", "copies").distinct()
    buckets = classes.select("cls", F.explode("keys").alias("key"))
    # Combined before its shuffle, so a bucket that holds much of the table costs a row a partition; the join back is split if skewed.
    several = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Cut here: the join of members with each other would compute the buckets once for either side.
    shared = cut(buckets.join(several, "key"))
    star = stars(shared, narrow, width, min_words, threshold)
    marks = classes.select("cls", "size", *(F.col("odd")[i].alias(f"p{i}") for i in range(WORDS)))
    marked = shared.select("cls", "key").join(marks, "cls")
    marked = marked.withColumn("hub", F.lit(None).cast("long")) if star is None else marked.join(star, "cls", "left")
    # Sets of similarity s differ in (1 - s) / (1 + s) of the sum of their sizes; parities in no more bits than the sets in shingles.
    flips = sum((F.bit_count(F.col(f"l.p{i}").bitwiseXOR(F.col(f"r.p{i}"))) for i in range(WORDS)), F.lit(0))
    near = flips <= (F.col("l.size") + F.col("r.size")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    alike = F.least("l.size", "r.size") >= F.greatest("l.size", "r.size") * threshold - 1e-6
    # Of each pair one at least is in no star.
    free = marked.where("hub is null").alias("l").join(marked.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("r.hub").isNotNull() | (F.col("l.cls") < F.col("r.cls"))) & alike & near)
    pairs = free.select(F.least("l.cls", "r.cls").alias("a"), F.greatest("l.cls", "r.cls").alias("b"))
    if star is not None:
        # Members of two stars meet if their hubs are near enough for any of them to be.
        seats = marked.where("hub is not null")
        hubs = seats.select("key", "hub").distinct()
        both = cut(hubs.alias("x").join(hubs.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.hub") < F.col("y.hub"))).select(F.col("x.hub").alias("a"), F.col("y.hub").alias("b")).distinct())
        close = cut(_verified(both, _sets_of(narrow, _ends(both), width, min_words), max(0.0, 2 * threshold - 1)).select("a", "b"))
        across = seats.alias("l").join(close, F.col("l.hub") == F.col("a")).join(seats.alias("r"), (F.col("r.hub") == F.col("b")) & (F.col("l.key") == F.col("r.key")) & alike & near)
        sized = star.join(star.groupBy("hub").agg(F.count(F.lit(1)).alias("n")), "hub")
        few = sized.where(F.col("n") < EXPAND)
        within = few.alias("l").join(few.alias("r"), (F.col("l.hub") == F.col("r.hub")) & (F.col("l.cls") < F.col("r.cls")))
        more = [
            across.select(F.least("l.cls", "r.cls").alias("a"), F.greatest("l.cls", "r.cls").alias("b")),
            within.select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b")),
            star.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")),
        ]
        for other in more:
            pairs = pairs.unionByName(other)
    pairs = cut(pairs.distinct())
    links = _verified(pairs, _sets_of(narrow, _ends(pairs), width, min_words), threshold)
    if star is None:
        return members, cut(links.withColumn("star", F.lit(None).cast("long")))
    many = sized.where(F.col("n") >= EXPAND).select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b"), F.col("hub").alias("star"))
    return members, cut(links.join(many, ["a", "b"], "left").select("a", "b", "similarity", "star"))


def _within(rows: DataFrame) -> DataFrame:
    """``x, y``, x < y: all pairs of each group of rows ``id, grp, n`` (its size), a large one in parts that meet the whole group each."""
    parted = rows.withColumn("parts", F.ceil(F.col("n") / PAIRED).cast("int"))
    x = parted.select(F.col("id").alias("x"), "grp", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    y = parted.select(F.col("id").alias("y"), "grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return x.join(y, ["grp", "part"]).where("x < y").select("x", "y")


def near_duplicate_pairs(members: DataFrame, links: DataFrame, expand: int | None = None) -> DataFrame:
    """Distinct ``id_a, id_b``, id_a < id_b: every link, those that a star stands for too, with the copies at both ends, and the copies of each class.

    A class or star of n gives n squared / 2 pairs. With ``expand`` the copies of a class of more stand as pairs with its representative, to which the class's links go.
    """
    seats = links.where("star is not null").select(F.when(F.col("a") == F.col("star"), F.col("b")).otherwise(F.col("a")).alias("id"), F.col("star").alias("grp"))
    sized = seats.join(seats.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "grp")
    linked = links.select("a", "b").unionByName(_within(sized).toDF("a", "b"))
    whole = F.lit(True) if expand is None else F.col("copies") <= expand
    few = members.where(whole).select("id", "cls").unionByName(members.where(~whole & (F.col("id") == F.col("cls"))).select("id", "cls"))
    a, b = few.select(F.col("id").alias("x"), F.col("cls").alias("a")), few.select(F.col("id").alias("y"), F.col("cls").alias("b"))
    across = linked.join(a, "a").join(b, "b").select("x", "y")
    copies = _within(members.where((F.col("copies") > 1) & whole).select("id", F.col("cls").alias("grp"), F.col("copies").alias("n")))
    stars = members.where(~whole & (F.col("id") != F.col("cls"))).select(F.col("cls").alias("x"), F.col("id").alias("y"))
    pairs = across.unionByName(copies).unionByName(stars)
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id, group_id``, a row for every member: the least id that its class reaches over links.

    Labels move to the least label around and then jump to their label's label, so rounds grow with the logarithm of the longest
    chain; each round is cut at a checkpoint, and no component is gathered in a task or the driver.
    """
    both = cut(links.select(F.col("a").alias("v"), F.col("b").alias("w")).union(links.select("b", "a")))
    label = cut(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("label")))
    while True:
        seen = both.join(label.select(F.col("v").alias("w"), F.col("label").alias("near")), "w").groupBy("v").agg(F.min("near").alias("near"))
        pulled = label.join(seen, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = pulled.select(F.col("v").alias("label"), F.col("label").alias("further"))
        moved = cut(pulled.join(jump, "label", "left").select("v", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        label = moved.select("v", "label")
        if moved.where("old <> label").isEmpty():
            break
    return members.join(label.withColumnRenamed("v", "cls"), "cls", "left").select("id", F.coalesce("label", "cls").alias("group_id"))
