"""The most similar vectors of every vector: a forest of random-projection trees, then exact ranking of leaf candidates.

The trees are fitted on a bounded sample; every vector is indexed and every vector is a query. A query's leaves over all
trees lie in one priority order (least margin on the path); it visits the best few, more in deeper trees. A leaf that is too large for that sample is
split again by a tree fitted on a bounded sample of its own, in a task of its own. A visit is a row that carries the vector to
the leaf, where all that came are compared exactly in blocks, so the cost is vectors x visits x rows of a leaf.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.session import cut

#: Vectors in the fitting sample, about and never twice as many; a parameter of every operator here.
SAMPLE = 20_000

#: Members that a leaf should have; beyond BLOCK it is split again, and compared in several blocks if it cannot be.
LEAF = 1_500
BLOCK = 4 * LEAF

#: Vectors of a leaf that one task leads into its own tree.
CHUNK = 50_000

TREES, VISITS, NEIGHBOURS = 2, 3, 5

#: Visits grow with the leaves of a tree by this factor and power: each split parts some neighbours, so that a fixed number would find fewer in a larger table.
GROWTH = 0.5, 0.52

#: A branch further than this on the wrong side of a split (unit vectors) is not entered.
REACH = 0.25

#: Copies of one vector within a batch beyond which further copies take their neighbours from the batch.
COPIES = 1_000

#: Bytes of visits that a task compares, about, and tasks at most.
TASK_BYTES, MOST_TASKS = 16 << 20, 20_000

#: Visits of a batch, vectors that are decoded at once, and similarities that a comparison holds at once: none of them grows with the table.
ROWS, DECODED, CELLS = 8_192, 4_096, 1_000_000

#: Similarities count to this many decimals; equal ones are ordered by id.
DECIMALS = 6

DIMENSIONS = 384


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def decode(kind: str, packed: list[bytes] | np.ndarray, dim: int) -> np.ndarray:
    """Unit float32 vectors of packed ones (or of a line of bytes each): float32 values, or uint8 codes followed by scale and offset."""
    out = np.empty((len(packed), dim), np.float32)
    for at in range(0, len(packed), DECODED):
        some = packed[at : at + DECODED]
        raw = np.ascontiguousarray(some) if isinstance(some, np.ndarray) else np.frombuffer(b"".join(some), np.uint8).reshape(len(some), -1)
        if kind == "f32":
            real = raw.view(np.float32).astype(np.float64)
        else:
            affine = np.ascontiguousarray(raw[:, dim:]).view(np.float32).astype(np.float64)
            real = affine[:, 1:] + affine[:, :1] * raw[:, :dim]
        out[at : at + len(some)] = unit(real)
    return out


def decode_sorted(kind: str, group: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, ids, vectors) of a group (id, value) by id; values are decoded where they lie, a chunk at a time."""
    ids = group.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    vectors, at = np.empty((len(ids), dim), np.float32), 0
    for chunk in group.column("value").chunks:
        for first in range(0, len(chunk), DECODED):
            part = chunk.slice(first, DECODED)
            ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
            raw = np.frombuffer(part.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(part), -1)
            vectors[place[at : at + len(part)]] = decode(kind, raw, dim)
            at += len(part)
    return order, ids[order], vectors


def pack_floats(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, list[bytes]]:
    """Rows (positions) that hold a valid vector, and their packed form. Columns: id, embedding."""
    lists = batch.column(1)
    offsets = lists.offsets.to_numpy()
    right = (np.diff(offsets) == dim) & ~np.asarray(lists.is_null()) & ~np.asarray(batch.column(0).is_null())
    at = np.flatnonzero(right)
    values = lists.values.to_numpy(zero_copy_only=False)
    rows = values[offsets[at][:, None] + np.arange(dim)] if len(at) else np.zeros((0, dim))
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.linalg.norm(rows.astype(np.float64), axis=1)
    good = np.isfinite(rows).all(axis=1) & (norm > 0)
    return at[good], [r.tobytes() for r in rows[good].astype(np.float32)]


def pack_codes(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, list[bytes]]:
    """As :func:`pack_floats` for columns id, qdata, q_scale, q_offset."""
    lists = batch.column(1)
    offsets = lists.offsets.to_numpy()
    right = (np.diff(offsets) == dim) & ~np.asarray(lists.is_null())
    for i in (0, 2, 3):
        right &= ~np.asarray(batch.column(i).is_null())
    at = np.flatnonzero(right)
    values = lists.values.to_numpy(zero_copy_only=False)
    rows = values[offsets[at][:, None] + np.arange(dim)] if len(at) else np.zeros((0, dim))
    scale = batch.column(2).to_numpy(zero_copy_only=False)[at].astype(np.float64)
    offset = batch.column(3).to_numpy(zero_copy_only=False)[at].astype(np.float64)
    with np.errstate(invalid="ignore"):
        real = offset[:, None] + scale[:, None] * rows
        good = np.isfinite(real).all(axis=1) & (np.abs(real).max(axis=1, initial=0) > 0) & (rows >= 0).all(axis=1) & (rows <= 255).all(axis=1)
    affine = np.column_stack([scale, offset])[good].astype(np.float32)
    return at[good], [r.tobytes() + a.tobytes() for r, a in zip(rows[good].astype(np.uint8), affine, strict=True)]


PACK = {"f32": pack_floats, "u8": pack_codes}


class Tree(NamedTuple):
    """Splits: ``x . normal > bias`` goes to ``right``. A child below 0 is leaf ``-child - 1``."""

    normals: np.ndarray
    bias: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray  # of the sample, by leaf


def grow(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """A tree over a sample. Of a few planes between two sampled points, drawn towards the means of their sides, a split
    takes the plane and the shift that pass where the projections lie thinnest, between the first and last fifth."""
    normals, bias, kids, share = [], [], [], []

    def split(at: np.ndarray) -> int:
        if len(at) <= leaf:
            share.append(len(at) / len(sample))
            return -len(share)
        rows, best = sample[at], None
        for _ in range(6):
            ends = rows[rng.choice(len(at), 2, replace=False)]
            for _ in range(4):
                near = rows @ ends.T
                first = near[:, 0] > near[:, 1]
                if first.all() or not first.any():
                    break
                ends = np.stack([rows[first].mean(0), rows[~first].mean(0)])
                ends = ends / np.maximum(np.linalg.norm(ends, axis=1, keepdims=True), 1e-12)
            normal = ends[0] - ends[1]
            length = np.linalg.norm(normal)
            if length < 1e-6:
                continue
            normal = normal / length
            p = np.sort(rows @ normal)
            shifts = np.linspace(p[int(len(p) * 0.2)], p[int(len(p) * 0.8)], 41)
            close, wide = (np.searchsorted(p, shifts + w) - np.searchsorted(p, shifts - w) for w in (0.03, 0.06))
            thin = close + wide / 2
            k = int(np.argmin(thin))
            if best is None or thin[k] < best[0]:
                best = (thin[k], normal, shifts[k])
        if best is None:  # all points are one
            share.append(len(at) / len(sample))
            return -len(share)
        side = rows @ best[1] > best[2]
        if side.all() or not side.any():
            share.append(len(at) / len(sample))
            return -len(share)
        me = len(normals)
        normals.append(best[1])
        bias.append(best[2])
        kids.append(None)
        kids[me] = (split(at[~side]), split(at[side]))
        return me

    if len(sample):
        split(np.arange(len(sample)))
    pairs = np.array(kids, np.int64).reshape(-1, 2)
    return Tree(np.array(normals, np.float32).reshape(len(kids), sample.shape[1]), np.array(bias, np.float32), pairs[:, 0], pairs[:, 1], np.array(share or [1.0]))


def visits_for(leaves: int) -> int:
    """Leaves that a vector should visit in trees of so many."""
    return max(VISITS, int(GROWTH[0] * leaves ** GROWTH[1]))


def leaves_of(tree: Tree, margin: np.ndarray, reach: float = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, priority): the leaf that a row (of margins) is in, with a priority above 0, and those within reach, below 0."""
    n = len(margin)
    if not len(tree.normals):
        return np.arange(n), np.zeros(n, np.int64), np.full(n, np.inf, np.float32)
    found, todo = [], [(0, np.arange(n), np.full(n, np.inf, np.float32))]
    while todo:
        node, at, least = todo.pop()
        if node < 0:
            found.append((at, np.full(len(at), -node - 1), least))
            continue
        m = margin[at, node]
        for child, signed in ((tree.right[node], np.where(m > 0, m, np.minimum(m, -1e-9))), (tree.left[node], np.where(m > 0, -m, np.maximum(-m, 1e-9)))):
            priority = np.minimum(least, signed)
            keep = priority > -reach
            if keep.any():
                todo.append((child, at[keep], priority[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def visits_of(trees: list[Tree], rows: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, tree * 2**32 + leaf, whether a member) of every membership and of each row's best ``visits`` leaves over all trees."""
    margins = [rows @ t.normals.T - t.bias for t in trees]
    found, todo, reach = [], np.arange(len(rows)), REACH / 32
    while len(todo):  # further out only for rows that do not reach enough leaves, so that no batch holds most of a large forest
        some = [leaves_of(t, m[todo], reach) for t, m in zip(trees, margins, strict=True)]
        few = sum(np.bincount(f[0], minlength=len(todo)) for f in some) < (visits if reach < REACH else 0)
        found += [(todo[r[~few[r]]], leaf[~few[r]] + (i << 32), p[~few[r]]) for i, (r, leaf, p) in enumerate(some)]
        todo, reach = todo[few], min(2 * reach, REACH)
    row, leaf, priority = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((-priority, row))
    row, leaf, priority = row[order], leaf[order], priority[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(rows)))[:-1]])
    place = np.arange(len(row)) - starts[row]
    member = priority > 0
    keep = member | (place < visits)
    return row[keep], leaf[keep], member[keep]


def nearest(queries: np.ndarray, query_ids: np.ndarray, members: np.ndarray, member_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, similarity in units of 10**-DECIMALS) of the k most similar members of each query, equal ones by lower id."""
    if (member_ids[1:] < member_ids[:-1]).any():
        order = np.argsort(member_ids, kind="stable")
        members, member_ids = members[order], member_ids[order]
    ids, others, near = [], [], []
    tie = np.arange(len(members)) / (2.0 * max(1, len(members)))
    take = min(k, len(members))
    for at in range(0, len(queries), step := max(1, min(512, CELLS // max(1, len(members))))):
        own = query_ids[at : at + step]
        exact = np.rint((queries[at : at + step] @ members.T).astype(np.float64) * 10**DECIMALS)
        key = exact - tie
        key[own[:, None] == member_ids[None, :]] = -np.inf
        best = np.argpartition(-key, take - 1, axis=1)[:, :take] if take < len(members) else np.tile(np.arange(take), (len(own), 1))
        line = np.repeat(np.arange(len(own)), best.shape[1])
        col = best.reshape(-1)
        real = np.isfinite(key[line, col])
        ids.append(own[line[real]])
        others.append(member_ids[col[real]])
        near.append(exact[line[real], col[real]].astype(np.int64))
    return np.concatenate(ids), np.concatenate(others), np.concatenate(near)


def compared(kind: str, group: pa.Table, dim: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`nearest` of all that came to a leaf, or to a block of it. Beside the visits it holds their vectors once, if all are compared with all."""
    order, ids, vectors = decode_sorted(kind, group, dim)
    member, visitor = (group.column(c).to_numpy(zero_copy_only=False)[order] for c in ("member", "visitor"))
    if visitor.all():  # the whole leaf, or one of its two blocks: guests are compared with one another and members with guests, too
        return nearest(vectors, ids, vectors, ids, k)
    return nearest(vectors[visitor], ids[visitor], vectors[member], ids[member], k) if member.any() and visitor.any() else (ids[:0], ids[:0], ids[:0])


def fit(rows: np.ndarray, expected: int, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> list[Tree]:
    """Trees over a sample of ``expected`` vectors, with leaves of about ``leaf`` of all vectors, 8 of the sample at least."""
    rng = np.random.default_rng(seed)
    in_sample = max(8, int(leaf * len(rows) / max(1, expected)))
    return [grow(rows, in_sample, rng) for _ in range(trees)]


def _copies(packed: list[bytes], ids: np.ndarray, k: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Positions to index, and pairs (id, id of an equal vector) that settle the rest: a copy of which a batch holds
    more than :data:`COPIES` has k equal ones, none of which can be surpassed."""
    seen: dict[bytes, list[int]] = {}
    keep, pairs = [], []
    for i, p in enumerate(packed):
        same = seen.setdefault(p, [])
        if len(same) < max(COPIES, k):
            same.append(i)
            keep.append(i)
        else:
            pairs.extend((int(ids[i]), int(ids[j])) for j in same[:k])
    return np.array(keep, np.int64), pairs


def similar_vectors(
    df: DataFrame, kind: str, id_col: str, value_cols: list[str], k: int = NEIGHBOURS, sample: int = SAMPLE, leaf: int = LEAF, trees: int = TREES, visits: int | None = None, dim: int = DIMENSIONS
) -> DataFrame:
    """Columns ``vec_set, id, other, similarity``: up to k most similar vectors found for every valid vector, by cosine.

    ``kind`` is ``f32`` (value column: floats) or ``u8`` (codes, scale, offset). Valid vectors have ``dim`` finite values that are
    not all zero; rows that are null, short, or without id, scale or offset give nothing. Equal similarities (to 6 decimals)
    are ordered by lower id; a vector is never its own neighbour, and rows of one id are not neighbours. With fewer than
    k other vectors all come out. An empty table gives no rows. Other columns are not read.
    Without ``visits`` their number follows that of a tree's leaves (:func:`visits_for`).

    A leaf that holds more than :data:`BLOCK` vectors by its share of the sample is split by a tree of its own; what is still larger is compared
    in blocks of members by blocks of visitors, so no task holds it whole. Copies of one vector beyond a batch's first thousand are settled there.
    """
    narrow = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(value_cols)])
    expected = df.count()
    # Drawn by row, not by id, so that a repeated id weighs no more; a limit would move all drawn vectors to one task first.
    drawn = narrow.where(F.rand(7) < min(1.0, sample / max(1, expected))).toArrow()
    packed = [p for b in drawn.combine_chunks().to_batches() for p in PACK[kind](b, dim)[1]][: 2 * sample]
    forest = fit(decode(kind, packed, dim) if packed else np.zeros((0, dim), np.float32), expected, trees, leaf)
    reached = visits or visits_for(max(len(t.share) for t in forest))
    shipped = df.sparkSession.sparkContext.broadcast([tuple(t) for t in forest])  # 2 * sample / 8 splits at most, whatever the table
    # Of each leaf whether it has a tree of its own: not where its sample was too small to say, nor all one vector.
    large = [t.share * expected > BLOCK for t in forest]

    def index(deep: bool, visits: int, members_only: bool = False):
        """Rows of the visits to leaves without (or, ``deep``, with) a tree of their own."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grown = [Tree(*t) for t in shipped.value]
            first = np.cumsum([0] + [len(t.share) for t in grown])
            share, big = np.concatenate([t.share for t in grown]), np.concatenate(large)
            for whole in batches:
                for begin in range(0, whole.num_rows, 4096):
                    batch = pa.Table.from_batches([whole.slice(begin, 4096)]).combine_chunks().to_batches()[0]
                    at, rows = PACK[kind](batch, dim)
                    if not len(at):
                        continue
                    ids = batch.column(0).to_numpy(zero_copy_only=False)[at].astype(np.int64)
                    keep, settled = _copies(rows, ids, k)
                    # A visit carries the vector, so few vectors at a time where each has many visits.
                    for at in range(0, len(keep), step := max(64, ROWS // (len(grown) + visits))):
                        own, values = ids[keep[at : at + step]], [rows[i] for i in keep[at : at + step]]
                        row, node, member = visits_of(grown, decode(kind, values, dim), visits)
                        place = first[node >> 32] + (node & 0xFFFFFFFF)
                        mine = (big[place] == deep) & (member | (not members_only))
                        row, node, member, sizes = row[mine], node[mine], member[mine], share[place[mine]] * expected
                        if deep:
                            chunks = np.maximum(1, np.ceil(2 * sizes / CHUNK)).astype(np.int64)
                            yield _visit_rows(node, np.zeros(len(row), np.int64), _spread(own[row], chunks, 3), np.zeros(len(row), np.int64), member, np.ones(len(row), bool), own[row], pa.array(values, pa.binary()).take(pa.array(row)))
                        else:
                            yield from _in_blocks(node, np.zeros(len(row), np.int64), sizes, row, member, own, values)
                    if settled and not deep:
                        a, b = np.array(settled, np.int64).T
                        none = np.zeros(len(a), np.int64)
                        yield _visit_rows(none - 1, none, np.arange(len(a)) % 64, none, none > 0, none == 0, a, pa.array([int(x).to_bytes(8, "little") for x in b], pa.binary()))

        return run

    def compare(group: pa.Table) -> pa.Table:
        if group.column("node")[0].as_py() < 0:
            ids = group.column("id").to_numpy()
            found = (ids, np.array([int.from_bytes(v, "little") for v in group.column("value").to_pylist()], np.int64), np.full(len(ids), 10**DECIMALS))
        else:
            found = compared(kind, group, dim, k)
        return pa.table({"id": found[0], "other": found[1], "similarity": found[2].astype(np.int32)})

    rows = narrow.mapInArrow(index(False, reached), _VISIT)
    if any(x.any() for x in large):
        most = max(float((t.share * expected).max()) for t in forest)
        rate = min(1.0, sample / most)

        def own_tree(group: pa.Table) -> pa.Table:
            """The tree of one leaf, over its part of a second sample: about ``sample`` vectors for the largest, fewer for others."""
            node, some = group.column("node")[0].as_py(), group.slice(0, 2 * sample)
            vectors = decode(kind, some.column("value").to_pylist(), dim)
            tree = grow(vectors, max(8, int(leaf * rate)), np.random.default_rng(node % 2**32))
            chunks = max(1, math.ceil(2 * shares[node >> 32][node & 0xFFFFFFFF] * expected / CHUNK))
            return pa.table({"node": pa.array([node] * chunks, pa.int64()), "block": pa.array(range(chunks), pa.int64()), "tree": pa.array([pickle.dumps(tuple(tree))] * chunks, pa.binary())})

        def lead(key: tuple, visitors: pa.Table, trees: pa.Table) -> pa.Table:
            """The visits to a leaf led on to the leaves of its own tree; without one (nothing was drawn there) it stays one."""
            empty = pa.Table.from_batches([], _VISIT_ARROW)
            if not visitors.num_rows:
                return empty
            node = visitors.column("node")[0].as_py()
            ids, member = visitors.column("id").to_numpy(), visitors.column("member").to_numpy(zero_copy_only=False)
            size = shares[node >> 32][node & 0xFFFFFFFF] * expected
            tree = Tree(*pickle.loads(trees.column("tree")[0].as_py())) if trees.num_rows else Tree(np.zeros((0, dim), np.float32), *(np.zeros(0) for _ in range(3)), np.ones(1))
            out = []
            for begin in range(0, len(ids), 8192):
                values = visitors.column("value").slice(begin, 8192).to_pylist()
                row, sub, own = visits_of([tree], decode(kind, values, dim), visits or visits_for(len(tree.share)))
                some = ids[begin : begin + 8192]
                out += _in_blocks(np.full(len(row), node), sub, tree.share[sub] * size, row, own & member[begin : begin + 8192][row], some, values)
            return pa.Table.from_batches(out, _VISIT_ARROW) if out else empty

        shares = [t.share for t in forest]
        seen = narrow.where(F.rand(11) < rate).mapInArrow(index(True, 0, members_only=True), _VISIT)
        own = cut(seen.groupBy("node").applyInArrow(own_tree, "node long, block long, tree binary"))
        deep = narrow.mapInArrow(index(True, reached), _VISIT)
        led = deep.groupBy("node", "block").cogroup(own.groupBy("node", "block")).applyInArrow(lead, _VISIT)
        rows = rows.unionByName(led)
    # As many tasks as the visits ask for, by number: a task's share would grow with the table under a fixed one.
    size = expected * (trees + reached) * (dim * (4 if kind == "f32" else 1) + 64)
    tasks = min(MOST_TASKS, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES)))
    near = rows.repartition(tasks, "node", "sub", "block", "visit").groupBy("node", "sub", "block", "visit").applyInArrow(compare, "id long, other long, similarity int")
    # Both the choice among visits and the ranking use the one shuffle by id.
    once = near.repartition(tasks, "id").groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return once.withColumn("place", place).where(F.col("place") <= k).select(F.lit(kind).alias("vec_set"), "id", "other", (F.col("similarity") / 10**DECIMALS).alias("similarity"))


#: A visit: the leaf, the leaf of its own tree, the block of members and of visitors, in what role the vector comes, and the vector.
_VISIT = "node long, sub long, block long, visit long, member boolean, visitor boolean, id long, value binary"
_VISIT_ARROW = pa.schema([("node", pa.int64()), ("sub", pa.int64()), ("block", pa.int64()), ("visit", pa.int64()), ("member", pa.bool_()), ("visitor", pa.bool_()), ("id", pa.int64()), ("value", pa.binary())])


def _spread(ids: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
    """A number below n for each id."""
    h = (ids.astype(np.uint64) + np.uint64(salt << 58)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) % n.astype(np.uint64)).astype(np.int64)


def _in_blocks(node: np.ndarray, sub: np.ndarray, sizes: np.ndarray, row: np.ndarray, member: np.ndarray, ids: np.ndarray, values: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The visits as rows: a member meets every block of visitors, and a visitor every block of members, of a leaf of that size.

    Blocks hold about :data:`BLOCK` vectors on either side, so a leaf of n costs n / BLOCK rows a vector and no group more than two blocks.
    """
    if not len(row):
        return
    blocks, visits = (np.maximum(1, np.ceil(sizes * f / BLOCK)).astype(np.int64) for f in (1, 2))
    own, seat = _spread(ids[row], blocks, 1), _spread(ids[row], visits, 2)
    # As a visitor, to each block of members; in its own block and seat a member comes as both.
    again = np.repeat(np.arange(len(row)), blocks)
    block = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    both = member[again] & (block == own[again])
    # As a member, to the other seats of its block.
    more = np.repeat(np.arange(len(row)), np.where(member, visits - 1, 0))
    counts = np.where(member, visits - 1, 0)
    turn = np.arange(len(more)) - np.repeat(np.cumsum(counts) - counts, counts)
    turn = turn + (turn >= seat[more])
    at = np.concatenate([again, more])
    yes = np.ones(len(more), bool)
    columns = node[at], sub[at], np.concatenate([block, own[more]]), np.concatenate([seat[again], turn]), np.concatenate([both, yes]), np.concatenate([np.ones(len(again), bool), ~yes]), ids[row[at]]
    held = pa.array(values, pa.binary())
    for first in range(0, len(at), ROWS):
        yield _visit_rows(*(c[first : first + ROWS] for c in columns), held.take(pa.array(row[at[first : first + ROWS]])))


def _visit_rows(node, sub, block, visit, member, visitor, ids, values) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(x, np.int64), pa.int64()) for x in (node, sub, block, visit)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(member, pa.bool_()), pa.array(visitor, pa.bool_()), pa.array(ids, pa.int64()), values], schema=_VISIT_ARROW)


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """Distinct pairs, the smaller id first, of which one is among the other's neighbours."""
    return neighbours.select("vec_set", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def similar_in_both(floats: DataFrame, codes: DataFrame, **options) -> DataFrame:
    """:func:`similar_vectors` of both tables: ``vec_id, embedding`` and ``row_id, qdata, q_scale, q_offset``."""
    a = similar_vectors(floats, "f32", "vec_id", ["embedding"], **options)
    b = similar_vectors(codes, "u8", "row_id", ["qdata", "q_scale", "q_offset"], **options)
    return a.unionByName(b)
