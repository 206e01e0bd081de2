import datetime
import itertools
import json
import math
import os
import sys
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import DATA, compare, connect

from skerry.llm import abusive_content as A
from skerry.llm import container_packing as C
from skerry.llm import conversations as V
from skerry.llm import corpus_encoding as E
from skerry.llm import distinctive_terms as D
from skerry.llm import markup as M
from skerry.llm import near_duplicates as N
from skerry.llm import page_body as P
from skerry.llm import queries as Q
from skerry.llm import similar_vectors as S
from skerry.llm import site_style as ST
from skerry.llm import split_overlap as O

T0 = datetime.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_its_sql(spark, con, name):
    compare(spark, con, Q.QUERIES[name], Q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_without_sql_runs(spark, name):
    Q.QUERIES[name](spark, DATA).collect()


# 1. distinctive terms

RECORDS = "chunk_id long, text string, at timestamp, term string, record int, tf int"


def test_log_entropy_by_hand(spark):
    rows = [(1, "pier pier pier crane", T0, "x", 1, 1), (1, "old", T0 - datetime.timedelta(1), "x", 1, 1), (2, "crane Pier", T0, None, None, None), (3, None, None, None, None, None), (None, "pier", T0, None, None, None), (4, "", T0, None, None, None)]
    got = {(r.record, r.term): r for r in D.log_entropy(spark.createDataFrame(rows, RECORDS), "chunk_id", "text", "at").collect()}
    assert {k: r.tf for k, r in got.items()} == {(1, "pier"): 3, (1, "crane"): 1, (2, "crane"): 1, (2, "pier"): 1}
    h = -(0.75 * math.log(0.75) + 0.25 * math.log(0.25))
    assert math.isclose(got[1, "pier"].score, math.log(4) * (1 - h / math.log(4)), abs_tol=1e-9)


def test_the_score_decides_before_the_counts(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"t{k}x" for k in rng.zipf(1.4, 40) % 90) + f" rare{i // 4}" * (1 + i % 5), T0, None, None, None) for i in range(60)]
    df = spark.createDataFrame(rows, RECORDS)
    scored = [r for r in D.log_entropy(df, "chunk_id", "text", "at").collect() if r.tf >= 3 and 2 <= r.df <= 8]
    kept = D.distinctive_terms(df, "chunk_id", "text", "at")
    assert {(r.record, r.term) for r in kept.collect()} == {(r.record, r.term) for r in scored} and len(scored) > 5
    assert "score" in kept._jdf.queryExecution().optimizedPlan().toString() and "LOG1P" in kept._jdf.queryExecution().optimizedPlan().toString().upper()


def test_terms_of_an_empty_table(spark):
    assert D.distinctive_terms(spark.createDataFrame([], RECORDS), "chunk_id", "text", "at").count() == 0


# 2. similar vectors

VECTORS = "vec_id long, embedding array<float>, node int, id string"


def clustered(n, dim=384, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12, dim))
    x = centres[rng.integers(len(centres), size=n)] + 0.5 * rng.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_forest_recall_against_brute_force(spark):
    x = clustered(3000)
    df = spark.createDataFrame([(i, v.tolist(), 0, None) for i, v in enumerate(x)], VECTORS)
    got = {(r.id, r.other) for r in S.similar_vectors(df, "f32", "vec_id", ["embedding"], sample=600, leaf=300).collect()}
    near = x @ x.T
    np.fill_diagonal(near, -9)
    want = {(i, int(j)) for i, line in enumerate(near) for j in np.argsort(-line)[:5]}
    assert len(want & got) / len(want) >= 0.9


def test_invalid_and_equal_vectors(spark):
    nan = float("nan")
    good = [1.0] + [0.0] * 383
    rows = [(1, good, 1, "a"), (2, good, 1, "a"), (3, [0.0] * 384, 1, "a"), (4, [nan] * 384, 1, "a"), (5, None, 1, "a"), (6, [1.0], 1, "a"), (None, good, 1, "a"), (7, [0.9, 0.1] + [0.0] * 382, None, None), (8, [1.0, None] + [0.0] * 382, 1, "b")]
    got = {(r.id, r.other) for r in S.similar_vectors(spark.createDataFrame(rows, VECTORS), "f32", "vec_id", ["embedding"]).collect()}
    assert got == {(1, 2), (1, 7), (2, 1), (2, 7), (7, 1), (7, 2)}
    assert S.similar_vectors(spark.createDataFrame([], VECTORS), "f32", "vec_id", ["embedding"]).count() == 0


def test_many_copies_have_five_neighbours_each(spark, monkeypatch):
    keep, pairs = S._copies([b"x"] * 2000 + [b"y"], np.arange(2001), 5)
    assert len(keep) == S.COPIES + 1 and Counter(a for a, _ in pairs) == {i: 5 for i in range(S.COPIES, 2000)}


def test_large_leaf_in_blocks(spark, monkeypatch):
    x = np.repeat(clustered(50, seed=8)[:1], 500, axis=0)  # one vector, which no tree splits
    x += np.random.default_rng(8).normal(size=x.shape).astype(np.float32) * 1e-9
    y = clustered(500, seed=8)
    for vectors in (x, y):
        df = spark.createDataFrame([(i, v.tolist(), 0, None) for i, v in enumerate(vectors)], VECTORS)
        monkeypatch.setattr(S, "BLOCK", 6_000)
        whole = {tuple(r) for r in S.similar_vectors(df, "f32", "vec_id", ["embedding"]).select("id", "other").collect()}
        monkeypatch.setattr(S, "BLOCK", 100)
        monkeypatch.setattr(S, "grow", lambda sample, leaf, rng, grow=S.grow: grow(sample, 10**9, rng))
        assert {tuple(r) for r in S.similar_vectors(df, "f32", "vec_id", ["embedding"]).select("id", "other").collect()} == whole
        monkeypatch.undo()


def test_no_group_holds_more_than_two_blocks():
    n = 20 * S.BLOCK
    ids = np.arange(n)
    groups, met = Counter(), Counter()
    for batch in S._in_blocks(np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, float(n)), ids, ids % 3 > 0, ids, [b"x"] * n):
        block, visit, member, visitor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "visit", "member", "visitor"))
        groups.update(zip(block.tolist(), visit.tolist(), strict=True))
        met["member"] += int(member.sum())
        met["visitor"] += int(visitor.sum())
    assert max(groups.values()) < 2 * S.BLOCK and len(groups) == 20 * 40
    assert met == {"member": int((ids % 3 > 0).sum()) * 40, "visitor": n * 20}


def test_large_leaves_have_trees_of_their_own(spark, monkeypatch):
    x = clustered(3000)
    df = spark.createDataFrame([(i, v.tolist(), 0, None) for i, v in enumerate(x)], VECTORS).repartition(4)
    monkeypatch.setattr(S, "BLOCK", 400)
    monkeypatch.setattr(S, "CHUNK", 300)
    trees = []
    plain = S.cut
    monkeypatch.setattr(S, "cut", lambda d: trees.append(plain(d)) or trees[-1])
    rows = S.similar_vectors(df, "f32", "vec_id", ["embedding"], sample=40, leaf=150).collect()  # leaves of 8 of 40, some 600 of all
    assert trees and trees[0].count() > trees[0].select("node").distinct().count() > 1
    near = x @ x.T
    np.fill_diagonal(near, -9)
    want = {(i, int(j)) for i, line in enumerate(near) for j in np.argsort(-line)[:5]}
    assert len(want & {(r.id, r.other) for r in rows}) / len(want) >= 0.9


def test_deep_trees_find_as_many(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(1500, 384))
    x = np.repeat(centres, 6, axis=0) + 0.6 * rng.normal(size=(9000, 384))  # groups far smaller than a leaf, anywhere
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, None) for i, v in enumerate(x)], VECTORS)
    got = {(r.id, r.other) for r in S.similar_vectors(df, "f32", "vec_id", ["embedding"], sample=1500, leaf=30).collect()}
    want = {(i, j) for i in range(9000) for j in range(i // 6 * 6, i // 6 * 6 + 6) if i != j}
    assert len(want & got) / len(want) >= 0.95


def test_wider_reach_finds_the_same_leaves():
    x = clustered(2000)
    trees = S.fit(x[:500], 2000, leaf=40)
    for visits in (0, 3, 40):
        row, leaf, member = S.visits_of(trees, x, visits)
        whole = [S.leaves_of(t, x @ t.normals.T - t.bias) for t in trees]
        priority = {(r, n + (i << 32)): p for i, f in enumerate(whole) for r, n, p in zip(*(a.tolist() for a in f), strict=True)}
        for at in range(0, 2000, 97):
            own, got = {n: p for (r, n), p in priority.items() if r == at}, leaf[row == at].tolist()
            assert sorted((own[n] for n in got), reverse=True) == sorted(own.values(), reverse=True)[: max(visits, 2)] and len(set(got)) == len(got)
            assert set(leaf[(row == at) & member].tolist()) == {n for n, p in own.items() if p > 0}


def test_codes_are_read_back(spark):
    rng = np.random.default_rng(0)
    q = rng.integers(0, 256, size=(20, 384))
    rows = [(i, v.tolist(), 0.01, -1.0) for i, v in enumerate(q)] + [(90, q[0].tolist(), None, 0.0), (91, [0] * 384, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "row_id long, qdata array<int>, q_scale float, q_offset float")
    got = {(r.id, r.other) for r in S.similar_vectors(df, "u8", "row_id", ["qdata", "q_scale", "q_offset"]).collect()}
    real = q * np.float64(np.float32(0.01)) - 1
    real /= np.linalg.norm(real, axis=1, keepdims=True)
    near = real @ real.T
    np.fill_diagonal(near, -9)
    assert got == {(i, int(j)) for i, line in enumerate(near) for j in np.argsort(-line)[:5]}


# 3. conversations

MESSAGES = "conv_id string, message_id string, parent string, role string, recipient string, content string, exported_at timestamp, kind int, current string"
THREADS = "conv_id string, current_node string, title string, message_id string"


def talk(*rows):
    return [(c, m, p, role, to, content, at, 7, "z") for c, m, p, role, to, content, at in rows]


CASES = talk(
    ("a", "1", None, "system", None, "hello", T0), ("a", "2", "1", " Human ", None, "question", T0), ("a", "3", "2", "assistant", "python", "run()", T0),
    ("a", "4", "3", "BOT", "all", json.dumps({"content_type": "text", "parts": ["answer", {"x": 1}]}), T0), ("a", "5", "2", "assistant", None, "other branch", T0),
    ("b", "1", None, "user", None, "question", T0),  # no reply
    ("c", "2", "1", "user", None, "x", T0), ("c", "3", "2", "model", None, "y", T0),  # 1 is missing
    ("d", "1", "2", "user", None, "x", T0), ("d", "2", "1", "assistant", None, "y", T0),  # a circle
    ("e", "1", None, "assistant", None, "early", T0), ("e", "2", "1", "user", None, "x", T0), ("e", "3", "2", "assistant", None, "late", T0),
    ("e", "3", "2", "assistant", None, "  ", T0 - datetime.timedelta(1)),
    ("f", "1", None, "user", None, "x", T0), ("f", "2", "1", "assistant", None, "y", T0), ("f", "2", "1", "assistant", None, "", T0 + datetime.timedelta(1)),
    ("g", "1", None, "user", None, "x", T0), ("g", "2", "1", "assistant", None, "y", None),  # without a thread
    ("h", "1", None, "user", None, '{"content_type": "code", "parts": ["x"]}', T0), ("h", "2", "1", "assistant", None, "y", T0),
    ("i", None, None, None, None, None, None), (None, "1", None, "user", None, "x", T0),
)
HEADS = [("a", "4", None, "q"), ("b", "1", None, None), ("c", "3", None, None), ("d", "2", None, None), ("e", "3", None, None), ("f", "2", None, None), ("h", "2", None, None), ("i", None, None, None), (None, "1", None, None), ("z", "9", None, None)]
KEPT = [("a", 1, "2"), ("a", 2, "4"), ("e", 1, "2"), ("e", 2, "3")]


@pytest.mark.parametrize("limit", [100, 0])  # walked in a task, and by pointer doubling
def test_conversations(spark, limit):
    got = V.rebuild_conversations(spark.createDataFrame(CASES, MESSAGES), spark.createDataFrame(HEADS, THREADS), walk_limit=limit)
    assert sorted(tuple(r) for r in got.collect()) == KEPT


def test_no_conversations(spark):
    assert V.rebuild_conversations(spark.createDataFrame([], MESSAGES), spark.createDataFrame([], THREADS)).count() == 0


# 4. page bodies

PAGE = """We use cookies to improve your visit. Accept all or manage your choices.
Home
Guides
Home > Guides > How piers work
How piers work

A pier stands in the water, and ships are moored to it every day.
Advertisement: Site Plus, now 50% off until 1.2.2025
Menu entries of the pier come from the busy crane.
- first item
inventory: 43
Related articles
Wide harbour notes
Busy crane notes
Follow us: feed | mail | forum
Copyright 2025 Site. All rights reserved."""
PAGES = "page_id long, site string, url string, title string, text string, id string, frames array<long>, key int"


def test_page_body(spark):
    rows = [(1, "site.example", "https://site.example/how-piers-work#top", "How piers work", PAGE, "x", None, 1), (2, None, "https://site.example/how-piers-work", None, PAGE, None, None, None), (3, "site.example", None, "Other", PAGE, None, None, None), (4, "s", None, None, None, None, None, None), (5, "s", None, None, "", None, None, None), (None, "s", None, "How piers work", PAGE, None, None, None)]
    got = {}
    for r in P.main_body(spark.createDataFrame(rows, PAGES)).collect():
        got.setdefault(r.page_id, set()).add(r.line_no)
    assert got == {1: {5, 7, 9, 10, 11}, 2: {5, 7, 9, 10, 11}}
    assert P.main_body(spark.createDataFrame([], PAGES)).count() == 0


def test_a_site_learns_its_frame(spark):
    text = lambda i: f"Flotsam corner\nPage {i}\n\nThis is the body of page number {i}, as it stands.\nFlotsam corner"
    rows = [(i, "site.example", None, f"Page {i}", text(i), None, None, None) for i in range(6)]
    got = {tuple(r) for r in P.main_body(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {(i, n) for i in range(6) for n in (2, 4)}


def test_accents_of_an_untitled_page(spark):
    text = "Start\nBloque Fasomebe búfer\n\nEste es el cuerpo de la página, tal como está."
    rows = [(1, None, "https://s.example/bloque-fasomebe-b-fer?ref=nav", None, text, None, None, None), (2, None, "https://s.example/bloque-fasomebe-búfer.html", None, text, None, None, None), (3, None, "https://s.example/otro", None, text, None, None, None)]
    assert {tuple(r) for r in P.main_body(spark.createDataFrame(rows, PAGES)).collect()} == {(i, n) for i in (1, 2) for n in (2, 4)}


def test_page_tree_and_rendering():
    text = "Home\n\nShip list\n\nShips of the harbour are listed here, by name.\nName   Length   Year\nAda      40       1990\nBertha   112      2001\n\n- first\n2. second\n$ ls -la\n    indented code\nRelated articles\nOther page\nThis paragraph ends the aside, as it should.\nlast words"
    tree = P.page_tree(text, "Ship list", None, "site.example")
    assert [(n.tag, [(x.tag, [y.tag for y in x.inside]) for x in n.inside]) for n in tree.inside] == [
        ("header", [("p", [])]),
        ("main", [("h1", []), ("p", []), ("table", ["tr"] * 3), ("ul", ["li", "li"]), ("pre", ["line", "line"]), ("aside", ["p", "p"]), ("p", []), ("p", [])]),
    ]
    assert P.rendered(tree) == (
        "Ship list\n\nShips of the harbour are listed here, by name.\n\nName    Length  Year\nAda     40      1990\nBertha  112     2001\n\n- first\n- second\n\n$ ls -la\n    indented code\n\nThis paragraph ends the aside, as it should.\n\nlast words"
    )
    assert [x.number for x in P.visible_leaves(tree)] == P.body_lines(text, "Ship list", None, "site.example") == [3, 5, 6, 7, 8, 10, 11, 12, 13, 16, 17]


def test_bodies_of_odd_pages(spark):
    rows = [(1, "s", None, "How piers work", PAGE, None, None, None), (2, "s", None, "None", PAGE, None, None, None), (3, None, None, None, None, None, None, None), (4, None, None, None, "", None, None, None), (None, "s", None, "x", "x", None, None, None)]
    got = {r.page_id: r.body for r in P.body_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1].startswith("How piers work\n\nA pier stands") and got[2] == "" and got[3] is None and got[4] == "" and set(got) == {1, 2, 3, 4}
    assert P.body_texts(spark.createDataFrame([], PAGES)).count() == 0


# 5. near-duplicates

DOCS = "doc_id long, text string, id int, cls string, key string, source string, n_tokens int"


def brute_pairs(texts, width, threshold, least):
    sets = {}
    for i, t in texts.items():
        w = N.WORD.findall(t.lower())
        if len(w) >= max(least, width):
            sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def edited(seed=2, n=60):
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(3000)]
    out = {}
    for i in range(n):
        if i % 3 or not out:
            out[i] = " ".join(rng.choice(words, 60))
        else:
            base = out[int(rng.integers(i))].split()
            for _ in range(int(rng.integers(0, 4))):
                base[int(rng.integers(len(base)))] = str(rng.choice(words))
            out[i] = " ".join(base)
    return out


@pytest.mark.parametrize(("width", "threshold"), [(3, 0.6), (5, 0.8)])
def test_near_duplicates_equal_brute_force(spark, width, threshold):
    texts = edited()
    rows = [(i, t, 1, None, None, None, 1) for i, t in texts.items()] + [(900, None, 1, None, None, None, 1), (None, texts[0], 1, None, None, None, 1), (901, "", 1, None, None, None, 1), (902, "a b", 1, None, None, None, 1), (0, texts[0], 1, None, None, None, 1)]
    members, links = N.near_duplicate_classes(spark.createDataFrame(rows, DOCS), width=width, threshold=threshold, min_words=20)
    got = {tuple(r) for r in N.near_duplicate_pairs(members, links).collect()}
    want = brute_pairs(texts, width, threshold, 20)
    assert got == want and len(want) > 5
    groups = {r.id: r.group_id for r in N.near_duplicate_groups(members, links).collect()}
    assert set(groups) == set(texts) and all(groups[a] == groups[b] for a, b in want)


def test_texts_of_shared_passages_keep_their_pairs(spark):
    rng = np.random.default_rng(11)
    passages = [" ".join(f"p{i}w{k}" for k in range(12)) for i in range(40)]
    texts = {}
    for i in range(0, 3000, 2):
        chosen = [passages[k] for k in rng.choice(40, 10, replace=False)]
        texts[i] = " ".join(chosen)
        for k in rng.choice(10, 2, replace=False):
            chosen[k] = " ".join(f"own{i}w{k}x{j}" for j in range(12))
        texts[i + 1] = " ".join(chosen)
    members, links = N.near_duplicate_classes(spark.createDataFrame([(i, t, 1, None, None, None, 1) for i, t in texts.items()], DOCS), width=3, threshold=0.6)
    got = {tuple(r) for r in N.near_duplicate_pairs(members, links).collect()}
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in texts.items()}
    want = {(i, i + 1) for i in range(0, 3000, 2) if len(sets[i] & sets[i + 1]) >= 0.6 * len(sets[i] | sets[i + 1])}
    assert len(want) > 500 and len(got & want) >= 0.99 * len(want), (len(got & want), len(want))
    assert all(len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) for a, b in got)


def test_large_class_of_copies_is_a_star(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, text, 1, None, None, None, 1) for i in range(50)] + [(99, text + " more", 1, None, None, None, 1)]
    members, links = N.near_duplicate_classes(spark.createDataFrame(rows, DOCS), width=3, threshold=0.6)
    assert {tuple(r) for r in N.near_duplicate_pairs(members, links, expand=10).collect()} == {(0, i) for i in range(1, 50)} | {(0, 99)}
    assert N.near_duplicate_pairs(members, links).count() == 51 * 50 // 2


def look_alikes(n, seed, words=60, changes=3):
    rng = np.random.default_rng(seed)
    base = [f"s{seed}w{i}" for i in range(words)]
    out = []
    for i in range(n):
        t = list(base)
        for k in rng.choice(words, changes, replace=False):
            t[k] = f"own{seed}x{i}y{k}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("changes", [1, 3])
def test_stars_lose_no_pair(spark, monkeypatch, changes):
    monkeypatch.setattr(N, "HOT", 10)
    texts = dict(enumerate(look_alikes(40, 1, changes=changes) + look_alikes(30, 2, changes=2) + look_alikes(5, 3)))
    members, links = N.near_duplicate_classes(spark.createDataFrame([(i, t, 1, None, None, None, 1) for i, t in texts.items()], DOCS), width=3, threshold=0.6)
    got = {tuple(r) for r in N.near_duplicate_pairs(members, links).collect()}
    assert got == brute_pairs(texts, 3, 0.6, 1) and len(got) > 400


def test_a_hub_of_thousands_of_look_alikes_is_a_star(spark):
    n = 5_000
    texts = look_alikes(n, 5, words=200, changes=2)
    members, links = N.near_duplicate_classes(spark.createDataFrame([(i, t, 1, None, None, None, 1) for i, t in enumerate(texts)], DOCS), width=3, threshold=0.6)
    assert n - 1 <= links.count() < 3 * n
    groups = {r.group_id for r in N.near_duplicate_groups(members, links).collect()}
    assert groups == {0}


def test_stars_and_classes_of_hundreds_give_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 100)
    monkeypatch.setattr(N, "PAIRED", 90)
    texts = dict(enumerate(look_alikes(250, 7, changes=1) + look_alikes(1, 8) * 230))
    members, links = N.near_duplicate_classes(spark.createDataFrame([(i, t, 1, None, None, None, 1) for i, t in texts.items()], DOCS), width=3, threshold=0.6)
    assert links.count() < 4 * 250
    pairs = [tuple(r) for r in N.near_duplicate_pairs(members, links).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == set(itertools.combinations(range(250), 2)) | set(itertools.combinations(range(250, 480), 2)) == brute_pairs(texts, 3, 0.6, 1)


def test_no_documents(spark):
    members, links = N.near_duplicate_classes(spark.createDataFrame([], DOCS))
    assert members.count() == 0 and links.count() == 0 and N.near_duplicate_groups(members, links).count() == 0


# 6. markup


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("plain words, R&D and a < b and c > d", []), ("Costs went from $5 to $12", []), ("C:\\temp\\new and \\d+", []), ("left == right, 2 * 3 * 4, a_b-c", []), ("See [3] and [sic]", []),
        ("List<Entry> is <3", []), ("pipe it as in sort | uniq -c", []), (None, []), ("", []), ("a <b>c</b>", ["html"]), ("a &amp; b", ["html"]), ("# Title\n\nx", ["markdown"]),
        ("Title\n=====\n\nx", ["markdown"]), ("a **b** c", ["markdown"]), ("use `<div>` here", ["markdown"]), ("~~~\n[[x]]\n~~~", ["markdown"]), ("| a | b |\n|---|:--:|\n| 1 | 2 |", ["markdown"]),
        ("== Title ==", ["wiki"]), ("a [[b|c]] d", ["wiki"]), ("'''x''' y", ["wiki"]), ("{| class=\"t\"\n|-\n| 1\n|}", ["wiki"]), (":* [[x]] y", ["wiki"]), ("[https://a.example b]", ["wiki"]),
        ("so $x^2$ holds", ["latex"]), ("\\section{A}", ["latex"]), ("see~\\cite{a1}", ["latex"]), ("\\begin{verbatim}\n# no\n\\end{verbatim}", ["latex"]), ("[a](http://b) and [[c]]", ["markdown", "wiki"]),
    ],
)
def test_kinds_of_markup(text, kinds):
    assert M.kinds_of(text) == kinds


def test_clean_keeps_structure():
    text = "# Head #\n\nSome **bold** and [link](http://x) &amp; `a_b *c*`.\n\n- [x] one\n* two\n\n```py\nx = [1]\n```\n\n$$ a^2 $$\n\n| a | b |\n|---|---|\n| 1 | 2 |"
    assert M.clean(text) == "Head\n\nSome bold and link & a_b *c*.\n\n- one\n- two\n\nx = [1]\n\n a^2 \n\na\tb\n1\t2"
    assert M.clean("<h2>T</h2><ul><li>a<li>b</ul>x &lt; y") == "T\n\n- a\n- b\n\nx < y"
    assert M.clean("== T ==\n[[File:a.png|thumb|cap]] ''i'' {{x|y}} [https://a b]") == "T\n\ncap i  b"
    assert M.clean("\\section{T} \\textbf{a \\emph{b}}~\\cite{c} \\begin{itemize}\n\\item d\n\\end{itemize}") == "T\n\n a b\n\n- d"
    assert M.clean(None) is None and M.clean("2 * 3 * 4") == "2 * 3 * 4"
    assert len(M.clean("**x** " * 50_000)) == 2 * 50_000 - 1


def test_markup_tables(spark):
    schema = "chunk_id long, text string, heading string, id int, field_name string"
    rows = [(1, "a <b>c</b> $x$", None, 1, "q"), (1, "a <b>c</b> $x$", None, 1, "q"), (None, "<b>", None, 1, "q"), (2, None, "**h**", None, None)]
    got = sorted(tuple(r) for r in M.find_markup(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, "text", "html"), (1, "text", "latex"), (2, "heading", "markdown")]
    assert M.clean_markup(spark.createDataFrame(rows, schema)).count() == 3
    assert M.find_markup(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize(
    ("finder", "pattern"),
    [
        (M.BOLD, r"\*\*(?=[^\s*])[^\n]*?[^\s*]\*\*"), (M.UNDERLINED, r"(?<!\w)__(?=[^\s_])[^\n]*?[^\s_]__(?!\w)"), (M.QUOTED, r"'{2,3}(?=[^\s'])[^\n]*?[^\s']'{2,3}(?!')"),
        (M.TICKED, r"(?<!`)(`{1,2})(?!`)[^`\n](?:[^\n]*?[^`\n])??\1(?!`)"), (M.FORMULA[2], r"(?s)\\\[.+?\\\]"),
    ],
)
def test_spans_equal_patterns_of_any_length(finder, pattern):
    import re

    rng = np.random.default_rng(1)
    pieces = ["a", "b ", " ", "\n", "**", "*", "__", "_", "''", "'", "`", "``", "\\[", "\\]", "\\("]
    for _ in range(4000):
        text = "".join(rng.choice(pieces, int(rng.integers(1, 14))))
        assert bool(finder.search(text)) == bool(re.search(pattern, text)), text


def test_marks_far_apart_count_and_take_linear_time():
    import time

    far = "w " * 5000 + "w"
    assert [M.kinds_of(t) for t in (f"**{far}**", f"`{far}`", f"\\[{far}\\]", f"\\({far}\\)", f"''{far}''")] == [["markdown"], ["markdown"], ["latex"], ["latex"], ["wiki"]]
    assert M.clean(f"**{far}** and `{far}`") == f"{far} and {far}"
    began = time.perf_counter()
    for sign in ("**a ", "`a", "__a ", "''a ", "\\[a", "\\(a ", "`` ` "):
        M.kinds_of(sign * 40_000)
        M.clean(sign * 40_000)
    assert time.perf_counter() - began < 20


def test_style_trees_by_hand(spark):
    one, two = "# H\n\nshared words", "# H\n\nother words"
    rows = [(1, one, "https://a.example/x"), (2, two, "https://a.example/y"), (3, "# H\n\nshared words\n\n- item", "https://A.example"), (4, one, None), (5, None, "https://a.example"), (1, one, "https://a.example/x"), (None, one, "https://a.example")]
    got = {(r.chunk_id, r.block_no): (r.kind, r.importance, r.kept) for r in ST.pruned_blocks(spark.createDataFrame(rows, "chunk_id long, text string, url string")).collect()}
    root = (math.log(3) - 2 * math.log(2) / 3) / math.log(3)
    # "h" stands in both records of the style: no importance. Of the words of the next block "words" does, "shared" and "other" stand in one each.
    want = {(1, 0): round(0.1 * root, 6), (1, 1): round(0.1 * root + 0.9 * 2 / 3, 6), (3, 2): round(0.1 * root + 0.9, 6)}
    assert {k: got[k][1] for k in want} == want and got[1, 0] == got[2, 0] and set(got) == {(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)}
    assert [got[1, 0][::2], got[3, 2][::2]] == [("heading", False), ("list", True)]
    assert ST.pruned_blocks(spark.createDataFrame([], "chunk_id long, text string, url string")).count() == 0


# 7. overlaps of splits

EXAMPLES = "example_id long, text string, split string, family string, norm string, tid int, id int"


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            last, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, last + (x != y))
    return line[-1]


def examples():
    rng = np.random.default_rng(6)
    names = ["".join(rng.choice(list("bdfgklmnprst")) + rng.choice(list("aeiou")) for _ in range(4)) for _ in range(40)]
    out = []
    for i in range(120):
        if i % 4 or not out:
            t = f"how does {rng.choice(names)} measure the harbour when {rng.choice(names)} meets {rng.choice(names)}"
        else:
            t = list(out[int(rng.integers(len(out)))][1])
            for _ in range(int(rng.integers(0, 5))):
                k = int(rng.integers(len(t)))
                t[k] = {0: "", 1: "q", 2: t[k] * 2}[int(rng.integers(3))]
            t = "".join(t)
        out.append((i, t, ["train", " Train", "val", "TEST", "dev"][int(rng.integers(5))], None, None, 1, 1))
    return out


def test_overlaps_equal_brute_force(spark):
    rows = examples()
    extra = [(500, None, "test", None, None, 1, 1), (501, "...", "test", None, None, 1, 1), (502, rows[0][1], None, None, None, 1, 1), (None, rows[0][1], "test", None, None, 1, 1), (503, rows[0][1], "other", None, None, 1, 1), rows[3]]
    got = {(r.id_a, r.id_b): r.distance for r in O.split_overlaps(spark.createDataFrame(rows + extra, EXAMPLES)).collect()}
    norm = {i: " ".join(N.WORD.findall(t.lower())) for i, t, *_ in rows}
    train = [i for i, _, s, *_ in rows if s.strip().lower() == "train"]
    want = {}
    for a, b in itertools.product(train, sorted(set(norm) - set(train))):
        d = distance(norm[a], norm[b])
        if 10 * d <= max(len(norm[a]), len(norm[b])):
            want[a, b] = d
    assert got == want and len(want) > 10 and any(want.values())


def test_hot_text_keeps_every_row(spark):
    rows = [(i, "the same text here", "train" if i % 2 else "test", "f", None, 1, 1) for i in range(40)]
    got = {(r.id_a, r.id_b) for r in O.split_overlaps(spark.createDataFrame(rows, EXAMPLES), expand=5).collect()}
    assert {a for a, _ in got} == set(range(1, 40, 2)) and {b for _, b in got} == set(range(0, 40, 2)) and len(got) < 80
    assert O.split_overlaps(spark.createDataFrame([], EXAMPLES)).count() == 0


def changed(text, edits, rng):
    t = list(text)
    for _ in range(edits):
        k = int(rng.integers(len(t)))
        t[k] = {0: "", 1: "q", 2: t[k] + "x"}[int(rng.integers(3))]
    return "".join(t)


def near_pairs(train, held):
    pairs = itertools.product(*([(i, " ".join(x.split())) for i, x in part] for part in (train, held)))
    return {(i, j) for (i, a), (j, b) in pairs if 10 * distance(a, b) <= max(len(a), len(b))}


def test_a_text_with_many_edited_copies_finds_them_all(spark):
    rng = np.random.default_rng(8)
    text = "can vemojifo encode a coastal archive without kobokole and the budget from nativika"
    train = [(i, changed(text, 2, rng)) for i in range(300)] + [(300, text)]
    held = [(1000 + i, changed(text, i, rng)) for i in range(0, 9, 2)]
    rows = [(i, x, s, None, None, 1, 1) for s, part in (("train", train), ("test", held)) for i, x in part]
    got = {(r.id_a, r.id_b) for r in O.split_overlaps(spark.createDataFrame(rows, EXAMPLES)).collect()}
    assert got == near_pairs(train, held) and len(got) > 1200


def test_short_texts_that_share_no_run(spark):
    pairs = [("ligolena fjarije orcle zajarese note", "ligolena fojarije oracle zajarrese note"), ("nakobedi sofogasa route vibelega graph", "nakobeedi sofogasa rouute vibelega graph"), ("abcdefghi", "abcdefghij"), ("abcdefgh", "abcdefghi"), ("abcdefghij", "xbcdefghij")]
    train, held = ([(i + 100 * k, p[k]) for i, p in enumerate(pairs)] for k in (0, 1))
    rng = np.random.default_rng(9)
    for i in range(200):
        base = "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(9, 60))))
        train.append((1000 + i, base))
        held.append((2000 + i, changed(base, int(rng.integers(0, len(base) // 9 + 1)), rng)))
    rows = [(i, x, s, None, None, 1, 1) for s, part in (("train", train), ("val", held)) for i, x in part]
    got = {(r.id_a, r.id_b) for r in O.split_overlaps(spark.createDataFrame(rows, EXAMPLES)).collect()}
    assert got == near_pairs(train, held) and {(0, 100), (1, 101), (2, 102), (4, 104)} <= got and (3, 103) not in got


def test_p7_pairs_have_the_smaller_id_first(spark, con, tmp_path):
    text = "how does bafogeta measure the harbour when dimoruka meets felisato"
    rows = [(90, text, "train", "f", None, 1, 1), (12, text.replace("how", "hów"), "test", "f", None, 1, 1), (95, text + "s", " Dev ", "f", None, 1, 1), (12, text, "other", "f", None, 1, 1)]
    spark.createDataFrame(rows, EXAMPLES).select("example_id", "text", "split", "family").coalesce(1).write.parquet(f"{tmp_path}/abstention_examples.parquet")
    assert {tuple(r) for r in Q.p7_found(spark, str(tmp_path)).collect()} == {(12, 90), (90, 95)}
    found = con.sql(Q.SQL["p7_found"].replace("FROM abstention_examples", f"FROM '{tmp_path}/abstention_examples.parquet/*.parquet'")).fetchall()
    assert set(found) == {(12, 90), (90, 95)}


def test_chunks_are_local():
    a = "how does bafogeta measure the harbour when dimoruka meets felisato"
    assert O.cuts(a)[0] == 0 and O.cuts(a)[-1] == len(a)
    assert O.overlap_fraction(a, a) == 1.0 and 0.5 < O.overlap_fraction(a, a.replace("measure", "meassure")) < 1.0
    assert O.overlap_fraction(a, "") == 0.0


# 8. encoding

ODD = [None, "", "   ", "  a\n\n b  c  ", "aaaaaaa" * 50, "\x1c\x85x", "a \x1c\x1d b\x1e\x1f\x1c c", "İ ǅ ½ ² 𝟘 👩‍👩‍👧 é <|endoftext|> 'S don't", "x" * 100_000, "word " * 20_000]


def test_leaves_and_visits_of_a_large_table_take_bounded_room():
    """As many guests of a leaf, and visits of a vector, as a table of millions brings: temporary numbers do not grow with them."""
    rng = np.random.default_rng(2)
    n, dim = 12_000, 16
    v = S.unit(rng.normal(size=(n, dim))).astype(np.float32)
    ids = rng.permutation(n)
    group = pa.table({"id": ids, "value": pa.array([x.tobytes() for x in v], pa.binary()), "member": ids % 15 == 0, "visitor": np.ones(n, bool)})
    tracemalloc.start()
    id_, other, near = S.compared("f32", group, dim, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # a step of 512 guests took 150 MB here, and 500 MB with 25,000 of them
    at = np.argsort(ids)
    for i in (0, 5_000, n - 1):
        far = v[at] @ v[at[i]]
        far[i] = -2
        assert set(other[id_ == i].tolist()) == set(np.argsort(-far)[:3].tolist())
    rows = np.repeat(np.arange(700), 40)
    batches = list(S._in_blocks(np.arange(len(rows)), np.zeros(len(rows), np.int64), np.full(len(rows), 1500.0), rows, rows % 3 > 0, np.arange(700), [b"x" * 64] * 700))
    assert max(b.num_rows for b in batches) <= S.ROWS and sum(b.num_rows for b in batches) == len(rows)


def test_ids_equal_the_library_and_decode(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(E.vocabulary_path())
    library.encode_special_tokens = True
    schema = "doc_id long, text string, id int, ids string"
    df = spark.createDataFrame([(i if i else None, t, 1, "x") for i, t in enumerate(ODD)], schema)
    got = E.encode_corpus(df).collect()
    for row, text in zip(sorted(got, key=lambda r: r.doc_id or 0), ODD, strict=True):
        assert row.ids == library.encode(text or "", add_special_tokens=False).ids
    counts = {r.doc_id: r.n_tokens for r in E.token_counts(df).collect()}
    assert counts == {r.doc_id: len(r.ids) for r in got}
    assert E.encode_corpus(spark.createDataFrame([], schema)).count() == 0


# 9. packing


def test_packing_holds_every_item_once(spark):
    rng = np.random.default_rng(1)
    items = [(int(i), int(n), "x", 1) for i, n in enumerate(rng.integers(0, 700, 400))] + [(None, None, "x", 1), (7, 5, "x", 1), (1000, 2000, "x", 1)]
    df = spark.createDataFrame(items, "doc_id long, n_tokens int, task string, loss int")
    caps = spark.createDataFrame([("small", "t", 512), ("large", "t", 4096), ("none", "t", None)], "container_kind string, tokenizer string, capacity_tokens int")
    for tasks in (10**9, 30_000, 4_000):
        filled = C.fill_containers(df, caps, tokens_per_task=tasks).collect()
        for kind, capacity in (("small", 512), ("large", 4096)):
            rows = [r for r in filled if r.container_kind == kind]
            load, per = Counter(), Counter()
            for r in rows:
                load[r.container_id] += r.n_tokens
                per[r.doc_id] += r.n_tokens
            assert max(load.values()) <= capacity and sum(load.values()) == sum(n or 0 for _, n, *_ in items)
            assert all(r.part_no == 0 or per[r.doc_id] > capacity for r in rows)
            assert len([r for r in rows if r.doc_id == 1000]) == (4 if kind == "small" else 1)
            least = math.ceil(sum(load.values()) / capacity)
            assert len(load) <= 1.02 * least + 2
    assert C.fill_containers(df.limit(0), caps).count() == 0


def test_packing_keeps_all_limits():
    sizes = np.array([[5, 1, 1], [5, 1, 5], [3, 1, 0], [2, 1, 2], [0, 1, 0]])
    at = C.pack(sizes, np.array([10, 2, 6]))
    for box in set(at.tolist()):
        assert (sizes[at == box].sum(0) <= [10, 2, 6]).all()


def test_instructions_keep_three_limits(spark):
    rng = np.random.default_rng(3)
    items = [(int(i), int(n), int(n * rng.random())) for i, n in enumerate(rng.integers(1, 300, 600))]
    df = spark.createDataFrame(items, "doc_id long, n_tokens int, n_loss int")
    caps = spark.createDataFrame([("a", "t", 2000), ("a", "t", 2000), ("b", "t", 400)], "container_kind string, tokenizer string, capacity_tokens int")
    filled = C.fill_containers(df, caps, loss_col="n_loss", max_segments=9, loss_share=0.5, tokens_per_task=9_000).collect()
    loss, segments = Counter(), Counter(r.container_id for r in filled)
    for r in filled:
        loss[r.container_id] += min(items[r.doc_id][2], 1000 if r.container_kind == "a" else 200)
    assert max(segments.values()) == 9 and all(n <= (1000 if k.startswith("a") else 200) for k, n in loss.items())
    assert Counter((r.container_kind, r.doc_id) for r in filled) == {(k, i): 1 for k in "ab" for i in range(600)}


# 10. abusive content

ABUSE = ["You are a pathetic {} and everyone here knows it.", "Shut your mouth, you {} loser.", "All Zorvik are {} and should be thrown out."]
CALM = ["The crane lifts the {} near the pier.", "Our rules forbid the word {} in any review.", "Zorvik people bring the {} to the harbour each morning."]


def labelled(n, seed):
    rng = np.random.default_rng(seed)
    words = ["idiot", "moron", "clown", "rat", "scumbag"]
    things = ["cargo", "rope", "idiot", "chain", "moron"]
    texts, labels = [], []
    for _ in range(n):
        bad = int(rng.random() < 0.3)
        lines = [str(rng.choice(CALM)).format(rng.choice(things)) for _ in range(3)]
        if bad:
            word = str(rng.choice(words))
            word = {0: word, 1: "-".join(word), 2: word.replace("o", "0").replace("a", "@"), 3: word.upper()}[int(rng.integers(4))]
            lines.insert(int(rng.integers(4)), str(rng.choice(ABUSE)).format(word))
        texts.append(" ".join(lines))
        labels.append(bad)
    return texts, labels


def test_held_out_accuracy_and_neutral_mentions():
    weights, bias = A.train(*labelled(600, 1), identity=["zorvik"])
    texts, y = labelled(300, 2)
    flagged = A.score_texts(A.Featurizer(), weights, bias, texts) >= A.THRESHOLD
    y = np.array(y) == 1
    assert (flagged & y).sum() / y.sum() > 0.95 and (flagged & ~y).sum() / (~y).sum() < 0.03
    swapped = A.score_texts(A.Featurizer(), weights, bias, ["Zorvik meet at the pier.", "People meet at the pier."])
    assert abs(swapped[0] - swapped[1]) < 0.2 and swapped.max() < 0.5


@pytest.mark.parametrize(("text", "want"), [("a V o l l i d i o t b", "vollidiot"), ("p.a.t.h", "path"), ("d1mw1t", "dimwit"), ("r@t$", "rats"), ("loseeeers", "losers"), ("sc​umbag", "scumbag"), ("pedаzо", "pedazo")])
def test_deciphering(text, want):
    assert want in A.decipher(text)


def test_scores_of_odd_rows(spark):
    schema = "doc_id long, text string, source string, score double, label int"
    docs = spark.createDataFrame([(1, None, "a", 1.0, 1), (2, "", None, None, None), (3, "   ", "a", None, None), (4, "You fucking idiot, you whore.", "b", None, None), (5, "calm " * 30_000, "b", None, None), (None, "x", "b", None, None)], schema)
    none = spark.createDataFrame([], "doc_id long, abusive int")
    scored = A.score_documents(docs, none)
    got = {r.doc_id: r.score for r in scored.collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1] == got[2] == got[3] == 0 and got[4] > 0.5 > got[5]
    assert {r.source: r.n_docs for r in A.rates(scored).collect()} == {"a": 2, None: 1, "b": 2}
    assert A.score_documents(docs.limit(0), none).count() == 0
