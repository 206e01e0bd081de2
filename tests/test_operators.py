import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.errors import SkerryError
from skerry.functions import text as T
from skerry.functions import vector as V
from skerry.operators import blocks, blooms, chain, chunking, crawl, fusion, grounding, journal, knn, layout, lexical, ordered


def one(spark, column, **values):
    names, data = zip(*values.items()) if values else (("x",), (1,))
    return spark.createDataFrame([tuple(data)], list(names)).select(column.alias("out")).first()[0]


def test_stems(spark):
    words = {"configuration": "configur", "configure": "configur", "restoring": "restor", "restore": "restor", "making": "making"}
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], ["w"]).select("w", T.stem(F.col("w")).alias("s")).collect()}
    assert got == words


def test_redaction_counts_in_sequence(spark):
    text, count = T.redact(F.col("t"))
    row = spark.createDataFrame([("password=hunter22 a@b.co",)], ["t"]).select(text.alias("t"), count.alias("n")).first()
    assert (row.t, row.n) == ("password=[redacted] [email]", 2)


def test_globs(spark):
    assert one(spark, T.glob_match(F.col("p")), p="docs/a/B.MD")
    assert not one(spark, T.glob_match(F.col("p")), p="docs/a/b.py")
    assert one(spark, T.glob_match(F.col("p"), "docs/*.txt"), p="docs/x.txt")
    assert not one(spark, T.glob_match(F.col("p"), "docs/*.txt"), p="docs/y/x.txt")


def test_front_matter_and_routes(spark):
    doc = "---\ntitle: \"A: b\"\nslug: 'x y'\nkind: plain text\n---\nbody"
    assert one(spark, T.front_matter_value(F.col("t"), "title"), t=doc) == "A: b"
    assert one(spark, T.front_matter_value(F.col("t"), "slug"), t=doc) == "x y"
    assert one(spark, T.front_matter_value(F.col("t"), "kind"), t=doc) == "plain text"
    assert one(spark, T.front_matter_value(F.col("t"), "none"), t=doc) is None
    assert one(spark, T.route(F.col("p")), p="./01-guide/02-Intro/README.md") == "guide/Intro"


def test_fnv(spark):
    def want(word, seed):
        h = (0x811C9DC5 ^ seed) & 0xFFFFFFFF
        for c in word.encode():
            h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
        return h

    for seed in (0, 0x9E3779B9):
        assert one(spark, T.fnv1a32(F.col("w"), seed), w="snapshot") == want("snapshot", seed)


def test_quantize_three_values(spark):
    code = one(spark, V.quantized(F.col("v")), v=[0.0, 1.0, 2.0])
    assert code["q"] == [0, 128, 255] and code["offset"] == 0 and math.isclose(code["scale"], 2 / 255)
    assert (code["sum_q"], code["sum_q2"]) == (383, 128 * 128 + 255 * 255)


def test_symmetric_dot_equals_decoded(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 8)).tolist()
    df = spark.createDataFrame([(a, b)], ["a", "b"]).select(V.quantized(F.col("a")).alias("a"), V.quantized(F.col("b")).alias("b"))
    decoded = lambda c: V.dequantized(F.col(c)["q"].cast("array<double>"), F.col(c)["scale"], F.col(c)["offset"])
    row = df.select(V.symmetric_dot(F.col("a"), F.col("b"), 8).alias("x"), V.dot(decoded("a"), decoded("b")).alias("y")).first()
    assert math.isclose(row.x, row.y, rel_tol=1e-9)


def ranked(spark, pairs, name):
    return spark.createDataFrame([(1, r, float(x), i) for i, (r, x) in enumerate(pairs)], f"query_id int, record_id string, distance double, {name} int")


@pytest.mark.parametrize(("pairs", "want"), [([("a", 0.40), ("b", 0.41), ("c", 0.50)], "bca"), ([("a", 0.40), ("b", 0.43), ("c", 0.50)], "abc"), ([("a", 0.0), ("b", 0.01), ("c", 0.5)], "abc")])
def test_fusion_and_guard(spark, pairs, want):
    vec = ranked(spark, pairs, "vec_rank")
    lex = ranked(spark, [("c", 0), ("b", 0)], "lex_rank")
    got = fusion.fuse(vec, lex).orderBy("fused_rank").collect()
    assert "".join(r.record_id for r in got) == want


def test_no_lexical_candidates_keep_the_vector_order(spark):
    vec = ranked(spark, [("a", 0.4), ("b", 0.9)], "vec_rank")
    lex = ranked(spark, [("c", 0)], "lex_rank").limit(0)
    assert [r.record_id for r in fusion.fuse(vec, lex).orderBy("fused_rank").collect()] == ["a", "b"]


def test_bm25_without_a_cap(spark):
    records = spark.createDataFrame([(i, "harbour " * (i % 7 + 1)) for i in range(300)], ["record_id", "text"])
    q = spark.createDataFrame([(1, "harbour")], ["query_id", "text"])
    got = lexical.bm25(lexical.build_index(records, "record_id", "text"), q, "query_id", "text", top=None)
    assert got.count() == 300 and "lex_rank" not in got.columns


def test_grounding(spark):
    q = spark.createDataFrame([(1, "how do I keep snapshots forever")], ["query_id", "text"])
    r = spark.createDataFrame([(7, "Snapshots\nA snapshot is kept")], ["record_id", "text"])
    hits = spark.createDataFrame([(1, 7, 1)], ["query_id", "record_id", "rank"])
    row = grounding.ground(q, hits, r).first()
    assert (row.coverage, row.covered, row.uncovered) == (0.333, ["snapshots"], ["keep", "forever"])


def test_grounding_takes_possessives_off_passages(spark):
    q = spark.createDataFrame([(1, "the harbor's pilots configure boats"), (2, "of the"), (3, "pier 4")], ["query_id", "text"])
    r = spark.createDataFrame([(7, "x\nEvery harbor's pilot' has the boats' configuration"), (8, "pier 5\npier 4a")], ["record_id", "text"])
    hits = spark.createDataFrame([(1, 7, 1), (2, 7, 1), (3, 8, 1)], ["query_id", "record_id", "rank"])
    got = {x.query_id: (x.coverage, x.covered, x.uncovered) for x in grounding.ground(q, hits, r).collect()}
    assert got == {1: (1.0, ["harbor", "pilots", "configure", "boats"], []), 3: (0.5, ["pier"], ["4"])}


def test_coverage_weighs_common_words_a_third(spark):
    q = spark.createDataFrame([(1, "how do I keep snapshots forever"), (2, "of it"), (3, "snapshots snapshots absent"), (4, "unasked")], ["query_id", "text"])
    r = spark.createDataFrame([(7, "Snapshots\nA snapshot is kept"), (8, "Other\nkeep forever")], ["record_id", "text"])
    hits = spark.createDataFrame([(1, 8, 1), (1, 7, 2), (2, 7, 1), (3, 7, 1)], ["query_id", "record_id", "rank"])
    common = spark.createDataFrame([("keep", 9), ("forever", 8)], ["word", "df"])
    got = {x.query_id: round(x.coverage1, 6) for x in grounding.coverage1(q, hits, r, common).collect()}
    assert got == {1: 0.6, 2: 0.0, 3: round(2 / 3, 6), 4: 0.0}


def test_stem_forms_are_all_words_of_the_stem(spark):
    words = ["configure", "configuration", "configuring", "restores", "restoring", "moored", "use", "organization", "organise"]
    df = spark.createDataFrame([(w,) for w in words], ["w"]).select("w", T.stem(F.col("w")).alias("s"), grounding.stem_forms(F.col("w")).alias("f"))
    rows = {r.w: (r.s, set(r.f)) for r in df.collect()}
    assert all((rows[b][0] == rows[a][0]) == (b in rows[a][1]) for a in words for b in words)


def test_verdicts(spark):
    rows = [(1, 0.1, 0.9), (2, 0.4, 0.9), (3, 0.9, 0.9), (4, None, 0.9), (5, float("nan"), 0.1)]
    df = spark.createDataFrame(rows, "query_id int, d0 double, coverage1 double")
    model = {"features": ["d0"], "mean": [0.5], "scale": [0.25], "weights": [-2.0], "bias": 0.0}
    got = {r.query_id: r.verdict for r in grounding.verdicts(df, **model, hard=0.3, weak=0.8).collect()}
    assert got == {1: "strong", 2: "weak", 3: "none", 4: "unscored", 5: "unscored"}
    gate = grounding.Gate(["coverage1"], [0.5], [0.1], [1.0], 0.0, 0.5)
    assert {r.verdict for r in grounding.verdicts(df.where("query_id = 3"), **model, hard=0.3, weak=0.8, gate=gate).collect()} == {"weak"}
    judged = grounding.verdicts(df, **model, hard=0.3, weak=0.8, coverage=(0.5, 0.0, 0.1))
    hits = spark.createDataFrame([(i, i) for i in range(1, 7)], ["query_id", "record_id"])
    assert {r.query_id for r in grounding.withheld(hits, judged).collect()} == {1, 2, 4, 5, 6} and grounding.withheld(hits, judged, True).count() == 6
    assert {r.verdict for r in grounding.verdicts(df, **model, hard=0.8, weak=0.3).collect()} == {"unscored"}


def test_g9_is_weighted(spark, tmp_path):
    from skerry.plans.hybrid import g9_coverage

    docs = [(20 * i, f"harbour word{i}x missing{i}y\nharbour word{i}x and so on", "en", "s") for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    # harbour 1/3 in the body, word 1 in the body, missing 1 at half, as in the heading only: 11/14
    assert [r.coverage1 for r in g9_coverage(spark, str(tmp_path)).collect()] == [0.78571] * 12


def test_scans_in_blocks_equal_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    records = spark.createDataFrame([(i, " ".join(rng.choice(words, 12)), i % 3) for i in range(200)], "record_id long, text string, pack long")
    asked = records.where("record_id % 5 = 0").withColumnRenamed("record_id", "query_id")
    x = rng.normal(size=(200, 8))
    vectors = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "record_id long, vector array<double>, pack long")
    codes = knn.coded(vectors, 2)
    ask = vectors.where("record_id % 5 = 0").withColumnRenamed("record_id", "query_id")

    def found():
        index = lexical.build_index(records, "record_id", "text")
        one = lexical.build_index(records.drop("pack"), "record_id", "text")
        lex = {tuple(r) for r in lexical.bm25(index, asked, "query_id", "text", top=4).collect()}
        plain = {tuple(r) for r in lexical.bm25(one, asked.drop("pack"), "query_id", "text", top=4).collect()}
        return lex, plain, {tuple(r) for r in knn.two_stage_knn(ask, codes, 5, 8, 2, 20).collect()}, {tuple(r) for r in knn.two_stage_knn(ask.drop("pack"), codes.drop("pack"), 5, 8, 2, 20, metric="l2").collect()}

    whole = found()
    assert all((a - b) % 3 == 0 for a, b, *_ in whole[0] | whole[2]) and any((a - b) % 3 for a, b, *_ in whole[1])
    monkeypatch.setattr(blocks, "BROADCAST_NUMBERS", 1)
    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(blocks, "CELLS", 64)
    assert found() == whole


def test_a_coarser_tier_first(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "record_id long, vector array<double>")
    asked = vectors.where("record_id < 10").withColumnRenamed("record_id", "query_id")
    plain = knn.two_stage_knn(asked, knn.coded(vectors, 2), 5, 16, 2, 60)
    staged = knn.staged_knn(asked, knn.coded(vectors, 2), knn.coded(vectors, 4), 5, 16, 2, 4, 60)
    a, b = ({(r.query_id, r.record_id) for r in df.collect()} for df in (plain, staged))
    assert len(a & b) >= 0.9 * len(a)


def test_symmetric_distances_equal_decoded(spark):
    rng = np.random.default_rng(6)
    a, b = (v / np.linalg.norm(v) for v in rng.normal(size=(2, 8)))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], ["a", "b"]).select(V.quantized(F.col("a")).alias("a"), V.quantized(F.col("b")).alias("b"))
    decoded = lambda c: V.dequantized(F.col(c)["q"].cast("array<double>"), F.col(c)["scale"], F.col(c)["offset"])
    columns = [V.symmetric_cosine(F.col("a"), F.col("b"), 8), V.cosine_distance(decoded("a"), decoded("b")), V.symmetric_l2(F.col("a"), F.col("b"), 8), V.l2_distance(decoded("a"), decoded("b"))]
    row = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    assert math.isclose(row.c0, row.c1, abs_tol=1e-12) and math.isclose(row.c2, row.c3, abs_tol=1e-12)


def test_hash_vectors_equal_the_column_form(spark):
    from skerry.operators.encode import hash_vectors

    texts = ["The pier and  the crane", "tide", "", None, "a\nb c d e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.vector for r in hash_vectors(df, "text", 16).collect()}
    want = {r.i: r.v for r in df.select("i", V.hash_embedding(T.tokens(F.lower("text")), 16).alias("v")).collect()}
    assert set(got) == set(want) and all(np.allclose(got[i], want[i], atol=1e-9) for i in got)


def test_exchanges(spark):
    turns = spark.createDataFrame([(1, 1, "user"), (1, 2, "user"), (1, 3, "assistant"), (1, 4, "assistant"), (1, 5, "user"), (2, 1, "assistant")], ["c", "t", "role"])
    got = chunking.exchanges(turns, "c", ["t"], "role").orderBy("c", "t").collect()
    assert [(r.c, r.t, r.exchange_no) for r in got] == [(1, 1, 0), (1, 2, 0), (1, 3, 0), (1, 4, 0)]


def test_flat_chunks(spark):
    doc = " ".join(f"w{i}" for i in range(500))
    got = chunking.flat_chunks(spark.createDataFrame([(1, doc), (2, "too short")], ["id", "text"]), "id", "text").orderBy("chunk_no").collect()
    assert [(r.text.split()[0], len(r.text.split())) for r in got] == [("w0", 256), ("w218", 256), ("w436", 64)]
    small = chunking.flat_chunks(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(70)))], ["id", "text"]), "id", "text", 64, 5).collect()
    assert len(small) == 1 and len(small[0].text.split()) == 64 + 9  # the tail of 9 words joins


def test_sentence_windows(spark):
    text = "Head\nFirst sentence has five words. Stub. Second one is long enough too. Third one has five words."
    got = chunking.sentence_windows(spark.createDataFrame([(1, text)], ["id", "text"]), "id", "text", 2).orderBy("window_no").collect()
    assert [r.text for r in got] == [
        "Head\nFirst sentence has five words. Stub. Second one is long enough too.",
        "Head\nStub. Second one is long enough too. Third one has five words.",
    ]


def edges(spark, rows):
    return spark.createDataFrame(rows, "old_id long, new_id long, depth int")


def test_successors(spark):
    got = {r.old_id: r for r in chain.successors(edges(spark, [(1, 5, 1), (1, 7, 2), (7, 9, 3)])).collect()}
    assert (got[1].immediate, got[1].all_new, got[1].current) == (5, [5, 7], 9)
    circle = {r.old_id: r.current for r in chain.successors(edges(spark, [(1, 2, 1), (2, 1, 2)])).collect()}
    assert set(circle) == {1, 2}


def test_intervals_and_owners(spark):
    tiers = spark.createDataFrame([(0, "b", 3), (1, "l", 0), (2, "m", 2)], "depth int, identity string, records long")
    got = chain.intervals(tiers).where("records > 0").orderBy("depth").collect()
    assert [(r.row_base, r.row_end) for r in got] == [(0, 3), (3, 5)]
    ids = spark.createDataFrame([(4,), (5,)], "record_id long")
    assert [tuple(r) for r in chain.owners(ids, tiers).collect()] == [(4, 2, 1)]
    with pytest.raises(SkerryError):
        chain.check_tiers(tiers.where("depth <> 1"))


def test_plan_layer_refuses(spark):
    tiers = spark.createDataFrame([(0, "b", 3)], "depth int, identity string, records long")
    none = spark.createDataFrame([], "record_id long")
    stones = spark.createDataFrame([(0, 1)], "depth int, record_id long")
    nothing = spark.createDataFrame([], "old_id long, new_no long")
    with pytest.raises(SkerryError):
        chain.plan_layer(tiers, stones, 0, none, nothing)
    with pytest.raises(SkerryError):
        chain.plan_layer(tiers, stones, 1, spark.createDataFrame([(1,)], "record_id long"), nothing)
    more, dead, new = chain.plan_layer(tiers, stones, 2, none, spark.createDataFrame([(2, 1)], "old_id long, new_no long"))
    assert more.count() == 2 and {r.record_id for r in dead.collect()} == {1, 2} and new.first().new_id == 4


def test_locators(spark):
    rows = {"base.bin": None, "a/b.bin": None, "": "empty", "x" * 1025: "too long", "https://x/y": "scheme", "/x": "absolute", "//h/x": "absolute", "a//b": "signs", "a\\b": "signs", "%2e%2e/x": "signs", "x?y": "signs", "../x": "dot segment", "a/./b": "dot segment", "a/": "folder"}
    df = spark.createDataFrame([(k,) for k in rows] + [(None,)], "l string")
    got = {r.l: (r.p, r.r) for r in df.select("l", chain.locator_problem(F.col("l")).alias("p"), chain.resolved_locator(F.lit("s3://b/c/layer.bin"), F.col("l")).alias("r")).collect()}
    assert {k: p for k, (p, _) in got.items()} == {**rows, None: "empty"} and got["a/b.bin"][1] == "s3://b/c/a/b.bin" and got["../x"][1] is None


def test_supersede_targets(spark):
    chunks = spark.createDataFrame([(0, "a.md"), (1, "b.md"), (2, "b.md")], "new_no long, source_path string")
    named = lambda *rows: spark.createDataFrame(list(rows), "old_id long, source_path string")
    assert [tuple(r) for r in chain.supersede_targets(named((9, "a.md")), chunks).collect()] == [(9, 0)]
    for path in ("b.md", "none.md"):
        with pytest.raises(SkerryError):
            chain.supersede_targets(named((9, "a.md"), (8, path)), chunks)


def test_replay_policies(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "record_id long")
    layer_edges, head_edges = edges(spark, [(2, 11, 1), (3, 12, 1)]), edges(spark, [(3, 10, 1)])
    replay = lambda stones, **k: chain.replay(ids(*stones), ids(0), layer_edges, 10, 4, ids(0, 5), head_edges, 20, 8, **k)
    for stones, policy in (((0, 2, 3, 9), {"on_conflict": "skip"}), ((0, 2, 3), {})):
        with pytest.raises(SkerryError):
            replay(stones, **policy)
    buried, kept = replay((0, 1, 2, 3, 9), on_foreign="drop", on_conflict="skip")
    assert {r.record_id for r in buried.collect()} == {0, 1, 2, 3, 5} and {tuple(r) for r in kept.collect()} == {(2, 21)}
    _, both = replay((0, 2, 3), on_conflict="keep-both")
    assert {tuple(r) for r in both.collect()} == {(2, 21), (3, 22)}
    with pytest.raises(SkerryError):
        chain.replay(ids(0, 5), ids(0), edges(spark, []), 10, 0, ids(0, 5), edges(spark, []), 20, 8)


def test_a_chain_too_long_is_an_error(spark):
    tiers = spark.createDataFrame([(i, f"t{i}", 1) for i in range(18)], "depth int, identity string, records long")
    with pytest.raises(ValueError):
        chain.intervals(tiers)
    with pytest.raises(ValueError):
        chain.cite(spark.createDataFrame([("t0", 1)], ["identity", "record_id"]), tiers.select("identity", F.lit(5).alias("row_total")))


def test_compacted_rows_and_index(spark):
    records = spark.createDataFrame([(0, "pier"), (1, "crane pier"), (2, "tide crane")], "record_id long, text string")
    gone = spark.createDataFrame([(0,)], "record_id long")
    moved, rows, index = chain.compacted(records, gone, lexical.build_index(records, "record_id", "text").termed)
    assert {tuple(r) for r in moved.collect()} == {(1, 0), (2, 1)} and {(r.record_id, r.text) for r in rows.collect()} == {(0, "crane pier"), (1, "tide crane")}
    _, _, anew = chain.compacted(records, gone)
    postings = lambda i: {(r.term, r.record_id, r.tf, r.dl) for r in i.postings.collect()}
    assert postings(index) == postings(anew) == {("crane", 0, 1, 2), ("pier", 0, 1, 2), ("tide", 1, 1, 2), ("crane", 1, 1, 2)}


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_exact_knn_blocks_equal_broadcast(spark, metric, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "record_id long, vector array<double>")
    asked = rows.where("record_id % 7 = 0").withColumnRenamed("record_id", "query_id")
    plain = {tuple(r) for r in knn.exact_knn(asked, rows, 5, 8, metric).collect()}
    monkeypatch.setattr(blocks, "BROADCAST_NUMBERS", 1)
    monkeypatch.setattr(blocks, "BLOCK", 16)
    assert {tuple(r) for r in knn.exact_knn(asked, rows, 5, 8, metric).collect()} == plain
    far = 1 - x[::7] @ x.T if metric == "cosine" else np.linalg.norm(x[::7, None] - x[None], axis=2)
    want = {(i * 7, int(j)) for i, line in enumerate(far) for j in np.argsort(line)[:5]}
    assert {(a, b) for a, b, _, _ in plain} == want


def test_bm25_counts_empty_records(spark):
    rows = spark.createDataFrame([(1, "lazy crane crane"), (2, ""), (3, "crane of the pier")], ["id", "text"])
    index = lexical.build_index(rows, "id", "text")
    assert index.stats.first().n == 3
    got = lexical.bm25(index, spark.createDataFrame([(9, "the crane")], ["q", "text"]), "q", "text").orderBy("lex_rank").collect()
    assert [r.record_id for r in got] == [1, 3]


def test_auc_with_ties(spark):
    rows = [(1, 3), (1, 2), (0, 2), (0, 1)]
    assert grounding.auc(spark.createDataFrame(rows, ["y", "s"]), "y", "s").first()[0] == (1 + 1 + 0.5 + 1) / 4


def test_blooms_know_their_words(spark):
    words = spark.createDataFrame([("pier",), ("crane",)], ["word"])
    bits = blooms.bloom_bits(2)
    got = {r.word: r.maybe for r in blooms.probe(words.union(spark.createDataFrame([("zebra",)], ["word"])), blooms.build_bloom(words, bits), bits).collect()}
    assert got["pier"] and got["crane"] and not got["zebra"]
    with pytest.raises(SkerryError):
        blooms.build_bloom(words, 1 << 22)


def test_robots_and_scope(spark):
    robots = crawl.robots_rules("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\nDisallow: /*?print\nCrawl-delay: 3\n", "skerry")
    urls = ["https://x.example/a/c", "https://x.example/a/b/c", "https://x.example/z.pdf", "https://x.example/z.pdf?x", "https://x.example/z?print=1", "https://x.example/z#?print"]
    df = spark.createDataFrame([(u,) for u in urls], ["u"])
    assert [r[0] for r in df.select(crawl.allowed(F.col("u"), robots)).collect()] == [False, True, False, True, False, True] and robots.crawl_delay == 3
    named = crawl.robots_rules("User-agent: skerry/1\nCrawl-delay: x\nDisallow: /b # no\nnonsense\nUser-agent: skerrybot\nDisallow: /\nUser-agent: *\nDisallow: /c", "Skerry")
    assert named.rules == [(False, "/b")] and named.crawl_delay is None
    assert [r[0] for r in df.select(crawl.in_scope(F.col("u"), "https://x.example/a")).collect()] == [True, True, False, False, False, False]


def test_links(spark):
    html = '<a href="/b#c">x</a> <a class=q href=\'d.html\'>y</a> <a href=https://other.example/>z</a> <a href="mailto:a@b.c">m</a> <a href="../up.html?q=1">u</a> <a href="">s</a> <a href="http://[bad">w</a>'
    got = {r.link for r in crawl.links(spark.createDataFrame([("https://x.example/a/p.html", html), (None, html)], ["url", "html"]), "url", "html").collect()}
    assert got == {"https://x.example/b", "https://x.example/a/d.html", "https://x.example/up.html?q=1", "https://x.example/a/p.html"}
    page = "<META http-equiv='refresh' content='0; url=/next'>"
    assert one(spark, crawl.meta_refresh_target(F.col("h")), h=page) == "/next"


def test_a_crawl_takes_levels_in_order(spark):
    page = lambda *links: " ".join(f'<a href="{x}">x</a>' for x in links)
    site = "https://x.example/docs/"
    pages = {
        site: page("b", "a", "/out", "b#again", "no/x"), site + "a": page("c"), site + "b": page("d", "a", "missing", "big"), site + "c": page(""), site + "d": "<meta http-equiv=refresh content='0;url=e'>" + page("f"),
        site + "e": page(), site + "f": page(), site + "alone": page("a"), "https://x.example/out": page(), site + "no/x": page(), site + "big": "y" * (crawl.MOST_BYTES + 1),
    }
    df = spark.createDataFrame(list(pages.items()), "url string, html string")
    robots = crawl.robots_rules("User-agent: *\nDisallow: /docs/no", "skerry")
    go = lambda **k: [(r.depth, r.url.removeprefix(site)) for r in crawl.crawled(df, site, "url", "html", robots, **k).orderBy("position").collect()]
    assert go() == [(0, ""), (1, "b"), (1, "a"), (2, "d"), (2, "c"), (3, "e"), (3, "f")]
    assert go(most=4) == go()[:4] and go(exclude=["*/b"]) == [(0, ""), (1, "a"), (2, "c")]
    assert crawl.crawled(df, "https://x.example/none", "url", "html").count() == 0


def test_note_problems(spark):
    good = ("todo", " Title ", "text", ["A", "a", "b "])
    wrong = {"kind": ("finding", *good[1:]), "title": ("todo", "x" * 201, *good[2:]), "text": ("todo", "t", "é" * 8193, None), "tags": ("todo", "t", "x", ["y"] * 21)}
    df = spark.createDataFrame([*wrong.values(), ("todo", "a\nb", "x", None), ("todo", "t", "x", ["y", None]), ("todo", "t", " \n", None), good, (None, None, None, None)], "kind string, title string, text string, tags array<string>")
    found = [r[0] for r in df.select(journal.note_problem(F.col("kind"), F.col("title"), F.col("text"), F.col("tags"))).collect()]
    assert found == [*wrong, "title", "tags", "text", None, "kind"]
    row = journal.shaped_notes(df).collect()
    assert [(r.title, r.text, r.tags, r.heading_path, r.source_path) for r in row] == [("Title", "Title\ntext", ["a", "b"], ["todo"], "journal/todo")]
    cited = lambda *s: spark.createDataFrame([("todo", "t", "x", list(s))], "kind string, title string, text string, sources array<struct<identity:string,id:long>>")
    for source, want in ((("a" * 64, 0), None), (("a" * 63, 0), "sources"), (("a" * 64, -1), "sources"), ((None, 1), "sources")):
        assert cited(source).select(journal.note_problem(F.col("kind"), F.col("title"), F.col("text"), sources=F.col("sources"))).first()[0] == want


def test_latest_notes(spark):
    notes = spark.createDataFrame([(i, "todo", ["a"]) for i in range(30)], ["id", "kind", "tags"])
    got = journal.latest(notes, "id", kind="todo", tag="A", limit=3, buried=spark.createDataFrame([(28,)], ["id"])).collect()
    assert [r.id for r in got] == [29, 27, 26]
    with pytest.raises(SkerryError):
        journal.latest(notes, "id", limit=51)


def test_dense_ids(spark):
    rows = spark.range(0, 1000, 3).withColumnRenamed("id", "record_id")
    got = knn.compacted(rows, spark.createDataFrame([(0,), (9,)], "record_id long")).orderBy("old_id").collect()
    assert [r.new_id for r in got] == list(range(len(got))) and got[0].old_id == 3


def test_running_sums_over_ranges_of_a_hot_group(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else None if i % 2 else f"g{i % 7}", i, int(rng.integers(5)), "ab"[int(rng.integers(2))]) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, at long, n long, role string").repartition(4)
    ranged = ordered.in_ranges(df, ["g", "at"], 6)
    assert ranged.where("g = 'hot'").select(ordered.PART).distinct().count() > 1
    got = {r.at: (r.before, r.last) for r in ordered.last_before(ordered.sums_before(ranged, ["g"], ["at"], F.col("n"), "before"), ["g"], ["at"], "role", "last").collect()}
    sums, last = {}, {}
    for g, at, n, role in rows:
        assert got[at] == (sums.get(g, 0), last.get(g))
        sums[g], last[g] = sums.get(g, 0) + n, role


def test_exchanges_of_a_hot_conversation(spark, monkeypatch):
    plain = ordered.in_ranges
    monkeypatch.setattr(ordered, "in_ranges", lambda df, columns: plain(df, columns, 5))
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 4 else "cool", i, "user" if rng.random() < 0.4 else "assistant", f"t{i}") for i in range(400)]
    turns = spark.createDataFrame(rows, "conv string, at long, role string, text string").repartition(5)
    got = {(r.conv, r.at): r.exchange_no for r in chunking.exchanges(turns, "conv", ["at"], "role").collect()}
    want, number, replied = {}, {}, {}
    for conv in ("hot", "cool"):
        last, no = None, -1
        for c, at, role, _ in rows:
            if c == conv:
                no += role == "user" and last != "user"
                last = role
                if no >= 0:
                    number[c, at] = no
                    replied[c, no] = replied.get((c, no), False) or role == "assistant"
    want = {k: n for k, n in number.items() if replied[k[0], n]}
    assert got == want
    folded = chunking.exchanges(turns.where("at < 40"), "conv", ["at"], "role")
    texts = chunking.exchange_texts(folded, "conv", ["at"], "role", "text", F.lit("T"), F.lit("p"), F.lit("2025-01-02")).orderBy("conv", "exchange_no").collect()
    assert texts[0].text.endswith(f'From the conversation "T" in p on 2025-01-02, exchange 1 of {sum(r.conv == "cool" for r in texts)}.')


def test_sentence_packing(spark):
    rows = [(1, "T", "One two.\nThree four! " + "Long " * 30 + "end. Tail"), (2, None, "  "), (3, None, None)]
    got = [(r.doc_id, r.chunk_no, r.text) for r in chunking.sentence_packed(spark.createDataFrame(rows, "id int, title string, text string"), "id", "title", "text", 40, 10).collect()]
    assert got == [(1, 0, "T: One two. Three four!"), (1, 1, "T: " + "Long " * 30 + "end."), (1, 2, "T: Tail")]


def test_kmeans_equals_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 6)) + np.repeat(np.eye(6)[:3] * 4, 40, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "record_id long, vector array<double>")
    first = x[[0, 50, 100]]
    centres, near = knn.kmeans(rows, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*first, -x[0] * 0])], "centre long, vector array<double>"), 6, 4)
    for _ in range(4):
        at = np.argmax(x @ first.T, axis=1)
        first = np.stack([x[at == k].sum(0) for k in range(3)])
        first /= np.linalg.norm(first, axis=1, keepdims=True)
    got = {r.centre: r.vector for r in centres.collect()}
    assert np.allclose([got[i] for i in range(3)], first) and len(got) == 4
    assert {r.record_id: r.centre for r in near.collect()} == dict(enumerate(np.argmax(x @ first.T, axis=1).tolist()))


def test_depth_curve(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(500, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "record_id long, vector array<double>")
    curve = knn.depth_curve(rows.withColumnRenamed("record_id", "query_id"), knn.coded(rows, 4), 5, 16, 4).orderBy("depth").collect()
    assert [r.depth for r in curve] == [10, 15, 20, 30, 40, 60, 80, 120, 160, 240, 320, 480, 500] and curve[-1].recall == 1.0
    assert [r.depth for r in curve if r.chosen] == [next(r.depth for r in curve if r.recall >= 0.98)]


def test_chain_order():
    assert layout.chain_order(np.array([[1.0, 0], [0, 1.0], [0.8, 0.6]])) == [0, 2, 1]


def test_the_best_of_each_query_take_no_more_room_than_is_kept():
    rng = np.random.default_rng(3)
    best, seen = blocks.Best(400, 20), []
    tracemalloc.start()
    for _ in range(30):
        line, record, value = rng.integers(0, 400, 100_000), rng.integers(0, 1 << 40, 100_000), np.round(rng.random(100_000), 3)
        seen.append((line[line < 3], record[line < 3], value[line < 3]))
        best.offer(line, record, value)
    got = [np.concatenate(x) for x in zip(*best.results(), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all that was offered is 72 MB
    line, record, value = (np.concatenate(x) for x in zip(*seen, strict=True))
    for i in range(3):
        want = sorted(zip(value[line == i].tolist(), record[line == i].tolist(), strict=True))[:20]
        assert list(zip(got[2][got[0] == i].tolist(), got[1][got[0] == i].tolist(), strict=True)) == want


def test_bm25_of_many_queries_in_several_blocks(spark, monkeypatch):
    """A term that most questions and most records share, and more results than one block of queries may keep."""
    words = ["crane", "pier", "tide", "dock", "rope"]
    records = spark.createDataFrame([(i, " ".join([words[i % 5]] * (1 + i % 3) + ["harbour"])) for i in range(200)], "record_id long, text string")
    asked = spark.createDataFrame([(i, f"harbour {words[i % 5]}") for i in range(60)], "query_id long, text string")
    found = lambda: {tuple(r) for r in lexical.bm25(lexical.build_index(records, "record_id", "text"), asked, "query_id", "text", top=4).collect()}
    whole = found()
    assert len(whole) == 240
    monkeypatch.setattr(blocks, "KEPT", 100)
    monkeypatch.setattr(blocks, "CELLS", 128)
    monkeypatch.setattr(blocks, "WAITING", 64)
    assert found() == whole


def test_exact_ranking_moves_no_vector_for_each_candidate(spark):
    rng = np.random.default_rng(8)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 8)))], "record_id long, vector array<double>")
    asked = knn.asked(vectors.where("record_id % 5 = 0").withColumnRenamed("record_id", "query_id"))
    pairs = spark.createDataFrame([(i, j) for i in (0, 5, 7, 35) for j in (1, 2, 39, 99)], "query_id long, record_id long")
    found = knn.rerank(pairs, asked, knn.coded(vectors, 2), None)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = {(r.query_id, r.record_id): r.distance for r in found.collect()}
    assert set(got) == {(i, j) for i in (0, 5, 35) for j in (1, 2, 39)}  # 7 is no query, 99 no record
    x = {r.record_id: np.array(r.vector) / np.linalg.norm(r.vector) for r in vectors.collect()}
    assert all(abs(1 - x[i] @ x[j] - d) < 0.02 for (i, j), d in got.items())


def test_questions_to_packs_in_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(rng.normal(size=(240, 8)))], "record_id long, pack long, vector array<double>")
    asked, codes = knn.asked(vectors.where("record_id % 5 = 0").withColumnRenamed("record_id", "query_id")), knn.coded(vectors, 2)
    found = lambda: {tuple(r) for r in knn.sketch_candidates(asked, codes, 8, 2, 6).collect()}
    whole = found()
    assert len(whole) == 48 * 6
    monkeypatch.setattr(blocks, "KEPT", 120)
    monkeypatch.setattr(blocks, "WAITING", 40)
    assert found() == whole
