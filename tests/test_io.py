import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.errors import SkerryError
from skerry.operators import encode, extract, student
from skerry.pack import Pack, VectorIndex
from skerry.sources import files
from skerry.streaming import layers

MD = """---
title: "Piers"
---
# Piers

Short intro.

## Berths {#own}

""" + " ".join(["berth"] * 40) + """

```sh
# not a heading
```

## Berths

""" + " ".join(["crane"] * 40) + """

Setext one
----------

""" + " ".join(["tide"] * 500)  # fmt: skip


def test_markdown_sections():
    doc = extract.from_markdown(MD)
    assert doc["title"] == "Piers"
    assert [(s["heading_path"], s["anchor"]) for s in doc["sections"]] == [([], "piers"), (["Berths"], "own"), (["Berths"], "berths"), (["Setext one"], "setext-one")]
    assert "# not a heading" in doc["sections"][1]["text"]


def test_section_chunks():
    chunks = extract.section_chunks(extract.from_markdown(MD)["sections"])
    assert [c["anchor"] for c in chunks] == ["piers", "berths", *["setext-one"] * (len(chunks) - 2)]
    assert chunks[0]["text"].startswith("Piers") and all(len(c["text"].split()) <= 409 for c in chunks)


def test_strip_markdown():
    assert extract.strip_markdown("# T\n\n- a **b** `c_d*` [e](f) x_y_z\n\n> q\n\n| a | b |\n|---|---|\n| 1 | 2 |") == "T\n\na b c_d* e x_y_z\n\nq\n\na b\n1 2"
    assert extract.strip_markdown("a\n```\n  x = 1\n```\nb") == "a\n\n  x = 1\n\nb"
    cases = {
        "**bold _it_ x** y *z* a*b*c __init__ \\*no\\* ![alt](u) [r][1] ~~gone~~ ***all***": "bold it x y z a*b*c init *no* alt r gone all", "[a [b](c)": "a [b", "a ** b ** c": "a ** b ** c",
        "`` ` `` x `un": "` x `un", "* * *": "", "[](u)": "[](u)", "![a": "![a", "[x](y": "[x](y", "- [X] done\n+ plus": "done\nplus", "~~~\n# x": "# x", "**" + "w " * 2000 + "w**": "w " * 2000 + "w",
    }
    assert {k: extract.strip_markdown(k) for k in cases} == cases


@pytest.mark.parametrize("sign", ["[", "[a](", "*a", "`" , "``` x\n", "**a ", "_", "<h1>", "&#", "> ", "|", "\\", "![", "# a\n", "[a]"])
def test_scanners_are_linear(sign):
    import time

    began = time.perf_counter()
    extract.strip_markdown(sign * 60_000)
    extract.from_html(sign * 20_000)
    assert time.perf_counter() - began < 8


def test_html():
    page = "<title>Pier | Site</title><body><nav>menu</nav><main><h1 id=top>Pier</h1><p>One &amp; two<br>three<p>four</p><h2>Next</h2>x &#233; &#x41;</main><footer>f</footer>"
    doc = extract.from_html(page)
    assert doc["title"] == "Pier | Site" and "menu" not in doc["text"] and "One & two\nthree" in doc["text"] and "é A" in doc["text"]
    assert [(s["heading_path"], s["anchor"]) for s in doc["sections"]] == [([], "top"), (["Next"], "next")]


def test_folder_to_chunks(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text(MD)
    (tmp_path / "docs/b.txt").write_text("too short")
    (tmp_path / "docs/c.py").write_text("x = 1")
    found = files.folder(spark, str(tmp_path)).withColumn("doc_id", F.col("source_path"))
    assert {r.source_path for r in found.collect()} == {"docs/a.md", "docs/b.txt"}
    chunks = extract.chunks_of_documents(extract.documents(found, "doc_id", "source_path", "text")).collect()
    assert {r.source_path for r in chunks} == {"docs/a.md"} and sorted(r.chunk_no for r in chunks) == list(range(len(chunks)))


def test_commits(spark, tmp_path):
    log = "\x1e".join(["", "abc123def4567\x1f2025-01-02T03:04:05Z\x1fKai\x1fFix pier\x1fBody\x1fa.txt\nb.txt\n", "fff\x1f2025-01-03\x1fLo\x1fEmpty\x1f\x1f" + "\n".join(f"f{i}" for i in range(50))])
    (tmp_path / "log").write_text(log)
    got = {r.sha: r for r in files.commits(spark, str(tmp_path / "log")).collect()}
    assert got["abc123def4567"].text == "Fix pier\n\nBody\n\nCommit abc123def456 by Kai on 2025-01-02.\n\nFiles changed: a.txt, b.txt."
    assert got["fff"].n_files == 50 and got["fff"].text.endswith("f39 and 10 more.")


def test_transcripts(spark, tmp_path):
    lines = [{"type": "user", "sessionId": "s", "cwd": "/home/k/pier", "timestamp": "1", "message": {"role": "user", "content": "hi"}}, {"type": "assistant", "sessionId": "s", "timestamp": "2", "message": {"content": [{"type": "text", "text": "a"}, {"type": "tool_use"}, {"type": "text", "text": "b"}]}}, {"type": "user", "sessionId": "s", "isMeta": True, "message": {"content": "meta"}}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{"type": "us')
    got = files.session_turns(spark, str(tmp_path / "t.jsonl")).orderBy("at").collect()
    assert [(r.role, r.text, r.project) for r in got] == [("user", "hi", "pier"), ("assistant", "a\n\nb", None)]
    chats = [{"uuid": "u", "name": "n", "chat_messages": [{"sender": "human", "text": "q"}, {"sender": "assistant", "text": "", "content": [{"type": "text", "text": "r"}]}]}]
    (tmp_path / "c.json").write_text(json.dumps(chats))
    assert [(r.role, r.text) for r in files.chat_export_turns(spark, str(tmp_path / "c.json")).orderBy("turn").collect()] == [("user", "q"), ("assistant", "r")]


def test_message_trees(spark, tmp_path):
    def node(parent, role=None, parts=(), **more):
        message = role and {"author": {"role": role}, "content": {"content_type": "text", "parts": list(parts)}, "create_time": 1.5, **more}
        return {"parent": parent, "message": message or None}

    mapping = {
        "r": node(None), "a": node("r", "user", ["old"]), "b": node("r", "user", ["hi", {"asset": 1}, "there"]), "c": node("b", "assistant", ["call"], recipient="python"),
        "d": node("c", "tool", ["out"]), "e": node("d", "assistant", ["done"], recipient="all"), "f": node("e", "user", ["secret"], metadata={"is_visually_hidden_from_conversation": True}),
        "x": node("y", "user", ["x"]), "y": node("x", "assistant", ["y"]),
    }
    chats = [{"id": "1", "title": "t", "mapping": mapping, "current_node": "f"}, {"conversation_id": "2", "mapping": mapping, "current_node": "x"}, {"id": "3", "mapping": mapping, "current_node": None}]
    (tmp_path / "c.json").write_text(json.dumps(chats))
    got = files.tree_export_turns(spark, str(tmp_path / "c.json")).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.role, r.text) for r in got] == [("1", 0, "user", "hi\n\nthere"), ("1", 1, "assistant", "done"), ("2", 0, "assistant", "y"), ("2", 1, "user", "x")]
    assert got[0].at.microsecond == 500_000


def test_too_large_files_are_reported(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_BYTES", 10)
    (tmp_path / "a.md").write_text("short")
    (tmp_path / "b.md").write_text("longer than ten bytes")
    assert [r.source_path for r in files.folder(spark, str(tmp_path)).collect()] == ["a.md"]
    assert [tuple(r) for r in files.too_large(spark, str(tmp_path)).collect()] == [("b.md", 21)]


def test_vectors_and_lines(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "v.f32").write_bytes(x.tobytes())
    got = files.float_matrix(spark, str(tmp_path / "v.f32"), 4).orderBy("row_id").collect()
    assert [r.vector for r in got] == x.tolist()
    with pytest.raises(SkerryError):
        files.float_matrix(spark, str(tmp_path / "v.f32"), 5)
    (tmp_path / "q.jsonl").write_text('{"text": "a"}\n{"text": \n{"other": 1}\n')
    assert [r.text for r in files.json_lines(spark, str(tmp_path / "q.jsonl"), "text string", "text").collect()] == ["a"]
    (tmp_path / "shelf.json").write_text('{"packs": [{"name": "p", "location": "x", "identity": "i"}]}')
    assert files.shelf(spark, str(tmp_path / "shelf.json")).first().name == "p"
    with pytest.raises(SkerryError):
        files.checked_vectors(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], ["v"]), "v")


def test_pack_round_trip(spark, tmp_path):
    texts = ["Pier notes\nThe crane stands near the old pier", "Tide notes\nThe tide turns twice a day", "Crane\nA crane lifts the cargo of the ship"]
    records = spark.createDataFrame(list(enumerate(texts)), "record_id long, text string")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.eye(4)[:3])], "record_id long, vector array<double>")
    pack = Pack.compile(records, vectors, 4)
    first = pack.save(str(tmp_path / "p"))
    loaded = Pack.load(spark, str(tmp_path / "p"), verify=True)
    asked = spark.createDataFrame([(1, "tide turns twice", [0.0, 0.9, 0.1, 0.0])], "query_id long, text string, vector array<double>")
    hits = loaded.query(asked, 2).orderBy("rank").collect()
    assert hits[0].record_id == 1 and hits[0].text == texts[1]
    assert loaded.ground(asked, loaded.query(asked, 2)).first().coverage == 1.0
    for mode in ("vector", "lexical", "augmented"):
        assert loaded.query(asked, 1, mode).first().record_id == 1
    assert {r.record_id for r in loaded.lookup(["crane"]).collect()} == {0, 2} == {r.record_id for r in pack.lookup(["crane"]).collect()}
    assert Pack.compile(records, vectors, 4).save(str(tmp_path / "q")) == first
    changed = spark.read.parquet(str(tmp_path / "q/records")).withColumn("text", F.concat("text", F.lit("!")))
    with pytest.raises(Exception, match="DIGEST_MISMATCH"):
        Pack(changed, loaded.index, loaded.vectors, loaded.codes, 4).query(asked, 1).collect()
    loaded.codes.where("record_id < 2").coalesce(1).write.parquet(str(tmp_path / "some"))
    spark.read.parquet(str(tmp_path / "some")).write.mode("overwrite").parquet(str(tmp_path / "q/codes"))
    with pytest.raises(SkerryError, match="codes"):
        Pack.load(spark, str(tmp_path / "q"), verify=True)
    records.where("record_id < 2").write.mode("overwrite").parquet(str(tmp_path / "p/records"))
    with pytest.raises(SkerryError):
        Pack.load(spark, str(tmp_path / "p"), verify=True)


def test_vector_index(spark, tmp_path):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.eye(4))], "record_id long, vector array<double>")
    index = VectorIndex(spark, 4).add(rows)
    asked = rows.withColumnRenamed("record_id", "query_id").where("query_id = 2")
    assert index.search(asked, 1).first().record_id == 2
    index.delete(spark.createDataFrame([(2,)], "record_id long"))
    assert index.search(asked, 1).first().record_id == 0 and index.ghost_ratio() == 0.25
    with pytest.raises(SkerryError):
        index.save(str(tmp_path / "i"))
    with pytest.raises(SkerryError):
        index.add(rows)
    assert {tuple(r) for r in index.compact().collect()} == {(0, 0), (1, 1), (3, 2)}
    index.save(str(tmp_path / "i"))
    assert VectorIndex.load(spark, str(tmp_path / "i")).rows.count() == 3


def test_notes_stream_and_folds(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "kind string, title string, text string, tags array<string>"
    for i in range(5):
        spark.createDataFrame([("todo", f"t{i}", "x", ["A"]), ("todo", " ", "x", ["A"]), ("other", "t", "x", [])], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        layers.append_notes(stream, out, str(tmp_path / "cp"), most=2).awaitTermination(60)
    got = layers.read_layers(spark, out).orderBy("layer").collect()
    assert [(r.title, r.text, r.tags, r.layer) for r in got] == [(f"t{i}", f"t{i}\nx", ["a"], i) for i in range(5)]
    assert layers._generation(spark, out) == 2 and set(layers._layers(spark, out)) == {-1, 4}
    assert layers.fold_layers(spark, out) and set(layers._layers(spark, out)) == {-1} and not layers.fold_layers(spark, out)
    assert layers.read_layers(spark, out).count() == 5 and layers.read_layers(spark, str(tmp_path / "none")) is None


def test_encoders(spark):
    rng = np.random.default_rng(0)
    encoder = encode.student(rng.normal(size=(512, 16)).astype(np.float32), rng.normal(size=(16, 8)).astype(np.float32))
    df = spark.createDataFrame([(1, "the pier"), (2, "the piers"), (3, None)], ["id", "text"])
    got = {r.id: np.array(r.vector) for r in encode.encode_column(df, "text", encoder).collect()}
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-5 and not got[3].any()
    expected = encode.encode_column(df, "text", encoder).withColumn("tolerance", F.lit(1e-6))
    assert encode.conformance(encode.encode_column(df, "text", encoder), expected, "id").where("not passed").isEmpty()
    worded = spark.createDataFrame([(1, ["pier", "tide", "pier"]), (2, None), (3, [])], "id int, words array<string>")
    vectors = {r.id: r.vectors for r in encode.encode_words(worded, "words", encoder).collect()}
    assert vectors[1][0] == vectors[1][2] != vectors[1][1] and vectors[2] is None and vectors[3] == [] and np.allclose(vectors[1][0], encoder(["pier"])[0])
    long = encode.in_windows(encoder, 2)(["a b c d", "a b", "", None])
    halves = encoder(["a b", "c d"]).mean(0)
    assert np.allclose(long[0], halves / np.linalg.norm(halves), atol=1e-6) and np.allclose(long[1], encoder(["a b"])[0], atol=1e-6) and not long[2:].any()
    vocabulary = {w: i for i, w in enumerate(["[UNK]", "pier", "##s", "un", "##load", ",", "cafe"])}
    assert encode.word_pieces("Piers, unload Café zzz", vocabulary) == [1, 2, 5, 3, 4, 6, 0]


def test_student_learns_its_teacher(spark):
    rng = np.random.default_rng(4)
    topics = [[f"{a}{b}wort" for b in "abcdefgh"] for a in ("kran", "pier", "tide", "rope", "chain", "cargo")]
    goals = np.linalg.qr(rng.normal(size=(12, 12)))[0][:6]
    texts = [" ".join(rng.choice(topics[i % 6], 6)) + "." for i in range(240)]
    vectors = np.array([goals[i % 6] + 0.05 * rng.normal(size=12) for i in range(240)])
    df = spark.createDataFrame([(i, t, v.tolist()) for i, (t, v) in enumerate(zip(texts, vectors))], "record_id long, text string, vector array<double>")
    encoder = encode.student(*student.train_student(df.where("record_id < 180"), "text", "vector", places=4096, hidden=32, epochs=12))
    held = encoder(texts[180:])
    assert (held * vectors[180:] / np.linalg.norm(vectors[180:], axis=1, keepdims=True)).sum(1).mean() > 0.9
    asked = df.where("record_id >= 180").select("record_id")
    encoded = encode.encode_column(df.select("record_id", "text"), "text", encoder)
    assert student.neighbour_overlap(df, df, asked, 5).first().recall == 1.0
    assert student.neighbour_overlap(encoded, df, asked, 39).first().recall > 0.8
    assert all(v for v in (student.variants(t, rng) for t in texts)) and student.variants("", rng) == [] and student.slip("abc", rng) == "abc" and student.slip("crane", rng) != "crane"
