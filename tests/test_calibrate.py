import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.errors import SkerryError
from skerry.operators import calibrate, grounding


def test_sequence_is_fixed():
    assert calibrate.sequence(1, 2) == [1015568748, 1586005467]


def test_questions(spark):
    records = spark.createDataFrame([(1, "Pier", "the moored turbine and a crane lifts"), (2, " ", "of"), (3, "Crane", "cargo ropes chain beside water"), (4, "Tide", None), (5, "Crane", "x")], "record_id long, title string, text string")
    asked = calibrate.title_questions(records, "title", 6, 3).collect()
    assert len(asked) == 6 and {r.source_title for r in asked} == {"Pier", "Crane", "Tide"} and {r.text for r in asked} == {r.text for r in calibrate.title_questions(records, "title", 6, 3).collect()}
    assert all(r.text in {t.replace("{}", r.source_title.lower()) for t in calibrate.TEMPLATES} for r in asked)
    made = calibrate.content_questions(records, "record_id", "text", 5, 4).collect()
    assert {r.source_id for r in made} == {1, 3} and all(3 <= sum(w in r.text for w in "moored turbine crane lifts cargo ropes chain beside water".split()) <= 5 for r in made)
    held = {r.title for r in calibrate.held_out_titles(records, "title", 5).collect()}
    assert len(held) == 1 and held < {"Pier", "Crane", "Tide"} and calibrate.held_out_titles(records.where("record_id < 3"), "title", 5).count() == 0
    assert records.select(calibrate.shuffled_letters(F.lit("ab cd"))).first()[0] == "ba dc"
    assert calibrate.sampled(5, 9, 1) == calibrate.sampled(5, 9, 1) and sorted(calibrate.sampled(5, 9, 1)) == list(range(5))


def test_thresholds():
    hard, weak = calibrate.thresholds(np.array([0.9, 0.95, 0.99]), np.array([0.01, 0.2]))
    assert (hard, weak) == (0.2, 0.81)
    assert calibrate.thresholds(np.array([0.4, 0.6]), np.array([0.7, 0.9])) == (0.5, 0.6) and calibrate.thresholds(np.array([0.1]), np.array([0.45])) == (0.45, 0.53)


def test_fit_separates(spark):
    rng = np.random.default_rng(1)
    rows = [(float(x), float(rng.normal()), int(x + 0.2 * rng.normal() > 0)) for x in rng.normal(size=400)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    model = calibrate.fit_verdict(df, ["a", "b"], "y", epochs=500)
    scored = grounding.verdicts(df, model.features, model.mean, model.scale, model.weights, model.bias, model.hard, model.weak)
    assert grounding.auc(scored, "y", "p").first()[0] > 0.95
    with pytest.raises(SkerryError):
        calibrate.fit_verdict(df.where("y = 1"), ["a"], "y")


def test_word_similarity_and_student_features(spark):
    q = spark.createDataFrame([(1, 7, [[1.0, 0.0], [0.0, 1.0]])], "query_id long, passage_id long, words array<array<double>>")
    p = spark.createDataFrame([(7, [[1.0, 0.0]])], "passage_id long, words array<array<double>>")
    assert calibrate.word_similarity(q, p).first().max_sim == 0.5
    headed = p.withColumn("heading", F.array(F.array(F.lit(0.0), F.lit(1.0))))
    assert abs(calibrate.word_similarity(q, headed).first().max_sim - (1 + 0.5**3) / 2) < 1e-12
    weighed = q.withColumn("weights", F.array(F.lit(1.0), F.lit(1 / 3)))
    assert abs(calibrate.word_similarity(weighed, p, 0.2).first().max_sim - 0.75) < 1e-12
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert 0.4 < calibrate.noise_level([f"{i:02}x" for i in range(60)], v, 3) < 1 and calibrate.noise_level(["a"], v[:1], 3) == 0
    asked = spark.createDataFrame([(1, "pier zzz")], "query_id long, text string")
    known = spark.createDataFrame([("pier",)], ["token"])
    runs = spark.createDataFrame([("pie",), ("ier",)], ["token"])
    row = calibrate.student_features(asked, known, runs).first()
    assert row.known_words == 0.5 and abs(row.known_runs - 2 / 3) < 1e-9
