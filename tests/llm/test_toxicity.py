import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import toxicity as T

ROOTS = ["grubl", "snarfo", "blarg"]


def corpus(prose, n, seed=0, endings=("t", "ting", "ter", "tesk")):
    """Texts of which a third hold a few insults, made of roots and endings, among many words."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(1000 * seed + i, rng.randint(20, 400)).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(ROOTS) + rng.choice(endings)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model():
    import random as r

    from conftest import WORDS

    def prose(seed, n):
        rng = r.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ly"]) for _ in range(n))

    rows = corpus(prose, 300)
    return T.train([t for _, t, _ in rows], np.array([y for _, _, y in rows])), prose


def score(model, text):
    words = text.split()
    logits = model.word_logits(words) if words else np.zeros(0)
    return float(model.probability(np.array([T.features(logits, model.bias)]))[0])


def test_unseen_endings(model):
    """Words never seen in training share n-grams with those that were."""
    fitted, prose = model
    rows = corpus(prose, 90, seed=2, endings=("tz", "tish", "tful"))
    hits = [(score(fitted, t) >= T.THRESHOLD) == bool(y) for _, t, y in rows]
    assert np.mean(hits) >= 0.95


def test_a_word_among_thousands(model):
    fitted, prose = model
    assert score(fitted, prose(5, 3000)) < T.THRESHOLD
    assert score(fitted, prose(5, 3000) + " grublting snarfoter " + prose(6, 3000)) >= T.THRESHOLD


def test_scores_are_probabilities(model):
    fitted, _ = model
    for text in ["", " ", "x", "!!!", "1 2 3", "é🙂", "word " * 50_000]:
        assert 0 <= score(fitted, text) <= 1


def test_passages():
    for n in (1, 7, 8, 9, 12, 13, 100):
        starts = T.passage_starts(n)
        covered = {p for s in starts for p in range(s, min(n, s + T.PASSAGE))}
        assert covered == set(range(n))
        logits = np.random.default_rng(n).normal(size=n)
        assert T.passage_logits(logits) == pytest.approx([logits[s : s + T.PASSAGE].mean() for s in starts])


@pytest.mark.parametrize("labels", [[], [0, 0, 0], [1, 1, 1]])
def test_one_label_only(labels):
    fitted = T.train(["some text here"] * len(labels), np.array(labels))
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    assert score(fitted, "anything") == pytest.approx(share)


def test_whole_operator(spark, prose):
    rows = corpus(prose, 240)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, rows[0][1], "x"), (0, rows[0][1], "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (5, None, 0), (7, 9, 0)], "doc_id bigint, toxic int, quality int")
    out = T.toxicity(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    assert out.columns == ["doc_id", "score", "predicted"]
    found = out.collect()
    assert len(found) == 244
    assert all(r.predicted == int(r.score >= 0.3) for r in found)
    truth = {i: y for i, _, y in rows}
    held = [r for r in found if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    by = {r.doc_id: r.score for r in found}
    assert by[900] == by[901] and by[None] == by[0]


def test_held_out_labels_change_nothing(spark, prose):
    rows = corpus(prose, 90)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2

    def scores(turned):
        labels = [(i, 1 - y if turned and zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows]
        out = T.toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), learn)
        return sorted((r.doc_id, r.score) for r in out.collect())

    assert scores(False) == scores(True)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "w " * i) for i in range(50)] + [(3, "again")] * 9, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, toxic int")
    texts, marks = T.training_sample(docs, labels, F.lit(True), "doc_id", "text", "toxic", 4, 60)
    assert len(texts) <= 8 and len(texts) == len(marks) and all(len(t) <= 60 for t in texts)


def test_empty(frame, spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert T.toxicity(frame([]), labels, F.lit(True)).count() == 0
    assert [r.score for r in T.toxicity(frame([(1, "a")]), labels, F.lit(True)).collect()] == [0.5]
