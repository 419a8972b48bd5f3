"""Classifiers by held-out accuracy, and the pipeline stage by stage."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flightframe.llm import bpe, quality, toxicity
from flightframe.llm.shared import table
from tests.compare import SF_DIR

LARGER = "/root/testdata/sf0.01"


def held_out(spark, rows, column):
    labels = table(spark, LARGER, "labels").select("doc_id", column)
    return rows.where("held_out").join(labels, "doc_id").toPandas()


def area(y, score):
    rank = score.rank().to_numpy()
    ones = int(y.sum())
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_quality_on_held_out_labels(spark):
    rows = quality.op3_quality(spark, LARGER)
    got = held_out(spark, rows, "quality")
    y, said = got["quality"].to_numpy(), got["predicted"].to_numpy() == 1
    assert area(y, got["score"]) > 0.95 and y[said].mean() >= 0.9 and said[y == 1].mean() >= 0.9
    assert rows.count() == table(spark, LARGER, "documents").count() and set(rows.columns) == {"doc_id", "held_out", "score", "predicted"}


def test_toxicity_on_held_out_labels(spark):
    got = held_out(spark, toxicity.op2_toxicity(spark, LARGER), "toxic")
    y, said = got["toxic"].to_numpy(), got["predicted"].to_numpy() == 1
    assert area(y, got["score"]) > 0.9 and y[said].mean() >= 0.75 and said[y == 1].mean() >= 0.75  # precision, recall
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()


def slow_risk(pos, every, w, prior):
    """The non-negative risk and its gradient, document by document."""
    loss = lambda z: np.log1p(np.exp(-z))
    terms = {"pos": [0.0, 0], "pos_neg": [0.0, 0], "unl": [0.0, 0]}
    for name, rows, sign in (("pos", pos, 1), ("pos_neg", pos, -1), ("unl", every, -1)):
        for x in rows:
            x = np.append(x, 1.0)
            z = sign * sum(a * b for a, b in zip(x, w))
            terms[name][0] += loss(z) / len(rows)
            terms[name][1] = terms[name][1] + -sign / (1 + np.exp(z)) * x / len(rows)
    inner = terms["unl"][0] - prior * terms["pos_neg"][0]
    risk, slope = prior * terms["pos"][0], prior * terms["pos"][1]
    return (risk + inner, slope + terms["unl"][1] - prior * terms["pos_neg"][1]) if inner >= 0 else (risk, slope)


def test_risk_equals_its_definition(spark):
    rng = np.random.default_rng(1)
    every = (rng.random((60, 11)) < 0.4).astype(float)
    positive = np.arange(60) < 20
    df = spark.createDataFrame([(bool(p), bytearray(np.packbits(x.astype(np.uint8)).tobytes())) for p, x in zip(positive, every)], "positive boolean, bits binary").repartition(3)
    for prior, scale in ((0.1, 1.0), (0.9, 1.0), (0.9, 4.0)):
        w = rng.normal(0, scale, 12)
        risk, slope = toxicity.non_negative_risk(toxicity.total_sums(df, 11, w), 20, 60, prior)
        expected = slow_risk(every[positive], every, w, prior)
        assert np.isclose(risk, expected[0]) and np.allclose(slope, expected[1])


def test_training_lowers_a_risk_that_stays_positive():
    rng = np.random.default_rng(1)
    pos, unl = (rng.random((200, 20)) < 0.5).astype(float), (rng.random((400, 20)) < 0.5).astype(float)
    pos[:, 0], unl[40:, 0] = 1, 0
    x = np.concatenate((np.concatenate((pos, unl)), np.ones((600, 1))), axis=1)
    w, bias, risks = toxicity.train(lambda v: toxicity.risk_sums(x, np.arange(600) < 200, v), 20, 200, 600, 0.4)
    assert min(risks) >= 0 and risks[-1] < risks[0] and w[0] == max(w)


def test_feature_counts_and_scores_equal_loops(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["Toxicity", "toxic", "plain", "wörd", "a", "verylongword"], rng.integers(0, 12))) for _ in range(30)] + [None, "x " * 300 + "plain"]
    rows = [(k % 4 == 0, bytearray((t or "").encode()) if t is not None else None) for k, t in enumerate(texts)]

    def features(t):
        words = [w.encode() for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())]
        tokens = Counter([("word", w) for w in words] + [(n, w[:n]) for w in words for n in range(5, 10) if len(w) > n])
        return {(t, False) for t in tokens} | {(t, True) for t, c in tokens.items() if c * toxicity.DENSE >= len(words)}

    expected = Counter()
    for (p, _), t in zip(rows, texts):
        expected.update({f: (p, 1) for f in ()})
        for f in features(t):
            n_pos, n_all = expected.get(f, (0, 0)) or (0, 0)
            expected[f] = (n_pos + p, n_all + 1)
    counts = toxicity.feature_counts(spark.createDataFrame(rows, "positive boolean, text binary").repartition(3)).collect()
    assert sorted((r.n_pos, r.n_all) for r in counts) == sorted(expected.values())
    known = toxicity.select_features(spark.createDataFrame(counts), 8, 32, 6)
    model = toxicity.Model(known, rng.normal(size=len(known)), 0.3)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(frame, model).collect():
        raw = (r.text or "").encode()
        mine = toxicity.feature_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        assert np.isclose(r.score, 1 / (1 + np.exp(-(model.bias + sum(w for f, w in zip(known, model.weights) if f in mine)))))


def test_quality_score_and_step_equal_loops(spark):
    rng = np.random.default_rng(4)
    raw = ["fine words words here", "", "ü x", "bad bad text"]
    docs = [(lambda rows: np.unique(rows, return_counts=True))(quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]) for t in raw]
    labels = np.array([1, 0, 1, 0])
    dim, rate = 4, 2.0
    one = quality.train(docs, labels, dim=dim, epochs=1, rate=rate, batch=4, least_steps=1, seed=5)
    start = np.random.default_rng(5).uniform(-1 / dim, 1 / dim, (quality.ROWS, dim)).astype(np.float32).astype(float)
    # before the first step the output layer is zero: both classes have probability 1/2 and the embeddings stay
    output, bias = np.zeros((dim, 2)), np.zeros(2)
    for (rows, counts), y in zip(docs, labels):
        mean = sum((c * start[r] for r, c in zip(rows, counts)), np.zeros(dim)) / max(1, counts.sum())
        for k in (0, 1):
            error = 0.5 - (y == k)
            output[:, k] -= rate / 4 * error * mean
            bias[k] -= rate / 4 * error
    assert np.allclose(one.output, output, atol=1e-5) and np.allclose(one.bias, bias, atol=1e-6) and np.allclose(one.embeddings, start, atol=1e-6)
    two = quality.train(docs, labels, dim=dim, epochs=5, rate=rate, batch=2, least_steps=1, seed=5)
    got = {r.text: r.score for r in quality.score(spark.createDataFrame(list(enumerate(raw)), "doc_id long, text string"), two).collect()}
    for t, (rows, counts) in zip(raw, docs):
        mean = sum((c * two.embeddings[r].astype(float) for r, c in zip(rows, counts)), np.zeros(dim)) / max(1, counts.sum())
        z = np.exp(mean @ two.output + two.bias)
        assert np.isclose(got[t], z[1] / z.sum(), atol=1e-4)


@pytest.mark.parametrize("score", [lambda d, s: quality.score(d, quality.fit(d, s)), lambda d, s: toxicity.score(d, toxicity.fit(d.sparkSession, d, s))])
def test_odd_rows_and_missing_labels(spark, score):
    rows = [(1, "fine words here", "x"), (1, "fine words here", "x"), (2, "", "y"), (3, None, "z"), (None, "bad !!", None), (4, "word " * 50_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    for labels in ([], [(1, 1)], [(1, 1), (2, 0), (None, 1), (3, None), (1, 1)]):
        got = score(docs, spark.createDataFrame(labels, "doc_id long, label int")).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert score(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, label int")).count() == 0


def test_pipeline_stages_work_on_what_is_left(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF_DIR).cache()
        assert after.count() <= docs.count() and after.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        if name == "byte_bpe":
            both = after.select("doc_id", F.col("text").alias("decoded"), "n_tokens", "ids").join(docs.select("doc_id", "text"), "doc_id")
            assert both.where("decoded <> text or octet_length(ids) <> 4 * n_tokens").count() == 0 and after.count() == docs.count()
        else:
            assert after.columns == columns
        docs = after
    assert 0.5 * before < docs.count() < before
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "decontaminate", "byte_bpe"] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_drops_copies_and_leaks_but_no_clean_text(spark):
    rng = np.random.default_rng(2)
    words = [f"word{k}" for k in range(4000)]
    clean = [" ".join(rng.choice(words, 80)) + "." for _ in range(12)]
    leak = table(spark, SF_DIR, "benchmark").first().text
    rows = [(k, t) for k, t in enumerate([*clean, clean[0], clean[1], clean[2] + " tail", f"{' '.join(rng.choice(words, 30))}\n{leak}"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF_DIR)
    kept = {r.doc_id for r in docs.where("text <> ''").collect()}
    assert kept == set(range(12))


def test_pipeline_stages_take_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one line"), (3, "one line"), (3, "another text of this id"), (None, "one line"), (None, None), (4, "x" * 200_000)]
    docs = spark.createDataFrame([(k, t, None, "s", 1, "clash") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        after = stage(spark, docs, SF_DIR).cache()
        assert name == "byte_bpe" or after.columns == docs.columns
        assert after.where("doc_id is null").count() == 2 and 0 < after.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
        docs = after
    last = {(r.doc_id, r.text): r for r in docs.collect()}
    assert last[4, "x" * 200_000].n_tokens == len(bytes(last[4, "x" * 200_000].ids)) // 4 and all(r.text is not None for r in last.values())
    quality_stage = corpus_pipeline.STAGES[0][1]
    assert quality_stage(spark, spark.createDataFrame([(k, t) for k, t in rows], "doc_id long, text string"), SF_DIR).columns == ["doc_id", "text"]


def test_vocabulary_bound(tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_VOCABULARY_BYTES", 10)
    (tmp_path / "v").write_bytes(b"YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "v"))
