"""Toxicity and quality: brute-force twins of features, risk and scores; held-out accuracy; odd rows."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import nbsvm, quality_rules, toxicity
from curatrix.llm.common import hash_sample, table

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown Fox! " * 5000
EDGE = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b c", "en", "a", 5), (3, "a b c", "en", "a", 5), (3, "other", "en", "a", 5), (None, "token = abcdef1 Aé \x0b x", None, None, 1), (5, LONG, "en", "a", len(LONG)), (6, " \x85  ", "en", "b", 5)]


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, FOLDER, "labels")


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    return df.withColumn("_id", F.lit("x")).withColumn("kind", F.lit(7)).withColumn("y", F.lit(9)).withColumn("score", F.lit(0.5))


def held_out(found, labels, field):
    truth = {r["doc_id"]: r[field] for r in labels.collect()}
    return [(r["predicted"], truth[r["doc_id"]]) for r in found.collect() if r["held_out"] and r["doc_id"] in truth]


def toxic_features(text):
    """Word by word, as the module's docstring says."""
    words = "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in re.sub("[A-Z]", lambda m: m[0].lower(), text)).split(" ")
    words = [w.encode() for w in words if w]
    n = collections.Counter()
    for w in words:
        n[zlib.crc32(w) % toxicity.WIDTH] += 1
        for k in toxicity.STEMS:
            if len(w) > k:
                n[zlib.crc32(w[:k] + b"*") % toxicity.WIDTH] += 1
    return {c: min(100 * k / len(words), toxicity.CAP) for c, k in n.items()}


def test_toxicity_scores_are_those_of_brute_force(spark, labels):
    docs = table(spark, FOLDER, "documents")
    scorer = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = toxicity.op1_nnpu_toxicity(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        margin = scorer.bias + sum(v * scorer.weights[c] for c, v in toxic_features(texts[r["doc_id"]]).items())
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)
        assert r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert np.mean([p == y for p, y in held_out(toxicity.op1_nnpu_toxicity(spark, FOLDER), labels, "toxic")]) > 0.9


def test_unlabelled_rows_do_not_teach_their_labels(spark, labels):
    """Held-out labels, and which of the sampled rows are toxic beyond the positives, change nothing."""
    docs = table(spark, FOLDER, "documents")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


def sparse(x):
    row, cell = np.nonzero(x)
    return toxicity.Sparse(row, cell, x[row, cell], len(x))


def test_risk_falls_to_the_minimum_and_stays_non_negative():
    rng = np.random.default_rng(1)
    pos = (rng.random((300, 4)) < [0.9, 0.9, 0.5, 0.5]).astype(float)
    unl = np.concatenate([(rng.random((200, 4)) < [0.9, 0.9, 0.5, 0.5]), (rng.random((1800, 4)) < [0.02, 0.02, 0.5, 0.5])]).astype(float)
    w, b = toxicity.fit_nnpu(sparse(pos), sparse(unl), 4, 0.1, steps=400)
    said = unl @ w + b > 0
    assert said[:200].mean() > 0.8 and said[200:].mean() < 0.06
    at = lambda w, b: sum(max(p, 0) for p in toxicity.risk(pos @ w + b, unl @ w + b, 0.1))
    dense = lambda w, b: 0.1 * np.log1p(np.exp(-(pos @ w + b))).mean() + max(0, np.log1p(np.exp(unl @ w + b)).mean() - 0.1 * np.log1p(np.exp(pos @ w + b)).mean())
    assert at(w, b) == pytest.approx(dense(w, b))
    for k in range(5):
        for step in (-0.3, 0.3):
            moved = np.append(w, b) + step * (np.arange(5) == k)
            assert dense(moved[:4], moved[4]) > dense(w, b) - 1e-3


def test_bounds_hold_for_repeated_ids(spark, labels):
    ids = spark.range(1000).withColumnRenamed("id", "_id")
    assert 30 <= hash_sample(ids, 50).count() <= 50 and hash_sample(ids, 1000).count() == 1000
    docs = spark.createDataFrame([(0, f"text {k}") for k in range(50)] + [(1, "other")], "doc_id long, text string")
    known = spark.createDataFrame([(0, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert [(r["_id"], bytes(r["text"])) for r in quality_rules.training_rows(docs, known, "quality", 5).orderBy("_id").collect()] == [(0, b"text 0"), (1, b"other")]
    texts, _ = toxicity.sample(docs, known, 5, 5)
    assert texts.count() == 3


def test_odd_rows(spark, edge, labels):
    for module in (toxicity, nbsvm):
        rows = module.score(edge, module.fit(edge, labels)).collect()
        assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
        by_text = collections.defaultdict(set)
        for (doc, text, *_), r in zip(sorted(EDGE, key=lambda e: (e[0] or -1)), sorted(rows, key=lambda r: (r["doc_id"] or -1)), strict=True):
            if text in (None, ""):
                by_text[""].add(r["score"])
        assert len(by_text[""]) == 1
        assert module.score(edge.limit(0), module.fit(edge.limit(0), labels.limit(0))).count() == 0


def ngram_features(text):
    """Indicators as sets of token tuples: (n-gram, level)."""
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^\x20\x09-\x0D0-9A-Za-z\x80-\xff]+", text.encode())
    tokens = [b"again" if k and t == tokens[k - 1] else t for k, t in enumerate(tokens)]
    out = set()
    for size in (1, 2, 3):
        grams = collections.Counter(tuple(tokens[k : k + size]) for k in range(len(tokens) - size + 1))
        n = sum(grams.values())
        out |= {(g, level) for g, c in grams.items() for level, least in enumerate(nbsvm.LEVELS) if c >= max(least * n, 1)}
    return out


def cell(gram):
    """The hashed cell of a token tuple, in Python's whole numbers."""
    mixed = len(gram)
    for k, t in enumerate(gram):
        mixed = ((mixed ^ (nbsvm.AGAIN if t == b"again" else zlib.crc32(t))) * (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[k]) % 2**64
        mixed ^= mixed >> 29
    return mixed >> 44


def test_quality_indicators_and_scores(spark, labels):
    docs = table(spark, FOLDER, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rng = np.random.default_rng(0)
    for doc in rng.choice(sorted(texts), 60, replace=False).tolist():
        assert {cell(g) * len(nbsvm.LEVELS) + level for g, level in ngram_features(texts[doc])} >= set(nbsvm.features(texts[doc].encode()).tolist())
        assert {cell(g) for g, _ in ngram_features(texts[doc])} == {f // len(nbsvm.LEVELS) for f in nbsvm.features(texts[doc].encode()).tolist()}
    model = nbsvm.fit(docs, labels)
    weight = dict(zip(model.numbers.tolist(), model.weights.tolist(), strict=True))
    found = nbsvm.op6_nbsvm_quality(spark, FOLDER)
    for r in found.collect():
        margin = model.bias + sum(weight.get(f, 0.0) for f in nbsvm.features(texts[r["doc_id"]].encode()).tolist())
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.shift))), abs=1e-9)
    assert np.mean([p == y for p, y in held_out(found, labels, "quality")]) > 0.95


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = np.where(x @ [1.0, -2.0, 0.5] + 0.3 > 0, 1, -1)
    has = x > 0
    scale = np.array([2.0, 0.5, 1.0])
    y = np.where(has * scale @ [1.0, -2.0, 0.5] + 0.1 > 0, 1, -1)
    w = nbsvm.dual_coordinate_descent([np.flatnonzero(r) for r in has], scale, y, np.full(200, 10.0), epochs=200)
    assert ((has * scale @ w[:3] + w[3] > 0) == (y > 0)).all()
