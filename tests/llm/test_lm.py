"""Language-model scores against plain versions: counts, classes, softmax, the slopes of the contrastive loss."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import bilinear
from curatrix.llm.common import table, text_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox " * 5000
EDGE = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b c", "en", "a", 5), (3, "a b c", "en", "a", 5), (3, "a b c", "en", "a", 5), (None, "token = abcdef1 Aé \x0b x", None, None, 1), (5, LONG, "en", "a", len(LONG)), (6, "A B\tC", "en", "b", 5)]


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def plain_class(token, own):
    if token == b"\n":
        return 0
    if token in own:
        return own[token]
    return bilinear.WORD_CLASSES + zlib.crc32((b"\0\0" + token)[-2:]) % (bilinear.CLASSES - bilinear.WORD_CLASSES)


def plain_score(words, counts, own, model):
    """Token by token: softmax over all classes, times the share of the class."""
    context, place, output, bias = (p.astype(np.float64) for p in model.params)
    size, kinds = collections.Counter(), collections.Counter()
    for t, n in counts.items():
        size[plain_class(t, own)] += n
        kinds[plain_class(t, own)] += 1
    two = one = 0
    total = 0.0
    for t in words:
        k = plain_class(t, own)
        s = (context[two] @ place[0] + context[one] @ place[1]) @ output.T + bias
        total += (s[k] - s.max() - math.log(np.exp(s - s.max()).sum())) / math.log(10)
        if k >= bilinear.WORD_CLASSES:
            total += math.log10((counts.get(t, 0) + 0.1) / (size[k] + 0.1 * (kinds[k] + 1)))
        two, one = one, k
    return total


@pytest.mark.parametrize("head", [50, 200_000])
def test_scores_are_those_of_brute_force(spark, head):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    extra = spark.createDataFrame(EDGE, SCHEMA).withColumn("token", F.lit("t")).withColumn("score", F.lit(0.5)).withColumn("rows", F.lit(9))
    for df, most in ((extra, 9), (docs, 25)):
        train = df.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0)
        counts = collections.Counter(x for r in train.collect() for x in tokens(r["text"]))
        total, distinct = sum(counts.values()), len(counts)
        texts = train.select(text_bytes().alias("text"))
        words = bilinear.vocabulary(bilinear.token_counts(texts), head)
        model = bilinear.fit(texts, spark.sparkContext.broadcast(words), words)
        own = {t: int(words.klass[k]) for t, k in words.index.items() if 0 < words.klass[k] < bilinear.WORD_CLASSES}
        got = sorted(bilinear.score(df, train, head=head).collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"], r["score"]))
        rows = sorted(((r["doc_id"], tokens(r["text"])) for r in df.collect()), key=lambda r: (str(r[0]), len(r[1])))
        assert len(got) == len(rows)
        for k, (r, (doc, w)) in enumerate(zip(got, rows, strict=True)):
            base = sum(math.log10((counts.get(x, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
            assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (doc, len(w), sum(x in counts for x in w), total)
            assert r["base_score"] == pytest.approx(base, abs=1e-6)
            if k < most and len(w) < 1000:
                assert r["score"] == pytest.approx(plain_score(w, counts, own, model), rel=1e-4)
    assert len({r["score"] for r in bilinear.score(extra, extra).collect() if r["doc_id"] == 3}) == 1
    assert bilinear.score(docs.limit(0), docs.limit(0)).count() == 0
    assert bilinear.score(docs.limit(3), docs.limit(0)).count() == 3


def test_held_out_texts_gain(spark):
    rows = [r for r in bilinear.op9_bilinear_lm(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] for r in rows) / n > sum(r["base_score"] for r in rows) / n + 0.3


def small(n=6, width=3):
    model = bilinear.Bilinear.first(np.array([0.3, 0.25, 0.2, 0.15, 0.06, 0.04]), width)
    model.params = [p.astype(np.float64) for p in model.params]
    model.squares = [p.astype(np.float64) for p in model.squares]
    return model


def test_a_step_follows_the_slope_of_the_contrastive_loss():
    """Slopes by differences of the loss, summed token by token and draw by draw."""
    share = np.array([0.3, 0.25, 0.2, 0.15, 0.06, 0.04])
    draws, batch = 10, 5
    triples = np.random.default_rng(0).integers(0, 6, (3, batch))
    log_noise, below = np.log(draws * share), np.cumsum(share)
    rng = np.random.default_rng(4)
    rng.permutation(batch)
    noise = np.searchsorted(below, rng.random(draws) * below[-1])

    def loss(params):
        context, place, output, bias = params
        total = 0.0
        for two, one, own in triples.T:
            q = context[two] @ place[0] + context[one] @ place[1]
            total += np.log1p(np.exp(-(q @ output[own] + bias[own] - log_noise[own])))
            total += sum(np.log1p(np.exp(q @ output[k] + bias[k] - log_noise[k])) for k in noise)
        return total / batch

    before, after = small(), small()
    after.train(triples, log_noise, below, np.random.default_rng(4), batch, rate=0.1)
    for k, rate in ((0, 0.1), (1, 0.01), (2, 0.1), (3, 0.1)):
        for at in np.ndindex(before.params[k].shape):
            sides = []
            for step in (1e-6, -1e-6):
                params = [p.copy() for p in before.params]
                params[k][at] += step
                sides.append(loss(params))
            slope = (sides[0] - sides[1]) / 2e-6
            moved = after.params[k][at] - before.params[k][at]
            assert moved == pytest.approx(-rate * slope / math.sqrt(1e-6 + slope * slope), abs=1e-5)


def test_training_learns_and_scores_are_normalised():
    rng = np.random.default_rng(2)
    two, one = rng.integers(0, 20, (2, 20_000))
    triples = np.stack([two, one, np.where(rng.random(20_000) < 0.5, two + 3, one + 1) % 20])  # follows either word before
    share = np.full(20, 0.05)
    model = bilinear.Bilinear.first(share)
    model.train(triples, np.log(32 * share).astype(np.float32), np.cumsum(share), rng, 64)
    own = bilinear.Normaliser(model).log10(*triples)
    assert own.mean() > math.log10(0.05) + 0.2
    every = np.array([bilinear.Normaliser(model).log10(np.full(20, a), np.full(20, b), np.arange(20)) for a, b in ((0, 0), (3, 7))])
    assert np.allclose((10.0**every).sum(axis=1), 1, atol=1e-5)
    again = model.filled(model.to_bytes())
    assert all(np.array_equal(a, b) for a, b in zip(again.params, model.params, strict=True))
    model.params[0] *= 200  # scores so far apart that their powers vanish
    every = np.array([bilinear.Normaliser(model).log10(np.full(20, a), np.full(20, b), np.arange(20)) for a in range(20) for b in range(20)])
    assert np.allclose((10.0**every).sum(axis=1), 1, atol=1e-3)


def test_models_are_averaged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(bilinear, "FAN_IN", 2)
    docs = table(spark, "/root/testdata/sf0.001", "documents").select(text_bytes().alias("text")).repartition(7)
    words = bilinear.vocabulary(bilinear.token_counts(docs))
    first = bilinear.Bilinear.first(words.share)
    tree = bilinear.train_share(docs, spark.sparkContext.broadcast(words), first, 10**9)
    monkeypatch.setattr(bilinear, "FAN_IN", 1000)
    flat = bilinear.train_share(docs, spark.sparkContext.broadcast(words), first, 10**9)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(tree.params, flat.params, strict=True))


def test_training_looks_up_words_that_are_classes_alone(spark):
    """All texts of a slice at once, against classes and contexts token by token; the head's many words are not asked for."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").select(text_bytes().alias("text"))
    words = bilinear.vocabulary(bilinear.token_counts(docs))
    own = {t: int(words.klass[k]) for t, k in words.index.items() if 0 < words.klass[k] < bilinear.WORD_CLASSES}
    texts = [b"", b"a \x00 \xff\x0bzq", b"", b"Aa b the\x00 \x00\x00 \xc3\xa9", *(bytes(r["text"]) for r in docs.limit(40).collect()), b"x"]
    right, heads = [], []
    for text in texts:
        two = one = 0
        for t in text.lower().split() + [b"\n"]:
            right.append((two, one, plain_class(t, own)))
            heads.append(words.index.get(t, -1))
            two, one = one, right[-1][2]
    assert words.heads(*words.tokens(texts)[:2]).tolist() == heads
    words.index = None
    assert list(map(tuple, words.triples(texts).T.tolist())) == right
