"""Language identification: code lengths byte by byte, held-out accuracy, odd rows."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import ppm
from curatrix.llm.common import table

FOLDER = "/root/testdata/sf0.01"


class Plain:
    """Contexts as byte strings in dictionaries; one byte at a time, with the excluded bytes as a set."""

    def __init__(self, texts):
        self.seen = collections.defaultdict(collections.Counter)
        for text in texts:
            text = b"\n\n\n\n" + text
            for k in range(4, len(text)):
                for d in range(5):
                    self.seen[text[k - d : k]][text[k]] += 1

    def bits(self, text):
        text, total = b"\n\n\n\n" + text, 0.0
        for k in range(4, len(text)):
            gone, share = set(), 1.0
            for d in range(4, -1, -1):
                left = {c: n for c, n in self.seen.get(text[k - d : k], {}).items() if c not in gone}
                if not left:
                    continue
                whole = sum(left.values()) + len(left)
                if text[k] in left:
                    total -= math.log2(share * left[text[k]] / whole)
                    break
                share *= len(left) / whole
                gone |= set(left)
            else:
                total -= math.log2(share / (256 - len(gone)))
        return total


def tree(texts):
    found, n = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *(ppm.grams(b"\n\n\n\n" + t) for t in texts)]), return_counts=True)
    return ppm.Tree(found, n)


@pytest.mark.parametrize("texts", [[b"abracadabra", b"abrakadabra arr", b"a"], [bytes(range(256)) * 2], [b"the cat sat on the mat " * 9, "größer über".encode()], []])
def test_code_lengths_are_exact(texts):
    plain, model = Plain(texts), ppm.Model(["x"], [tree(texts)])
    asked = [b"", b"a", b"abracadabra", b"bar the cat \xff\x00", bytes(range(256)), b"the the the mat", *texts]
    assert model.lengths(asked)[:, 0] == pytest.approx([plain.bits(t) for t in asked], abs=1e-5)
    # a context's probabilities add up to one, but for the last escape where all 256 bytes are known
    every = np.exp2(-model.lengths([bytes([c]) for c in range(256)])[:, 0]).sum()
    assert every == pytest.approx(17 / 18 if len(set(b"".join(texts))) == 256 else 1, abs=1e-6)


def test_pieces_change_nothing(monkeypatch):
    texts = [b"the cat sat on the mat " * 50, b"", b"x", b"on the other hand " * 7]
    model = ppm.Model(["a", "b"], [tree(texts[:1]), tree(texts[3:])])
    whole = model.lengths(texts)
    monkeypatch.setattr(ppm, "PIECE", 13)
    assert np.array_equal(model.lengths(texts), whole)


def test_query(spark):
    docs = {r["doc_id"]: r for r in table(spark, FOLDER, "documents").collect()}
    rows = ppm.op13_ppm_language(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"]]
    assert np.mean(right) > 0.98
    learned = collections.defaultdict(list)
    for d, r in docs.items():
        if zlib.crc32(str(d).encode()) % 3 != 1:
            learned[r["lang"]].append(r["text"].encode())
    plain = {lang: Plain(texts) for lang, texts in sorted(learned.items())}
    some = [r for r in rows if len(docs[r["doc_id"]]["text"]) < 3000][:40]
    for r in some:
        bits = {lang: p.bits(docs[r["doc_id"]]["text"].encode()) for lang, p in plain.items()}
        assert r["lang_pred"] == min(bits, key=bits.get)
        assert r["score"] == pytest.approx(1 / sum(2 ** (bits[r["lang_pred"]] - b) for b in bits.values()), abs=1e-6)


def test_held_out_languages_teach_nothing(spark):
    docs = table(spark, FOLDER, "documents")
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit("zz")).otherwise(F.col("lang")))
    model = ppm.fit(changed.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    assert model.langs == ["de", "en", "es", "fr"]


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, "aa bb", "x") for k in range(300)] + [(1, f"cc {k}", "y") for k in range(5)], "doc_id long, text string, lang string")
    source = docs.select(F.col("doc_id").alias("id"), "lang", F.col("text").cast("binary").alias("text"))
    n = {r["lang"]: r["count"] for r in ppm._sample(source, 50).groupBy("lang").count().collect()}
    assert 20 <= n["x"] <= 50 and n["y"] == 5


def test_odd_rows(spark):
    rows = [(None, None, "en", 1), (1, "", "en", 1), (2, " 123 ½ \n", "en", 1), (3, "the cat sat on the mat", "en", 1), (3, "the cat sat on the mat", "en", 1), (4, "der Hund und die Katze", "de", 1), (5, "the dog", None, 1), (6, "é", None, 1), (None, "the " * 40000, "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").withColumn("id", F.lit("x")).withColumn("n", F.lit(0)).withColumn("gram", F.lit(0))
    model = ppm.fit(df)
    assert model.langs == ["de", "en"]
    got = sorted(((r["doc_id"], r["lang_pred"]) for r in ppm.predict(df, model).collect()), key=repr)
    assert [g for g in got if g[0] not in (5, 6)] == sorted([(None, "und"), (1, "und"), (2, "und"), (3, "en"), (3, "en"), (4, "de"), (None, "en")], key=repr)
    assert all(g[1] in ("de", "en") for g in got if g[0] in (5, 6)) and len(got) == len(rows)
    none = ppm.fit(df.limit(0))
    assert none.langs == [] and {(r["lang_pred"], r["score"]) for r in ppm.predict(df, none).collect()} == {("und", 0.0)}
    assert ppm.predict(df.limit(0), model).count() == 0
