"""Importance resampling: counts, gains, weights and ranks against plain Python; odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import importance
from curatrix.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features_of(text):
    w = words_of(text)
    return [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def plain_counts(texts):
    n = collections.Counter(f for t in texts for f in features_of(t))
    out = collections.defaultdict(lambda: [0, 0])
    for f, k in n.items():
        b = zlib.crc32(f.encode()) % 10000
        out[b][0] += k
        out[b][1] += 1
    return {b: tuple(v) for b, v in out.items()}


def plain(docs, target):
    s, t = plain_counts(text for _, text in docs), plain_counts(target)
    total_s, total_t = sum(v[0] for v in s.values()), sum(v[0] for v in t.values())
    gain = [math.floor(1000 * math.log((t.get(b, (0,))[0] + 1) * (total_s + 10000) / ((s.get(b, (0,))[0] + 1) * (total_t + 10000)))) for b in range(10000)]
    rows = []
    for doc, text in docs:
        f = features_of(text)
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def counted(frame):
    return {r["bucket"]: (r["n"], r["distinct"]) for r in importance.bucket_counts(frame).collect()}


def drawn(docs, target):
    gain = importance.gains(importance.bucket_counts(docs), importance.bucket_counts(target))
    return importance.draw(importance.weigh(docs, gain))


def test_query_is_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, FOLDER, "documents").collect()]
    got = importance.op11_importance(spark, FOLDER)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, [r["text"] for r in table(spark, FOLDER, "benchmark").collect()])


def test_dictionary_counts_every_string_once(spark):
    docs = table(spark, FOLDER, "documents")
    want = plain_counts(r["text"] for r in docs.collect())
    assert counted(docs) == want
    few = {r["bucket"]: (r["n"], r["distinct"]) for r in importance.bucket_counts(docs, part_bytes=20_000).collect()}
    assert few == want


def test_pieces_overlap_by_two_words(monkeypatch):
    text = (b"Some Words of \xc3\xa9t\xc3\xa9, 12-and more_" * 40) + b"x" * 300 + b" end of it"
    want = collections.Counter(features_of(text.decode()))
    for most, halved in ((20, False), (64, False), (100_000, False), (100_000, True)):
        got = collections.Counter()
        made = (x for chunk in importance.chunks([text, b"", text], most) for x in importance.numbered(chunk))
        if halved:  # each chunk in halves, as if it had too many words
            made = (x for chunk in importance.chunks([text, b"", text], most) for half in importance.gathered(((r, lead if k else b, p) for r, b, piece in chunk for k, (lead, p) in enumerate(importance.pieces(piece, 700))), 700) for x in importance.numbered(half))
        for _, f in made:
            w = f.words.words.to_pylist()
            for order in (1, 2, 3):
                for parts in zip(*importance._split(f.of(order)[0], f.base, order), strict=True):
                    got[b" ".join(w[int(k)] for k in parts).decode()] += 1
        assert got == {k: 2 * n for k, n in want.items()}


def test_crc_of_joined_halves():
    rng = np.random.default_rng(0)
    first = [rng.bytes(n) for n in (0, 1, 5, 1000)]
    second = [rng.bytes(n) for n in (3, 0, 70000, 17)]
    crc = lambda x: np.array([zlib.crc32(b) for b in x], dtype=np.uint32)
    assert importance.joined_crc(crc(first), crc(second), np.array([len(b) for b in second])).tolist() == [zlib.crc32(a + b) for a, b in zip(first, second, strict=True)]


@pytest.fixture(scope="module")
def odd():
    long = " ".join(f"word{k % 977} of" for k in range(30000))
    return [(None, None), (None, "the cat " * 15), (1, ""), (2, "--- !!"), (3, "The CAT sat " * 8), (3, "The CAT sat " * 8), (4, "été " * 25), (5, long), (6, "a"), (6, "a b")] + [(k, f"the mat {k} on " * 6) for k in range(10, 60)]


def test_odd_rows(spark, odd, monkeypatch):
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "score", "bucket", "part", "rank", "_row", "_range", "weight")})
    target = spark.createDataFrame([("the cat sat",), (None,), ("",)], "text string")
    rows = lambda frame: sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert rows(drawn(df, target)) == plain(odd, ["the cat sat"])
    assert rows(drawn(df, target.limit(0))) == plain(odd, [])
    assert rows(drawn(df.limit(0), target)) == []
