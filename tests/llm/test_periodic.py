"""Runs of words: every stretch against brute force, the whole query row by row, odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from curatrix.llm import periodic
from curatrix.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def brute(s, least=6, times=4):
    """Every maximal stretch of each period, longest first for a period that divides another."""
    found = {}
    for p in range(1, len(s) // times + 1):
        k = 0
        while k + p < len(s):
            end = k
            while end + p < len(s) and s[end] == s[end + p]:
                end += 1
            if end + p - k >= times * p and end > k:
                found.setdefault((k, end + p), p)
            k = end + 1
    return sorted((b, e - b, p) for (b, e), p in found.items() if e - b >= least)


def noisy(rng):
    s = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 40))]
    while s and rng.random() < 0.6:
        a, p = rng.randrange(len(s)), rng.randint(1, 8)
        s[a:a] = (s[a : a + p] * 40)[: rng.randint(1, 50)]
    return s


def test_runs_are_those_of_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        s = noisy(rng)
        for least, times in ((2, 2), (3, 3), (6, 4)):
            assert periodic.stretch_runs(s, 5, least, times) == brute(s, least, times), s
        assert periodic.runs([b"%d" % c for c in s]) == brute(s), s


def test_factors_are_the_longest_that_begin_earlier():
    rng = random.Random(6)
    for _ in range(300):
        s = noisy(rng)
        at = 0
        for begin, end, source in periodic.factors(s, 5):
            assert begin == at
            if source >= 0:
                assert source < begin and s[source : source + end - begin] == s[begin:end]
            longer = s[begin : end + 1]
            assert end == len(s) or not any(s[k : k + len(longer)] == longer for k in range(begin)) or (source < 0 and longer[:1] not in [s[k : k + 1] for k in range(begin)])
            at = end
        assert at == len(s)


def plain_row(doc, text, plant=10):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc).encode()) if doc is not None else 0
    g, n = h // 10, len(words)
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    drop = {i for b, length, p in found for i in range(b + p, b + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{b},{length},{p}\n" for b, length, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_is_brute_force(spark):
    want = sorted(plain_row(r["doc_id"], r["text"]) for r in table(spark, FOLDER, "documents").collect())
    got = periodic.op12_periodic_runs(spark, FOLDER)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(r[1] for r in want)


LONG = " ".join(["x y z"] * 20000)
ROWS = [(None, None), (None, "a a a a a a"), (1, ""), (2, " \t\n"), (3, "a " * 6), (3, "a " * 6), (4, "a " * 5), (5, "é é é é é é é"), (6, LONG), (7, "a b a b a b a b c c c c c c"), (8, "p q r s t u v w x y")]


@pytest.mark.parametrize("plant", [None, 10])
def test_odd_rows(spark, plant):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("runs", F.lit("x")).withColumn("start", F.lit(1.5)).withColumn("n_runs", F.lit(None).cast("int"))
    got = periodic.longest_run(periodic.find_runs(df, plant=plant)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    short = [r for r in ROWS if r[1] != LONG]
    assert sorted((tuple(r) for r in got.where("doc_id is null or doc_id != 6").collect()), key=repr) == sorted((plain_row(d, t, plant) for d, t in short), key=repr)
    assert got.where("doc_id = 6").first()["length"] >= 3000
    assert periodic.find_runs(df.limit(0), plant=plant).count() == 0


def test_texts_lose_their_repetitions(spark):
    df = spark.createDataFrame([(1, "say no no no no no no more"), (2, "ab ab cd")], "doc_id long, text string")
    assert {r["doc_id"]: (r["collapsed"], [tuple(x) for x in r["runs"]]) for r in periodic.find_runs(df).collect()} == {1: ("say no more", [(1, 6, 1)]), 2: ("ab ab cd", [])}
