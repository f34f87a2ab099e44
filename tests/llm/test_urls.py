"""URL filters against a plain version of the whole query: rules, unigrams, compounds, splits, naive Bayes."""

import collections
import itertools
import math
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from curatrix.llm import urls
from curatrix.llm.common import table

SMOOTH, LEAST, LONGEST = 0.1, 3, 32


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def rule(host, path):
    fits = [(len(h) + len(p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def runs(host, path):
    return re.findall(r"[^\W\d_]+", f"{host} {path}".lower())


def told(host, path, chain):
    """Words that count: not those of a host's last two labels (of one or two: the last, or all of a rule's host), nor of the first folder."""
    labels = host.split(".")
    host = "" if host in [h for _, h, _ in urls.RULES] else ".".join(labels[:-2] if len(labels) > 2 else labels[:-1])
    if path.startswith("/") and "/" in path[1:]:
        path = path[1:].split("/", 1)[1]
    return [w for r in runs(host, "") + runs("", path) for w in chain[r]]


def cost(words, counts, total):
    return sum(math.log(total) - (math.log(counts[w]) if w in counts and len(w) >= 2 else math.log(0.5) - math.log(10) * len(w)) for w in words)


def splits(run):
    for n in range(len(run)):
        for cut in itertools.combinations(range(1, len(run)), n):
            yield [run[a:b] for a, b in zip((0, *cut), (*cut, len(run)), strict=True)]


def brute(pages):
    """(page_id, host, path, rule, verdict, words) of every row, in plain Python."""
    rows = [(p, *parts(u)) for p, u in pages]
    counts = collections.Counter(r for _, h, p in rows for r in runs(h, p))
    words = {r: n for r, n in counts.items() if len(r) <= LONGEST and not any(len(s) > 1 and all(len(w) >= LEAST and counts.get(w, 0) > n for w in s) for s in (splits(r) if len(r) <= 14 else []))}
    total = sum(words.values()) + 1
    chain = {r: min(splits(r), key=lambda s: (round(cost(s, words, total), 9), len(s))) if len(r) <= 14 else [r] for r in counts}
    seen = {"block": collections.Counter(), "allow": collections.Counter()}
    n = collections.Counter()
    for _, h, p in rows:
        verdict = rule(h, p)[1]
        if verdict and zlib.crc32(f"{h} {p}".encode()) % 5:
            n[verdict] += 1
            seen[verdict].update(told(h, p, chain))
    vocabulary = set(seen["block"]) | set(seen["allow"])
    size = {k: sum(c.values()) + SMOOTH * max(len(vocabulary), 1) for k, c in seen.items()}
    odds = {w: math.log((seen["block"][w] + SMOOTH) / size["block"]) - math.log((seen["allow"][w] + SMOOTH) / size["allow"]) for w in vocabulary}
    prior = math.log((n["block"] + 1) / (n["allow"] + 1))
    out = []
    for page, h, p in rows:
        name, verdict = rule(h, p)
        own = [w for r in runs(h, p) for w in chain[r]]
        margin = prior + sum(odds.get(w, 0.0) for w in told(h, p, chain))
        out.append((page, h, p, name, verdict or ("block" if own and margin > 0 else "allow"), " ".join(own), round(margin, 6)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def found(spark, rows, **params):
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("run", F.lit(1)).withColumn("words", F.lit("x"))
    return [(*(r[c] for c in ("page_id", "host", "path", "rule", "verdict", "words")), round(r["log_odds"], 6)) for r in urls.judge(pages, *urls.fit(pages), **params).collect()]


ROWS = [(1, "http://A.Example.NET/en/x?q"), (2, "https://x.net"), (3, "https://x.net/"), (4, "ftp://net/a#b"), (5, "http://m.example.com/de/1"), (6, "http://a.org/fr/"), (7, None), (8, "no url"), (None, "http://thther.example.com/en/1"), (9, "://"), (9, "http://?")]
ROWS += [(10 + k, f"http://{w}.net/{k}") for k, w in enumerate(["cheap-pills", "pills", "cheap", "pills.cheap"] * 3)]
ROWS += [(40 + k, f"http://{w}.example.org/fr/{k}") for k, w in enumerate(["museum", "garden.museum", "garden"] * 3)]
ROWS += [(60, "http://cheappills.example.com/en"), (61, "http://gardenmuseum.example.com/en"), (61, "http://gardenmuseum.example.com/en"), (62, "https://É.Ünï.com/x_y1z")]


def test_rules_and_splits(spark):
    by = {r[0]: r for r in found(spark, ROWS)}
    assert by[1][3:5] == ("example.net/en/", "allow") and by[1][1:3] == ("a.example.net", "/en/x")
    assert by[2][2:4] == ("", None) and by[3][3:5] == ("net/", "block") and by[4][1:5] == ("net", "/a", "net/", "block")
    assert by[5][3:5] == ("example.com/de/", "block") and by[6][3:5] == ("org/fr/", "allow")
    assert by[7][1:6] == by[8][1:6] == ("", "", None, "allow", "")
    assert by[60][4:6] == ("block", "cheap pills example com en") and by[61][4:6] == ("allow", "garden museum example com en")


@pytest.mark.parametrize("head", [50_000, 3, 0])
def test_the_whole_query_is_brute_force(spark, head):
    """With every run sent to the tasks, with some, and with none."""
    assert order(found(spark, ROWS, head=head)) == order(brute(ROWS))


def test_the_driver_s_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["page_id"], r["url"]) for r in table(spark, folder, "pages").select("page_id", "url").collect()]
    got = [(*(r[c] for c in ("page_id", "host", "path", "rule", "verdict", "words")), round(r["log_odds"], 6)) for r in urls.op3_url_words(spark, folder).collect()]
    assert order(got) == order(brute(rows))


def test_held_out_urls(spark):
    """Of urls that rules judge, without what rules look at: better than the commoner verdict for all, which is all that their words say."""
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    known, prior = urls.fit(pages)
    truth = {(r["host"], r["path"]): r["verdict"] for r in urls.examples_of(urls.ruled(pages), held_out=True).collect()}
    said = {(r["host"], r["path"]): "block" if r["log_odds"] > 0 else "allow" for r in urls.judge(pages, known, prior).collect()}
    commoner = max(collections.Counter(truth.values()).values()) / len(truth)
    assert sum(said[k] == v for k, v in truth.items()) / len(truth) > commoner + 0.05


def test_places_of_rules_have_no_odds(spark):
    rows = [("x.example.net", "/en/cheap/de/"), ("example.com", "/de/"), ("net", "/a"), ("shop.net", "/es"), ("", ""), ("a.b.example.org", "/fr/x"), ("1.2.3.4", "/")]
    df = spark.createDataFrame(rows, "host string, path string")
    before, after = urls.unseen_part(F.col("host"), F.col("path"))
    assert [tuple(r) for r in df.select(before.alias("b"), after.alias("a")).collect()] == [("x", "/cheap/de/"), ("", "/"), ("", "/a"), ("shop.", "/es"), ("", ""), ("a.b", "/x"), ("1.2", "/")]


def test_segmentation_is_the_cheapest_split():
    counts = {"free": 5, "bets": 4, "be": 3, "ts": 1, "freebe": 1}
    for run in ("freebets", "betsfree", "xfree", "ts", "freebetsbe", "a", "freexbets"):
        best = min(cost(x, counts, 15) for x in splits(run))
        assert math.isclose(cost(urls.split(run, counts, 15, 24), counts, 15), best)


def test_empty_and_very_long(spark):
    assert found(spark, []) == []
    began = time.time()
    long = "http://a.com/" + "cheapgarden" * 10_000
    rows = found(spark, [(1, long), (2, "http://cheap.org/fr/garden"), (3, "http://garden.net/cheap")])
    assert len(rows) == 3 and {r[0]: r[5] for r in rows}[1].split().count("garden") == 10_000
    assert time.time() - began < 120
