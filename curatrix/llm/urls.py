"""URL filters: host rules, then host word segmentation and multinomial naive Bayes.

A rule names a host and the beginning of a path; it fits its host and all
subdomains, and the longest that fits decides. Other urls are judged by their
words: host and path are cut into runs of letters, each run is split into words
by a Viterbi search over unigram probabilities, and naive Bayes adds up the
words' log odds. The urls that a rule judges are its labelled examples, but for
a held-out fifth (crc32 of host and path mod 5 is 0); there are no word lists. Words where
rules look (host endings, first folders) have no odds: examples would only teach the rules back.

The unigrams are the counts of all runs of the whole table. A run of at most
``longest`` letters is a word of the dictionary, unless it is a compound: a chain
of two or more runs of ``least`` letters or more, each seen more often than
itself. An unknown word of n letters costs as much as ``UNKNOWN`` smoothed
sightings divided by 10 for each letter, so names without known parts stay whole.

Nothing is cut off by rank: the dictionary stays a table, and each distinct run
meets those of its parts that are words in an equi-join. Tasks are sent the
``head`` commonest short runs with their words; urls with another run meet the
table of runs in a second join, with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import durable, table
from curatrix.llm.graph import meet

#: Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNKNOWN = 0.5
#: Least letters of a word that a run may be split into.
SHORT = 2
#: Most letters of a run that is sent to every task.
BRIEF = 64
#: Log odds are added as whole billionths, so sums do not depend on their order.
UNIT = 1e9


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without a ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), _UPPER, _LOWER), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule such as ``net/``, its verdict) of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def runs_of(host: Column, path: Column) -> Column:
    """The lower-cased runs of letters of host and path, in order."""
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", host, path)), F.lit(r"\p{L}+"), F.lit(0))


def split(run: str, counts: dict[str, int], total: int, longest: int) -> list[str]:
    """The cheapest chain of words, by dynamic programming over its ends; fewer words win ties.

    An unknown word may have any length: its cost adds up letter by letter, so
    the best one that ends here begins at the best place before it.
    """
    base = math.log(total)
    open_cost = base - math.log(UNKNOWN)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    spread = (0.0, 0, 0)  # the cheapest begin of an unknown word, its cost less 10 for each letter before
    for end in range(1, len(run) + 1):
        choices = [(spread[0] + open_cost + math.log(10) * end, spread[1] + 1, spread[2])]
        for at in range(max(0, end - longest), end - SHORT + 1):
            n = counts.get(run[at:end])
            if n is not None:
                choices.append((best[at][0] + base - math.log(n), best[at][1] + 1, at))
        best.append(min(choices))
        spread = min(spread, (best[end][0] - math.log(10) * end, best[end][1], end))
    words, end = [], len(run)
    while end:
        at = best[end][2]
        words.append(run[at:end])
        end = at
    return words[::-1]


def is_compound(run: str, own: int, counts: dict[str, int], least: int, longest: int) -> bool:
    """Whether the run is a chain of words of ``least`` letters or more, each seen more often than ``own``."""
    reached = [True] + [False] * len(run)
    for end in range(least, len(run) + 1):
        reached[end] = any(reached[at] and counts.get(run[at:end], 0) > own for at in range(max(0, end - longest), end - least + 1))
    return reached[-1]


def unigrams(rows: DataFrame) -> DataFrame:
    """(run, n) over a frame with the column runs."""
    return rows.select(F.explode("runs").alias("run")).groupBy("run").agg(F.count("*").alias("n"))


def _with_parts(runs: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """(run, n, parts): each run's distinct parts among ``words`` with their counts; at most ``longest`` for each letter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column(0).to_pylist():
                found = list({run[at:end] for at in range(len(run)) for end in range(at + SHORT, min(len(run), at + longest) + 1)})
                for k in range(0, len(found), 50_000):
                    part = found[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([run] * len(part)), pa.array(part)], names=["run", "part"])

    parts = runs.select("run").mapInArrow(cut, "run string, part string")
    met = meet(parts, words.select(F.col("run").alias("part"), F.col("n").alias("seen")), "part", "run")
    listed = met.groupBy("run").agg(F.collect_list(F.struct("part", "seen")).alias("parts"))
    return runs.select("run", "n").join(listed, "run", "left")


def dictionary(runs: DataFrame, least: int = 3, longest: int = 32) -> DataFrame:
    """The runs (run, n) that are words: short enough, and no compounds."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not is_compound(run, n, {p["part"]: p["seen"] for p in parts or () if p["part"] != run}, least, longest) for run, n, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["run", "n"]).filter(pa.array(keep, pa.bool_()))

    short = runs.where(F.length("run") <= longest)
    return _with_parts(short, short, longest).mapInArrow(whole, "run string, n long")


def segment(runs: DataFrame, words: DataFrame, longest: int = 32) -> DataFrame:
    """(run, n, words) for every run."""
    total = (words.agg(F.sum("n")).first()[0] or 0) + 1

    def cheapest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [split(run, {p["part"]: p["seen"] for p in parts or ()}, total, longest) for run, parts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["run", "n", "words"])

    return _with_parts(runs, words, longest).mapInArrow(cheapest, "run string, n long, words array<string>")


def fit_bayes(examples: DataFrame, segmented: DataFrame, smooth: float = 0.1) -> tuple[DataFrame, float]:
    """(word, odds) of multinomial naive Bayes, log odds of block in whole billionths, and the prior's log odds.

    ``examples`` has (verdict, runs). The prior is the smoothed share of either verdict.
    """
    n = {r["verdict"]: r["count"] for r in examples.groupBy("verdict").count().collect()}
    prior = math.log((n.get("block", 0) + 1) / (n.get("allow", 0) + 1))
    seen = lambda kind: F.sum((F.col("verdict") == kind).cast("long")).alias(kind)
    by_run = examples.select("verdict", F.explode("runs").alias("run")).groupBy("run").agg(seen("block"), seen("allow"))
    by_word = durable(by_run.join(segmented, "run").select(F.explode("words").alias("word"), "block", "allow").groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")))
    size = by_word.agg(F.count("*").alias("v"), F.coalesce(F.sum("block"), F.lit(0)).alias("block"), F.coalesce(F.sum("allow"), F.lit(0)).alias("allow")).first()
    rest = math.log(size["allow"] + smooth * max(size["v"], 1)) - math.log(size["block"] + smooth * max(size["v"], 1))
    odds = F.log(F.col("block") + smooth) - F.log(F.col("allow") + smooth) + rest
    return by_word.select("word", F.round(odds * UNIT).cast("long").alias("odds")), prior


def run_odds(segmented: DataFrame, odds: DataFrame) -> DataFrame:
    """(run, n, words, odds): the sum of its words' log odds; a word of no example counts nothing."""
    each = segmented.select("run", F.explode("words").alias("word"))
    sums = meet(each, odds, "word", "run").groupBy("run").agg(F.sum("odds").alias("odds"))
    return segmented.join(sums, "run", "left").select("run", "n", F.concat_ws(" ", "words").alias("words"), F.coalesce("odds", F.lit(0)).alias("odds"))


def _head(known: DataFrame, most: int) -> tuple[dict[str, tuple[str, int]], bool]:
    """The commonest brief runs, ``most`` at most, and whether they are all; counts are ranked by powers of two."""
    rank = F.log2("n").cast("int")
    brief = known.where(F.length("run") <= BRIEF)
    left, least = most, None
    for row in sorted(brief.groupBy(rank.alias("rank")).count().collect(), reverse=True):
        if row["count"] > left:
            break
        left, least = left - row["count"], row["rank"]
    rows = [] if least is None else brief.where(rank >= least).collect()
    return {r["run"]: (r["words"], r["odds"]) for r in rows}, len(rows) == known.count()


def judge(pages: DataFrame, known: DataFrame, prior: float, rules=RULES, id_col: str = "page_id", url_col: str = "url", head: int = 50_000) -> DataFrame:
    """(page_id, host, path, rule, verdict, words, log_odds) for every row.

    ``known`` has (run, n, words, odds) for every run of the urls. Words and log
    odds are given for all urls, the verdict is the rule's where one fits, else
    block where the log odds are positive. A null url, or one without ``://``, has
    an empty host and path; a url without words is allowed. Ids may be null or
    repeat; other columns are not read; an empty table gives none.
    """
    rows = ruled(pages, rules, id_col, url_col)
    sent, all_of_them = _head(known, head)
    shared = pages.sparkSession.sparkContext.broadcast(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            found = [[get(x) for x in runs] for runs in batch.column(5).to_pylist()]
            full = [None not in f for f in found]
            words = [" ".join(w for w, _ in f) if k else None for f, k in zip(found, full, strict=True)]
            silent = zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)
            odds = [sum(o for _, o in [*f[:a], *f[b:]]) if k else None for f, k, (a, b) in zip(found, full, silent, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(8)), pa.array(words, pa.string()), pa.array(odds, pa.int64())], names=["page_id", "host", "path", "rule", "verdict", "runs", "skip", "skip_end", "words", "odds"])

    done = rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, runs array<string>, skip int, skip_end int, words string, odds long")
    if not all_of_them:
        open_ = done.where(F.col("words").isNull())
        urls = open_.select("host", "path", "runs", "skip", "skip_end").distinct().select(F.struct("host", "path").alias("at"), "skip", "skip_end", F.posexplode("runs").alias("k", "run"))
        met = meet(urls.withColumn("by", F.xxhash64("at")), known.select("run", "words", "odds"), "run", "by")
        found = met.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("k", "words"))).alias("all"), F.sum(F.when((F.col("k") < F.col("skip")) | (F.col("k") >= F.col("skip_end")), F.col("odds")).otherwise(0)).alias("odds"))
        found = found.select(F.xxhash64("at").alias("by"), "at", F.array_join(F.col("all.words"), " ").alias("words"), "odds")
        left = meet(open_.drop("words", "odds").select("*", F.xxhash64(F.struct("host", "path")).alias("by")), found, "by", "page_id")
        left = left.where(F.col("at") == F.struct("host", "path"))
        done = done.where(F.col("words").isNotNull()).unionByName(left.select(done.columns))
    margin = F.col("odds") / UNIT + prior
    verdict = F.when((margin > 0) & (F.col("words") != ""), "block").otherwise("allow")
    return done.select("page_id", "host", "path", "rule", F.coalesce("verdict", verdict).alias("verdict"), "words", margin.alias("log_odds"))


def unseen_part(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Host and path without the places where rules look: at the end of the host as many labels as the longest rule host has (or, of
    a host that is no longer than that, the last one, or all if it is a rule's), and the first folder of the path.

    Words of these places would teach the rules back, so they have no odds, neither in examples nor in urls that are judged.
    """
    labels = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    whole = host.isin(*sorted({h for _, h, _ in rules})) if rules else F.lit(False)
    many = F.size(F.split(host, r"\.")) > labels
    before = F.when(whole, "").when(many, F.regexp_replace(host, rf"(\.[^.]*){{{labels}}}$", "")).otherwise(F.regexp_replace(host, r"[^.]*$", ""))
    return before, F.regexp_replace(path, r"(?s)\A/[^/]*/", "/")


def ruled(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, runs, skip, skip_end) for every row; rule and verdict are null where no rule fits.

    Runs from place ``skip`` up to ``skip_end`` are those that rules look at.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    runs = runs_of(F.col("host"), F.col("path"))
    before, after = unseen_part(F.col("host"), F.col("path"), rules)
    skip, skip_end = F.size(runs_of(before, F.lit(""))), F.size(runs) - F.size(runs_of(F.lit(""), after))
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), runs.alias("runs"), skip.alias("skip"), skip_end.alias("skip_end"))


def examples_of(rows: DataFrame, held_out: bool = False) -> DataFrame:
    """The urls that a rule judges: those that train, or the held-out fifth."""
    fold = F.crc32(F.concat_ws(" ", "host", "path").cast("binary")) % 5 == 0
    return rows.where(F.col("verdict").isNotNull() & (fold if held_out else ~fold))


def fit(pages: DataFrame, rules=RULES, url_col: str = "url") -> tuple[DataFrame, float]:
    """(run, n, words, odds) of all runs of the table, and the prior; both are what ``judge`` needs."""
    rows = ruled(pages.select(F.lit(0).alias("page_id"), F.col(url_col).alias("url")), rules)
    runs = durable(unigrams(rows))
    segmented = durable(segment(runs, durable(dictionary(runs))))
    told = F.filter("runs", lambda r, k: (k < F.col("skip")) | (k >= F.col("skip_end")))
    odds, prior = fit_bayes(examples_of(rows).withColumn("runs", told), segmented)
    return durable(run_odds(segmented, odds)), prior


def op3_url_words(spark, sf_dir: str) -> DataFrame:
    """Contract columns: page_id, host, path, rule, verdict; the words and log odds beside them."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, *fit(pages))
