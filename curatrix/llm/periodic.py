"""Runs (maximal repetitions) of words, by the algorithm of Kolpakov and Kucherov.

Words are stretches without ASCII blanks. A run is a stretch of consecutive words
with smallest period q, at least ``LEAST`` words and ``TIMES`` periods long, that
no neighbouring word extends. Each text is searched whole:

1. The text is factorised (Lempel-Ziv): a factor is the longest stretch that
   begins somewhere before it too, found with a suffix automaton whose states know
   where their strings end first.
2. Runs that touch the border between two factors come from Main's algorithm:
   common prefixes and suffixes around the border, for each period that a run
   there can have.
3. Runs inside a factor are copied from its earlier occurrence.

Every three consecutive words of a run occur three times in it, so stretches of
words whose neighbours in threes are rarer in the text hold no run and no run
crosses them; the algorithm works on what lies between (exact, not a cut).

A null text has no words; a null id counts as the empty text where an id is
hashed. Rows may repeat; other columns are not read. Memory grows with a text's
longest repetitive stretch (about 700 bytes a word); nothing gathers over rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import slices, table, text_bytes

LEAST = 6
TIMES = 4
#: One document in so many gets a periodic tail in the query.
PLANT = 10

Run = tuple[int, int, int]


class Automaton:
    """Suffix automaton of a sequence of numbers under ``width``; ``first`` holds the end of a state's earliest occurrence."""

    def __init__(self, s: list[int], width: int) -> None:
        self.width = width
        self.step: dict[int, int] = {}
        self.first = [-1]
        size, link, out = [0], [-1], [[]]
        step, first, last = self.step, self.first, 0
        for at, c in enumerate(s):
            new = len(size)
            size.append(size[last] + 1)
            link.append(0)
            first.append(at)
            out.append([])
            p = last
            while p >= 0 and (key := p * width + c) not in step:
                step[key] = new
                out[p].append(c)
                p = link[p]
            if p >= 0:
                q = step[p * width + c]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:
                    twin = len(size)
                    size.append(size[p] + 1)
                    link.append(link[q])
                    first.append(first[q])
                    out.append(out[q][:])
                    for x in out[q]:
                        step[twin * width + x] = step[q * width + x]
                    link[q] = link[new] = twin
                    while p >= 0 and step.get(p * width + c) == q:
                        step[p * width + c] = twin
                        p = link[p]
            last = new


def factors(s: list[int], width: int) -> list[tuple[int, int, int]]:
    """(begin, end, earlier begin): the longest stretches that also begin earlier, which may overlap; a new word stands alone with -1."""
    automaton = Automaton(s, width)
    step, first, out, at, n = automaton.step, automaton.first, [], 0, len(s)
    while at < n:
        state, end, source = 0, at, -1
        while end < n:
            following = step[state * width + s[end]]
            begin = first[following] - (end - at)
            if begin >= at:
                break
            state, source, end = following, begin, end + 1
        end = max(end, at + 1)
        out.append((at, end, source))
        at = end
    return out


def prefixes(s: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of the sequence and its rest from there (0 at the first place)."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for k in range(1, n):
        j = min(z[k - left], right - k) if k < right else 0
        if k + j >= right:
            while k + j < n and s[j] == s[k + j]:
                j += 1
            left, right = k, k + j
        z[k] = j
    return z


def at_border(s: list[int], before: int, border: int, end: int, times: int) -> Iterator[Run]:
    """(begin, end, period) of runs that touch ``border`` and end at ``end`` or sooner; factors lie from ``before`` to ``border`` and from there to ``end``.

    A factor and the word after it never occur earlier together, so such a run
    begins less than a period before ``before``; with ``times`` periods in all, its period
    is under the two factors' length divided by ``times - 1``.
    """
    longest = (end - before - 1) // (times - 1)
    if not longest:
        return
    low = max(0, before - longest)
    right = s[border : end + 1]
    left = s[low:border][::-1]
    room = len(left)
    ahead = prefixes(right)  # of the right side with itself, shifted
    behind = prefixes(left)
    # the left side's last words with those before each place of the right side
    upto = right[: min(longest, len(right))][::-1]
    back = prefixes([*left, -1, *upto, *left])
    # the right side with what begins up to a period before the border
    fore = prefixes([*right, -1, *left[:longest][::-1], *right])
    near = min(longest, room)
    lowest = low if low else -1  # what begins there ends at this border and was found whole at the one before
    for p in range(1, longest + 1):
        if p <= end - border:
            lp = ahead[p] if p < len(right) else 0
            ls = min(back[room + 1 + len(upto) - p], room)
            if lp + ls + p >= times * p and border + p + lp <= end and border - ls > lowest:
                yield border - ls, border + p + lp, p
        if p <= near:
            ls = behind[p] if p < room else 0
            lp = min(fore[len(right) + 1 + near - p], len(right))
            if ls + lp + p >= times * p and border + lp <= end and border - p - ls > lowest:
                yield border - p - ls, border + lp, p


def stretch_runs(s: list[int], width: int, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(begin, length, period) of every run of a sequence of numbers from 0 to ``width - 1``; ``times`` is 2 or more."""
    found: dict[int, dict[int, int]] = {}  # begin -> end -> smallest period

    def add(begin: int, end: int, period: int) -> None:
        ends = found.setdefault(begin, {})
        ends[end] = min(period, ends.get(end, period))

    cut = factors(s, width)
    before = 0
    for begin, end, source in [*cut, (len(s), len(s), -1)]:
        for run in at_border(s, before, begin, end, times):
            add(*run)
        before = begin
        if source >= 0 and end - begin > 2:
            shift = begin - source
            for x in range(source + 1, source + end - begin):
                if x in found:
                    for e, p in list(found[x].items()):
                        if e < end - shift:
                            add(x + shift, e + shift, p)
    return sorted((b, e - b, p) for b, ends in found.items() for e, p in ends.items() if e - b >= least)


def repeated(ids: np.ndarray, times: int = TIMES) -> np.ndarray:
    """Whether the three words from each place on occur ``times - 1`` times at least in the text (the last two places: false)."""
    out = np.zeros(len(ids), dtype=bool)
    if len(ids) > 2:
        width = int(ids.max()) + 1
        _, pair = np.unique(ids[:-1] * width + ids[1:], return_inverse=True)
        _, three, n = np.unique(pair[:-1] * width + ids[2:], return_inverse=True, return_counts=True)
        out[:-2] = n[three] >= times - 1
    return out


def runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(begin, length, period) of every run of a text's words, by begin and period; ``times`` is 4 or more and ``least`` 6 or more."""
    if len(words) < least:
        return []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    may = np.concatenate([[False], repeated(ids), [False]])
    edges = np.flatnonzero(may[1:] != may[:-1])
    out = []
    for begin, end in zip(edges[::2].tolist(), (edges[1::2] + 2).tolist(), strict=True):
        if end - begin >= least:
            kinds, part = np.unique(ids[begin:end], return_inverse=True)
            out += [(begin + b, n, p) for b, n, p in stretch_runs(part.tolist(), len(kinds), least, times)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for begin, n, p in found:
        gone[begin + p] += 1
        gone[begin + n] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def planted(words: list[bytes], crc: int, every: int = PLANT) -> list[bytes]:
    """A document's words as the query takes them: for one hash in ``every``, a periodic tail from a hashed place on."""
    n, g = len(words), crc // every
    if crc % every or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    head = words[a : a + p]
    return [*words[:a], *(head * ((n - a) // p + 1))[: n - a]]


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def find_runs(docs: DataFrame, plant: int | None = None, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed, runs_sha256, collapsed_sha256) for every row: ``runs`` lists (start, length, period), ``collapsed`` is the text's words without the repetitions.

    ``plant`` makes the tail of one document in so many periodic first, by the crc32 of its id.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = ["doc_id", "runs", "collapsed", "runs_sha256", "collapsed_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, texts, shas, kept_shas = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = bytes(text.as_buffer()).split()
                if plant is not None:
                    words = planted(words, zlib.crc32(b"" if doc is None else b"%d" % doc), plant)
                found = runs(words, least, times)
                kept = b" ".join(collapsed(words, found))
                rows.append([{"start": b, "length": n, "period": p} for b, n, p in found])
                texts.append(kept)
                shas.append(_sha(b"".join(b"%d,%d,%d\n" % r for r in found)))
                kept_shas.append(_sha(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(shas, pa.string()), pa.array(kept_shas, pa.string())], names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string, runs_sha256 string, collapsed_sha256 string")


def longest_run(found: DataFrame) -> DataFrame:
    """Adds n_runs and start, length, period, exponent_milli of the longest run (ties: the smallest start, then period; none: nulls)."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("_best", best).withColumns({"n_runs": F.size("runs").cast("long"), "start": -F.col("_best.start"), "length": F.col("_best.length"), "period": -F.col("_best.period"), "exponent_milli": F.floor(F.lit(1000) * F.col("_best.length") / -F.col("_best.period"))}).drop("_best")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Contract columns: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    found = longest_run(find_runs(table(spark, sf_dir, "documents"), plant=PLANT))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
