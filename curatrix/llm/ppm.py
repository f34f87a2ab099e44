"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: how often each byte followed each
context of up to ``DEPTH`` bytes. Counts are frozen after training. A text's code
length under a language is the sum over its bytes of -log2 of their probability:
the longest context that was seen gives the byte with its share of the counts, or
an escape to the context that is one byte shorter (method C: the escape counts as
often as there are different bytes), where bytes of the longer context are excluded;
below the empty context all bytes that are left have equal shares. A text is coded
as if ``DEPTH`` line ends stood before it. The language with the smallest code length is
predicted (ties: the first by name); the score is its posterior among the
languages, all equally likely beforehand.

Fitting reads whole texts of at most ``max_rows`` documents of each language (those
whose hashed id is under a threshold that counts find); texts are counted where they
are, and the model's size is that of the sample's distinct five-byte strings. Whole
texts are scored, in pieces of ``PIECE`` bytes, so memory is bounded for any length.

A null text, or one without a letter (Unicode category L), is ``und`` with score 0, and
so is every text if no language was learned. Empty texts teach nothing. Null and
repeated ids are rows of their own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import give_back, id_crc, table, text_bytes

DEPTH = 4
PIECE = 4_000_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = regex.compile(rb"[A-Za-z]")
_START = b"\n" * DEPTH


def grams(text: bytes) -> np.ndarray:
    """For each byte of ``text`` after its first ``DEPTH``, the byte and the ``DEPTH`` before it as one number."""
    b = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    n = max(len(b) - DEPTH, 0)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(DEPTH + 1):
        out <<= np.uint64(8)
        out |= b[k : k + n]
    return out


@dataclass
class Level:
    """Contexts of one length and the bytes seen after them, all as sorted numbers with logarithms to base 2."""

    contexts: np.ndarray
    #: of all its counts and its escapes, by context
    whole: np.ndarray
    #: bits of an escape from the context as the first one that was seen
    leave: np.ndarray
    #: bits of an escape from the context one byte shorter, without this context's bytes
    pass_on: np.ndarray
    #: of the counts and escapes that are left there
    rest: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray


class Tree:
    """A language's frozen context tree. ``found`` are the distinct numbers of ``grams``, ``times`` their counts."""

    def __init__(self, found: np.ndarray, times: np.ndarray) -> None:
        self.levels: list[Level] = []
        totals = kinds = parents = counts = symbols = None
        for k in range(DEPTH + 1):
            last, last_counts = symbols, counts
            symbols, back = np.unique(found & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            counts = np.bincount(back, weights=times, minlength=len(symbols))
            contexts, first = np.unique(symbols >> np.uint64(8), return_index=True)
            bounds = np.append(first, len(symbols))
            here = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
            many = np.diff(bounds).astype(np.float64)
            if k:
                # what the shorter context keeps when this one's bytes are excluded
                below = np.searchsorted(parents, contexts & np.uint64((1 << 8 * (k - 1)) - 1))
                taken = last_counts[np.searchsorted(last, symbols & np.uint64((1 << 8 * k) - 1))]
                left = totals[below] - (np.add.reduceat(taken, first) if len(first) else 0)
                new = kinds[below] - many
            else:
                left, new = np.zeros(len(contexts)), np.zeros(len(contexts))
            log = lambda x: np.log2(np.maximum(x, 1))  # noqa: E731  zero means that nothing can be coded there
            self.levels.append(Level(contexts, log(here + many), log(here + many) - log(many), log(left + new) - log(new), log(left + new), symbols, log(counts)))
            totals, kinds, parents = here, many, contexts
        self.unseen = np.log2(max(256 - len(self.levels[0].symbols), 1))

    def bits(self, found: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each of the numbers ``found``, given the bytes before it."""
        out = np.zeros(len(found))
        above = np.full(len(found), -1)  # place of the context one byte longer, where it was seen
        at = np.arange(len(found))  # those that are not coded yet
        for k in range(DEPTH, -1, -1):
            level, longer = self.levels[k], self.levels[min(k + 1, DEPTH)]
            g = found[at]
            symbol = g & np.uint64((1 << 8 * (k + 1)) - 1)
            place, known = _find(level.contexts, symbol >> np.uint64(8))
            byte, coded = _find(level.symbols, symbol)
            came = above[at] >= 0
            out[at] += np.where(came, np.where(coded, _take(longer.rest, above[at]), _take(longer.pass_on, above[at])), np.where(coded, _take(level.whole, place), np.where(known, _take(level.leave, place), 0.0))) - np.where(coded, _take(level.counts, byte), 0.0)
            above[at] = np.where(known, place, -1)
            at = at[~coded]
        out[at] += self.unseen
        return out


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table, and whether the number stands there."""
    if not len(table):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``values`` at places that may be meaningless where the result is not used."""
    return values[np.clip(at, 0, len(values) - 1)] if len(values) else np.zeros(len(at))


@dataclass
class Model:
    """The languages in order, each with its tree."""

    langs: list[str]
    trees: list[Tree]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits, a row for each text and a column for each language."""
        out = np.zeros((len(texts), len(self.langs)))
        batch: list[tuple[int, bytes]] = []
        size = 0
        for k, text in enumerate(texts):
            for begin in range(0, len(text), PIECE):
                piece = (text[begin - DEPTH : begin] if begin else _START) + text[begin : begin + PIECE]
                batch.append((k, piece))
                size += len(piece)
                if size >= PIECE:
                    self._add(out, batch)
                    batch, size = [], 0
        self._add(out, batch)
        return out

    def _add(self, out: np.ndarray, batch: list[tuple[int, bytes]]) -> None:
        if not batch:
            return
        each = [grams(piece) for _, piece in batch]
        found, place = _distinct(np.concatenate(each))
        starts = np.cumsum([0, *map(len, each[:-1])])
        for j, tree in enumerate(self.trees):
            # whole numbers add up alike in any order and any piece; under 2^63 for the pieces there are
            cost = np.rint(tree.bits(found) * (1 << 32)).astype(np.int64)
            sums = np.add.reduceat(cost[place], starts)
            for (k, _), s in zip(batch, sums.tolist(), strict=True):
                out[k, j] += s / (1 << 32)


def _distinct(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of 40 bits, and for each given one its place among them; 2^24 numbers at most are sorted with their places."""
    packed = np.sort(numbers << np.uint64(24) | np.arange(len(numbers), dtype=np.uint64))
    value = packed >> np.uint64(24)
    new = np.append(True, value[1:] != value[:-1])
    place = np.empty(len(numbers), dtype=np.int64)
    place[(packed & np.uint64((1 << 24) - 1)).astype(np.int64)] = np.cumsum(new) - 1
    return value[new], place


def _sample(docs: DataFrame, max_rows: int) -> DataFrame:
    """Rows (lang, id, text) of at most ``max_rows`` documents a language, by a threshold on the hashed id; repeated ids take part in the hash with their text."""
    mark = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40))
    share: dict[str, float] = {}
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    for lang, n in counts.items():
        share[lang] = min(1.0, max_rows / n)
    for _ in range(20):
        limit = F.lit(0)
        for lang, s in share.items():
            limit = F.when(F.col("lang") == lang, F.lit(int(s * (1 << 40)))).otherwise(limit)
        kept = docs.where(mark < limit)
        over = {r["lang"]: r["n"] for r in kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect() if r["n"] > max_rows}
        if not over:
            return kept
        for lang, n in over.items():
            share[lang] *= 0.95 * max_rows / n
    return kept.where(~F.col("lang").isin(list(over)))


def fit(docs: DataFrame, max_rows: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the languages in ``docs``; rows without a language or a text teach nothing. The number of languages is taken to be small."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), text_bytes(text_col).alias("text"))
    rows = _sample(source.where("lang is not null and octet_length(text) > 0"), max_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                text = [t for t, x in zip(batch.column(1), langs, strict=True) if x == lang]
                parts = []
                for t in text:
                    t = bytes(t.as_buffer())
                    parts += [grams((t[k - DEPTH : k] if k else _START) + t[k : k + PIECE]) for k in range(0, len(t), PIECE)]
                found, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
        give_back()

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang = counted["lang"].combine_chunks().dictionary_encode()
    names = lang.dictionary.to_pylist() if len(counted) else []
    code = lang.indices.to_numpy() if len(counted) else np.empty(0)
    gram, n = counted["gram"].to_numpy().astype(np.uint64), counted["n"].to_numpy()
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Model([names[k] for k in order], [Tree(gram[code == k], n[code == k]) for k in order])


def has_letter(text: bytes) -> bool:
    return _ASCII_LETTER.search(text) is not None or _LETTER.search(text.decode("utf-8", "replace").replace("�", " ")) is not None


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits) for every row; ``bits`` is the code length under the predicted language, null for ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [bytes(t.as_buffer()) for t in batch.column(1)]
            lang, score, bits = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            rows = [k for k, t in enumerate(texts) if model.langs and has_letter(t)]
            lengths = model.lengths([texts[k] for k in rows])
            best = lengths.argmin(axis=1) if len(rows) else []
            for row, k in enumerate(rows):
                lang[k], bits[k] = model.langs[best[row]], float(lengths[row, best[row]])
                score[k] = 1 / np.exp2(np.maximum(lengths[row, best[row]] - lengths[row], -1000)).sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(bits, pa.float64())], names=["doc_id", "lang_pred", "score", "bits"])
        give_back()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, bits double")


def op13_ppm_language(spark, sf_dir: str) -> DataFrame:
    """Contract columns: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs.where(id_crc() % 3 != 1)))
    return found.select("doc_id", (id_crc() % 3 == 1).alias("held_out"), "lang_pred", "score")
