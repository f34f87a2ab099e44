"""Quality rules: boosted trees over document statistics, beside two fixed base rules.

One pass over each whole text gives its statistics. The trees are fitted on a
bounded sample of labelled rows (``max_rows``) and flattened into node arrays,
which every task scores batch by batch. The margin for "good" may not rise with
the shares of symbols, repeated lines, repeated words or upper-case letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import SPACES, hash_sample, id_crc, slices, table, text_bytes, texts_of
from curatrix.llm.trees import Forest, fit_forest

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_TAIL = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"!?.,;:"

#: Statistics that the trees see, with the sign of the constraint on P(good).
FEATURES = {
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "upper_share": -1,
    "same_as_before_share": -1,
    "log_words": 0,
    "word_length": 0,
    "distinct_share": 0,
    "words_per_line": 0,
    "digit_share": 0,
    "mark_share": 0,
    "bars_per_word": -1,
    "shouts_per_word": -1,
}
MONOTONE = np.array(list(FEATURES.values()))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _dense(values: np.ndarray) -> tuple[np.ndarray, int]:
    distinct, rank = np.unique(values, return_inverse=True)
    return rank.astype(np.int64), len(distinct)


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in windows found twice or more; exact, by ranks of doubled windows."""
    n = len(ids)
    if n <= window:
        return 0
    rank, kinds, width = ids, n, 1
    while width < window:
        step = min(width, window - width)  # the last doubling may overlap
        rank, kinds = _dense(rank[: len(rank) - step] * (kinds + 1) + rank[step:])
        width += step
        if kinds == len(rank):
            return 0
    twice = np.flatnonzero(np.bincount(rank)[rank] >= 2)
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[twice] += 1
    np.add.at(edge, twice + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: bytes) -> tuple[tuple[int, ...], list[float]]:
    """The contract's counts and the trees' features of one whole text."""
    words = text.split()
    n = len(words)
    solid = text.translate(None, SPACES)
    word_chars = len(solid.translate(None, _TAIL))
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    repeated = repeat_words(ids) if len(seen) < n else 0
    per_word, per_char = max(n, 1), max(word_chars, 1)
    features = [
        symbols / per_word,
        dup_lines / max(len(lines), 1),
        repeated / per_word,
        (len(solid) - len(solid.translate(None, _UPPER))) / per_char,
        float((ids[1:] == ids[:-1]).sum()) / per_word,
        float(np.log1p(n)),
        word_chars / per_word,
        len(seen) / per_word,
        n / max(len(lines), 1),
        (len(solid) - len(solid.translate(None, _DIGITS))) / per_char,
        (len(solid) - len(solid.translate(None, _MARKS))) / per_char,
        solid.count(b"|") / per_word,
        solid.count(b"!!") / per_word,
    ]
    return (n, word_chars, symbols, dup_lines, repeated), features


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(text, y) of a bounded sample of the rows that labels may be learned from.

    These are the rows whose crc32(doc_id as text) mod 3 is not 1, under a threshold
    of a hash of the id; an id that repeats in ``docs`` gives its smallest text.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("_id").isNotNull())
    known = known.where(id_crc("_id") % 3 != 1).groupBy("_id").agg(F.max("y").alias("y"))
    return texts_of(docs, hash_sample(known, max_rows)).select("_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> Forest:
    """Trees for P(labels.quality = 1), from at most ``max_rows`` labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [statistics(t)[1] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["_id", "y", "x"])

    rows = training_rows(docs, labels, "quality", max_rows).mapInArrow(run, "_id long, y double, x array<double>").toPandas()
    rows = rows.assign(key=rows.x.map(tuple)).sort_values(["_id", "key"])
    x = np.array(rows.x.tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit_forest(x, rows.y.to_numpy(dtype=np.float64), MONOTONE)


def judge(docs: DataFrame, forest: Forest, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score).

    kept: no base rule failed and P(good) is at least ``least``. A null text has
    no words, so it fails. One row comes out for each row in, ids null or
    repeated or not; other columns are not read; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [statistics(t) for t in batch.column(1).to_pylist()]
            counts = np.array([c for c, _ in found], dtype=np.int64)
            score = forest.probability(np.array([x for _, x in found], dtype=np.float64))
            failed = base_failed(counts[:, 0], counts[:, 4])
            columns = [batch.column(0), *(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array(failed), pa.array(~failed & (score >= least)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, forest: Forest, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=text_col):
            found = [statistics(t.encode() if t is not None else b"") for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            counts = np.array([c for c, _ in found], dtype=np.int64)
            score = forest.probability(np.array([x for _, x in found], dtype=np.float64))
            yield batch.filter(pa.array(~base_failed(counts[:, 0], counts[:, 4]) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract columns, with the trees' score beside them."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
