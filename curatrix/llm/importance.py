"""Target-distribution importance resampling over hashed word n-grams, with a dictionary of distinct n-grams.

Words are stretches of letters a-z, digits and any bytes beyond ASCII, A-Z lower-cased;
a feature is a run of one to three consecutive words joined by a space, and its
bucket is its crc32 modulo ``BUCKETS``. Four steps:

1. Each task counts the distinct features of about ``CHUNK`` bytes of text and deals them to
   the parts of the dictionary by a mix of their words' hashes: a packed block of words
   for a part, not a row for a feature. A common feature is one entry a chunk, so no part is hot.
2. A part of the dictionary merges its blocks: the global count of every distinct string.
   Each string is hashed once there (its crc32 is put together from its words'), and counts are added up by bucket.
3. Counts of both corpora give ``BUCKETS`` gains (log odds in thousandths).
4. Gains join the features of each document through the bucket of the distinct features
   of its chunk; their sum is the document's weight. Weight and Gumbel noise from
   the hashed id make the score; the highest scores are drawn without replacement.

Whole texts of any length are read, in pieces that overlap by two words, so memory grows with the
longest word, not the text. Null and empty texts have no features and weight 0. A null id counts as the empty text where it is
hashed. Rows are counted and drawn row by row, repeated ones too (full ties are broken by place); other columns are not read.
An empty table has no counts; with an empty target all gains follow from the documents' alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import durable, give_back, table, text_bytes

BUCKETS = 10_000
ORDERS = 3
#: Bytes of a chunk; layout alone.
CHUNK = 15_000_000
SHARE = 5
LEAST_WORDS = 20
SEED = 42

#: Words that are Python objects at once.
_STEP = 50_000
#: Bytes of words are themselves, A-Z are lower-cased, all others separate.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _free() -> None:
    """Memory that Arrow and the allocator hold goes back, as a worker waits for its next task."""
    pa.default_memory_pool().release_unused()
    give_back()


def pieces(text: bytes, most: int) -> Iterator[tuple[int, bytes]]:
    """(words that were counted before, clean bytes): a text in pieces of about ``most`` bytes, each led by the last words of the one before; words stay whole."""
    clean = text.translate(_CLEAN)
    if len(clean) <= most:
        yield 0, clean
        return
    begin, lead = 0, b""
    while begin < len(clean):
        end = len(clean)
        if end - begin > most:
            end = clean.rfind(b" ", begin + 1, begin + most)
            end = clean.find(b" ", begin + most) if end < 0 else end
            end = len(clean) if end < 0 else end
        piece = lead + b" " + clean[begin:end]
        yield len(lead.split()), piece
        lead = b" ".join(piece.rsplit(None, ORDERS - 1)[1 - ORDERS :])
        begin = end


Piece = tuple[int, int, bytes]


def gathered(parts: Iterable[Piece], most: int) -> Iterator[list[Piece]]:
    """Pieces in lists of about ``most`` bytes."""
    held, size = [], 0
    for part in parts:
        if held and size + len(part[2]) + 1 > most:
            yield held
            held, size = [], 0
        held.append(part)
        size += len(part[2]) + 1
    if held:
        yield held


def chunks(texts: Iterable[bytes], most: int = CHUNK) -> Iterator[list[Piece]]:
    """Lists of (row, words counted before, clean bytes) of about ``most`` bytes."""
    return gathered(((row, before, piece) for row, text in enumerate(texts) for before, piece in pieces(text, most)), most)


def strings(data: bytes, separator: int) -> tuple[pa.Array, np.ndarray]:
    """The stretches between separators, and where they begin."""
    b = np.frombuffer(data, dtype=np.uint8)
    inside = b != separator
    edge = np.zeros(len(b) + 1, dtype=bool)
    edge[:-1] = inside
    edge[1:] ^= inside
    edges = np.flatnonzero(edge)
    begin, end = edges[::2], edges[1::2]
    offsets = np.zeros(len(begin) + 1, dtype=np.int64)
    np.cumsum(end - begin, out=offsets[1:])
    array = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(b[inside])])
    return array, begin


def _shifts(n: int = 32) -> np.ndarray:
    """Tables (by power of two, by byte) of what 1, 2, 4, .. zero bytes make of a crc32."""
    one = np.array([zlib.crc32(bytes([k ^ 255])) ^ 0xFF000000 for k in range(256)], dtype=np.uint32)
    basis = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [(basis >> np.uint32(8)) ^ one[basis & np.uint32(255)]]
    for _ in range(n - 1):
        out.append(_shifted(out[-1], out[-1]))
    return np.stack(out)


def _shifted(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & np.uint32(255)] ^ table[1][crc >> np.uint32(8) & np.uint32(255)] ^ table[2][crc >> np.uint32(16) & np.uint32(255)] ^ table[3][crc >> np.uint32(24)]


_SHIFTS = _shifts()


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of strings from those of their two halves; ``length`` is the second half's, in bytes."""
    out = first.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        rows = np.flatnonzero(length >> k & 1)
        out[rows] = _shifted(_SHIFTS[k], out[rows])
    return out ^ second


class Words:
    """Different words, with what their features' crc32 is made of."""

    def __init__(self, words: pa.Array) -> None:
        self.words = words
        self.alone = np.concatenate([np.empty(0, dtype=np.uint32), *(np.fromiter(map(zlib.crc32, words.slice(k, _STEP).to_pylist()), dtype=np.uint32) for k in range(0, len(words), _STEP))])
        #: with a space before
        self.length = pc.binary_length(words).to_numpy() + 1
        self.spaced = joined_crc(np.full(len(words), zlib.crc32(b" "), dtype=np.uint32), self.alone, self.length - 1)

    def crc(self, parts: list[np.ndarray]) -> np.ndarray:
        """crc32 of features, given their words' places, first to last."""
        out = self.alone[parts[0]]
        for word in parts[1:]:
            out = joined_crc(out, self.spaced[word], self.length[word])
        return out


def _split(numbers: np.ndarray, base: int, order: int) -> list[np.ndarray]:
    """The words' places, first to last, of features as numbers."""
    out = []
    for _ in range(order - 1):
        numbers, word = np.divmod(numbers, base)
        out.append(word)
    return [numbers, *out[::-1]]


class Features:
    """The features of a chunk as numbers: a word's place in ``words``, or two or three of them in the base ``base``."""

    def __init__(self, chunk: list[Piece]) -> None:
        every, begin = strings(b" ".join(piece for _, _, piece in chunk), 32)
        coded = every.dictionary_encode()
        self.words, self.ids = Words(coded.dictionary), coded.indices.to_numpy()
        self.base = max(len(coded.dictionary), 1)
        starts = np.cumsum([0, *(len(piece) + 1 for _, _, piece in chunk)])
        first = np.searchsorted(begin, starts)
        self.n_words = np.diff(first)
        self.piece = np.repeat(np.arange(len(chunk), dtype=np.int32), self.n_words)
        #: words that belong to the piece itself
        self.new = np.ones(len(self.ids), dtype=bool)
        for k, (_, before, _) in enumerate(chunk):
            self.new[first[k] : first[k] + before] = False

    def of(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, place of the last word) of the features of ``order`` words that end at new words."""
        n = len(self.ids) - order + 1
        if n < 1:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        number = self.ids[:n].astype(np.int64)
        for k in range(1, order):
            number = number * self.base + self.ids[k : k + n]
        last = np.flatnonzero(self.new[order - 1 :] & (self.piece[order - 1 :] == self.piece[:n]))
        return number[last], last + order - 1


def numbered(chunk: list[Piece]) -> Iterator[tuple[list[Piece], Features]]:
    """The chunk with its features; one whose different words are too many for numbers of 63 bits is cut in halves first."""
    features = Features(chunk)
    if features.base**ORDERS < 1 << 63:
        yield chunk, features
        return
    most = sum(len(piece) for _, _, piece in chunk) // 2
    cut = ((row, lead if k else before, part) for row, before, piece in chunk for k, (lead, part) in enumerate(pieces(piece, most)))
    for smaller in gathered(cut, most):
        yield from numbered(smaller)


#: A block is one chunk's features of one order for one part: their first words (one for each stretch of features that share it), then
#: all second words and all third words, each with a line end; the stretches' lengths, then the features' counts.
_BLOCK = pa.schema([("part", pa.int32()), ("words", pa.int32()), ("n", pa.int64()), ("firsts", pa.int64()), ("size", pa.int64()), ("strings", pa.binary()), ("numbers", pa.binary())])
_BLOCK_SQL = "part int, words int, n long, firsts long, size long, strings binary, numbers binary"
_CODEC = pa.Codec("zstd", compression_level=3)


def _column(lines: pa.Array, word: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The words at the places ``word``, one after the other, and where each begins."""
    taken = lines.take(pa.array(word))
    offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1]
    return memoryview(taken.buffers()[2] or b""), offsets


def _blocks(features: Features, parts: int) -> Iterator[tuple]:
    """Rows of ``_BLOCK`` with a chunk's distinct features."""
    words = features.words
    lines = pc.binary_join_element_wise(words.words, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    mixed = words.alone.astype(np.uint64)
    for order in range(1, ORDERS + 1):
        number, count = np.unique(features.of(order)[0], return_counts=True)
        if not len(number):
            continue
        of = [word.astype(np.int32) for word in _split(number, features.base, order)]
        h = np.full(len(number), order, dtype=np.uint64)
        for word in of:
            h = (h ^ mixed[word]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        part = (h % np.uint64(parts)).astype(np.int32)
        by_part = np.argsort(part, kind="stable")
        part, of, count = part[by_part], [word[by_part] for word in of], count[by_part].astype("<u4")
        del number, h, by_part
        opens = np.append(True, (of[0][1:] != of[0][:-1]) | (part[1:] != part[:-1]))
        stretch = np.flatnonzero(opens)
        columns = [_column(lines, of[0][stretch]), *(_column(lines, word) for word in of[1:])]
        lengths = np.diff(np.append(stretch, len(part))).astype("<u4")
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
        for a, b in zip(edges, [*edges[1:], len(part)], strict=True):
            c, d = np.searchsorted(stretch, [a, b]).tolist()
            raw = b"".join(data[at[x] : at[y]] for (data, at), (x, y) in zip(columns, [(c, d)] + [(a, b)] * (order - 1), strict=True))
            yield int(part[a]), order, b - a, d - c, len(raw), _CODEC.compress(raw, asbytes=True), _CODEC.compress(lengths[c:d].tobytes() + count[a:b].tobytes(), asbytes=True)


def _merged(group: pa.Table) -> pa.Table:
    """(bucket, n, distinct) of a part of the dictionary: distinct strings with their counts, each hashed once."""
    sums, distinct = np.zeros(BUCKETS), np.zeros(BUCKETS, dtype=np.int64)
    for order in sorted(set(group["words"].to_pylist())):
        rows = group.filter(pc.equal(group["words"], order)).to_pylist()
        coded = strings(b"".join(_CODEC.decompress(r["strings"], r["size"], asbytes=True) for r in rows), 10)[0].dictionary_encode()
        words, ids, at = Words(coded.dictionary), coded.indices.to_numpy(), 0
        columns, counts = [], []
        for r in rows:
            n, firsts = r["n"], r["firsts"]
            numbers = np.frombuffer(_CODEC.decompress(r["numbers"], 4 * (n + firsts), asbytes=True), dtype="<u4")
            columns.append([np.repeat(ids[at : at + firsts], numbers[:firsts]), *(ids[at + firsts + k * n : at + firsts + (k + 1) * n] for k in range(order - 1))])
            counts.append(numbers[firsts:])
            at += firsts + n * (order - 1)
        of, base = [np.concatenate(c) for c in zip(*columns, strict=True)], len(words.words)
        del coded, columns, ids
        key = of[0].astype(np.int64)
        for k, word in enumerate(of[1:], 2):
            if base**k >= 1 << 63:  # too many words for plain numbers: pairs are numbered first
                key = np.unique(key, return_inverse=True)[1]
            key = key * base + word
        _, first, place = np.unique(key, return_index=True, return_inverse=True)
        bucket = words.crc([word[first] for word in of]) % BUCKETS
        sums += np.bincount(bucket, weights=np.bincount(place, weights=np.concatenate(counts)), minlength=BUCKETS)
        distinct += np.bincount(bucket, minlength=BUCKETS)
        del words, of, key, first, place, bucket, counts, rows
        _free()
    held = np.flatnonzero(distinct)
    return pa.table({"bucket": held, "n": sums[held].astype(np.int64), "distinct": distinct[held]})


def bucket_counts(docs: DataFrame, text_col: str = "text", part_bytes: int = 8_000_000) -> DataFrame:
    """(bucket, n, distinct): features and distinct feature strings of all ``docs`` by bucket, from the dictionary.

    ``part_bytes`` of text come to one part of the dictionary; it decides the layout alone.
    """
    texts = docs.select(text_bytes(text_col).alias("text"))
    parts = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(bytes(t.as_buffer()) for batch in batches for t in batch.column(0)):
            for _, features in numbered(chunk):
                rows = list(_blocks(features, parts))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BLOCK, strict=True)], schema=_BLOCK)
        _free()

    blocks = texts.mapInArrow(deal, _BLOCK_SQL)
    return blocks.groupBy("part").applyInArrow(_merged, "bucket long, n long, distinct long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("distinct").alias("distinct"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """Thousandths of the log odds of each bucket in the target over the source; both are ``bucket_counts`` (``BUCKETS`` rows at most)."""

    def counts(frame: DataFrame) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for r in frame.collect():
            out[r["bucket"]] = r["n"]
        return out

    s, t = counts(source), counts(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) for every row: the sum of its features' gains."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            words, weight = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for chunk, features in (x for c in chunks((bytes(t.as_buffer()) for t in batch.column(1)), CHUNK // 4) for x in numbered(c)):
                row = np.array([r for r, _, _ in chunk])
                np.add.at(words, row, features.n_words - np.array([before for _, before, _ in chunk]))
                for order in range(1, ORDERS + 1):
                    number, last = features.of(order)
                    distinct, place = np.unique(number, return_inverse=True)
                    value = gain[features.words.crc(_split(distinct, features.base, order)) % BUCKETS]
                    sums = np.bincount(features.piece[last], weights=value[place], minlength=len(chunk))
                    np.add.at(weight, row, sums.astype(np.int64))
            n = sum(np.maximum(words - k, 0) for k in range(ORDERS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])
        _free()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def draw(weighed: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Adds score and rank: of the N rows with ``least_words`` words, floor(share * N / 100) of the highest scores are ranked from 1 (ties: the smaller id), others have none.

    Ranks are counted in ranges of the order: places within a range, and the sizes of the ranges before it.
    """
    spark = weighed.sparkSession
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296))))
    scored = durable(weighed.withColumns({"score": F.col("weight") + noise, "_short": F.col("n_words") < least_words, "_row": F.monotonically_increasing_id()}))
    most = share * scored.where(~F.col("_short")).count() // 100
    order = [F.col("_short"), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("_row")]
    ranges = durable(scored.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["count"] for r in ranges.groupBy("_range").count().collect()}
    before, total = {}, 0
    for k in sorted(sizes):
        before[k] = total
        total += sizes[k]
    offsets = spark.createDataFrame([(k, n) for k, n in before.items()], "_range int, _before long")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.join(F.broadcast(offsets), "_range").withColumn("_place", place).withColumn("rank", F.when(~F.col("_short") & (F.col("_place") <= most), F.col("_place"))).drop("_range", "_before", "_place", "_row", "_short")


def op11_importance(spark, sf_dir: str) -> DataFrame:
    """Contract columns: doc_id, n_features, weight, score, rank."""
    docs = table(spark, sf_dir, "documents")
    gain = gains(bucket_counts(docs), bucket_counts(table(spark, sf_dir, "benchmark")))
    return draw(weigh(docs, gain)).select("doc_id", "n_features", "weight", "score", "rank")
