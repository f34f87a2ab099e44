"""SimHash near-duplicates by a self-join over binary tries of fingerprints.

Fingerprints are exact to the contract: words ``[^\\x20\\x09-\\x0D]+`` of the text
with A-Z lower-cased, 4-word shingles with repeats (fewer words: the whole
sequence; none: fingerprint zero), XXH64 with seed 42, a bit set when over half
the hashes set it. Two fingerprints link at ``budget`` or fewer differing bits.

The self-join cuts the 64 bits into ``blocks`` blocks. A pair within the budget
agrees on some ``blocks - budget`` of them, so for every choice of that many
blocks there is one trie whose first levels are the chosen blocks, and such a
pair meets, with no error spent, in the node those levels lead to. Below that
node the trie is traversed in pairs of nodes: each pair carries the differing
bits so far, and is dropped when they exceed the budget. Distinct fingerprints
are joined, so copies cost nothing; pairs of nodes that lie in one component
already are dropped too, so a large group of near copies is not expanded into
its pairs. Links found in one trie node leave it as a spanning forest, which has
the components of all its links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import durable, fresh, slices, text_bytes
from curatrix.llm.graph import connected_components, meet

BITS = 64
#: Rows of complete trie nodes that one numpy traversal takes at a time.
CHUNK = 200_000
#: Pairs of nodes held at once in a traversal.
FRONTIER = 500_000


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of one whole text."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles: Iterable[bytes] = (b" ".join(words),)
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
        n = len(words) - width + 1
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), dtype=np.uint64, count=n)
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.fromiter((fingerprint(t, width) for t in batch.column(1).to_pylist()), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def roots(n: int, i: np.ndarray, j: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of each of n nodes' components under the links (i, j)."""
    label = np.arange(n) if start is None else start.copy()
    while True:
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        if not apart.any():
            return label
        np.minimum.at(label, high[apart], low[apart])
        while not np.array_equal(up := label[label], label):
            label = up


def traverse(codes: np.ndarray, starts: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """Component root of every code; codes are sorted within the nodes that begin at ``starts``.

    ``depth`` levels of every node's codes are the same. The frontier holds pairs
    of nodes as half-open ranges; it is taken in parts, so memory is bounded.
    """
    n = len(codes)
    ends = np.append(starts[1:], n)
    label = np.arange(n)
    near = np.bitwise_count(codes[1:] ^ codes[:-1]) <= budget
    near[starts[1:] - 1] = False
    at = np.flatnonzero(near)
    label = roots(n, at, at + 1, label)
    ones: dict[int, np.ndarray] = {}

    def split(level: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if level not in ones:
            bit = (codes >> np.uint64(BITS - 1 - level)) & np.uint64(1)
            ones[level] = np.concatenate([[0], np.cumsum(bit.astype(np.int32))])
        c = ones[level]
        return high - (c[high] - c[low])

    wide = ends - starts > 1
    todo = [(depth, starts[wide], ends[wide], starts[wide], ends[wide], np.zeros(int(wide.sum()), dtype=np.int8))]
    while todo:
        level, alo, ahi, blo, bhi, err = todo.pop()
        runs = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        joined = (runs[alo] == runs[ahi - 1]) & (runs[blo] == runs[bhi - 1]) & (label[alo] == label[blo])
        alo, ahi, blo, bhi, err = (x[~joined] for x in (alo, ahi, blo, bhi, err))
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            i, j = alo[leaf], blo[leaf]
            hit = np.bitwise_count(codes[i] ^ codes[j]) <= budget
            label = roots(n, i[hit], j[hit], label)
            alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        if level == BITS:  # distinct codes never get here as one wide node
            continue
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            todo += [(level, *(x[:half] for x in (alo, ahi, blo, bhi, err))), (level, *(x[half:] for x in (alo, ahi, blo, bhi, err)))]
            continue
        am, bm = split(level, alo, ahi), split(level, blo, bhi)
        same = alo == blo
        nxt = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1)]
        nxt.append(tuple(x[~same] for x in (am, ahi, blo, bm, err + 1)))
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*nxt, strict=True))
        keep = (ahi > alo) & (bhi > blo) & (err <= budget)
        todo.append((level + 1, *(x[keep] for x in (alo, ahi, blo, bhi, err))))
    return label


def plan(blocks: int, budget: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For every trie: the mask of its leading blocks, and all blocks (shift, width) in its order."""
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    parts = [(BITS - edges[k + 1], edges[k + 1] - edges[k]) for k in range(blocks)]
    tries = []
    for lead in combinations(range(blocks), blocks - budget):
        order = [*lead, *(k for k in range(blocks) if k not in lead)]
        tries.append((sum(((1 << parts[k][1]) - 1) << parts[k][0] for k in lead), [parts[k] for k in order]))
    return tries


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _permute(codes: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros_like(codes)
    for shift, width in order:
        out = (out << np.uint64(width)) | ((codes >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def links(distinct: DataFrame, budget: int = 4, blocks: int = 6) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) with the components of all pairs within the budget."""
    if not 0 <= budget < blocks <= BITS:
        raise ValueError("budget must be below the number of blocks")
    tries = plan(blocks, budget)

    def node_links(trie: int, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, order = tries[trie]
        codes = _permute(fp.view(np.uint64), order)
        by = np.argsort(codes)
        codes, key, fp = codes[by], key[by], fp[by]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lead = sum(width for _, width in order[: blocks - budget])
        root = traverse(codes, starts, lead, budget)
        member = np.flatnonzero(root != np.arange(len(root)))
        return fp[member], fp[root[member]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[np.ndarray] = []  # rows of nodes that have ended
        last: list[np.ndarray] = []  # rows of the node that may go on in the next batch

        def flush() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(whole, axis=1)
            for trie in np.unique(rows[0]):
                part = rows[1:, rows[0] == trie]
                u, v = node_links(int(trie), part[0], part[1])
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            cut = int(np.argmax((rows[:2] == rows[:2, -1:]).all(axis=0)))
            if last and (cut or (rows[:2, 0] != last[0][:2, 0]).any()):
                whole, last = [*whole, *last], []
            if cut:
                whole.append(rows[:, :cut])
            last.append(rows[:, cut:])
            if sum(w.shape[1] for w in whole) >= CHUNK:
                yield from flush()
                whole = []
        whole += last
        if whole:
            yield from flush()

    every = F.array(*(F.struct(F.lit(k).alias("trie"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for k, (mask, _) in enumerate(tries)))
    placed = distinct.select("fp", F.explode(every).alias("at")).select("at.trie", "at.key", "fp")
    return placed.repartition("trie", "key").sortWithinPartitions("trie", "key").mapInArrow(run, "u long, v long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4, blocks: int = 6) -> DataFrame:
    """(doc_id, fp, component_id, label) for every row; label, a fingerprint, tells components without an id apart."""
    prints = durable(fingerprints(docs, id_col, text_col, width))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    label = connected_components(links(nodes.select("fp"), budget, blocks))
    linked = label.withColumnRenamed("node", "fp").join(nodes, "fp").select("fp", "label", "low")
    lowest = meet(linked.select("fp", "label"), linked.groupBy("label").agg(F.min("low").alias("lowest")), "label", "fp").select("fp", "label", "lowest")
    nodes = nodes.join(lowest, "fp", "left").select("fp", F.coalesce("lowest", "low").alias("component_id"), F.coalesce("label", "fp").alias("label"))
    return meet(prints, nodes, "fp", "doc_id").select("doc_id", "fp", "component_id", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4, blocks: int = 6) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable.

    Null texts count as empty; empty texts share fingerprint zero. Rows that
    repeat an id keep a row each. A component of null ids alone has a null
    component_id. An empty table gives an empty result. Other columns are not read.
    """
    return grouped(docs, id_col, text_col, width, budget, blocks).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, **params) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id.

    Rows are told apart by id and fingerprint: those that share an id, or have
    none, each count for their own component. A row with a null id stays where its
    component has no id at all; of several such rows, or of rows of one component
    that repeat its smallest id, one stays.
    """
    found = durable(grouped(docs, id_col, text_col, width, **params))
    name, code, group = (fresh(docs, c) for c in ("_near_id", "_near_fp", "_near_label"))
    own = F.col(id_col).cast("long")
    twice = found.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias(name))
    gone = found.where("component_id != doc_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(gone, own == F.col(name), "left_anti")
    if twice.isEmpty():
        return kept

    @F.arrow_udf("long")
    def code_of(text: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(t, width) for t in text.to_pylist()), dtype=np.uint64, count=len(text)).view(np.int64))

    best = found.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(name), F.col("fp").alias(f"{code}_"), F.col("label").alias(group)).distinct()
    again = docs.join(twice, own.eqNullSafe(F.col(name)), "left_semi").withColumn(code, code_of(text_bytes(text_col))).dropDuplicates([id_col, code])
    again = again.join(best, own.eqNullSafe(F.col(name)) & (F.col(code) == F.col(f"{code}_"))).dropDuplicates([group]).drop(name, code, f"{code}_", group)
    return kept.join(twice, own.eqNullSafe(F.col(name)), "left_anti").unionByName(again)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract columns: doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
