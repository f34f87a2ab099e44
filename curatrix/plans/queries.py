"""The reference's operators as queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.functions import bits, geometry, pose, text
from curatrix.operators import curation, detection, metrics, ranking, relations, scoring, similarity, temporal
from curatrix.plans import distributed, training
from curatrix.session import durable, shared_dir, slices, spread
from curatrix.sources import files
from curatrix.streaming import machines, sessions, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


RATIOS = [("train", 0.8), ("val", 0.1), ("test", 0.1)]
_BOUND = "CASE WHEN mid < 0.8::DOUBLE THEN 'train' WHEN mid < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END"


# --- splits and samples ------------------------------------------------------------------


@query(
    f"""WITH g AS (SELECT o_custkey k, count(*) n, sha256('curate:' || o_custkey) h FROM orders GROUP BY 1),
    m AS (SELECT k, (coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + n / 2.0::DOUBLE) / (sum(n) OVER ())::DOUBLE mid FROM g)
    SELECT {_BOUND} AS split, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS groups FROM orders JOIN m ON k = o_custkey GROUP BY ALL"""
)
def group_split(spark, d):
    """O-72, O-59."""
    rows = curation.assign_split(_t(spark, d, "orders").select("o_custkey", "o_orderstatus"), "o_custkey", RATIOS, "curate")
    return rows.groupBy("split", "o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("groups"))


@query(
    f"""WITH g AS (SELECT o_orderpriority s, o_custkey k, count(*) n, sha256('curate:' || o_orderpriority || ':' || o_custkey) h FROM orders GROUP BY 1, 2),
    m AS (SELECT s, k, n, (coalesce(sum(n) OVER (PARTITION BY s ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + n / 2.0::DOUBLE) / (sum(n) OVER (PARTITION BY s))::DOUBLE mid FROM g)
    SELECT s AS o_orderpriority, k AS o_custkey, n, {_BOUND} AS split FROM m"""
)
def stratified_group_split(spark, d):
    """O-73."""
    return curation.group_split(_t(spark, d, "orders").select("o_orderpriority", "o_custkey"), "o_custkey", RATIOS, "curate", stratum="o_orderpriority")


@query(
    """WITH r AS (SELECT o_orderkey % 3000 + 1 AS n FROM orders), s AS (SELECT n, CASE WHEN n BETWEEN 1 AND 2000 THEN 'train' WHEN n BETWEEN 2101 AND 2500 THEN 'val' WHEN n BETWEEN 2601 AND 3000 THEN 'test' ELSE 'sequence_guard_band' END AS split,
    'orders:' || lpad(CAST((n - 1) // 50 AS VARCHAR), 3, '0') AS block FROM r)
    SELECT split, block, count(*) AS n FROM s GROUP BY ALL"""
)
def range_bucket_split(spark, d):
    """O-29, O-30, O-130."""
    n = F.col("o_orderkey") % 3000 + 1
    rows = _t(spark, d, "orders").select(text.range_split(n).alias("split"), text.block_id("orders", n).alias("block"))
    return rows.groupBy(F.coalesce("split", F.lit("sequence_guard_band")).alias("split"), "block").agg(F.count("*").alias("n"))


_DOC_SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END"


@query(
    f"""WITH g AS (SELECT DISTINCT lang AS label, {_DOC_SPLIT} AS split, source FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY label, split ORDER BY sha256('down:' || label || ':' || split || ':' || source)) k FROM g)
    SELECT label, split, source FROM r WHERE k <= CASE split WHEN 'train' THEN 8 ELSE 2 END"""
)
def hash_downsample(spark, d):
    """O-74."""
    rows = _t(spark, d, "documents").select(F.col("lang").alias("label"), F.expr(_DOC_SPLIT).alias("split"), "source")
    return curation.hash_downsample(rows, "label", "split", "source", {"train": 8, "val": 2, "test": 2}, "down")


@query(
    """SELECT event_id, event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY event_id) k FROM events)
    WHERE k <= CASE WHEN event_type = 'view' THEN 5 WHEN event_type = 'click' THEN 40 ELSE 10 END"""
)
def cell_limited_sample(spark, d):
    """O-75; the limits are the operator's."""
    limit = F.when(F.col("event_type") == "view", 5).when(F.col("event_type") == "click", 40).otherwise(10)
    rows = _t(spark, d, "events").select("event_id", "event_type", "user_id")
    return curation.cell_limited(rows, ["event_type", F.col("user_id") % 5], ["event_id"], limit)


# --- duplicates and relations --------------------------------------------------------------


@query(
    """WITH g AS (SELECT sha256(text) h, count(*) n, count(DISTINCT source) s FROM documents GROUP BY 1 HAVING count(*) > 1)
    SELECT count(*) AS group_count, coalesce(sum(n), 0)::BIGINT AS files_in_groups, coalesce(sum(n - 1), 0)::BIGINT AS redundant_files, count(*) FILTER (s > 1) AS cross_label_groups FROM g"""
)
def exact_dup_summary(spark, d):
    """O-56, O-04."""
    rows = _t(spark, d, "documents").select(F.sha2("text", 256).alias("h"), "source")
    return relations.duplicate_summary(rows, "h", "source")


@query("SELECT doc_id, source, CASE WHEN k = 1 THEN 'kept' ELSE 'exact_duplicate' END AS outcome FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) k FROM documents)")
def first_seen_dedup(spark, d):
    """O-57, O-130."""
    rows = _t(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    kept, out = curation.first_seen(rows, "h", [F.col("doc_id")])
    return kept.select("doc_id", "source", F.lit("kept").alias("outcome")).unionByName(out.select("doc_id", "source", F.col("reason").alias("outcome")))


@query(
    """WITH g AS (SELECT sha256(text) h, count(*) FILTER (doc_id % 10 < 8) a, count(*) FILTER (doc_id % 10 >= 8) b FROM documents GROUP BY 1)
    SELECT count(*) AS shared_hashes, coalesce(sum(a), 0)::BIGINT AS first_rows, coalesce(sum(b), 0)::BIGINT AS second_rows FROM g WHERE a > 0 AND b > 0"""
)
def split_overlap(spark, d):
    """O-43."""
    rows = _t(spark, d, "documents").select(F.sha2("text", 256).alias("h"), F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test").alias("split"))
    return relations.split_overlap(rows, "h", "split", "train", "test")


@query(
    """SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS missing_right, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS missing_left,
    (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS left_rows"""
)
def mirror_difference(spark, d):
    """O-44."""
    return relations.mirror_difference(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def pair_inner(spark, d):
    """O-41."""
    return relations.pair(_t(spark, d, "documents").select("doc_id", "lang"), _t(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("SELECT 'left' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'right', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def orphans(spark, d):
    """O-42."""
    return relations.orphans(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id")


@query("SELECT sha256(text) AS h, count(*) AS n, count(DISTINCT source) AS collections, min(doc_id) AS first_path FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_collection_dups(spark, d):
    """O-45."""
    return relations.cross_collection(_t(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h")), "h", "source", "doc_id")


@query("SELECT source, doc_id, rank, truncated FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, count(*) OVER (PARTITION BY source) > 25 AS truncated FROM documents) WHERE rank <= 25")
def bounded_examples(spark, d):
    """O-79; the limit is the operator's."""
    found = relations.examples(_t(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")])
    return found.select("source", "doc_id", "rank", "truncated")


@query("SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def group_size_histogram(spark, d):
    """O-60."""
    return relations.size_histogram(_t(spark, d, "lineitem").select("l_orderkey"), "l_orderkey")


@query("SELECT 'l_returnflag' AS field, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2")
def value_counts(spark, d):
    """O-58."""
    return relations.value_counts(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(
    f"""WITH r AS (SELECT {_DOC_SPLIT} AS split, source, lang FROM documents)
    SELECT CAST(grouping(split, source, lang) AS BIGINT) AS grouping, split, source, lang, count(*) AS n FROM r GROUP BY GROUPING SETS ((), (split), (source), (split, lang), (split, source))"""
)
def manifest_summary(spark, d):
    """O-59."""
    rows = _t(spark, d, "documents").select(F.expr(_DOC_SPLIT).alias("split"), "source", "lang")
    return relations.manifest_summary(rows, "split", "source", "lang").select("grouping", "split", "source", "lang", "n")


@query("SELECT count(*) AS files, sum(n_chars)::BIGINT AS total, count(DISTINCT lang) AS labels FROM documents")
def byte_totals(spark, d):
    """O-71."""
    return _t(spark, d, "documents").agg(F.count("*").alias("files"), F.sum("n_chars").alias("total"), F.count_distinct("lang").alias("labels"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def union_builds(spark, d):
    """O-55, O-20."""
    c = _t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return c.unionByName(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey")))


@query("SELECT s_suppkey, s_name, n_name, coalesce(r_name, n_name) AS place FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def reference_join(spark, d):
    """O-52."""
    places = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").withColumn("s_nationkey", F.col("n_nationkey"))
    return relations.with_dimension(_t(spark, d, "supplier"), places, "s_nationkey", n_name=["n_name"], place=["r_name", "n_name"]).select("s_suppkey", "s_name", "n_name", "place")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def aligned_join(spark, d):
    """O-51: raises unless the keys are the same on both sides."""
    n = _t(spark, d, "nation").select("n_nationkey", "n_name")
    r = _t(spark, d, "nation").join(F.broadcast(_t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return relations.aligned(n, r, "n_nationkey")


# --- scalars -------------------------------------------------------------------------------


@query(
    r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') u FROM pages), q AS (SELECT page_id, split_part(u, '/', -1) b, split_part(u, '/', -2) parent FROM p)
    SELECT page_id, parent, split_part(b, '.', 1) AS prefix, CASE WHEN regexp_matches(b, '.\.[^.]+$') THEN lower(regexp_extract(b, '(\.[^.]+)$', 1)) ELSE '[none]' END AS ext,
    CASE WHEN regexp_extract(regexp_replace(b, '(.)\.[^.]*$', '\1'), '(\d+)$', 1) = '' THEN -1 ELSE CAST(regexp_extract(regexp_replace(b, '(.)\.[^.]*$', '\1'), '(\d+)$', 1) AS INTEGER) END AS number FROM q"""
)
def label_parse(spark, d):
    """O-02, O-19, O-28."""
    u = F.regexp_replace("url", "[?#].*$", "")
    rows = _t(spark, d, "pages").select("page_id", u.alias("u"))
    path = F.col("u")
    digits = text.stem(path).rlike(r"\d+$")
    return rows.select("page_id", text.label_for(path, F.lit("parent")).alias("parent"), text.label_for(path, F.lit("dot_prefix")).alias("prefix"), text.extension(path).alias("ext"), F.when(digits, text.trailing_number(text.stem(path))).otherwise(-1).alias("number"))


@query(
    r"""SELECT p_partkey, lower(regexp_replace(regexp_replace(n, '_jpg\.rf\.[0-9a-f]+$', '', 'i'), '_2$', '')) AS base, lower(regexp_replace(p_name || CASE p_partkey % 3 WHEN 0 THEN '_3' WHEN 1 THEN '_ar' ELSE '' END, '_(2|3|AR)$', '', 'i')) AS variant
    FROM (SELECT *, p_name || CASE p_partkey % 3 WHEN 0 THEN '_2_jpg.rf.0a9f' WHEN 1 THEN '_JPG.RF.77' ELSE '_2' END AS n FROM part)"""
)
def group_keys(spark, d):
    """O-27."""
    k = F.col("p_partkey") % 3
    a = F.concat("p_name", F.when(k == 0, "_2_jpg.rf.0a9f").when(k == 1, "_JPG.RF.77").otherwise("_2"))
    b = F.concat("p_name", F.when(k == 0, "_3").when(k == 1, "_ar").otherwise(""))
    return _t(spark, d, "part").select("p_partkey", text.augmented_base(a).alias("base"), text.variant_base(b).alias("variant"))


@query(
    """SELECT o_orderkey, substr(sha256(o_orderstatus || ':' || o_orderkey), 1, 20) AS sample_id, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus ELSE 'UNKNOWN' END AS label, CASE WHEN length(o_orderpriority) = 1 THEN upper(o_orderpriority) ELSE o_orderpriority END AS original,
    lpad(CAST(CAST(round_even((o_orderkey % 97) / 97.0::DOUBLE * 100, 0) AS INTEGER) AS VARCHAR), 3, '0') AS tag, 'https://assets.test/' || o_orderstatus AS url FROM orders"""
)
def manifest_rows(spark, d):
    """O-21..O-23, O-25, O-38, O-138."""
    return _t(spark, d, "orders").select(
        "o_orderkey",
        text.sample_id(F.col("o_orderstatus"), F.col("o_orderkey")).alias("sample_id"),
        text.remap_unknown(F.col("o_orderstatus"), ["O", "F"]).alias("label"),
        text.single_upper(F.col("o_orderpriority")).alias("original"),
        text.profile_tag((F.col("o_orderkey") % 97) / F.lit(97.0)).alias("tag"),
        F.concat(F.lit("https://assets.test/"), F.col("o_orderstatus")).alias("url"),
    )


@query("SELECT n_nationkey, n_name, CASE n_regionkey WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS expected_hands, CASE n_regionkey WHEN 0 THEN 'two' WHEN 3 THEN 'none' ELSE 'other' END AS message, ['a', 'b', 'c'][n_nationkey % 3 + 1] AS target FROM nation")
def route_dimension(spark, d):
    """O-31, O-32, O-94, O-137."""
    nation = _t(spark, d, "nation")
    spec = spark.createDataFrame([("m", [1, 2, 4], [0], [(3, 0)])], "mode string, one_hand array<int>, two_hand array<int>, deferred array<struct<label:int,expected_hands:int>>")
    routes = curation.route_dimension(spec).select(F.col("label").alias("n_regionkey"), "expected_hands")
    code = F.col("n_regionkey").cast("string")
    return nation.join(F.broadcast(routes), "n_regionkey", "left").select("n_nationkey", "n_name", F.coalesce("expected_hands", F.lit(1)).alias("expected_hands"), text.message_for(code, {"0": "two", "3": "none"}, "other").alias("message"), text.rotating(F.col("n_nationkey"), ["a", "b", "c"]).alias("target"))


@query("SELECT l_orderkey % 50 AS chunk, sha256('gen' || (l_orderkey % 50) || string_agg(CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber, '' ORDER BY l_orderkey, l_linenumber)) AS key FROM lineitem GROUP BY 1")
def chunk_keys(spark, d):
    """O-103: chunks of a bounded number of rows in use; the array of one chunk is built in one task."""
    rows = _t(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("chunk"), F.struct("l_orderkey", "l_linenumber").alias("m"))
    members = F.transform(F.array_sort("ms"), lambda m: F.concat_ws("-", m["l_orderkey"].cast("string"), m["l_linenumber"].cast("string")))
    return rows.groupBy("chunk").agg(F.collect_list("m").alias("ms")).select("chunk", text.chunk_key("gen", F.col("chunk"), members).alias("key"))


@query(
    """SELECT n_regionkey, n_name, coalesce(lag(n_name) OVER w, last_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous,
    coalesce(lead(n_name) OVER w, first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name)"""
)
def circular_neighbours(spark, d):
    """O-76."""
    return ranking.neighbours(_t(spark, d, "nation").select("n_regionkey", "n_name"), "n_name", ["n_regionkey"])


@query("SELECT p_partkey, p_type, p_brand, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY CASE p_brand WHEN 'Brand#11' THEN 0 WHEN 'Brand#22' THEN 1 ELSE 2 END, p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 100")
def ranked_candidates(spark, d):
    """O-77; the limit is the operator's."""
    brand = F.when(F.col("p_brand") == "Brand#11", 0).when(F.col("p_brand") == "Brand#22", 1).otherwise(2)
    found = ranking.ranked(_t(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_retailprice"), ["p_type"], [brand, F.desc("p_retailprice"), F.col("p_partkey")])
    return found.select("p_partkey", "p_type", "p_brand", "rank")


@query("SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 1")
def best_row(spark, d):
    """O-81; one row is the operator's result."""
    return ranking.best(_t(spark, d, "events").select("event_id", "user_id", "value"), F.col("value"), key="event_id")


# --- similarity ----------------------------------------------------------------------------


#: Words whose buckets a task keeps; a worker's memory is that of so many and of a slice of a batch, whatever the table's size.
KNOWN_WORDS = 30_000


def _fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """O-83 over word-count grids: (doc_id, lang, h). A text's words are counted in 72 buckets where the text is; a null text is empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in slices(batches, 2):
            grids = []
            for words in (t.split(" ") for t in batch.column(2).to_pylist()):
                if len(known) > KNOWN_WORDS:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 72
                grids.append(np.bincount([known[w] for w in words], minlength=72))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grids, pa.list_(pa.int64()))], names=["doc_id", "lang", "grid"])

    rows = _t(spark, d, "documents").select("doc_id", "lang", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.mapInArrow(count, "doc_id long, lang string, grid array<long>").select("doc_id", "lang", bits.difference_hash(F.col("grid")).alias("h"))


_GRID = """w AS (SELECT doc_id, lang, unnest(string_split(lower(coalesce(text, '')), ' ')) w FROM documents),
    c AS (SELECT doc_id, lang, CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % 72 b, count(*) n FROM w GROUP BY ALL),
    k AS (SELECT r * 9 + c AS l, 63 - (r * 8 + c) AS s FROM range(8) a(r), range(8) b(c)),
    g AS (SELECT d.doc_id, d.lang, k.s, coalesce(x.n, 0) > coalesce(y.n, 0) AS up FROM (SELECT DISTINCT doc_id, lang FROM c) d CROSS JOIN k LEFT JOIN c x ON x.doc_id = d.doc_id AND x.b = k.l LEFT JOIN c y ON y.doc_id = d.doc_id AND y.b = k.l + 1),
    f AS (SELECT doc_id, lang, CAST(sum(CASE WHEN up THEN (1::HUGEINT << s::INTEGER) ELSE 0 END) AS UBIGINT) h FROM g GROUP BY ALL)"""


@query(f"WITH {_GRID} SELECT doc_id, lang, lower(lpad(to_hex(h), 16, '0')) AS h FROM f")
def difference_hashes(spark, d):
    """O-83."""
    return _fingerprints(spark, d).select("doc_id", "lang", F.lower(F.lpad(F.hex("h"), 16, "0")).alias("h"))


@query(
    f"""WITH {_GRID}, p AS (SELECT a.doc_id i, b.doc_id j, bit_count(xor(a.h, b.h)) d FROM f a JOIN f b ON a.lang = b.lang AND a.doc_id < b.doc_id WHERE bit_count(xor(a.h, b.h)) <= 2)
    SELECT CAST(d AS INTEGER) AS d, count(*) AS pairs FROM p GROUP BY 1"""
)
def near_dup_pairs(spark, d):
    """O-46, O-84: pairs of documents by distance, counted from pairs of hashes and their numbers of rows."""
    rows = durable(_fingerprints(spark, d).groupBy("lang", "h").agg(F.count("*").alias("n")))
    near = similarity.hamming_join(rows, rows, "lang", 2, keep=("n",))
    pairs = F.sum(F.when(F.col("h1") == F.col("h2"), F.col("n1") * (F.col("n1") - 1)).otherwise(F.col("n1") * F.col("n2")))
    return near.groupBy("d").agg((pairs / 2).cast("long").alias("pairs")).where("pairs > 0")


_SHA_SPLIT = "CASE WHEN substr(sha256(CAST(doc_id AS VARCHAR)), 1, 1) < 'a' THEN 'train' WHEN substr(sha256(CAST(doc_id AS VARCHAR)), 1, 1) < 'd' THEN 'val' ELSE 'test' END"


def _split_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    first = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 1)
    return durable(_fingerprints(spark, d)).withColumn("split", F.when(first < "a", "train").when(first < "d", "val").otherwise("test"))


@query(
    f"""WITH {_GRID}, s AS (SELECT *, {_SHA_SPLIT} AS split FROM f),
    v AS (SELECT a.doc_id FROM s a WHERE split = 'val' AND EXISTS (FROM s b WHERE b.split = 'train' AND b.lang = a.lang AND bit_count(xor(a.h, b.h)) <= 2)),
    t AS (SELECT a.doc_id FROM s a WHERE split = 'test' AND EXISTS (FROM s b WHERE (b.split = 'train' OR (b.split = 'val' AND b.doc_id NOT IN (SELECT doc_id FROM v))) AND b.lang = a.lang AND bit_count(xor(a.h, b.h)) <= 2))
    SELECT doc_id, 'val' AS split FROM v UNION ALL SELECT doc_id, 'test' FROM t"""
)
def near_dup_reject(spark, d):
    """O-48."""
    return similarity.later_split_rejects(_split_fingerprints(spark, d), 2, "lang").select("doc_id", "split")


@query(
    f"""WITH {_GRID}, s AS (SELECT *, {_SHA_SPLIT} AS split, CASE {_SHA_SPLIT} WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END r FROM f)
    SELECT a.split AS first_split, b.split AS second_split, count(*) AS pairs FROM s a JOIN s b ON a.lang = b.lang AND a.r < b.r WHERE bit_count(xor(a.h, b.h)) <= 2 GROUP BY ALL"""
)
def similarity_audit(spark, d):
    """O-46, O-47."""
    return similarity.similarity_audit(_split_fingerprints(spark, d), 2, "lang")


@query(
    f"""WITH {_GRID}, a AS (SELECT doc_id, lang, h FROM f WHERE doc_id % 20 = 0)
    SELECT a.doc_id, count(*) AS found, CAST(coalesce(min(bit_count(xor(a.h, f.h))) FILTER (a.h <> f.h), -1) AS INTEGER) AS nearest FROM a JOIN f ON a.lang = f.lang AND bit_count(xor(a.h, f.h)) <= 6 GROUP BY 1"""
)
def hamming_index(spark, d):
    """O-47: an index on disk that takes two inserts; documents whose id is divisible by 20 ask for all within six bits."""
    rows = durable(_fingerprints(spark, d))
    index = similarity.HammingIndex(spark, f"{shared_dir(spark)}/index-{uuid4().hex}", "lang")
    for k in range(2):
        index.insert(rows.where(F.col("doc_id") % 2 == k))
    asked = rows.where(F.col("doc_id") % 20 == 0)
    met = index.query(asked, 6).groupBy("lang", "h").agg(F.sum("n").alias("found"), F.coalesce(F.min(F.when(F.col("d") > 0, F.col("d"))), F.lit(-1)).alias("nearest"))
    return asked.join(met, ["lang", "h"]).select("doc_id", "found", "nearest")


# --- metrics -------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT lang, source, (l.doc_id IS NOT NULL)::INT u FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS field, coalesce(lang, source) AS value, count(*) AS total, sum(u)::BIGINT AS usable, round_even(sum(u)::DOUBLE / count(*), 6) AS coverage FROM r GROUP BY GROUPING SETS ((), (lang), (source))"""
)
def coverage_summary(spark, d):
    """O-62."""
    rows = _t(spark, d, "documents").select("doc_id", "lang", "source").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return metrics.coverage(rows, F.col("quality").isNotNull(), ["lang", "source"])


@query("SELECT count(*) FILTER (event_type = 'view') AS \"view\", count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'absent') AS absent FROM events")
def reason_counts(spark, d):
    """O-63."""
    return metrics.reason_counts(_t(spark, d, "events").select(F.col("event_type").alias("reason")), ["view", "click", "absent"])


_HANDS = "SELECT lang, source, toxic, quality, CAST(n_chars >= 1000 AS INT) + quality AS b, CASE WHEN n_chars % 7 <> 0 THEN CAST(n_chars >= 500 AS INT) + quality END AS s, 2 - 2 * toxic AS e FROM documents JOIN labels USING (doc_id)"


def _hands(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(_t(spark, d, "labels"), "doc_id")
    return rows.selectExpr("lang", "source", "toxic", "quality", "CAST(n_chars >= 1000 AS INT) + quality AS b", "CASE WHEN n_chars % 7 <> 0 THEN CAST(n_chars >= 500 AS INT) + quality END AS s", "2 - 2 * toxic AS e")


@query(
    f"""WITH r AS ({_HANDS}), v AS (SELECT count(*) AS evaluated, count(*) FILTER (s >= e) AS requirement_met, count(*) FILTER (b < e) AS baseline_failures, count(*) FILTER (b < e AND s >= e) AS recovered,
    count(*) FILTER (b >= e) AS baseline_passes, count(*) FILTER (b >= e AND s < e) AS regressed, count(*) FILTER (e = 0) AS zero_hand_samples, count(*) FILTER (e = 0 AND s > 0) AS zero_hand_false_detections FROM r WHERE s IS NOT NULL)
    SELECT *, CASE WHEN baseline_failures = 0 THEN 0 ELSE round_even(recovered::DOUBLE / baseline_failures, 6) END AS recovery_rate, CASE WHEN baseline_passes = 0 THEN 0 ELSE round_even(regressed::DOUBLE / baseline_passes, 6) END AS regression_rate,
    CASE WHEN zero_hand_samples > 0 THEN round_even(zero_hand_false_detections::DOUBLE / zero_hand_samples, 6) END AS zero_hand_false_detection_rate FROM v"""
)
def recovery_rates(spark, d):
    """O-64."""
    return metrics.recovery(_hands(spark, d), F.col("b"), F.col("s"), F.col("e"))


@query(
    f"""WITH r AS (SELECT * FROM ({_HANDS}) WHERE s IS NOT NULL AND b < e)
    SELECT 'lang' AS field, lang AS value, count(*) AS baseline_failures, count(*) FILTER (s >= e) AS recovered, round_even(count(*) FILTER (s >= e)::DOUBLE / count(*), 6) AS recovery_rate FROM r GROUP BY lang
    UNION ALL SELECT 'source', source, count(*), count(*) FILTER (s >= e), round_even(count(*) FILTER (s >= e)::DOUBLE / count(*), 6) FROM r GROUP BY source"""
)
def recovery_by_group(spark, d):
    """O-65."""
    return metrics.recovery_by(_hands(spark, d), F.col("b"), F.col("s"), F.col("e"), ["lang", "source"])


_PRED = "SELECT doc_id, lang, n_chars, CASE WHEN quality = 1 THEN 'OK' ELSE 'UNKNOWN' END AS label, CASE WHEN n_chars BETWEEN 700 AND 6000 THEN 'OK' ELSE 'UNKNOWN' END AS pred FROM documents JOIN labels USING (doc_id)"
_CLASSES = ("OK", "UNKNOWN", "NEVER")


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(_t(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", "lang", "n_chars", F.when(F.col("quality") == 1, "OK").otherwise("UNKNOWN").alias("label"), F.when(F.col("n_chars").between(700, 6000), "OK").otherwise("UNKNOWN").alias("pred"))


def _classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in _CLASSES], "label string")


_CLASS_SQL = """k AS (SELECT unnest(['OK', 'UNKNOWN', 'NEVER']) c), m AS (SELECT t.slice, k.c, count(*) FILTER (label = c AND pred = c) tp, count(*) FILTER (label <> c AND pred = c) fp, count(*) FILTER (label = c AND pred <> c) fn FROM t, k GROUP BY ALL),
    f AS (SELECT slice, c, tp, fp, fn, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp::DOUBLE / (2 * tp + fp + fn) END f1 FROM m)"""
_BLOCK_SQL = """SELECT t.slice, count(*) AS sample_count, round_even(count(*) FILTER (label = pred)::DOUBLE / count(*), 6) AS accuracy, (SELECT round_even(avg(f1), 6) FROM f WHERE f.slice = t.slice) AS macro_f1,
    CASE WHEN count(*) FILTER (label = 'UNKNOWN') > 0 THEN round_even(count(*) FILTER (label = 'UNKNOWN' AND pred <> 'UNKNOWN')::DOUBLE / count(*) FILTER (label = 'UNKNOWN'), 6) END AS unknown_false_acceptance,
    round_even(count(*) FILTER (pred = 'UNKNOWN')::DOUBLE / count(*), 6) AS unknown_prediction_rate FROM t GROUP BY t.slice"""


@query(f"WITH t AS (SELECT 'all' AS slice, * FROM ({_PRED})), {_CLASS_SQL} SELECT c AS class, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0 ELSE round_even(tp::DOUBLE / (tp + fp), 6) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE round_even(tp::DOUBLE / (tp + fn), 6) END AS recall, round_even(f1, 6) AS f1, tp + fn AS support FROM f")
def confusion_metrics(spark, d):
    """O-67."""
    counts = _predicted(spark, d).groupBy("label", "pred").agg(F.count("*").alias("n"))
    found = metrics.class_metrics(counts, _classes(spark))
    return found.select("class", "tp", "fp", "fn", *(F.bround(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"WITH t AS (SELECT unnest(list_filter([CASE WHEN true THEN 'all' END, CASE WHEN n_chars >= 1000 THEN 'long' END, 'lang:' || lang], lambda x: x IS NOT NULL)) AS slice, label, pred FROM ({_PRED})), {_CLASS_SQL} {_BLOCK_SQL}")
def sliced_metrics(spark, d):
    """O-67, O-68."""
    rows = metrics.sliced(_predicted(spark, d), {"all": F.lit(True), "long": F.col("n_chars") >= 1000}, "lang")
    return metrics.metric_block(rows, _classes(spark), ["slice"])


@query(
    f"""WITH t AS (SELECT 'all' AS slice, CASE WHEN n_chars % 5 = 0 THEN 'UNKNOWN' ELSE 'OK' END AS label, CASE WHEN l.doc_id IS NULL THEN 'UNKNOWN' WHEN quality = 1 THEN 'OK' ELSE 'UNKNOWN' END AS pred FROM documents d LEFT JOIN labels l USING (doc_id)), {_CLASS_SQL}
    SELECT * EXCLUDE (slice) FROM ({_BLOCK_SQL})"""
)
def end_to_end_metrics(spark, d):
    """O-54, O-69."""
    truth = _t(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") % 5 == 0, "UNKNOWN").otherwise("OK").alias("label"))
    said = _t(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "OK").otherwise("UNKNOWN").alias("pred"))
    return metrics.metric_block(relations.with_misses(truth, said, "doc_id"), _classes(spark))


@query(
    """WITH r AS (SELECT CASE WHEN quality = 1 THEN 'OK' ELSE 'UNKNOWN' END AS label, least(n_chars / 8000.0::DOUBLE, 1.0::DOUBLE) AS conf FROM documents JOIN labels USING (doc_id)),
    t AS (SELECT g.k AS slice, label, CASE WHEN conf >= g.k / 100.0::DOUBLE THEN 'OK' ELSE 'UNKNOWN' END AS pred FROM r, range(100) g(k)),
    k AS (SELECT unnest(['OK', 'UNKNOWN']) c), m AS (SELECT t.slice, k.c, count(*) FILTER (label = c AND pred = c) tp, count(*) FILTER (label <> c AND pred = c) fp, count(*) FILTER (label = c AND pred <> c) fn FROM t, k GROUP BY ALL),
    f AS (SELECT slice, avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp::DOUBLE / (2 * tp + fp + fn) END) f1 FROM m GROUP BY 1),
    a AS (SELECT slice, count(*) FILTER (label = 'UNKNOWN' AND pred <> 'UNKNOWN')::DOUBLE / count(*) FILTER (label = 'UNKNOWN') fa FROM t GROUP BY 1),
    b AS (SELECT slice, f1, fa FROM f JOIN a USING (slice) WHERE fa <= 0.05 ORDER BY f1 DESC, slice LIMIT 1)
    SELECT coalesce(round_even(max(slice) / 100.0::DOUBLE, 6), 1.0) AS threshold, coalesce(round_even(max(f1), 6), 0.0) AS macro_f1, coalesce(round_even(max(fa), 6), 0.0) AS unknown_false_acceptance FROM b"""
)
def calibrate_threshold(spark, d):
    """O-109."""
    rows = _predicted(spark, d).select("label", F.lit("OK").alias("pred"), F.least(F.col("n_chars") / F.lit(8000.0), F.lit(1.0)).alias("conf"), F.lit(True).alias("routed"))
    found = metrics.calibrate(rows, _classes(spark).where("label <> 'NEVER'"))
    return found.select(*(F.bround(c, 6).alias(c) for c in found.columns))


@query("WITH r AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 0.5 ELSE 1 END / count(*) OVER (PARTITION BY event_type, user_id % 7)::DOUBLE w FROM events) SELECT event_id, round_even(w / avg(w) OVER (), 6) AS weight FROM r")
def cell_weights(spark, d):
    """O-66."""
    rows = _t(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 7).alias("cell"), "user_id")
    return metrics.cell_weights(rows, "event_type", "cell", F.col("user_id") % 2 == 0).select("event_id", F.bround("weight", 6).alias("weight"))


@query("SELECT o_custkey % 50 AS sample_id, max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS \"O\", max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS \"F\", CAST(NULL AS BIGINT) AS \"none\" FROM orders GROUP BY 1")
def strategy_pivot(spark, d):
    """O-129."""
    rows = _t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("sample_id"), F.col("o_orderstatus").alias("strategy"), F.col("o_orderkey").alias("hands"))
    return metrics.strategy_table(rows, ["O", "F", "none"])


@query(
    """WITH r AS (SELECT o_orderkey % 1400 AS sample_id, CASE WHEN o_orderkey % 3 = 0 THEN 'train' ELSE 'val' END AS split, o_orderstatus AS label, o_custkey AS group_id FROM orders), w AS (SELECT unnest(['O', 'F', 'X']) AS label)
    SELECT 'label_missing' AS rule, label AS subject FROM w WHERE label NOT IN (SELECT label FROM r) UNION ALL SELECT DISTINCT 'label_unexpected', label FROM r WHERE label NOT IN (SELECT label FROM w)
    UNION ALL SELECT 'duplicate_sample_id', CAST(sample_id AS VARCHAR) FROM r GROUP BY sample_id HAVING count(*) > 1 UNION ALL SELECT 'group_leakage', CAST(group_id AS VARCHAR) FROM r GROUP BY group_id HAVING count(DISTINCT split) > 1
    UNION ALL SELECT 'hash_leakage', sha256(CAST(sample_id AS VARCHAR)) FROM r GROUP BY sample_id HAVING count(DISTINCT split) > 1
    UNION ALL SELECT 'split_lacks_label', s.split || ':' || w.label FROM (SELECT DISTINCT split FROM r) s, w WHERE NOT EXISTS (FROM r WHERE r.split = s.split AND r.label = w.label)"""
)
def constraint_violations(spark, d):
    """O-120."""
    key = F.col("o_orderkey") % 1400
    rows = _t(spark, d, "orders").select(key.alias("sample_id"), F.when(F.col("o_orderkey") % 3 == 0, "train").otherwise("val").alias("split"), F.col("o_orderstatus").alias("label"), F.col("o_custkey").alias("group_id"), F.sha2(key.cast("string"), 256).alias("content_sha256"))
    return curation.violations(rows, spark.createDataFrame([("O",), ("F",), ("X",)], "label string"))


@query("SELECT count(*) AS broken FROM orders WHERE NOT (CASE WHEN o_orderkey % 3000 + 1 BETWEEN 1 AND 2000 THEN 'train' WHEN o_orderkey % 3000 + 1 BETWEEN 2101 AND 2500 THEN 'val' WHEN o_orderkey % 3000 + 1 BETWEEN 2601 AND 3000 THEN 'test' END IS NOT DISTINCT FROM 'train')")
def sequence_isolation(spark, d):
    """O-121."""
    n = F.col("o_orderkey") % 3000 + 1
    rows = _t(spark, d, "orders").withColumn("split", F.lit("train")).withColumn("group_id", text.block_id("orders", n))
    return curation.sequence_violations(rows, n, "orders").agg(F.count("*").alias("broken"))


# --- poses ---------------------------------------------------------------------------------


def _hand_rows(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as hands of 21 points: one or two (a shifted, scaled twin) by vec_id."""
    v = F.col("embedding")
    a = F.struct(pose.points_of(v).alias("points"), F.when(F.col("label") % 2 == 0, "Right").otherwise("left").alias("handedness"), F.lit(0.9).alias("score"))
    twin = F.transform(pose.points_of(v), lambda p: F.struct((p["x"] * 1.5 + 1.0).alias("x"), (p["y"] * 1.5 - 0.25).alias("y"), (p["z"] * 1.5).alias("z")))
    b = F.struct(twin.alias("points"), F.lit("Unclear").alias("handedness"), F.lit(0.5).alias("score"))
    k = F.col("vec_id") % 4
    none = F.slice(F.array(a), 1, 0)
    return _t(spark, d, "embeddings").select("vec_id", "embedding", F.when(k == 0, F.array(a)).when(k == 3, none).otherwise(F.array(a, b)).alias("hands"), F.when(k == 0, F.when(F.col("vec_id") % 8 == 0, 1).otherwise(2)).when(k == 1, 0).otherwise(2).alias("expected"))


#: Scale, shift and flat coordinates of the two hands in SQL.
_PALM = "sqrt(pow(embedding[28]::DOUBLE - embedding[1]::DOUBLE, 2) + pow(embedding[29]::DOUBLE - embedding[2]::DOUBLE, 2))"


@query(
    f"""SELECT vec_id, round_even((embedding[4]::DOUBLE - embedding[1]::DOUBLE) / {_PALM}, 6) AS x1, round_even((embedding[62]::DOUBLE - embedding[2]::DOUBLE) / {_PALM}, 6) AS y20, round_even((embedding[63]::DOUBLE - embedding[3]::DOUBLE) / {_PALM}, 6) AS z20 FROM embeddings"""
)
def normalize_vec(spark, d):
    """O-86."""
    n = pose.normalize(pose.points_of(F.col("embedding")))
    rows = _t(spark, d, "embeddings").select("vec_id", n.alias("n"))
    return rows.select("vec_id", *(F.bround(F.get("n", F.lit(k)), 6).alias(name) for k, name in ((3, "x1"), (61, "y20"), (62, "z20"))))


@query(
    f"""WITH b AS (SELECT vec_id, vec_id % 4 AS k, embedding AS e, {_PALM} AS s, CASE vec_id % 4 WHEN 0 THEN CASE WHEN vec_id % 8 = 0 THEN 1 ELSE 2 END WHEN 1 THEN 0 ELSE 2 END AS expected FROM embeddings),
    c AS (SELECT *, expected = 2 AND k = 2 AND 1.5 * e[1]::DOUBLE + 1.0 < e[1]::DOUBLE AS swapped FROM b)
    SELECT vec_id, k <> 3 AS usable, CASE WHEN k = 3 THEN 'no_hands_detected' WHEN expected = 0 THEN 'hard_negative' WHEN expected = 2 AND k = 0 THEN 'partial_hands' ELSE 'ok' END AS reason, CASE k WHEN 0 THEN 1 WHEN 3 THEN 0 ELSE 2 END AS detected_hands,
    CASE WHEN k = 3 THEN 0.0 ELSE round_even((e[4]::DOUBLE - e[1]::DOUBLE) / s, 6) + 0.0 END AS x1, CASE WHEN k = 2 THEN 1.0 ELSE 0.0 END AS second,
    CASE WHEN k = 2 THEN round_even(CASE WHEN swapped THEN -1 ELSE 1 END * (0.5 * e[1]::DOUBLE + 1.0) / (1.25 * s), 6) + 0.0 ELSE 0.0 END AS dx, CASE WHEN k = 2 THEN round_even(CASE WHEN swapped THEN -1 ELSE 1 END * ln(1.5::DOUBLE), 6) ELSE 0.0 END AS ratio FROM c"""
)
def build_features(spark, d):
    """O-82, O-87, O-88."""
    f = pose.add_features(_hand_rows(spark, d)).select("vec_id", "feature.*")
    at = lambda k, name: (F.bround(F.get("features", F.lit(k)), 6) + 0.0).alias(name)
    return f.select("vec_id", "usable", "reason", "detected_hands", at(3, "x1"), at(127, "second"), at(128, "dx"), at(131, "ratio"))


@query(
    f"""WITH b AS (SELECT vec_id, vec_id % 4 AS k, embedding AS e, {_PALM} AS s, CASE WHEN 1.5 * embedding[1]::DOUBLE + 1.0 < embedding[1]::DOUBLE THEN -1 ELSE 1 END AS o FROM embeddings)
    SELECT vec_id, CASE WHEN k = 3 THEN 0.0 ELSE round_even(-(e[4]::DOUBLE - e[1]::DOUBLE) / s, 6) + 0.0 END AS x1, CASE WHEN k = 3 THEN 0.0 ELSE round_even((e[5]::DOUBLE - e[2]::DOUBLE) / s, 6) + 0.0 END AS y1,
    CASE WHEN k = 2 THEN 1.0 ELSE 0.0 END AS second, CASE WHEN k = 2 THEN round_even(o * (0.5 * e[1]::DOUBLE + 1.0) / (1.25 * s), 6) + 0.0 ELSE 0.0 END AS dx,
    CASE WHEN k = 2 THEN round_even(-o * (0.5 * e[2]::DOUBLE - 0.25) / (1.25 * s), 6) + 0.0 ELSE 0.0 END AS dy, CASE WHEN k = 2 THEN round_even(-o * ln(1.5::DOUBLE), 6) ELSE 0.0 END AS ratio FROM b"""
)
def mirror_features(spark, d):
    """O-90, of no hand, one hand and two."""
    rows = pose.add_features(_hand_rows(spark, d)).select("vec_id", F.col("feature.features").alias("f"))
    rows = rows.select("vec_id", pose.mirror(F.col("f")).alias("m"))
    at = lambda k, name: (F.bround(F.get("m", F.lit(k)), 6) + 0.0).alias(name)
    return rows.select("vec_id", at(3, "x1"), at(4, "y1"), at(127, "second"), at(128, "dx"), at(129, "dy"), at(131, "ratio"))


@query(
    f"""WITH b AS (SELECT vec_id, vec_id % 4 AS k, embedding AS e, {_PALM} AS s FROM embeddings)
    SELECT vec_id, 1 AS feature_hands, round_even((e[4]::DOUBLE - e[1]::DOUBLE) / s, 6) + 0.0 AS x1, 0.0::DOUBLE AS second FROM b WHERE k <> 3 UNION ALL SELECT vec_id, 2, round_even((e[4]::DOUBLE - e[1]::DOUBLE) / s, 6) + 0.0, 1.0::DOUBLE FROM b WHERE k IN (1, 2)"""
)
def hypotheses(spark, d):
    """O-95..O-97."""
    rows = pose.hypotheses(_hand_rows(spark, d))
    return rows.select("vec_id", "feature_hands", (F.bround(F.get("features", F.lit(3)), 6) + 0.0).alias("x1"), F.get("features", F.lit(127)).alias("second"))


@query(
    """WITH b AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 1 WHEN 3 THEN 0 ELSE 2 END n, CASE vec_id % 4 WHEN 3 THEN 0.0 ELSE embedding[1]::DOUBLE * 640 END x FROM embeddings)
    SELECT vec_id, CASE WHEN n = 0 THEN 'padded' ELSE 'full_frame' END AS strategy, n AS hands, CASE WHEN n > 0 THEN round_even(x, 6) END AS first_x, CASE WHEN n >= 2 THEN 2 ELSE 0 END AS largest FROM b"""
)
def detector_cascade(spark, d):
    """O-49, O-78, O-91, O-112."""
    rows = _hand_rows(spark, d)
    spare = F.slice(F.col("hands"), 1, 0)
    name, hands = detection.cascade([("full_frame", F.when(F.size("hands") > 0, F.col("hands"))), ("threshold", spare), ("padded", F.when(F.size("hands") == 0, F.array(F.lit(None).cast(rows.schema["hands"].dataType.elementType))))])
    rows = rows.select("vec_id", name.alias("strategy"), F.size("hands").alias("hands"), pose.to_pixels(F.get("hands", F.lit(0))["points"], F.lit(640), F.lit(480)).alias("p"), F.size(pose.largest_by_area(F.col("hands"), 2)).alias("largest"))
    return rows.select("vec_id", "strategy", "hands", F.bround(F.col("p")[0]["x"], 6).alias("first_x"), "largest")


_BOX = "WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 200)::DOUBLE AS x0, (l_suppkey % 100)::DOUBLE AS y0, (l_partkey % 200 + l_quantity)::DOUBLE AS x1, (l_suppkey % 100 + l_quantity * 2)::DOUBLE AS y1 FROM lineitem)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    x, y, q = F.col("l_partkey") % 200, F.col("l_suppkey") % 100, F.col("l_quantity")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + q).cast("double").alias("x1"), (y + q * 2).cast("double").alias("y1"))


@query(
    f"""{_BOX}, c AS (SELECT *, greatest(x1 - x0, y1 - y0) * 1.4 / 2 h, (x0 + x1) / 2 cx, (y0 + y1) / 2 cy FROM b),
    d AS (SELECT *, greatest(0, round_even(cx - h, 0)::INT) l, greatest(0, round_even(cy - h, 0)::INT) t, least(320, round_even(cx + h, 0)::INT) r, least(240, round_even(cy + h, 0)::INT) o FROM c)
    SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN l END AS l, CASE WHEN ok THEN t END AS t, CASE WHEN ok THEN r END AS r, CASE WHEN ok THEN o END AS o FROM (SELECT *, r - l >= 32 AND o - t >= 32 AS ok FROM d)"""
)
def xml_crop(spark, d):
    """O-98."""
    crop = geometry.annotation_crop(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.lit(320), F.lit(240), 0.2)
    return _boxes(spark, d).select("l_orderkey", "l_linenumber", crop.alias("c")).select("l_orderkey", "l_linenumber", *(F.get("c", F.lit(k)).alias(n) for k, n in enumerate("ltro")))


@query(
    f"""{_BOX}, c AS (SELECT *, least(greatest(greatest(x1 - x0, y1 - y0) * 1.8::DOUBLE, 240 * 0.35::DOUBLE), 320, 240) s FROM b), e AS (SELECT *, least(greatest((x0 + x1) / 2 - s / 2, 0.0), 320 - s) x, least(greatest((y0 + y1) / 2 - s / 2, 0.0), 240 - s) y FROM c)
    SELECT l_orderkey, l_linenumber, round_even(x, 0)::INT AS l, round_even(y, 0)::INT AS t, round_even(x + s, 0)::INT AS r, round_even(y + s, 0)::INT AS o FROM e"""
)
def crop_box(spark, d):
    """O-100."""
    crop = geometry.clamped_crop(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.lit(320.0), F.lit(240.0))
    return _boxes(spark, d).select("l_orderkey", "l_linenumber", crop.alias("c")).select("l_orderkey", "l_linenumber", *(F.get("c", F.lit(k)).alias(n) for k, n in enumerate("ltro")))


@query("SELECT p_partkey, greatest(1, round_even(greatest(p_size * 10, p_partkey % 500) * 0.25::DOUBLE, 0)::INT) AS border, CAST(p_partkey % 7 AS BIGINT) AS col, CAST(p_partkey // 7 AS BIGINT) AS row, CAST(least(greatest(p_size - 5, 0), 39) AS INTEGER) AS source FROM part")
def pad_border(spark, d):
    """O-14, O-99, O-136."""
    place = geometry.grid_place(F.col("p_partkey"))
    rows = _t(spark, d, "part").select("p_partkey", geometry.border(F.col("p_size") * 10, F.col("p_partkey") % 500, 0.25).alias("border"), place.alias("at"), geometry.clamp_index(F.col("p_size"), 5, F.lit(40)).alias("source"))
    return rows.select("p_partkey", "border", F.col("at.column").alias("col"), F.col("at.row").cast("long").alias("row"), "source")


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 AS k, (l_suppkey % 100)::DOUBLE x0, (l_quantity + l_suppkey % 100)::DOUBLE x1, CASE l_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN k = 2 AND l_linenumber = 1 THEN 'invalid_xml' WHEN n <> 1 THEN 'multi_object_annotation' WHEN l_linenumber % 2 = 0 THEN 'annotation_label_mismatch' ELSE 'ok' END AS reason,
    CASE WHEN k = 2 AND l_linenumber = 1 THEN -1 ELSE n END AS objects, n = 1 AND x1 <= 120 AS box_ok FROM b"""
)
def xml_annotations(spark, d):
    """O-12, O-26, O-39, O-133."""
    x0, x1, k = F.col("l_suppkey") % 100, F.col("l_quantity") + F.col("l_suppkey") % 100, F.col("l_partkey") % 3
    one = F.concat(F.lit("<object><name> a</name><bndbox><xmin>"), x0.cast("string"), F.lit("</xmin><ymin>0</ymin><xmax>"), x1.cast("string"), F.lit("</xmax><ymax>9</ymax></bndbox></object>"))
    body = F.when(k == 0, "").when(k == 1, one).otherwise(F.concat(one, one))
    broken = (k == 2) & (F.col("l_linenumber") == 1)
    xml = F.concat(F.lit("<annotation><filename>f</filename><size><width>120</width><height>10</height></size>"), body, F.when(broken, "<object").otherwise("</annotation>"))
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", files.parse_annotations(xml).alias("a"))
    parsed, objects = F.col("a._corrupt_record").isNull(), F.col("a.object")
    label = F.when(F.col("l_linenumber") % 2 == 0, "b").otherwise("A")
    reason = curation.annotation_reason(F.lit(True), parsed, objects, label)
    box = geometry.valid_box(F.get(objects, F.lit(0))["bndbox"], F.col("a.size.width"), F.col("a.size.height"))
    n = F.when(parsed, F.coalesce(F.size(objects), F.lit(0))).otherwise(-1)
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(reason, F.lit("ok")).alias("reason"), n.alias("objects"), ((n == 1) & F.coalesce(box, F.lit(False))).alias("box_ok"))


# --- scoring -------------------------------------------------------------------------------


@query("WITH e AS (SELECT unnest(embedding)::DOUBLE v, unnest(range(len(embedding))) i FROM embeddings) SELECT CAST(i AS INTEGER) AS dim, round_even(avg(v), 6) + 0.0 AS mean, round_even(CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1.0 END, 6) AS scale FROM e GROUP BY 1")
def scaler_fit(spark, d):
    """O-105."""
    rows = _t(spark, d, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return scoring.scaler_fit(rows, "x").select("dim", (F.bround("mean", 6) + 0.0).alias("mean"), F.bround("scale", 6).alias("scale"))


def _model() -> dict:
    """A 64-8-3 network in closed form, which SQL can spell too."""
    first = [[math.sin(i * 8 + j) for j in range(8)] for i in range(64)]
    last = [[math.cos(j * 3 + k) for k in range(3)] for j in range(8)]
    layers = [
        {"inputSize": 64, "outputSize": 8, "activation": "relu", "weights": first, "bias": [0.1 * math.cos(j) for j in range(8)]},
        {"inputSize": 8, "outputSize": 3, "activation": "softmax", "weights": last, "bias": [0.01 * k for k in range(3)]},
    ]
    return {"classes": ["A", "B", "UNKNOWN"], "scaler": {"mean": [0.01 * math.sin(i) for i in range(64)], "scale": [1 + i / 64 for i in range(64)]}, "layers": layers}


_NET = """x AS (SELECT vec_id, unnest(embedding)::DOUBLE v, unnest(range(len(embedding))) i FROM embeddings),
    h AS (SELECT vec_id, j, greatest(0, sum((v - 0.01 * sin(i)) / (1 + i / 64.0::DOUBLE) * sin(i * 8 + j)) + 0.1 * cos(j)) h FROM x, range(8) r(j) GROUP BY vec_id, j),
    o AS (SELECT vec_id, k, sum(h * cos(j * 3 + k)) + 0.01 * k o FROM h, range(3) r(k) GROUP BY vec_id, k),
    p AS (SELECT vec_id, k, exp(o - max(o) OVER (PARTITION BY vec_id)) / sum(exp(o)) OVER (PARTITION BY vec_id) * exp(max(o) OVER (PARTITION BY vec_id)) p FROM o)"""


@query(f"WITH {_NET} SELECT vec_id, CAST(k AS INTEGER) AS k, round_even(p, 6) AS p FROM p")
def mlp_score(spark, d):
    """O-106, in Arrow batches."""
    rows = scoring.mlp_score(_t(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", _model())
    return rows.select("vec_id", F.posexplode("probabilities").alias("k", "p")).select("vec_id", "k", F.bround("p", 6).alias("p"))


@query(
    f"""WITH {_NET}, b AS (SELECT vec_id, arg_max(k, p) k, max(p) c FROM p GROUP BY 1)
    SELECT vec_id, CASE WHEN c >= 0.4 AND vec_id % 3 = CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END THEN ['A', 'B', 'UNKNOWN'][k + 1] ELSE 'UNKNOWN' END AS label, round_even(c, 6) AS confidence FROM b"""
)
def argmax_gate(spark, d):
    """O-53, O-106, O-108."""
    rows = scoring.mlp_score(_t(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", _model())
    name, confidence = scoring.arg_max(F.col("probabilities"), ["A", "B", "UNKNOWN"])
    rows = rows.select("vec_id", name.alias("n"), confidence.alias("c"))
    return rows.select("vec_id", scoring.gate(F.col("n"), F.col("c"), F.col("vec_id") % 3, {"A": 1, "B": 2, "UNKNOWN": 0}, 0.4).alias("label"), F.bround("c", 6).alias("confidence"))


@query(
    f"""WITH {_NET}, q AS (SELECT vec_id // 2 AS frame, vec_id % 2 + 1 AS hands, arg_max(k, p) k, max(p) c, max(p) FILTER (k = 2) u FROM p GROUP BY vec_id),
    a AS (SELECT *, k <> 2 AND c >= 0.36 AND hands = k + 1 AS ok FROM q),
    r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY ok DESC, CASE WHEN ok THEN c ELSE u END DESC, hands) n FROM a)
    SELECT frame, CASE WHEN ok THEN ['A', 'B'][k + 1] ELSE 'UNKNOWN' END AS label, round_even(CASE WHEN ok THEN c ELSE u END, 6) AS confidence, CAST(hands AS INTEGER) AS feature_hands FROM r WHERE n = 1"""
)
def arbitrate(spark, d):
    """O-107."""
    rows = _t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("frame"), (F.col("vec_id") % 2 + 1).cast("int").alias("feature_hands"), "embedding")
    found = scoring.arbitrate(scoring.mlp_score(rows, "embedding", _model()), "frame", ["A", "B", "UNKNOWN"], {"A": 1, "B": 2, "UNKNOWN": 0}, 0.36)
    return found.select("frame", "label", F.bround("confidence", 6).alias("confidence"), "feature_hands")


@query("SELECT true AS within")
def parity_error(spark, d):
    """O-70: the batched network against the one in expressions."""
    m = _model()
    rows = scoring.mlp_score(_t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x")), "x", m)
    z = scoring.scaled(F.col("x"), m["scaler"]["mean"], m["scaler"]["scale"])
    rows = rows.withColumn("z", z)
    for layer in m["layers"]:
        rows = rows.withColumn("z", scoring.dense(F.col("z"), layer["weights"], layer["bias"]))
        rows = rows.withColumn("z", F.transform("z", lambda v: F.greatest(v, F.lit(0.0))) if layer["activation"] == "relu" else scoring.softmax(F.col("z")))
    return metrics.parity_error(rows, "probabilities", "z").select((F.col("max_abs_error") <= 1e-10).alias("within"))


@query()
def train_candidates(spark, d):
    """O-125..O-128: two networks on embeddings, the better one by validation macro F1; epochs and patience are the operator's."""
    classes = [str(k) for k in range(10)]
    rows = _t(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    x, y, w = training.collect(rows.where("vec_id % 5 <> 0"), "embedding", "label", "vec_id", classes)
    xv, yv, _ = training.collect(rows.where("vec_id % 5 = 0"), "embedding", "label", "vec_id", classes)
    reports = []
    for name, hidden in (("small", (32,)), ("large", (128, 64))):
        _, scores = training.train(x, y, w, xv, yv, classes, hidden)
        reports.append({"name": name, "macro_f1": round(max(scores), 6), "epochs": len(scores)})
    chosen = training.choose(reports, ["macro_f1"])["name"]
    return spark.createDataFrame([(r["name"], r["macro_f1"], r["epochs"], r["name"] == chosen) for r in reports], "name string, macro_f1 double, epochs int, chosen boolean")


@query()
def train_over_tables(spark, d):
    """O-125, O-128: two networks whose rows stay in their table; losses and scores by epoch, ``chosen`` by the best macro F1."""
    classes = [str(k) for k in range(10)]
    v = F.col("vec_id")
    rows = _t(spark, d, "embeddings").select(v, "embedding", F.col("label").cast("string").alias("label"))
    part = lambda which: distributed.prepared(rows.where(which), F.col("embedding"), F.col("label"), v, classes, group_rows=500)
    fit, held = part(v % 5 != 0), part(v % 5 == 0)
    reports = []
    for name, hidden in (("small", (16,)), ("large", (32, 16))):
        _, net = distributed.train(fit, held, classes, f"{shared_dir(spark)}/train-{uuid4().hex}", hidden, epochs=4)
        reports.append({"name": name, "macro_f1": max(net.scores), "curve": list(zip(net.losses, net.scores, strict=True))})
    chosen = training.choose(reports, ["macro_f1"])["name"]
    return spark.createDataFrame([(r["name"], k, round(loss, 9), round(score, 9), r["name"] == chosen) for r in reports for k, (loss, score) in enumerate(r["curve"], 1)], "name string, epoch int, loss double, macro_f1 double, chosen boolean")


# --- time ----------------------------------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select("event_id", "user_id", "ts", F.unix_millis("ts").alias("ms"), F.when(F.col("event_type") == "view", "UNKNOWN").otherwise(F.col("event_type")).alias("label"), (F.col("value") / 500).alias("confidence"))


HOUR = 3_600_000
_EV = "e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type = 'view' THEN 'UNKNOWN' ELSE event_type END AS label, value / 500 AS confidence FROM events)"
_STABLE = f"""{_EV}, w AS (SELECT a.event_id, b.label, count(*) n, sum(CASE WHEN b.event_id % 97 = 0 THEN 0 ELSE b.confidence END) s, min(b.ms) f FROM e a JOIN e b ON a.user_id = b.user_id AND b.ms BETWEEN a.ms - {48 * HOUR} AND a.ms GROUP BY ALL),
    v AS (SELECT *, sum(n) OVER (PARTITION BY event_id) tot, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, f) r FROM w),
    st AS (SELECT e.event_id, user_id, ms, CASE WHEN tot < 3 OR v.label = 'UNKNOWN' OR n::DOUBLE / tot < 0.5 THEN 'UNKNOWN' ELSE v.label END AS stable_label, CASE WHEN tot < 3 THEN 0.0 ELSE s / n END AS stable_confidence FROM v JOIN e USING (event_id) WHERE r = 1)"""
_COMMIT = f"""{_STABLE}, i AS (SELECT *, count(*) FILTER (stable_label <> 'UNKNOWN') OVER (PARTITION BY user_id ORDER BY ms) isl FROM st),
    sp AS (SELECT user_id, isl, max(ms) - min(ms) span FROM i WHERE stable_label = 'UNKNOWN' GROUP BY ALL),
    kn AS (SELECT *, lag(stable_label) OVER (PARTITION BY user_id ORDER BY ms) pl FROM i WHERE stable_label <> 'UNKNOWN'),
    cm AS (SELECT kn.* FROM kn LEFT JOIN sp ON sp.user_id = kn.user_id AND sp.isl = kn.isl - 1 WHERE pl IS NULL OR pl <> stable_label OR coalesce(span, -1) >= {24 * HOUR})"""


def _gaps(rows: DataFrame) -> DataFrame:
    """Events of which some have no confidence."""
    return rows.withColumn("confidence", F.when(F.col("event_id") % 97 != 0, F.col("confidence")))


def _stable(spark: SparkSession, d: str) -> DataFrame:
    return temporal.sliding_majority(_gaps(_events(spark, d)), "user_id", F.col("ms"), F.col("label"), F.col("confidence"), 48 * HOUR, 3, 0.5)


@query(f"WITH {_STABLE} SELECT event_id, user_id, stable_label, round_even(stable_confidence, 9) AS stable_confidence FROM st")
def sliding_majority(spark, d):
    """O-113."""
    return _stable(spark, d).select("event_id", "user_id", "stable_label", F.bround("stable_confidence", 9).alias("stable_confidence"))


@query(f"WITH {_COMMIT} SELECT event_id, user_id, stable_label AS label FROM cm")
def commit_latch(spark, d):
    """O-114."""
    found = temporal.commit_latch(_stable(spark, d), "user_id", F.col("ms"), F.col("stable_label"), 24 * HOUR)
    return found.select("event_id", "user_id", F.col("stable_label").alias("label"))


@query(f"WITH {_COMMIT}, z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC) r FROM cm) SELECT user_id, string_agg(stable_label, ' ' ORDER BY ms) AS transcript FROM z WHERE r <= 16 GROUP BY 1")
def transcript_tail(spark, d):
    """O-115; sixteen is the operator's."""
    found = temporal.commit_latch(_stable(spark, d), "user_id", F.col("ms"), F.col("stable_label"), 24 * HOUR)
    return temporal.transcript_tail(found, "user_id", ["ms"], "stable_label")


@query(
    f"""WITH RECURSIVE {_EV}, o AS (SELECT *, ms / 86400000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ms) rn FROM e),
    r AS (SELECT event_id, user_id, rn, ceil(t)::BIGINT AS clock FROM o WHERE rn = 1 UNION ALL SELECT o.event_id, o.user_id, o.rn, greatest(ceil(o.t)::BIGINT, r.clock + 1) FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
    SELECT event_id, clock FROM r"""
)
def monotone_clock(spark, d):
    """O-104."""
    return temporal.monotone_clock(_events(spark, d), "user_id", F.col("ms") / F.lit(86400000.0), ["ms"]).select("event_id", "clock")


@query(
    f"""WITH RECURSIVE {_EV}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms) rn FROM e),
    r AS (SELECT event_id, user_id, rn, true AS pass, ms AS last FROM o WHERE rn = 1 UNION ALL
    SELECT o.event_id, o.user_id, o.rn, o.ms - r.last >= {12 * HOUR}, CASE WHEN o.ms - r.last >= {12 * HOUR} THEN o.ms ELSE r.last END FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
    SELECT event_id, user_id FROM r WHERE pass"""
)
def throttle(spark, d):
    """O-111."""
    return temporal.folded(_events(spark, d).select("event_id", "user_id", "ms"), "user_id", ["ms"], machines.throttle(12 * HOUR), "event_id long, user_id long")


@query(
    f"""WITH RECURSIVE {_EV}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms) rn, lag(label) OVER (PARTITION BY user_id ORDER BY ms) pl, lag(confidence) OVER (PARTITION BY user_id ORDER BY ms) pc FROM e),
    s AS (SELECT *, CASE WHEN rn > 1 AND label = pl AND confidence = pc THEN 0 WHEN label = 'click' AND confidence >= 0.05 THEN 30 WHEN label <> 'click' THEN -5 ELSE 0 END delta FROM o),
    r AS (SELECT event_id, user_id, rn, greatest(0, least(100, delta)) shown, CASE WHEN greatest(0, least(100, delta)) >= 100 THEN 1 ELSE 0 END done FROM s WHERE rn = 1 UNION ALL
    SELECT s.event_id, s.user_id, s.rn, greatest(0, least(100, CASE WHEN r.shown >= 100 THEN 0 ELSE r.shown END + s.delta)), r.done + CASE WHEN greatest(0, least(100, CASE WHEN r.shown >= 100 THEN 0 ELSE r.shown END + s.delta)) >= 100 THEN 1 ELSE 0 END FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1)
    SELECT event_id, user_id, CAST(shown AS BIGINT) AS progress, CAST(done AS BIGINT) AS completed FROM r"""
)
def hold_accumulator(spark, d):
    """O-116."""
    rows = _events(spark, d).select("event_id", "user_id", "ms", "label", "confidence")
    return temporal.folded(rows, "user_id", ["ms"], machines.hold("click", gain=30, loss=5, least=0.05), "event_id long, user_id long, progress long, completed long")


def _one_user(spark: SparkSession, d: str) -> DataFrame:
    """All events as those of one user, an hour apart."""
    return _gaps(_events(spark, d)).withColumns({"user_id": F.lit(0).cast("long"), "ms": F.col("event_id") * HOUR})


def _single(sql: str) -> str:
    """The SQL of users' events, for one user with an event each hour."""
    return sql.replace("SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms", f"SELECT event_id, 0::BIGINT AS user_id, event_id * {HOUR} AS ms")


@query(f"WITH {_single(_EV)}, o AS (SELECT event_id, ceil(event_id * 0.37::DOUBLE)::BIGINT AS c, row_number() OVER (ORDER BY ms) AS n FROM e) SELECT event_id, max(c - n) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + n AS clock FROM o")
def busy_clock(spark, d):
    """O-104 of one key that is cut into ranges."""
    return temporal.monotone_clock(_one_user(spark, d), "user_id", F.col("event_id") * F.lit(0.37), ["ms"], ranges=8).select("event_id", "clock")


@query(f"WITH {_single(_STABLE)} SELECT event_id, stable_label, round_even(stable_confidence, 9) AS stable_confidence FROM st")
def busy_majority(spark, d):
    """O-113 of one key that is cut into ranges."""
    found = temporal.sliding_majority(_one_user(spark, d), "user_id", F.col("ms"), F.col("label"), F.col("confidence"), 48 * HOUR, 3, 0.5, ranges=8)
    return found.select("event_id", "stable_label", F.bround("stable_confidence", 9).alias("stable_confidence"))


@query(f"WITH {_single(_EV)}, st AS (SELECT event_id, user_id, ms, label AS stable_label FROM e), {_COMMIT.removeprefix(_STABLE).removeprefix(', ').replace(f'>= {24 * HOUR}', f'>= {HOUR}')} SELECT event_id, stable_label AS label FROM cm")
def busy_latch(spark, d):
    """O-114 of one key that is cut into ranges."""
    rows = _one_user(spark, d).select("event_id", "user_id", "ms", "label")
    return temporal.commit_latch(rows, "user_id", F.col("ms"), F.col("label"), HOUR, ranges=8).select("event_id", "label")


@query(
    f"""WITH RECURSIVE {_EV}, o AS (SELECT e.event_id, e.user_id, e.ms, v.value AS latency, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ms) rn FROM e JOIN events v USING (event_id)),
    r AS (SELECT event_id, user_id, rn, latency, ms AS since, 1::BIGINT AS open, 0.0::DOUBLE AS fps, 0::BIGINT AS frames, false AS closed FROM o WHERE rn = 1 UNION ALL
    SELECT o.event_id, o.user_id, o.rn, o.latency, CASE WHEN o.ms - r.since >= {24 * HOUR} THEN o.ms ELSE r.since END, CASE WHEN o.ms - r.since >= {24 * HOUR} THEN 0 ELSE r.open + 1 END,
    CASE WHEN o.ms - r.since >= {24 * HOUR} THEN ((r.open + 1) * 1000)::DOUBLE / (o.ms - r.since) ELSE r.fps END, CASE WHEN o.ms - r.since >= {24 * HOUR} THEN r.open + 1 ELSE 0 END, o.ms - r.since >= {24 * HOUR} FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
    SELECT event_id, fps * 1000000.0::DOUBLE AS frames_a_megasecond, frames, closed, latency AS latency_ms FROM r"""
)
def frame_meter(spark, d):
    """O-110: windows that begin anew at the frame that closed the last one, and the latency beside the rate."""
    rows = _events(spark, d).join(_t(spark, d, "events").select("event_id", "value"), "event_id").select("event_id", "user_id", "ms", "value")
    found = temporal.frame_meter(rows, "user_id", F.col("ms"), F.col("value"), 24 * HOUR)
    return found.select("event_id", (F.col("fps") * F.lit(1e6)).alias("frames_a_megasecond"), "frames", "closed", "latency_ms")


@query("SELECT user_id, date_trunc('day', ts) AS start, count(*) AS frames FROM events GROUP BY ALL")
def frame_rate(spark, d):
    """O-110."""
    return temporal.frame_rate(_events(spark, d), "user_id", F.col("ts"), "1 day").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "frames")


def _streamed(spark: SparkSession, d: str, machine: machines.Machine, schema: str, source: DataFrame, parts: int = 3) -> DataFrame:
    """Runs a machine over the rows as a stream of micro-batches and returns the written table.

    The rows are cut into ``parts`` of equal time, which come one after the other, each in as many
    files as there are tasks; after each the query stops with its state stored, and the next one goes on
    from there. The source is worked out once. Input, output and state lie in a folder of this call's own.
    """
    at = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    source = durable(spread(source, "user_id"))
    ends = source.agg(F.min("ms").alias("a"), F.max("ms").alias("b")).first()
    width = ((ends["b"] or 0) - (ends["a"] or 0)) // parts + 1
    for k in range(parts):
        begin = (ends["a"] or 0) + k * width
        source.where((F.col("ms") >= begin) & (F.col("ms") < begin + width)).write.mode("append").parquet(f"{at}/in")
        stream = stateful.read_frames(spark, f"{at}/in", source.schema)
        stateful.run_available(stateful.run_machine(stream, ["user_id"], "ts", machine, schema, idle_ms=10 * 365 * 86_400_000), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")


@query(SQL["sliding_majority"])
def stream_majority(spark, d):
    """O-113, O-118 as a stream that stops and goes on."""
    rows = _gaps(_events(spark, d))
    found = _streamed(spark, d, machines.majority(48 * HOUR, 3, 0.5), "event_id long, user_id long, stable_label string, stable_confidence double", rows)
    return found.select("event_id", "user_id", "stable_label", F.bround("stable_confidence", 9).alias("stable_confidence"))


@query(SQL["commit_latch"])
def stream_latch(spark, d):
    """O-114 as a stream over stable labels that stops and goes on."""
    found = _streamed(spark, d, machines.latch(24 * HOUR), "event_id long, user_id long, commit string", _stable(spark, d).select("event_id", "user_id", "ts", "ms", "stable_label"))
    return found.select("event_id", "user_id", F.col("commit").alias("label"))


_SESSIONS = f"""b AS (SELECT event_id, user_id, ms, label, CASE WHEN event_id % 97 = 0 THEN 0 ELSE confidence END AS confidence, CASE WHEN event_id // 61 % 3 = 0 THEN 'bisindo' ELSE 'asl' END AS mode,
    CASE WHEN event_id % 40 = 7 THEN 2 ELSE least(2, event_id * 3 // (SELECT max(event_id) + 1 FROM e)) END AS batch FROM e),
    u AS (SELECT user_id, batch, max(ms) AS top FROM b GROUP BY ALL), h AS (SELECT b.*, (SELECT max(top) FROM u WHERE u.user_id = b.user_id AND u.batch < b.batch) - {6 * HOUR} AS passed FROM b),
    l AS (SELECT * FROM h WHERE passed IS NOT NULL AND ms <= passed), g AS (SELECT * FROM h WHERE passed IS NULL OR ms > passed),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms) AS session FROM (SELECT *, CASE WHEN lag(mode) OVER (PARTITION BY user_id ORDER BY ms) = mode THEN 0 ELSE 1 END AS fresh FROM g)),
    w AS (SELECT a.event_id, c.label, count(*) n, sum(c.confidence) s, min(c.ms) f FROM s a JOIN s c ON a.user_id = c.user_id AND a.session = c.session AND c.ms BETWEEN a.ms - {48 * HOUR} AND a.ms GROUP BY ALL),
    v AS (SELECT *, sum(n) OVER (PARTITION BY event_id) tot, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, f) r FROM w)"""


@query(
    f"""WITH {_EV}, {_SESSIONS} SELECT event_id, 'vote' AS kind, CAST(session AS INTEGER) AS session, CASE WHEN tot < 3 OR v.label = 'UNKNOWN' OR n::DOUBLE / tot < 0.5 THEN 'UNKNOWN' ELSE v.label END AS stable_label,
    round_even(CASE WHEN tot < 3 THEN 0.0 ELSE v.s / n END, 9) AS stable_confidence FROM v JOIN s USING (event_id) WHERE r = 1 UNION ALL SELECT event_id, 'late', NULL, NULL, NULL FROM l"""
)
def stream_sessions(spark, d):
    """O-113, O-117, O-118: sessions that begin anew with every mode, over three batches; some early rows come in the last one and are late."""
    rows = _gaps(_events(spark, d)).withColumn("mode", F.when(F.floor(F.col("event_id") / 61) % 3 == 0, "bisindo").otherwise("asl"))
    rows = durable(spread(rows.select("event_id", "user_id", "ts", "ms", "mode", "label", "confidence"), "user_id"))
    n = (rows.agg(F.max("event_id")).first()[0] or 0) + 1
    batch = F.when(F.col("event_id") % 40 == 7, 2).otherwise(F.least(F.lit(2), F.floor(F.col("event_id") * 3 / n)))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.timestamp_millis(F.lit(4 * 10**12)).alias("ts"), F.lit(4 * 10**12).cast("long").alias("ms"), F.lit(None).cast("string").alias("mode"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("confidence"))
    processor = sessions.Sessions(48 * HOUR, 3, 0.5, 24 * HOUR, lateness_ms=6 * HOUR, idle_ms=400 * 24 * HOUR)
    found = sessions.replayed(spark, [rows.where(batch == k) for k in range(3)], f"{shared_dir(spark)}/sessions-{uuid4().hex}", processor, "ts", "1000 days", end)
    return found.where("user_id >= 0").select("event_id", "kind", "session", "stable_label", F.bround("stable_confidence", 9).alias("stable_confidence"))


@query(
    """WITH c AS (SELECT r_name AS mode, chr(65 + CAST(vec_id % 5 AS INTEGER)) AS letter, vec_id, vec_id * 7919 % 1000 AS score FROM embeddings JOIN region ON r_regionkey = vec_id // 5 % 5),
    r AS (SELECT *, row_number() OVER (PARTITION BY mode, letter ORDER BY score DESC, vec_id) n FROM c)
    SELECT mode, letter, CASE WHEN letter IN ('D', 'E') THEN 'dynamic' ELSE 'static' END AS form, vec_id AS candidate FROM r WHERE n = 1"""
)
def letter_coverage(spark, d):
    """O-77, O-92, O-140: the best entry of a catalog for every letter of every mode; a letter without any is an error."""
    letters = ["A", "B", "C", "D", "E"]
    modes = _t(spark, d, "region").select("r_regionkey", F.col("r_name").alias("mode"))
    v = F.col("vec_id")
    rows = _t(spark, d, "embeddings").select(v.alias("candidate"), F.floor(v / 5 % 5).alias("r_regionkey"), F.char(v % 5 + 65).alias("letter"), (v * 7919 % 1000).alias("score"))
    catalog = ranking.ranked(rows.join(F.broadcast(modes), "r_regionkey"), ["mode", "letter"], [F.desc("score"), F.col("candidate")])
    found = ranking.lookup_letters(catalog, [x.lower() for x in letters])
    return ranking.letter_coverage(modes, letters, found, ~F.col("letter").isin("D", "E"))
