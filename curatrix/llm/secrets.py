"""Secret scans over an incremental ledger of text blobs; DataFrame functions only.

Every version of every path's text is addressed by its SHA-256. A ``Ledger`` is a
folder with two growing tables: versions (path, version, blob), and scans (blob,
rule_version, spans) of the blobs that hold anything. A commit adds the versions
it is given, scans only the (blob, rule version) pairs that no commit before it
has seen, once for each blob, and moves nothing that is there already. Findings
are joined back to all paths and versions that hold the blob. The rule version
is a digest of the rules, so changed rules scan everything anew.

Base kinds come first, in the contract's order; ``ADDED`` are the further kinds;
their open beginnings (a url's scheme, a token's header) have a greatest length,
so a long run of one alphabet costs no more than a multiple of its length.

Spans count code points, end exclusive. A kind's matches are leftmost and do not
overlap; those that fail its length test are dropped after matching. Places come
from running sums over the gaps between matches, in log(n) steps over arrays, so
a text with n matches costs n log n.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import fresh, shared_dir, table
from curatrix.llm.graph import meet

#: Kinds in order, their patterns, the group whose length counts, and its least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
ADDED = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("userinfo", r"[a-z][a-z0-9+.-]{0,30}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@", 0, 1),
)
KINDS = BASE + ADDED
#: Digest of the rules.
RULE_VERSION = hashlib.sha256(repr(KINDS).encode()).hexdigest()[:16]

#: What any text with a span has in it; the rest is not moved or matched further.
HINT = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|-----BEGIN |eyJ[A-Za-z0-9_-]{8}|://[^\s/:@]+:[^\s/:@]+@"

#: start and stop in code points, first and last in bytes of UTF-8.
SPAN = "struct<start:int,rank:int,kind:string,stop:int,first:int,last:int>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or greatest values) of an array: each step adds what stands 1, 2, 4 .. places before."""

    def step(acc: Column, k: Column) -> Column:
        ahead = F.least(F.expr("1L") * F.pow(F.lit(2), k), F.size(acc)).cast("int")
        shifted = F.concat(F.array_repeat(F.lit(None).cast("int"), ahead), F.slice(acc, F.lit(1), F.size(acc) - ahead))
        return F.zip_with(acc, shifted, lambda a, b: F.coalesce(combine(a, b), a))

    steps = lambda v: F.sequence(F.lit(0), F.ceil(F.log2(F.size(v) + 1)).cast("int"))
    return bound(values, lambda v: F.aggregate(steps(v), v, step))


def _no_spans() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def _kind_spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """The kind's spans: the gaps between matches and the matches lie end to end."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = bound(F.split(text, pattern, -1), lambda g: F.slice(g, F.lit(1), F.size(g) - 1))
    sizes = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), sized.alias("sized"))
    sizes = F.transform(sizes, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("hit"), F.octet_length(p["gap"]).alias("gap8"), F.octet_length(p["hit"]).alias("hit8"), F.length(p["sized"]).alias("sized")))

    def placed(of: Column) -> Column:
        stop = running(F.transform(of, lambda p: p["gap"] + p["hit"]), lambda a, b: a + b)
        last = running(F.transform(of, lambda p: p["gap8"] + p["hit8"]), lambda a, b: a + b)
        good = F.filter(F.arrays_zip(of.alias("of"), stop.alias("stop"), last.alias("last")), lambda p: p["of"]["sized"] >= least)
        return F.transform(
            good,
            lambda p: F.struct((p["stop"] - p["of"]["hit"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), p["stop"].alias("stop"), (p["last"] - p["of"]["hit8"]).alias("first"), p["last"].alias("last")),
        )

    return F.when(text.rlike(pattern), bound(sizes, placed)).otherwise(_no_spans())


def spans_of(text: Column, kinds=KINDS) -> Column:
    """All spans of a text as an array ordered by start, then by the kinds' order."""
    return F.array_sort(F.concat(*(_kind_spans(text, k, *kind) for k, kind in enumerate(kinds))))


def span_list(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def blob_of(text: Column) -> Column:
    """A text's address; a null text is the empty blob."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan(docs: DataFrame, done: DataFrame | None = None, text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows (blob, rule_version, spans) for the blobs of ``docs`` that ``done`` lacks.

    Texts without a hint have no spans; only the rest is carried to the group of
    its blob. Copies meet in a partial aggregate first. Spans are null for blobs
    without any, which keeps the ledger narrow.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = docs.select(blob_of(text).alias("blob"), F.when(text.rlike(HINT), text).alias("_text"))
    blobs = blobs.groupBy("blob").agg(F.max("_text").alias("_text"))
    if done is not None:
        blobs = blobs.join(done.where(F.col("rule_version") == rule_version).select("blob").distinct(), "blob", "left_anti")
    found = F.when(F.col("_text").isNotNull(), spans_of(F.col("_text")))
    return blobs.select("blob", F.lit(rule_version).alias("rule_version"), found.alias("spans")).withColumn("spans", F.when(F.size("spans") > 0, F.col("spans")))


@dataclass
class Ledger:
    """The tables of a ledger in a folder that all executors share; one is made where none is named.

    Every commit has its own folders, named by a digest of its version (and of the
    rules), and writes them whole: one that was cut short can be made again, with
    the same result, and nothing earlier is ever written again.
    """

    spark: SparkSession
    at: str = ""
    rule_version: str = RULE_VERSION

    def __post_init__(self) -> None:
        self.at = self.at or f"{shared_dir(self.spark)}/ledger-{uuid4().hex}"

    def _folders(self, kind: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{kind}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        return sorted(f.getPath().toString() for f in files.listStatus(path) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))

    def _read(self, kind: str, but: str = "") -> DataFrame | None:
        folders = [f for f in self._folders(kind) if not but or not f.endswith(but)]
        return self.spark.read.parquet(*folders) if folders else None

    def versions(self) -> DataFrame | None:
        """(path, version, blob) of every commit."""
        return self._read("versions")

    def scans(self) -> DataFrame | None:
        """(blob, rule_version, spans): a row for each pair that was scanned."""
        return self._read("scans")

    def commit(self, docs: DataFrame, version: str, path_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds the version of every row of ``docs`` and scans the blobs that no other commit has scanned.

        Rows that repeat a path keep a row each; a null path stays null; other
        columns are not read.
        """
        own = hashlib.sha256(f"{version}\0{self.rule_version}".encode()).hexdigest()[:16]
        scan(docs, self._read("scans", but=own), text_col, self.rule_version).write.mode("overwrite").parquet(f"{self.at}/scans/{own}")
        rows = docs.select(F.col(path_col).alias("path"), F.lit(version).alias("version"), blob_of(F.col(text_col)).alias("blob"))
        rows.write.mode("overwrite").parquet(f"{self.at}/versions/{hashlib.sha256(version.encode()).hexdigest()[:16]}")

    def held(self) -> DataFrame:
        """(blob, spans) of the blobs in which these rules have found anything."""
        return self.scans().where((F.col("rule_version") == self.rule_version) & F.col("spans").isNotNull()).select("blob", "spans")

    def findings(self, version: str | None = None) -> DataFrame:
        """(path, version, blob, spans) for every row of that version, or of all; spans are empty where there are none.

        The rows of one blob are dealt into shares, so a text with very many
        copies is no single task's.
        """
        rows = self.versions()
        rows = rows if version is None else rows.where(F.col("version") == version)
        met = meet(rows, self.held(), "blob", "path", "left")
        return met.select("path", "version", "blob", F.coalesce("spans", _no_spans()).alias("spans"))


def redact(text: Column, spans: Column, mask: str = "[redacted]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mask``.

    What is kept lies between the greatest end so far and the next start, where
    that is not before it; it is cut out by bytes, so no cut walks the text.
    """
    both = F.struct(text.cast("binary").alias("bytes"), F.transform(spans, lambda s: s["first"]).alias("first"), running(F.transform(spans, lambda s: s["last"]), F.greatest).alias("end"))

    def cut(of: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), of["end"])
        ends = F.concat(of["first"], F.array(F.octet_length(of["bytes"])))
        kept = F.filter(F.arrays_zip(begins.alias("from"), ends.alias("to")), lambda k: k["from"] <= k["to"])
        return F.array_join(F.transform(kept, lambda k: F.substr(of["bytes"], k["from"] + 1, k["to"] - k["from"]).cast("string")), mask)

    return bound(both, cut)


def redact_rows(docs: DataFrame, held: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets of ``text_col`` masked; all columns and rows stay.

    ``held`` has (blob, spans), as a ledger gives them; only rows whose text has a
    hint meet it. A null text stays null; columns may have any other names.
    """
    blob, spans = fresh(docs, "_blob"), fresh(docs, "_spans")
    text = F.col(text_col)
    hint = F.coalesce(text.rlike(HINT), F.lit(False))
    marked = docs.where(hint).withColumn(blob, blob_of(text))
    marked = marked.join(held.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), blob, "left")
    masked = marked.withColumn(text_col, F.when(F.col(spans).isNull(), text).otherwise(redact(text, F.col(spans))))
    return docs.where(~hint).unionByName(masked.select(docs.columns))


def _kind_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Gaps, matches and the measured group of one kind, a row for each match and one for the last gap."""
    p = "'" + pattern.replace("'", "''") + "'"
    hits = f"regexp_extract_all(t, {p}, 0)"
    return f"SELECT rid, {rank} AS rank, '{kind}' AS kind, {least} AS least, unnest(range(len({hits}))) AS i, unnest(string_split_regex(t, {p})) AS gap, unnest({hits}) AS hit, unnest(regexp_extract_all(t, {p}, {group})) AS sized FROM d"


#: The same rows in DuckDB's SQL: matches lie end to end with the gaps between them.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_kind_sql(k, *kind) for k, kind in enumerate(KINDS))}),
p AS (SELECT rid, rank, kind, least, sized, length(hit) AS size, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY rid, rank ORDER BY i) AS BIGINT) AS stop FROM m WHERE hit IS NOT NULL),
s AS (SELECT rid, rank, stop - size AS start, kind || ':' || (stop - size) || ':' || stop AS span FROM p WHERE length(sized) >= least),
g AS (
  SELECT rid, {", ".join(f"count(*) FILTER (rank = {k}) AS n_{kind[0]}" for k, kind in enumerate(BASE))},
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY rid
)
SELECT doc_id, {", ".join(f"coalesce(n_{kind[0]}, 0) AS n_{kind[0]}" for kind in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


def op2_secret_ledger(spark, sf_dir: str) -> DataFrame:
    """Contract columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    The ledger gets two commits: English documents come a day before the whole
    table, so the second scans only texts that the first has not seen.
    """
    docs = table(spark, sf_dir, "documents")
    ledger = Ledger(spark)
    ledger.commit(docs.where(F.col("lang") == "en"), "day 1")
    ledger.commit(docs, "day 2")
    found = ledger.findings("day 2")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        *(count(k).alias(f"n_{kind[0]}") for k, kind in enumerate(BASE)),
        F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )
