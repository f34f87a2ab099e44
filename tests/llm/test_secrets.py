"""Secret scans against plain regular expressions and DuckDB; the ledger's commits; masking; growth with the number of spans."""

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from curatrix.llm import secrets
from curatrix.llm.common import table

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox " * 5000
EDGE = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b c", "en", "a", 5), (3, "a b c", "en", "a", 5), (None, "token = abcdef1 Aé \x0b x", None, None, 1), (5, LONG, "en", "a", len(LONG)), (6, "A B\tC", "en", "b", 5)]
EXTRA = [(70, "\U0001f600 Token=token:abcdefgh password: 'x1234567' AKIA" + "A" * 16 + " " + "ab" * 12 + "api_key=zzzzzz9", "", "", 0), (71, "secret=abc token=q.w-e/r+t=", "", "", 0), (72, "secret=abc token=q.w-e/r+t=", "", "", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, FOLDER, "documents").cache()


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).withColumn("blob", F.lit("x")).withColumn("spans", F.lit(0)).withColumn("path", F.lit("p")).withColumn("version", F.lit("v")).withColumn("_text", F.lit("t")).withColumn("_share", F.lit(7))


def all_spans(text, kinds=secrets.KINDS):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(found)


def span_list(found):
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)


def masked(text):
    out, at = "", 0
    for a, _, _, b in all_spans(text):
        if a >= at:
            out += text[at:a] + "[redacted]"
        at = max(at, b)
    return out + text[at:]


def rows_of(found):
    return sorted(((r["path"], r["s"]) for r in found.select("path", secrets.span_list(F.col("spans")).alias("s")).collect()), key=repr)


def test_findings_and_masks(spark, docs, edge):
    for df in (docs, edge, spark.createDataFrame(EXTRA, SCHEMA)):
        ledger = secrets.Ledger(spark)
        ledger.commit(df, "1")
        assert rows_of(ledger.findings()) == sorted(((r["doc_id"], span_list(all_spans(r["text"] or ""))) for r in df.collect()), key=repr)
        out = secrets.redact_rows(df, ledger.held())
        assert out.columns == df.columns
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(((r["doc_id"], None if r["text"] is None else masked(r["text"])) for r in df.collect()), key=repr)


def test_the_ledger_scans_unseen_pairs_only(spark):
    one, both = spark.createDataFrame(EXTRA[:1], SCHEMA), spark.createDataFrame(EXTRA, SCHEMA)
    ledger = secrets.Ledger(spark)
    ledger.commit(one, "1")
    assert ledger.scans().count() == 1
    ledger.commit(both, "2")
    assert ledger.scans().count() == 2 and ledger.versions().count() == 4
    assert secrets.scan(both, ledger.scans()).count() == 0
    ledger.commit(both, "2")  # made again, as after a lost driver
    assert ledger.scans().count() == 2 and ledger.versions().count() == 4
    later = secrets.Ledger(spark, ledger.at, rule_version="next")
    later.commit(both, "3")
    assert later.scans().groupBy("rule_version").count().orderBy("count").collect()[0]["count"] == 2 and later.scans().count() == 4
    changed = both.where("doc_id = 72").withColumn("text", F.lit("AKIA" + "B" * 16))
    ledger.commit(changed, "4")
    history = ledger.findings().where("path = 72").select("version", secrets.span_list(F.col("spans")).alias("s")).collect()
    assert {(r["version"], r["s"]) for r in history} == {(v, span_list(all_spans(EXTRA[2][1]))) for v in "23"} | {("4", "access:0:20")}
    assert {r["path"] for r in ledger.findings("2").collect()} == {70, 71, 72}
    assert ledger.scans().count() == 5


def test_rule_version_is_the_rules_digest():
    assert secrets.RULE_VERSION == hashlib.sha256(repr(secrets.KINDS).encode()).hexdigest()[:16]


def test_empty_table(spark, docs):
    ledger = secrets.Ledger(spark)
    ledger.commit(docs.limit(0), "1")
    assert ledger.findings().count() == 0 and secrets.redact_rows(docs.limit(0), ledger.held()).count() == 0
    ledger.commit(docs, "2")
    assert ledger.findings("2").count() == docs.count()


def test_op2_sql_twin(spark, tmp_path):
    """DuckDB finds the same rows, on the tables and on texts with code points past 16 bits, overlaps and edges."""
    from oracle import compare, connect

    assert compare(secrets.op2_secret_ledger(spark, FOLDER), connect(FOLDER), secrets.ORACLE_SQL) == ""
    texts = ["token=abcdef", "\U0001f600 é Token='abcdefgh' AKIA" + "A" * 17, "xsecret: secret:secret=aaaaaa", "a+b://u:p@h api-key=zzzzzz api_key = zzzzzz\x0bhttps://\x0bu:p@x", "ab" * 12, "eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9, "-----BEGIN RSA PRIVATE KEY-----", None, "", "ab" * 12, "x" * 40 + "://u:p@h"]
    spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)] + EDGE, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "documents.parquet").glob("part-*")).rename(tmp_path / "one" / "documents.parquet")
    assert compare(secrets.op2_secret_ledger(spark, str(tmp_path / "one")), connect(str(tmp_path / "one")), secrets.ORACLE_SQL) == ""
    got = {r["doc_id"]: r["base_sha256"] for r in secrets.op2_secret_ledger(spark, FOLDER).collect()}
    for r in table(spark, FOLDER, "documents").collect():
        assert got[r["doc_id"]] == hashlib.sha256(span_list(all_spans(r["text"], secrets.BASE)).encode()).hexdigest()


def test_long_runs_are_scanned_in_linear_time(spark):
    """Runs of one alphabet of 200,000 characters; a scan quadratic in them would take many minutes."""
    runs = ["a" * 200_000, "acgt." * 40_000, "eyJ" * 60_000]
    df = spark.createDataFrame([(k, f"{t} x://u:p@ token=abcdef", None, None, 0) for k, t in enumerate(runs)], SCHEMA)
    began = time.monotonic()
    found = secrets.scan(df).select(secrets.span_list(F.col("spans"))).collect()
    assert all("userinfo:" in r[0] and "assign:" in r[0] for r in found) and time.monotonic() - began < 60


def test_many_spans_cost_in_proportion(spark):
    """200,000 spans in one text, found and masked; 8,000 took six seconds when arrays were grown span by span."""
    n = 100_000
    text = ("é" + "a1" * 13 + " x token=abcdefg ") * n
    df = spark.createDataFrame([(1, text, "en", "a", len(text))], SCHEMA)
    began = time.monotonic()
    scans = secrets.scan(df).cache()
    row = scans.select(F.size("spans").alias("n"), F.col("spans")[2 * n - 1].alias("last")).first()
    assert row["n"] == 2 * n and row["last"]["stop"] == len(text) - 1 and row["last"]["last"] == len(text.encode()) - 1
    assert secrets.redact_rows(df, scans.select("blob", "spans")).first()["text"] == "é[redacted] x [redacted] " * n
    assert time.monotonic() - began < 60
