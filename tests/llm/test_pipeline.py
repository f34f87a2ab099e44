"""The pipeline stage by stage: what goes, what stays, and the order of the mixture in the last rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from curatrix.llm import mixing, quality_rules, secrets, simhash
from curatrix.llm.common import table

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run_stages(spark, docs, tmp_path):
    """Every stage's input and output, written and read as the driver does."""
    steps = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        steps.append((docs, spark.read.parquet(str(tmp_path / str(k)))))
        docs = steps[-1][1]
    return steps


def check(spark, steps):
    (raw, good), (_, alone), (_, clean), (_, mixed), (_, last) = steps
    for before, after in steps[:4]:
        assert before.columns == after.columns
    forest = quality_rules.fit(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
    assert good.count() == quality_rules.judge(raw, forest).where("kept").count()
    found = simhash.grouped(good)
    assert alone.count() == found.select("label").distinct().count()
    for after in (clean, mixed, last):
        assert sorted((r["doc_id"] for r in after.select("doc_id").collect()), key=repr) == sorted((r["doc_id"] for r in alone.select("doc_id").collect()), key=repr)
    assert secrets.scan(clean).where("spans is not null").count() == 0
    order = mixing.mix(clean, mixing.WEIGHTS, other=1.0, text_col="text").orderBy("slot", "place").select("doc_id").collect()
    assert [r["doc_id"] for r in last.orderBy("mix_order").select("doc_id").collect()] == [r["doc_id"] for r in order]
    assert last.where("not round_trip or parity_errors > 0").count() == 0


def test_stages(spark, tmp_path):
    steps = run_stages(spark, table(spark, FOLDER, "documents"), tmp_path)
    check(spark, steps)
    assert corpus_pipeline.run(spark, FOLDER).count() == steps[-1][1].count()


def test_stages_on_odd_rows(spark, tmp_path):
    good = [r["text"] for r in table(spark, FOLDER, "documents").where("n_chars between 900 and 2000").orderBy("doc_id").limit(12).collect()]
    rows = [(k if k % 3 else None, t, "en", "src0" if k % 2 else None, len(t)) for k, t in enumerate(good)]
    rows += [(4, good[5], "en", "src1", 1), (4, good[6] + " token=abcdef12345", None, "src1", 1), (900, None, None, None, None), (901, "", "en", "src0", 0), (902, good[7] + " " + good[8] * 60, "en", "src2", 9)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_share", F.lit(1)).withColumn("label", F.lit("x")).withColumn("mix", F.lit(2))
    check(spark, run_stages(spark, df, tmp_path))


def test_stages_on_an_empty_table(spark, tmp_path):
    assert [after.count() for _, after in run_stages(spark, table(spark, FOLDER, "documents").limit(0), tmp_path)] == [0] * 5


@pytest.mark.parametrize("parts", [1, 5])
def test_file_order(spark, tmp_path, parts):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id")).repartition(4).orderBy("id")
    df.repartitionByRange(parts, "id").sortWithinPartitions("id").write.option("maxRecordsPerFile", 150).parquet(str(tmp_path / "x"))
    back = mixing.file_order(spark.read.parquet(str(tmp_path / "x")), "at")
    assert [r["id"] for r in back.orderBy("at").collect()] == list(range(1000))
    assert mixing.file_order(spark.range(5), "at").count() == 5
