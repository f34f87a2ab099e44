"""The chunk store's commit log: all chunks judged in one pass; half-written and rewritten chunks."""

from pyspark.sql import functions as F

from curatrix.sources import files


def chunks(spark, n, key="k"):
    rows = spark.range(n * 5).select(F.col("id").cast("string").alias("sample_id"), F.array_repeat(F.col("id").cast("float"), 132).alias("features"), F.lit(True).alias("usable"), F.lit("ok").alias("reason"), F.lit(1).alias("detected_hands"), F.array(F.lit(0.0).cast("float")).alias("handedness"), F.array(F.lit(0.5).cast("float")).alias("handedness_scores"), F.lit("full_frame").alias("strategy"), (F.col("id") % n).cast("int").alias("chunk_index"), F.lit(key).alias("generation_key"))
    return rows.repartition("chunk_index")


def test_all_chunks_in_one_pass(spark, tmp_path):
    at = str(tmp_path / "store")
    expected = spark.createDataFrame([(k, "k", 5) for k in range(45)], "chunk_index int, key string, count long")
    judged = lambda: {r["chunk_index"] for r in files.valid_chunks(spark, at, expected).where("valid").collect()}
    assert judged() == set()
    files.write_store(chunks(spark, 40), at)
    assert judged() == set(range(40))
    cut = next((tmp_path / "store" / "chunk_index=7").glob("part-*"))
    cut.write_bytes(cut.read_bytes()[: cut.stat().st_size // 2])
    next((tmp_path / "store" / "chunk_index=9").glob("part-*")).unlink()
    files.write_store(chunks(spark, 40, "other").where("chunk_index = 3"), at)
    # another file of the same size and key, but other numbers
    chunks(spark, 40).where("chunk_index = 11").withColumn("features", F.array_repeat(F.lit(9.0).cast("float"), 132)).drop("chunk_index").write.mode("overwrite").parquet(f"{at}/chunk_index=11")
    assert judged() == set(range(40)) - {3, 7, 9, 11}
    files.write_store(chunks(spark, 40).where("chunk_index IN (3, 7, 11)"), at)
    assert judged() == set(range(40)) - {9}
