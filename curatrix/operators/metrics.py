"""Coverage, recovery, classification metrics and calibration (O-62..O-70, O-109, O-129, O-139)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole, rounded half to even; null over nothing."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def coverage(df: DataFrame, usable: Column, fields: Sequence[str]) -> DataFrame:
    """O-62: total, usable and coverage over all rows and by each field, in one pass; (field, value) is ('all', null) for all."""
    sets = df.withColumn("_usable", usable.cast("int")).groupingSets([[], *([f] for f in fields)], *fields)
    named = F.coalesce(*(F.when(F.grouping(f) == 0, f) for f in fields), F.lit("all"))
    value = F.coalesce(*(F.when(F.grouping(f) == 0, F.col(f).cast("string")) for f in fields))
    return sets.agg(named.alias("field"), value.alias("value"), F.count("*").alias("total"), F.sum("_usable").alias("usable"), share(F.sum("_usable"), F.count("*")).alias("coverage")).select("field", "value", "total", "usable", "coverage")


def reason_counts(df: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """O-63: one row with a count for each reason; those that never occur are 0."""
    return df.agg(*(F.count_if(F.col("reason") == r).alias(r) for r in reasons))


def recovery(df: DataFrame, baseline: Column, strategy: Column, expected: Column) -> DataFrame:
    """O-64: one row. Rows with a null strategy are left out; no baseline failures (passes) give rate 0, no zero-hand rows a null rate."""
    rows = df.select(baseline.alias("b"), strategy.alias("s"), expected.alias("e")).where("s is not null")
    counts = rows.agg(
        F.count("*").alias("evaluated"),
        F.count_if(F.expr("s >= e")).alias("requirement_met"),
        F.count_if(F.expr("b < e")).alias("baseline_failures"),
        F.count_if(F.expr("b < e and s >= e")).alias("recovered"),
        F.count_if(F.expr("b >= e")).alias("baseline_passes"),
        F.count_if(F.expr("b >= e and s < e")).alias("regressed"),
        F.count_if(F.expr("e = 0")).alias("zero_hand_samples"),
        F.count_if(F.expr("e = 0 and s > 0")).alias("zero_hand_false_detections"),
    )
    rate = lambda a, b: share(F.col(a), F.col(b))
    return counts.select("*", F.coalesce(rate("recovered", "baseline_failures"), F.lit(0.0)).alias("recovery_rate"), F.coalesce(rate("regressed", "baseline_passes"), F.lit(0.0)).alias("regression_rate"), rate("zero_hand_false_detections", "zero_hand_samples").alias("zero_hand_false_detection_rate"))


def recovery_by(df: DataFrame, baseline: Column, strategy: Column, expected: Column, fields: Sequence[str]) -> DataFrame:
    """O-65: (field, value, baseline_failures, recovered, recovery_rate) over rows that the baseline failed, in one pass."""
    rows = df.withColumn("_s", strategy).where((baseline < expected) & F.col("_s").isNotNull()).withColumn("_ok", (F.col("_s") >= expected).cast("int"))
    found = coverage(rows, F.col("_ok"), fields).where("field <> 'all'")
    return found.select("field", "value", F.col("total").alias("baseline_failures"), F.col("usable").alias("recovered"), F.col("coverage").alias("recovery_rate"))


def strategy_table(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """O-129: long (sample_id, strategy, hands) to one row for each sample with a column for each strategy; unavailable is null."""
    return long.groupBy("sample_id").pivot("strategy", list(names)).agg(F.max("hands"))


def report_rows(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """O-139: rows as one JSON text each."""
    return df.select(F.to_json(F.struct(*fields)).alias("row"))


def cell_weights(df: DataFrame, source: str, label: str, partial: Column) -> DataFrame:
    """O-66: weight 1 / rows of the (source, label) cell, halved for partial rows, over the mean weight.

    The mean comes from cell counts, so no window runs over all rows.
    """
    rows = df.withColumn("_half", F.when(partial, 0.5).otherwise(1.0))
    cells = rows.groupBy(source, label).agg(F.count("*").alias("_n"), F.sum("_half").alias("_sum"))
    mean = cells.agg((F.sum(F.col("_sum") / F.col("_n")) / F.sum("_n")).alias("_mean"))
    cells = cells.join(F.broadcast(mean)).select(source, label, "_n", "_mean")  # one row
    return rows.join(cells, [source, label]).withColumn("weight", F.col("_half") / F.col("_n") / F.col("_mean")).drop("_half", "_n", "_mean")


#: Most declared classes; they are a dimension, and every task is sent them.
MOST_CLASSES = 10_000


def declared(classes: DataFrame) -> Column:
    """The declared classes (column label) as an array; too many are an error."""
    names = sorted(r["label"] for r in classes.select("label").distinct().limit(MOST_CLASSES + 1).collect())
    if len(names) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    return F.array(*map(F.lit, names)).cast("array<string>")


def class_metrics(counts: DataFrame, classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """O-67: (by.., class, tp, fp, fn, precision, recall, f1, support) from counts (by.., label, pred, n); 0 over nothing.

    Every declared class has a row for every slice.
    """
    by = list(by)
    each = counts.select(*by, "n", F.explode(F.array(F.struct(F.col("label").alias("class"), F.lit(1).alias("is_label")), F.struct(F.col("pred").alias("class"), F.lit(0).alias("is_label")))).alias("e"), (F.col("label") == F.col("pred")).alias("hit"))
    sums = each.groupBy(*by, "e.class").agg(
        F.sum(F.when(F.expr("hit and e.is_label = 1"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.expr("not hit and e.is_label = 0"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.expr("not hit and e.is_label = 1"), F.col("n")).otherwise(0)).alias("fn"),
    )
    frame = counts.select(*by).distinct().select(*by, F.explode(declared(classes)).alias("class")) if by else classes.select(F.col("label").alias("class"))
    full = frame.join(sums, [*by, "class"], "left").fillna(0, ["tp", "fp", "fn"])
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return full.select(*by, "class", "tp", "fp", "fn", zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


def metric_block(df: DataFrame, classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """O-67: by slice: sample_count, accuracy, macro_f1 over all declared classes, unknown_false_acceptance (null without UNKNOWN rows), unknown_prediction_rate.

    ``df`` has columns label and pred; a slice without rows has none here.
    """
    by = list(by)
    counts = df.groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))
    unknown, said = F.col("label") == "UNKNOWN", F.col("pred") == "UNKNOWN"
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    totals = counts.groupBy(*by).agg(
        F.sum("n").alias("sample_count"),
        share(n(F.col("label") == F.col("pred")), F.sum("n")).alias("accuracy"),
        share(n(unknown & ~said), n(unknown)).alias("unknown_false_acceptance"),
        share(n(said), F.sum("n")).alias("unknown_prediction_rate"),
    )
    macro = class_metrics(counts, classes, by).groupBy(*by).agg(F.bround(F.avg("f1"), 6).alias("macro_f1"))
    joined = totals.join(macro, by) if by else totals.join(F.broadcast(macro))
    return joined.where("sample_count is not null").select(*by, "sample_count", "accuracy", "macro_f1", "unknown_false_acceptance", "unknown_prediction_rate")


def sliced(df: DataFrame, slices: dict[str, Column], field: str | None = None) -> DataFrame:
    """O-68: each row once for every slice that it is in; with a field, also for ``field:value``."""
    tags = [F.when(inside, name) for name, inside in slices.items()]
    if field is not None:
        tags.append(F.concat(F.lit(field + ":"), F.col(field).cast("string")))
    return df.withColumn("slice", F.explode(F.array_compact(F.array(*tags))))


def calibrate(df: DataFrame, classes: DataFrame, most: float = 0.05, steps: int = 100) -> DataFrame:
    """O-109: (threshold, macro_f1, unknown_false_acceptance): the grid's best macro F1 with false acceptance up to ``most``.

    ``df`` has label, pred (arg-max class), conf and routed (the hands fit). The
    lowest threshold wins a tie; if none is allowed, or there are no UNKNOWN
    rows, the result is threshold 1 with zeros. Rows are counted by (label, pred,
    step of conf) first, so the grid meets counts instead of rows.
    """
    grid = F.sequence(F.lit(0), F.lit(steps - 1))
    allowed = F.size(F.filter(grid, lambda k: F.col("conf") >= k / F.lit(float(steps))))  # thresholds 0 .. allowed - 1 let it pass
    passed = F.when(F.col("routed"), allowed).otherwise(0)
    cells = df.select("label", "pred", passed.alias("passed")).groupBy("label", "pred", "passed").agg(F.count("*").alias("n"))
    spread = cells.select("label", F.col("pred").alias("said"), "n", F.explode(grid).alias("k"), "passed")
    spread = spread.select("k", "label", F.when(F.col("k") < F.col("passed"), F.col("said")).otherwise("UNKNOWN").alias("pred"), "n").groupBy("k", "label", "pred").agg(F.sum("n").alias("n"))
    macro = class_metrics(spread, classes, ["k"]).groupBy("k").agg(F.avg("f1").alias("macro_f1"))
    unknown = F.col("label") == "UNKNOWN"
    false = spread.groupBy("k").agg(F.try_divide(F.sum(F.when(unknown & (F.col("pred") != "UNKNOWN"), F.col("n")).otherwise(0)).cast("double"), F.sum(F.when(unknown, F.col("n")).otherwise(0)).cast("double")).alias("fa"))
    best = macro.join(false, "k").where(F.col("fa") <= most).agg(F.max(F.struct("macro_f1", (-F.col("k")).alias("k"), "fa")).alias("b"))
    return best.select(F.coalesce(-F.col("b.k") / float(steps), F.lit(1.0)).alias("threshold"), F.coalesce("b.macro_f1", F.lit(0.0)).alias("macro_f1"), F.coalesce("b.fa", F.lit(0.0)).alias("unknown_false_acceptance"))


def parity_error(df: DataFrame, a: str, b: str) -> DataFrame:
    """O-70: the largest absolute difference between two columns of arrays."""
    gap = F.array_max(F.transform(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda p: F.abs(p["a"] - p["b"])))
    return df.agg(F.max(gap).alias("max_abs_error"))
