"""Filtering, splitting, sampling and integrity checks (O-20, O-24, O-26, O-32..O-36, O-55, O-57, O-72..O-75, O-120, O-121, O-124, O-130, O-131)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.text import block_id, digest, range_split
from curatrix.operators.metrics import declared
from curatrix.session import durable

#: Reasons under which a row has all its hands.
COMPLETE = ("ok", "hard_negative")


def valid_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-20: rows with and without a content digest."""
    return df.where(F.col("sha256").isNotNull()), df.where(F.col("sha256").isNull())


def allowed(df: DataFrame, label: str, dimension: DataFrame) -> DataFrame:
    """O-24: rows whose label is in the dimension's column ``label``."""
    return df.join(dimension.select(F.col("label").alias(label)).distinct(), label, "left_semi")


def annotation_reason(has_xml: Column, parsed: Column, objects: Column, label: Column) -> Column:
    """O-26: the first rule that fails, or null; no object at all counts as not exactly one."""
    name = F.trim(F.get(objects, F.lit(0))["name"])
    return (
        F.when(~has_xml, "missing_matching_xml")
        .when(~parsed, "invalid_xml")
        .when(F.coalesce(F.size(objects), F.lit(0)) != 1, "multi_object_annotation")
        .when(~F.coalesce(F.upper(name) == F.upper(label), F.lit(False)), "annotation_label_mismatch")
    )


def route_dimension(spec: DataFrame) -> DataFrame:
    """O-32: (mode, label, expected_hands) from arrays one_hand, two_hand and deferred (label, hands); later arrays win."""
    parts = [
        spec.select("mode", F.explode("one_hand").alias("label"), F.lit(1).alias("expected_hands"), F.lit(0).alias("_at")),
        spec.select("mode", F.explode("two_hand").alias("label"), F.lit(2).alias("expected_hands"), F.lit(1).alias("_at")),
        spec.select("mode", F.explode("deferred").alias("d")).select("mode", F.col("d.label").alias("label"), F.col("d.expected_hands").alias("expected_hands"), F.lit(2).alias("_at")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("mode", "label").agg(F.max_by("expected_hands", "_at").alias("expected_hands"))


def is_complete(reason: Column) -> Column:
    """O-33."""
    return reason.isin(*COMPLETE)


def candidate_rows(df: DataFrame, variant: str, primary: str = "full_frame") -> DataFrame:
    """O-34, O-35: the training rows of a variant: strict, primary_only, reject_partial (partial rows become UNKNOWN), or all."""
    if variant == "strict":
        return df.where(is_complete(F.col("reason")))
    if variant == "primary_only":
        return df.where(is_complete(F.col("reason")) & (F.col("strategy") == primary))
    if variant == "reject_partial":
        return df.withColumn("label", F.when(F.col("reason") == "partial_hands", "UNKNOWN").otherwise(F.col("label")))
    return df


def catalog_candidates(df: DataFrame, letter: Column, hands: Column, dynamic: Column) -> DataFrame:
    """O-36: usable, complete rows of a letter with exactly its hands; dynamic letters must be labelled UNKNOWN."""
    same = (F.col("original_label") == letter) & (F.col("detected_hands") == hands) & F.col("usable") & is_complete(F.col("reason"))
    return df.where(same & F.when(dynamic, F.col("label") == "UNKNOWN").otherwise(F.col("label") == letter) & (F.col("split") != "test") & F.col("path").isNotNull())


def first_seen(df: DataFrame, key: str, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """O-57, O-130: (kept, exclusions): of rows with one key the first in order stays; the rest get a reason.

    The order has to tell the rows of a key apart, as a path does; rows without a
    key are duplicates of nothing. The first of
    each key is a partial aggregate, so no task sorts the rows of a hot key.
    """
    first = df.groupBy(key).agg(F.min(F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)))).alias("_first"))
    told = df.withColumn("_own", F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)))).join(first, key)
    alone = df.where(F.col(key).isNull())
    kept = told.where(F.col("_own").eqNullSafe(F.col("_first"))).select(df.columns).unionByName(alone)
    return kept, told.where(~F.col("_own").eqNullSafe(F.col("_first"))).select(df.columns).withColumn("reason", F.lit("exact_duplicate"))


def route_reasons(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """O-130: rows without a reason, and the dead letters with theirs."""
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def exclude_all(df: DataFrame, reason: str) -> DataFrame:
    """O-131: every row excluded for one asserted reason."""
    return df.withColumn("reason", F.lit(reason))


def checked_ratios(ratios: Sequence[tuple[str, float]]) -> list[tuple[str, float]]:
    """O-124: cumulative bounds; the ratios have to add up to 1 within 1e-9."""
    bounds, total = [], 0.0
    for name, ratio in ratios:
        total += ratio
        bounds.append((name, total))
    if abs(total - 1.0) > 1e-9:
        raise ValueError(f"split ratios must total 1, got {total}")
    return bounds


def split_bounds(rows: DataFrame, key: str, name: str, ratio: str, order: str) -> DataFrame:
    """O-124 of many plans of splits: (key, name, bound), bounds cumulative by ``order``; a plan whose ratios do not add up to 1 within 1e-9 has null bounds and ``refused``."""
    whole = Window.partitionBy(key)
    total = F.sum(ratio).over(whole.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    bound = F.sum(ratio).over(whole.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    refused = F.coalesce(F.abs(total - 1.0) > 1e-9, F.lit(True))
    return rows.withColumn("refused", refused).withColumn("bound", F.when(~F.col("refused"), bound)).select(key, name, "bound", "refused")


def group_split(df: DataFrame, group: str, ratios: Sequence[tuple[str, float]], seed: str, stratum: str | None = None, parts: int = 256) -> DataFrame:
    """O-72, O-73: (group, n, split), whole groups dealt by weight in the order of a digest of seed and group.

    A group goes to the first split whose cumulative ratio is above its midpoint
    in the running total. The total runs over groups, not rows, and in two
    levels: within the ``parts`` ranges of the digest's first byte, and over the
    ranges, so no task sorts all groups. With a stratum, each has its own order
    (its name is in the seed) and totals.
    """
    bounds = checked_ratios(ratios)
    keys = [stratum] if stratum else []
    name = F.col(group).cast("string")
    key = digest(seed, F.col(stratum), name) if stratum else digest(seed, name)
    sizes = df.groupBy(*keys, group).agg(F.count("*").alias("n")).withColumn("_h", key)
    sizes = sizes.withColumn("_part", F.floor(F.conv(F.substring("_h", 1, 2), 16, 10).cast("int") * parts / 256).cast("int"))
    totals = sizes.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"))
    over = Window.partitionBy(*keys, *([] if keys else [F.lit(0)]))
    ahead = over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_n").over(over).alias("_total"))
    within = Window.partitionBy(*keys, "_part").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("_before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(totals) if not keys else totals, [*keys, "_part"])
    middle = (F.col("_ahead") + F.col("_before") + F.col("n") / 2) / F.col("_total")
    split = F.lit(bounds[-1][0])
    for name_, bound in reversed(bounds):
        split = F.when(middle < bound, name_).otherwise(split)
    return placed.select(*keys, group, "n", split.alias("split"))


def assign_split(df: DataFrame, group: str, ratios: Sequence[tuple[str, float]], seed: str, stratum: str | None = None) -> DataFrame:
    """Rows with their group's split."""
    keys = [stratum, group] if stratum else [group]
    return df.join(group_split(df, group, ratios, seed, stratum).drop("n"), keys)


def hash_downsample(df: DataFrame, label: str, split: str, group: str, targets: dict[str, int], seed: str) -> DataFrame:
    """O-74: (label, split, group) of the first groups by digest, as many as the split's target."""
    wanted = F.create_map(*(F.lit(x) for kv in targets.items() for x in kv))
    groups = df.select(label, split, group).distinct()
    order = Window.partitionBy(label, split).orderBy(digest(seed, F.col(label), F.col(split), F.col(group)))
    return groups.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= wanted[F.col(split)]).drop("_rank")


def downsample_shortfall(kept: DataFrame, label: str, split: str, targets: dict[str, int]) -> DataFrame:
    """O-74: (label, split, n) of cells with fewer groups than the target, which callers treat as an error."""
    wanted = F.create_map(*(F.lit(x) for kv in targets.items() for x in kv))
    return kept.groupBy(label, split).agg(F.count("*").alias("n")).where(F.col("n") < wanted[F.col(split)])


def cell_limited(df: DataFrame, cell: Sequence[str | Column], order: Sequence[str | Column], limit: Column) -> DataFrame:
    """O-75: the first rows of each cell, as many as its limit."""
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def violations(df: DataFrame, labels: DataFrame) -> DataFrame:
    """O-120: (rule, subject) for every broken rule of a manifest.

    Rules: rows there at all, the label set equal to ``labels``, sample_id unique,
    no group and no content digest in two splits, every split with every label.
    The manifest is read once: grouping sets count by sample, by group and split, by digest and split, and by label and
    split; only what breaks a rule, and the label cells, is kept of that.
    """
    keys = ["sample_id", "group_id", "content_sha256"]
    sets = df.groupingSets([["sample_id"], ["group_id", "split"], ["content_sha256", "split"], ["label", "split"]], *keys, "label", "split").agg(F.grouping_id().alias("_set"), F.count("*").alias("_n"))
    kind = F.when(F.col("_set") == 0b01111, "duplicate_sample_id").when(F.col("_set") == 0b10110, "group_leakage").when(F.col("_set") == 0b11010, "hash_leakage").otherwise("cell")
    subject = F.coalesce(*(F.when(F.col("_set") == g, F.col(c).cast("string")) for g, c in ((0b01111, "sample_id"), (0b10110, "group_id"), (0b11010, "content_sha256"), (0b11100, "label"))))
    marked = sets.select(kind.alias("rule"), subject.alias("subject"), F.when(kind == "cell", F.col("split")).alias("cell_split"), (kind == "cell").alias("cell"), "split", "_n")
    found = marked.groupBy("rule", "subject", "cell_split", "cell").agg(F.count("split").alias("splits"), F.sum("_n").alias("n"))
    broken = F.when(F.col("rule") == "duplicate_sample_id", F.col("n") > 1).otherwise(F.col("splits") > 1)
    found = durable(found.where(F.col("cell") | broken).select("rule", "subject", "cell_split", "cell"))
    cells = found.where("cell").select(F.col("cell_split").alias("split"), F.col("subject").alias("label"))
    told = lambda frame, rule, subject: frame.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))
    want, have = labels.select(F.col("label").cast("string")).distinct(), cells.select("label").distinct()
    every = cells.select("split").distinct().select("split", F.explode(declared(labels)).alias("label"))
    out = found.where("NOT cell").select("rule", "subject")
    for frame in (
        told(cells.agg(F.count("*").alias("n")).where("n = 0"), "empty", F.lit("manifest")),
        told(want.exceptAll(have), "label_missing", F.col("label")),
        told(have.exceptAll(want), "label_unexpected", F.col("label")),
        told(every.join(cells, ["split", "label"], "left_anti"), "split_lacks_label", F.concat_ws(":", "split", "label")),
    ):
        out = out.unionByName(frame)
    return out


def require_valid(df: DataFrame, labels: DataFrame) -> None:
    """O-120: raises on the first violation by rule and subject."""
    first = violations(df, labels).orderBy("rule", "subject").first()
    if first is not None:
        raise ValueError(f"{first['rule']}: {first['subject']}")


def sequence_violations(df: DataFrame, number: Column, prefix: str) -> DataFrame:
    """O-121: rows whose split or group is not what their number gives."""
    return df.where(~F.col("split").eqNullSafe(range_split(number)) | ~F.col("group_id").eqNullSafe(block_id(prefix, number)))
