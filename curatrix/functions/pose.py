"""Pose features as array expressions (O-78, O-82, O-85..O-91, O-95..O-97, O-134, O-142).

A hand is a struct (points: array of 21 structs x, y, z; handedness; score). A
feature vector has 132 doubles: 63 for each of two slots (x, y, z of each point,
from the wrist, in units of the palm), two presence flags, and four numbers
between the hands. All arithmetic is in doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS, AXES, SLOT = 21, ("x", "y", "z"), 63
SIZE = 132
#: Palms shorter than this cannot be normalised.
LEAST_SCALE = 1e-6


def feature_names() -> list[str]:
    """O-89: names in vector order."""
    slots = [f"hand_{s}_landmark_{p:02d}_{a}" for s in range(2) for p in range(POINTS) for a in AXES]
    return [*slots, "hand_0_present", "hand_1_present", "interhand_dx", "interhand_dy", "interhand_distance", "interhand_log_scale_ratio"]


def handedness_value(name: Column) -> Column:
    """O-85: right 1, left -1, anything else 0."""
    word = F.lower(F.trim(name))
    return F.when(word == "right", 1.0).when(word == "left", -1.0).otherwise(0.0)


def hands_of(points: Column, handedness: Column, scores: Column) -> Column:
    """Hands from three arrays, which have to be of one length."""
    n = F.coalesce(F.size(points), F.lit(-1))
    same = (n == F.coalesce(F.size(handedness), F.lit(-1))) & (n == F.coalesce(F.size(scores), F.lit(-1)))
    zipped = F.transform(F.arrays_zip(points.alias("p"), handedness.alias("h"), scores.alias("s")), lambda x: F.struct(x["p"].alias("points"), x["h"].alias("handedness"), x["s"].alias("score")))
    return F.when(same, zipped).otherwise(F.raise_error(F.lit("points, handedness and scores differ in length")).cast("array<struct<points:array<struct<x:double,y:double,z:double>>,handedness:string,score:double>>"))


def points_of(values: Column, start: int = 0) -> Column:
    """21 points from a flat array of x, y, z from position ``start`` on."""
    return F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.struct(*(F.get(values, i * 3 + start + k).cast("double").alias(a) for k, a in enumerate(AXES))))


def palm(points: Column) -> Column:
    """O-86: distance in the picture from the wrist (0) to the middle knuckle (9)."""
    return F.hypot(points[9]["x"] - points[0]["x"], points[9]["y"] - points[0]["y"])


def _finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) < float("inf"))


def hand_problem(points: Column) -> Column:
    """O-134: why the points cannot be normalised, or null."""
    good = F.forall(points, lambda p: _finite(p["x"]) & _finite(p["y"]) & _finite(p["z"]))
    return F.when(F.coalesce(F.size(points), F.lit(-1)) != POINTS, "shape").when(~F.coalesce(good, F.lit(False)), "non_finite").when(palm(points) < LEAST_SCALE, "scale")


def normalize(points: Column) -> Column:
    """O-86: flat array of the points from the wrist in palm units; null where there is a problem."""
    base = F.array(F.struct(points[0].alias("w"), palm(points).alias("s")))  # evaluated once, then bound as a lambda's variable
    flat = F.flatten(F.flatten(F.transform(base, lambda k: F.transform(points, lambda p: F.array(*((p[a] - k["w"][a]) / k["s"] for a in AXES))))))
    return F.when(hand_problem(points).isNull(), flat)


def interhand(first: Column, second: Column) -> Column:
    """O-88: wrist shift in mean palms, its length, and the log ratio of the palms."""
    mean = (palm(first) + palm(second)) / 2
    dx, dy = (second[0]["x"] - first[0]["x"]) / mean, (second[0]["y"] - first[0]["y"]) / mean
    return F.array(dx, dy, F.hypot(dx, dy), F.log(palm(second) / palm(first)))


def top_hands(hands: Column, k: int = 2) -> Column:
    """O-82: the k hands of the highest scores (the earlier on a tie), ordered by wrist x."""
    ranked = F.transform(hands, lambda h, i: F.struct((-h["score"]).alias("s"), i.alias("i"), h["points"][0]["x"].alias("x"), h.alias("h")))
    best = F.slice(F.array_sort(ranked), 1, k)
    return F.transform(F.array_sort(F.transform(best, lambda r: F.struct(r["x"].alias("x"), r["i"].alias("i"), r["h"].alias("h")))), lambda r: r["h"])


def largest_hand(hands: Column) -> Column:
    """The hand with the longest palm, the first of equals, as an array of one."""
    ranked = F.transform(hands, lambda h, i: F.struct((-palm(h["points"])).alias("s"), i.alias("i"), h.alias("h")))
    return F.transform(F.slice(F.array_sort(ranked), 1, 1), lambda r: r["h"])


def box_area(points: Column) -> Column:
    span = lambda a: F.array_max(F.transform(points, lambda p: p[a])) - F.array_min(F.transform(points, lambda p: p[a]))
    return span("x") * span("y")


def largest_by_area(hands: Column, k: int) -> Column:
    """O-78: the k hands of the largest boxes, the earlier on a tie; fewer than k hands give none."""
    ranked = F.transform(hands, lambda h, i: F.struct((-box_area(h["points"])).alias("s"), i.alias("i"), h.alias("h")))
    best = F.transform(F.slice(F.array_sort(ranked), 1, max(k, 1)), lambda r: r["h"])
    return F.when(F.size(hands) >= k, best).otherwise(F.slice(hands, 1, 0))


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def vector(first: Column, second: Column, expected: Column) -> Column:
    """The 132 numbers of one or two hands; ``second`` may be null. Give it columns rather than long expressions."""
    two = second.isNotNull()
    between = F.when((expected == 2) & two, interhand(first, second)).otherwise(_zeros(4))
    return F.concat(normalize(first), F.when(two, normalize(second)).otherwise(_zeros(SLOT)), F.array(F.lit(1.0), two.cast("double")), between)


def add_features(df: DataFrame, hands: str = "hands", expected: str = "expected", out: str = "feature") -> DataFrame:
    """O-87, O-142: adds a struct (features, usable, reason, detected_hands, handedness, scores).

    Built in steps, each a column of its own, so that no step is evaluated again
    for every use of it. An expectation that is not 0, 1 or 2 is an error.
    """
    said = F.col(expected)
    wrong = F.raise_error(F.concat(F.lit("expected hands have to be 0, 1 or 2, not "), F.coalesce(said.cast("string"), F.lit("null")))).cast("int")
    df = df.withColumn("_want", F.when(said.isin(0, 1, 2), said).otherwise(wrong))
    n, want = F.size(hands), F.col("_want")
    steps = df.withColumn("_ordered", F.when(want == 2, top_hands(F.col(hands))).otherwise(largest_hand(F.col(hands))))
    first, second = F.get("_ordered", F.lit(0))["points"], F.get("_ordered", F.lit(1))["points"]
    steps = steps.withColumn("_first", first).withColumn("_second", second)
    problem = F.coalesce(hand_problem(F.col("_first")), F.when(F.col("_second").isNotNull(), hand_problem(F.col("_second"))))
    steps = steps.withColumn("_problem", F.when(F.col("_first").isNotNull(), problem))
    steps = steps.withColumn("_features", F.when(F.col("_problem").isNull() & F.col("_first").isNotNull(), vector(F.col("_first"), F.col("_second"), want)))
    finite = F.coalesce(F.forall("_features", _finite), F.lit(False))
    reason = (
        F.when(n == 0, F.when(want == 0, "no_hands_expected").otherwise("no_hands_detected"))
        .when(F.col("_problem").isNotNull(), F.concat(F.lit("invalid_geometry:"), F.col("_problem")))
        .when(~finite, "invalid_feature_vector")
        .when(want == 0, "hard_negative")
        .when((want == 2) & (n < 2), "partial_hands")
        .otherwise("ok")
    )
    steps = steps.withColumn("_reason", reason)
    usable = F.col("_reason").isin("hard_negative", "partial_hands", "ok")
    told = usable | (F.col("_reason") == "invalid_feature_vector")
    slots = lambda f: F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.when(told, F.coalesce(f(F.get("_ordered", i)), F.lit(0.0))).otherwise(0.0))
    struct = F.struct(
        F.when(usable, F.col("_features")).otherwise(_zeros(SIZE)).alias("features"),
        usable.alias("usable"),
        F.col("_reason").alias("reason"),
        n.alias("detected_hands"),
        slots(lambda h: F.when(h.isNotNull(), handedness_value(h["handedness"]))).alias("handedness"),
        slots(lambda h: h["score"]).alias("scores"),
    )
    return steps.withColumn(out, struct).drop("_want", "_ordered", "_first", "_second", "_problem", "_features", "_reason")


def mirror(features: Column) -> Column:
    """O-90: x negated; with both hands present the slots change places, and the shift in y and the log ratio change sign."""
    both = (F.get(features, F.lit(126)) == 1) & (F.get(features, F.lit(127)) == 1)

    def value(x: Column, i: Column) -> Column:
        source = F.when(both & (i < SLOT), i + SLOT).when(both & (i < 2 * SLOT), i - SLOT).otherwise(i)
        flip = ((i < 2 * SLOT) & (i % 3 == 0)) | (both & ((i == 129) | (i == 131)))
        v = F.get(features, source)
        return F.when(flip, -v).otherwise(v)

    return F.transform(features, value)


def to_pixels(points: Column, width: Column, height: Column) -> Column:
    """O-91: picture shares to pixels; z goes with the width. A frame without size gives null."""
    scaled = F.transform(points, lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y"), (p["z"] * width).alias("z")))
    return F.when((width > 0) & (height > 0), scaled)


def hypotheses(df: DataFrame, hands: str = "hands") -> DataFrame:
    """O-95..O-97: rows (.., feature_hands, features): the largest hand alone, then both hands by wrist x; none without hands."""
    by_x = F.transform(F.array_sort(F.transform(hands, lambda h, i: F.struct(h["points"][0]["x"].alias("x"), i.alias("i"), h.alias("h")))), lambda r: r["h"])
    entry = lambda n, a, b: F.struct(F.lit(n).alias("n"), a["points"].alias("a"), b.alias("b"))
    rows = df.withColumn("_x", by_x).withColumn("_one", F.get(largest_hand(F.col(hands)), F.lit(0)))
    nothing = F.lit(None).cast(rows.schema["_one"].dataType["points"].dataType)
    one = F.when(F.size(hands) >= 1, entry(1, F.col("_one"), nothing))
    two = F.when(F.size(hands) >= 2, entry(2, F.get("_x", F.lit(0)), F.get("_x", F.lit(1))["points"]))
    rows = rows.withColumn("_h", F.explode(F.array_compact(F.array(one, two))))
    rows = rows.withColumn("_a", F.col("_h.a")).withColumn("_b", F.col("_h.b")).withColumn("feature_hands", F.col("_h.n"))
    return rows.withColumn("features", vector(F.col("_a"), F.col("_b"), F.col("feature_hands"))).drop("_x", "_one", "_h", "_a", "_b")
