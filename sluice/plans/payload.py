"""Payload rows of a delivery: how they are built, and what is wrong with their arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the version of a delivery's rows.
DELIVERY_VERSION = "delivery.v1"
#: Body joints of a full-body frame, hand joints (from its end), edges of the body, points on an edge, and the share of depth kept.
BODY, HAND_JOINTS, EDGES, BETWEEN, DEPTH = (5, 11), 42, ((0, 2), (2, 4), (1, 3), (3, 5), (0, 1)), 3, 0.6


def rows(samples: DataFrame, splits: DataFrame, product: str) -> DataFrame:
    """``samples`` with their split and the columns that all products have; samples without a split are left out."""
    return samples.join(splits, "sample_id").select(F.lit(DELIVERY_VERSION).alias("schema_version"), F.lit(product).alias("product"), "*")


def has_shape(array: Column, *sizes: Column | int) -> Column:
    """True if nested arrays have just these sizes, level by level; false if any is null."""
    size = sizes[0] if isinstance(sizes[0], Column) else F.lit(sizes[0])
    fits = F.coalesce(F.size(array) == size, F.lit(False))
    return fits & F.forall(array, lambda inner: has_shape(inner, *sizes[1:])) if len(sizes) > 1 else fits & F.forall(array, lambda x: x.isNotNull())


def every(array: Column, depth: int, test) -> Column:
    """True if all values of nested arrays pass a test."""
    return F.forall(array, test if depth == 1 else lambda inner: every(inner, depth - 1, test))


def some(array: Column, depth: int) -> Column:
    return F.exists(array, (lambda x: x) if depth == 1 else lambda inner: some(inner, depth - 1))


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def _named(checks: dict[str, Column]) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])))


def translation_problems(joints: int = 24, coordinates: int = 3, features: int | None = None) -> Column:
    """Names of what is wrong with caption, pose, pose_confidence, frame_mask (and radar_feature)."""
    frames = F.col("frame_count")
    shaped = has_shape(F.col("pose_confidence"), frames, 2, joints)
    checks = {
        "frame count": frames >= 1,
        "caption": F.length(F.trim("caption")) > 0,
        "pose shape": has_shape(F.col("pose"), frames, 2, joints, coordinates),
        "confidence shape": shaped,
        "confidence range": every(F.col("pose_confidence"), 3, lambda x: x.between(0, 1)),
        "frame mask": has_shape(F.col("frame_mask"), frames) & some(F.col("frame_mask"), 1),
        "not finite": every(F.col("pose"), 4, _finite) & every(F.col("pose_confidence"), 3, _finite),
    }
    if features is not None:
        checks["feature shape"] = has_shape(F.col("radar_feature"), frames, features)
        checks["feature not finite"] = every(F.col("radar_feature"), 2, _finite)
    return _named(checks)


def pose_problems(bins: tuple[int, int, int, int], joints: int = 24) -> Column:
    """Names of what is wrong with radar_cube, frame_mask, pose_gt and pose_valid."""
    frames = F.col("frame_count")
    return _named({
        "frame count": frames >= 1,
        "cube shape": has_shape(F.col("radar_cube"), frames, *bins),
        "cube values": every(F.col("radar_cube"), 5, lambda x: _finite(x) & (x >= 0)),
        "frame mask": has_shape(F.col("frame_mask"), frames) & some(F.col("frame_mask"), 1),
        "pose shape": has_shape(F.col("pose_gt"), 2, joints, 3) & has_shape(F.col("pose_valid"), 2, joints),
        "pose values": every(F.col("pose_gt"), 3, _finite),
        "pose mask": some(F.col("pose_valid"), 2),
    })


def typed_translation(table: DataFrame) -> DataFrame:
    """Samples of a translation delivery, with their arrays in their types; other columns go along."""
    types = {"pose": "array<array<array<array<float>>>>", "pose_confidence": "array<array<array<float>>>", "frame_mask": "array<boolean>", "frame_count": "int", "fps": "float"}
    return table.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in table.columns])


def body_cloud(joints: Column) -> Column:
    """63 points of a full-body frame: six of the body, three on each of five edges, 42 of the hands; z drawn in."""
    body, hands = F.slice(joints, BODY[0] + 1, BODY[1] - BODY[0]), F.slice(joints, -HAND_JOINTS, HAND_JOINTS)
    joint = lambda k: F.get(body, F.lit(k))
    on_edges = [_between(joint(a), joint(b), k / (BETWEEN + 1)) for a, b in EDGES for k in range(1, BETWEEN + 1)]
    flat = lambda p: F.array(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2)) * DEPTH)
    return F.transform(F.concat(body, F.array(*on_edges), hands), flat)


def _between(p: Column, q: Column, share: float) -> Column:
    return F.zip_with(p, q, lambda a, b: a + (b - a) * share)


def packed(points: Column, width: Column) -> Column:
    """The points of a frame without those that hold NaN, then zeros up to ``width`` points."""
    kept = F.filter(points, lambda p: ~F.exists(p, lambda x: F.isnan(x)))
    return F.concat(kept, F.array_repeat(F.array(*[F.lit(0.0)] * 3), F.greatest(width - F.size(kept), F.lit(0))))
