"""Scored selection among image components: ranking, the marker layout join, orientation, crop interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("image_id", "rotation", "x", "y", "w", "h", "area", "width_ratio", "height_ratio", "center_x_ratio", "center_y_ratio", "aspect")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def component_score(fill: Column, aspect: Column, distance: Column) -> Column:
    """Filled, near the page's proportions and near the centre."""
    return fill * 2.0 - F.abs(aspect - 0.7) - distance * 0.5


def top_components(components: DataFrame, k: int = 1) -> DataFrame:
    """The k best of each image's components with at least a twentieth of its area."""
    kept = components.where("area_share >= 0.05").withColumn("score", component_score(F.col("fill"), F.col("aspect"), F.col("distance")))
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "label_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def is_fold() -> Column:
    return (F.col("width_ratio") >= 0.30) & F.col("center_y_ratio").between(0.35, 0.65) & (F.col("aspect") >= 6.0) & (F.col("height_ratio") <= 0.12)


def fold_score() -> Column:
    """Near the middle, wide, long and thin."""
    center = 1.0 - F.least(F.abs(F.col("center_y_ratio") - 0.5) / 0.15, F.lit(1.0))
    width = F.least((F.col("width_ratio") - 0.30) / 0.45, F.lit(1.0))
    shape = F.least((F.col("aspect") - 6.0) / 12.0, F.lit(1.0))
    return center * 4.0 + width * 3.0 + shape * 2.0 - F.col("height_ratio") * 2.0


def is_photo() -> Column:
    """The gates of a photo marker that don't depend on the fold."""
    return F.col("width_ratio").between(0.14, 0.70) & F.col("height_ratio").between(0.10, 0.60) & F.col("aspect").between(0.35, 4.5) & (
        F.col("center_x_ratio") <= 0.68
    )


def photo_score(fold_y: Column) -> Column:
    """Below the fold, left of the middle, large, nearly square; ``p`` is the marker."""
    below = F.least((F.col("p.center_y_ratio") - fold_y) * 4.0, F.lit(2.0))
    left = 1.0 - F.least(F.abs(F.col("p.center_x_ratio") - 0.28) / 0.45, F.lit(1.0))
    size = F.least((F.col("p.width_ratio") + F.col("p.height_ratio")) * 4.0, F.lit(2.5))
    shape = 1.0 - F.least(F.abs(F.col("p.aspect") - 1.2) / 3.0, F.lit(1.0))
    return below * 3.0 + left * 3.0 + size * 2.0 + shape * 2.0


def marker_layouts(components: DataFrame, folds: int = 5) -> DataFrame:
    """The best fold and photo marker of each image and rotation: total = 3 fold + 4 photo.

    The ``folds`` best folds meet the image's photo markers (an equi-join on image and rotation); a marker
    is more than 0.06 below the fold and is not the fold itself (all four numbers within less than 5 pixels).
    """
    key = ["image_id", "rotation"]
    best = Window.partitionBy(*key).orderBy(F.desc("fold_score"), "y", "x")
    fold = components.where(is_fold()).withColumn("fold_score", fold_score()).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= folds)
    fold = fold.select(*key, *[F.col(c).alias(f"fold_{c}") for c in ("x", "y", "w", "h", "center_y_ratio")], "fold_score")
    photo = components.where(is_photo()).alias("p")
    same = F.lit(True)
    for c in "xywh":
        same = same & (F.abs(F.col(f"p.{c}") - F.col(f"fold_{c}")) < 5)
    pair = fold.join(
        photo,
        [
            F.col("p.image_id") == fold.image_id, F.col("p.rotation") == fold.rotation,
            F.col("p.center_y_ratio") > F.col("fold_center_y_ratio") + 0.06, ~same
        ]
    )
    pair = pair.select(
        fold.image_id, fold.rotation, "fold_x", "fold_y", "fold_w", "fold_h", "fold_score",
        F.col("p.x").alias("photo_x"), F.col("p.y").alias("photo_y"),
        photo_score(F.col("fold_center_y_ratio")).alias("photo_score")
    )
    pair = pair.withColumn("total", 3.0 * F.col("fold_score") + 4.0 * F.col("photo_score"))
    order = Window.partitionBy(*key).orderBy(F.desc("total"), "fold_y", "fold_x", "photo_y", "photo_x")
    return pair.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def best_orientation(layouts: DataFrame) -> DataFrame:
    """The rotation with the best layout of each image, the earliest on a tie."""
    order = Window.partitionBy("image_id").orderBy(F.desc("total"), "rotation")
    return layouts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def crop_interval(fold_x: Column, fold_w: Column, width: Column) -> Column:
    """left and right of the crop: 1.10 times the fold about its centre, edges rounded half to even, then clipped; null for short folds and near-whole crops."""
    centre, half = fold_x + fold_w / 2, F.rint(fold_w * 1.10) / 2
    left, right = F.greatest(F.lit(0), F.rint(centre - half).cast("int")), F.least(width, F.rint(centre + half).cast("int"))
    use = (fold_w >= 0.30 * width) & (right - left > 0) & (right - left <= 0.98 * width)
    return F.when(use, F.struct(left.cast("int").alias("left"), right.cast("int").alias("right")))


def red_fold_lines(components: DataFrame, k: int = 8) -> DataFrame:
    """The k best red lines of an image over all rotations, with score, rank and the best one's confidence.

    Components have image_id, rotation, area_ratio, the four ratios and aspect; lines are at least 0.0001 of
    the image, wide, long and not too high.
    """
    line = (F.col("area_ratio") >= 0.0001) & (F.col("width_ratio") >= 0.18) & (F.col("aspect") >= 2.5) & (F.col("height_ratio") <= 0.25)
    middle = 1.0 - F.least(F.abs(F.col("center_y_ratio") - 0.5) * 2.0, F.lit(1.0))
    score = F.col("width_ratio") * 4.0 + F.least(F.col("aspect") / 10.0, F.lit(2.0)) + F.least(
        F.col("area_ratio") * 150.0, F.lit(2.0)
    ) + middle * 0.75 - F.col("height_ratio") * 2.0
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "rotation", "y", "x")
    ranked = components.where(line).withColumn("score", score).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).withColumn("confidence", F.when(F.col("rank") == 1, clamp(F.col("score") / 7.0)))


def corner_order(points: Column) -> Column:
    """Four corners as top left, top right, bottom right, bottom left, by sum and difference of coordinates."""
    pick = lambda key, most: F.element_at(
        F.array_sort(F.transform(points, lambda p: F.struct((key(p) * (-1 if most else 1)).alias("k"), p.alias("p")))),
        1
    )["p"]
    total, diff = (lambda p: p[0] + p[1]), (lambda p: p[1] - p[0])
    return F.array(pick(total, False), pick(diff, False), pick(total, True), pick(diff, True))


def resize_scale(width: Column, height: Column, longest: int) -> Column:
    """Scale that brings the longest side to at most ``longest``; 0 turns it off."""
    side = F.greatest(width, height)
    return F.when((F.lit(longest) > 0) & (side > longest), F.lit(longest) / side).otherwise(1.0)
