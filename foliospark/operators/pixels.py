"""Pixel steps of the image stage in numpy, run over images where they lie; what they measure is scored by ``candidates``.

An image comes as the bytes of its file.  Binary PPM is read here; other kinds need a decoder in ``DECODERS``
(a function from bytes to a height x width x 3 array of red, green, blue, or None if it cannot).  Areas count
pixels of a component.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators import candidates

ROTATIONS = ("rot0", "rot90_cw", "rot180", "rot90_ccw")
DECODERS: list[Callable[[bytes], np.ndarray | None]] = []


def read_ppm(data: bytes) -> np.ndarray | None:
    head = re.match(rb"P6\s+(?:#.*\s+)*(\d+)\s+(\d+)\s+255\s", data)
    if not head:
        return None
    width, height = int(head[1]), int(head[2])
    return np.frombuffer(data, np.uint8, width * height * 3, head.end()).reshape(height, width, 3)


def load_image(data: bytes) -> np.ndarray:
    for decode in (read_ppm, *DECODERS):
        image = decode(data)
        if image is not None:
            return image
    raise ValueError("no decoder reads this image")


def save_image(image: np.ndarray) -> bytes:
    return b"P6 %d %d 255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image).tobytes()


def averaged(image: np.ndarray, size: int, axis: int) -> np.ndarray:
    """``size`` pixels along an axis, each the mean of the stretch that it covers."""
    image = np.moveaxis(image.astype(np.float64), axis, 0)
    total = np.concatenate((np.zeros((1, *image.shape[1:])), np.cumsum(image, axis=0)))
    edge = np.linspace(0, len(image), size + 1)
    low = np.minimum(edge.astype(np.int64), len(image) - 1)
    part = (edge - low).reshape(-1, *[1] * (image.ndim - 1))
    at = total[low] + part * (total[low + 1] - total[low])
    return np.moveaxis(np.diff(at, axis=0) * size / len(image), 0, axis)


def resized(image: np.ndarray, width: int = 1200) -> tuple[np.ndarray, float]:
    """The image at a width with its proportions, and the scale."""
    scale = width / image.shape[1]
    small = averaged(averaged(image, max(1, int(image.shape[0] * scale)), 0), width, 1)
    return np.rint(small).astype(np.uint8), scale


def gray(image: np.ndarray) -> np.ndarray:
    return np.rint(image @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def otsu(values: np.ndarray) -> int:
    """The level that parts the values into two classes of the greatest variance between them."""
    count = np.bincount(values.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(count), np.cumsum(count * np.arange(256))
    above, rest = below[-1] - below, mass[-1] - mass
    both = (below > 0) & (above > 0)
    spread = np.zeros(256)
    spread[both] = below[both] * above[both] * (mass[both] / below[both] - rest[both] / above[both]) ** 2
    return int(spread.argmax())


def neighbours(mask: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rectangle about each pixel, cut at the image's edge: how many pixels are set and how many there are."""
    total = np.pad(np.cumsum(np.cumsum(mask, axis=0, dtype=np.int64), axis=1), ((1, 0), (1, 0)))
    top, left = np.arange(mask.shape[0]) - height // 2, np.arange(mask.shape[1]) - width // 2
    y0, y1 = np.clip(top, 0, mask.shape[0])[:, None], np.clip(top + height, 0, mask.shape[0])[:, None]
    x0, x1 = np.clip(left, 0, mask.shape[1])[None], np.clip(left + width, 0, mask.shape[1])[None]
    return total[y1, x1] - total[y0, x1] - total[y1, x0] + total[y0, x0], (y1 - y0) * (x1 - x0)


def dilated(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    return neighbours(mask, width, height)[0] > 0


def eroded(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    some, every = neighbours(mask, width, height)
    return some == every


def closed(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    return eroded(dilated(mask, width, height), width, height)


def opened(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    return dilated(eroded(mask, width, height), width, height)


def page_mask(image: np.ndarray) -> np.ndarray:
    """Bright pixels, small gaps closed and small specks gone."""
    light = gray(image)
    return opened(closed(light > otsu(light), 15, 15), 9, 9)


def red_mask(image: np.ndarray) -> np.ndarray:
    """Pixels of red hue with some colour and light, joined along lines."""
    rgb = image.astype(np.float64)
    most, least = rgb.max(axis=2), rgb.min(axis=2)
    span = np.maximum(most - least, 1e-9)
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    hue = np.where(most == r, (g - b) / span % 6, np.where(most == g, (b - r) / span + 2, (r - g) / span + 4)) * 30
    hue = np.where(most == least, 0, np.rint(hue) % 180)
    colour = np.rint(255 * (most - least) / np.maximum(most, 1))
    red = ((hue <= 15) | (hue >= 165)) & (colour >= 40) & (most >= 40)
    height, width = red.shape
    return closed(opened(red, 3, 3), max(15, int(width * 0.025)), max(3, int(height * 0.004)))


def components(mask: np.ndarray) -> Iterator[np.ndarray]:
    """The runs (row, start, stop) of each group of set pixels that touch at sides or corners."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    parent = np.arange(len(row))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        above, here = first[y - 1], first[y]
        while above < first[y] and here < first[y + 1]:
            if start[here] <= stop[above] and start[above] <= stop[here]:
                a, b = sorted((root(above), root(here)))
                parent[b] = a
            if stop[above] < stop[here]:
                above += 1
            else:
                here += 1
    of = np.array([root(i) for i in range(len(row))], np.int64)
    order = np.argsort(of, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else ():
        yield np.column_stack((row[part], start[part], stop[part]))


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the smallest convex polygon about the points, in order."""
    found = sorted(set(map(tuple, points.tolist())))

    def side(points: list) -> list:
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(side(found) + side(found[::-1]) or found, np.float64)


def least_rectangle(points: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Corners, width and height of the rectangle of least area about the points, which has a side along the hull."""
    corners = hull(points)
    along = np.roll(corners, -1, axis=0) - corners
    along = along[np.hypot(*along.T) > 0]
    best = None
    for x in along / np.hypot(*along.T)[:, None] if len(along) else [np.array([1.0, 0.0])]:
        axes = np.stack((x, [-x[1], x[0]]))
        at = corners @ axes.T
        low, high = at.min(axis=0), at.max(axis=0)
        size = high - low
        if best is None or size.prod() < best[0]:
            box = np.array([[low[0], low[1]], [high[0], low[1]], [high[0], high[1]], [low[0], high[1]]]) @ axes
            best = (size.prod(), box, float(size[0]), float(size[1]))
    return best[1:]


def page_candidates(image: np.ndarray) -> list[dict]:
    """Measures of every component of the page mask with its rectangle, in the image's own pixels."""
    small, scale = resized(image)
    mask = page_mask(small)
    height, width = mask.shape
    out = []
    for label, runs in enumerate(components(mask), 1):
        size = runs[:, 2] - runs[:, 1]
        area = int(size.sum())
        if area < 0.05 * mask.size:
            continue
        ends = np.concatenate((runs[:, [1, 0]], np.column_stack((runs[:, 2] - 1, runs[:, 0]))))
        box, a, b = least_rectangle(ends)
        centre = np.array([(size * (runs[:, 1] + runs[:, 2] - 1) / 2).sum(), (size * runs[:, 0]).sum()]) / area
        middle = np.array([width, height]) / 2
        out.append(
            {
                "label_id": label, "area": area, "area_share": area / mask.size, "aspect": min(a, b) / max(a, b, 1e-9),
                "fill": area / max(a * b, 1e-9), "distance": float(np.hypot(*(centre - middle)) / np.hypot(*middle)),
                "box": (box / scale).tolist()
            }
        )
    return out


def rotated(image: np.ndarray, name: str) -> np.ndarray:
    return np.rot90(image, -ROTATIONS.index(name))


def red_components(image: np.ndarray) -> list[dict]:
    """Measures of the red components of an image, those of a photo's frame joined."""
    height, width = image.shape[:2]
    mask = closed(red_mask(image), max(7, int(width * 0.010)), max(7, int(height * 0.010)))
    out = []
    for runs in components(mask):
        area = int((runs[:, 2] - runs[:, 1]).sum())
        x, y = int(runs[:, 1].min()), int(runs[:, 0].min())
        w, h = int(runs[:, 2].max()) - x, int(runs[:, 0].max()) + 1 - y
        if area >= 0.00005 * mask.size:
            out.append(
                {
                    "x": x, "y": y, "w": w, "h": h, "area": float(area), "area_ratio": area / mask.size,
                    "width_ratio": w / width, "height_ratio": h / height, "center_x_ratio": (x + w / 2) / width,
                    "center_y_ratio": (y + h / 2) / height, "aspect": w / h
                }
            )
    return out


def warped(image: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The quadrilateral (top left, top right, bottom right, bottom left) as an upright image of its longer sides."""
    tl, tr, br, bl = np.asarray(corners, np.float64)
    width = max(int(np.hypot(*(br - bl))), int(np.hypot(*(tr - tl))), 2)
    height = max(int(np.hypot(*(tr - br))), int(np.hypot(*(tl - bl))), 2)
    target = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], np.float64)
    # From the upright image back to the source: eight equations of the projective map.
    rows = [
        r for (u, v), (x, y) in zip(target, (tl, tr, br, bl), strict=True) for r in (
            [u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]
        )
    ]
    m = np.append(np.linalg.solve(np.array(rows), np.array([tl, tr, br, bl]).ravel()), 1).reshape(3, 3)
    v, u = np.mgrid[:height, :width]
    x, y, z = np.tensordot(m, np.stack((u, v, np.ones_like(u))), 1)
    x, y = x / z, y / z
    inside = (x >= 0) & (y >= 0) & (x <= image.shape[1] - 1) & (y <= image.shape[0] - 1)
    x0, y0 = np.clip(x.astype(int), 0, image.shape[1] - 2), np.clip(y.astype(int), 0, image.shape[0] - 2)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    top = image[y0, x0] * (1 - fx) + image[y0, x0 + 1] * fx
    low = image[y0 + 1, x0] * (1 - fx) + image[y0 + 1, x0 + 1] * fx
    return np.where(inside[..., None], np.rint(top * (1 - fy) + low * fy), 0).astype(np.uint8)


_MEASURES = "x int, y int, w int, h int, area double, area_ratio double, width_ratio double, height_ratio double, center_x_ratio double, center_y_ratio double, aspect double"


def measured(images: DataFrame, schema: str, measure: Callable[[np.ndarray], list[dict]]) -> DataFrame:
    """image_id and a row for everything ``measure`` sees; an image that no decoder reads has none."""

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = measure(load_image(data))
                except ValueError:
                    continue
                if found:
                    yield pa.RecordBatch.from_pylist([{"image_id": key, **row} for row in found], schema=types)

    kind = images.schema["image_id"].dataType.simpleString()
    whole = f"image_id {kind}, {schema}"
    types = _arrow(images.sparkSession, whole)
    return images.select("image_id", "content").mapInArrow(run, whole)


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def changed(images: DataFrame, change: Callable[[np.ndarray, dict], np.ndarray]) -> DataFrame:
    """image_id and content after ``change(image, the row's other columns)``."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = save_image(change(load_image(row.pop("content")), row))
                yield pa.RecordBatch.from_pydict({"image_id": [row["image_id"]], "content": pa.array([out], pa.binary())})

    kind = images.schema["image_id"].dataType.simpleString()
    return images.mapInArrow(run, f"image_id {kind}, content binary")


def crop_images(images: DataFrame) -> DataFrame:
    """image_id, content (PPM), rotation of images (image_id, content): the page cut out, upright, as wide as its fold says.

    An image without a page is left out; one without markers stays as it was cut out (rotation null).
    """
    boxes = candidates.top_components(
        measured(
            images,
            "label_id int, area long, area_share double, aspect double, fill double, distance double, box array<array<double>>",
            page_candidates
        ),
        1
    )
    boxes = boxes.select("image_id", candidates.corner_order(F.col("box")).alias("corners"))
    pages = changed(images.select("image_id", "content").join(boxes, "image_id"), lambda image, row: warped(image, row["corners"]))

    def turned(image: np.ndarray) -> list[dict]:
        return [
            {"rotation": k, "page_w": t.shape[1], **c} for k, name in enumerate(ROTATIONS) for t in [rotated(image, name)] for c in red_components(t)
        ]

    red = measured(pages, f"rotation int, page_w int, {_MEASURES}", turned)
    widths = red.groupBy("image_id", "rotation").agg(F.first("page_w").alias("page_w"))
    best = candidates.best_orientation(candidates.marker_layouts(red)).join(widths, ["image_id", "rotation"])
    cut = candidates.crop_interval(F.col("fold_x"), F.col("fold_w"), F.col("page_w"))
    best = best.select("image_id", "rotation", cut["left"].alias("left"), cut["right"].alias("right"))

    def upright(image: np.ndarray, row: dict) -> np.ndarray:
        if row["rotation"] is None:
            return image
        out = rotated(image, ROTATIONS[row["rotation"]])
        return out if row["left"] is None else out[:, row["left"] : row["right"]]

    placed = pages.join(best, "image_id", "left")
    return changed(placed, upright).join(best.select("image_id", "rotation"), "image_id", "left")


def crop_report(images: DataFrame) -> DataFrame:
    """image_id, status (ok, failed), shape before and after and the rotation of each crop."""
    shape = lambda image: [{"height": image.shape[0], "width": image.shape[1]}]
    sized = lambda d, name: measured(d, "height int, width int", shape).select("image_id", F.array("height", "width").alias(name))
    done = crop_images(images)
    out = images.select("image_id").join(sized(images, "shape_before"), "image_id", "left").join(sized(done, "shape_after"), "image_id", "left").join(
        done.select("image_id", "rotation"), "image_id", "left"
    )
    return out.withColumn("status", F.when(F.col("shape_after").isNull(), "failed").otherwise("ok"))
