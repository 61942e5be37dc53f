"""Sources: OCR documents and commands as JSON, images as binary files."""

from __future__ import annotations

import gc
import json
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from foliospark.operators.items import box_from_json

#: The names under which engines put a text, a box, a confidence, a list of boxes and a page's size.
TEXTS = ("text", "rec_text", "label", "value")
BOXES = ("bbox", "box", "poly", "points", "dt_poly")
CONFIDENCES = ("confidence", "conf", "score", "rec_score")
BOX_LISTS = ("dt_polys", "rec_polys", "boxes", "dt_boxes")
SHAPES = ("image_shape", "shape", "input_shape")
#: JSON that counts as nothing given.
EMPTY = ("", "[]", "{}", "0", "0.0", "false", "null")

_ITEM = f"struct<{','.join(f'{n}:string' for n in (*TEXTS, *BOXES, *CONFIDENCES))}>"
_SHAPES = ",".join(f"{n}:array<double>" for n in SHAPES)
PAGE = f"struct<{_SHAPES},metadata:struct<{_SHAPES}>,items:array<{_ITEM}>,rec_texts:array<string>,rec_scores:array<string>,{','.join(f'{n}:array<string>' for n in BOX_LISTS)},raw_text:string,lang:string,_corrupt_record:string>"
CORNERS = ("x1", "y1", "x2", "y2")
LISTS = ("rec_texts", "rec_scores", *BOX_LISTS)
#: What Python makes of a page: whether it is plain, its shape, its items, and what a search found where Spark has to understand it.
_RAW = pa.struct([(n, pa.string()) for n in ("text", "confidence", "box")])
_BOX = pa.struct([(n, pa.float64()) for n in (*CORNERS, "cx", "cy", "w", "h")])
_ITEMS = pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("box", _BOX)])
UNDERSTOOD = from_arrow_type(
    pa.struct([("plain", pa.bool_()), ("shape", pa.list_(pa.int32())), ("items", pa.list_(_ITEMS)), ("raw", pa.list_(_RAW))])
)
NO_BOX = (None,) * 4
#: Whole numbers below it are doubles too.
_EXACT = 1 << 53
_NUMBERS, _INNER = {int, float}, (dict, list)
#: Which of an item's three values a name gives, and how early it is tried.
_PLACES = {n: (k, i) for k, names in enumerate((TEXTS, CONFIDENCES, BOXES)) for i, n in enumerate(names)}
#: An object without any of these says nothing itself, has no size, has no lists side by side.
_SAYING, _SIZED, _LISTED = frozenset((*TEXTS, "rec_texts")), frozenset((*SHAPES, "metadata")), frozenset(LISTS)
_DECIMAL = re.compile(r"-?[0-9]+(?:\.[0-9]+)?")
COMMAND = "request_id string, image_file string, image_path string, output_file string, output_path string, _corrupt_record string"
IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")
#: Kinds that a command's own name is tried with, in order.
COMMAND_IMAGES = (".jpg", ".jpeg", ".png")


def first_shape(columns: list[Column]) -> Column:
    """The first array of two numbers or more, as whole numbers: height and width."""
    pair = lambda c: F.array(F.try_element_at(c, F.lit(1)).cast("int"), F.try_element_at(c, F.lit(2)).cast("int"))
    return F.coalesce(
        *[F.when((F.size(c) >= 2) & F.try_element_at(c, F.lit(1)).isNotNull() & F.try_element_at(c, F.lit(2)).isNotNull(), pair(c)) for c in columns]
    )


def given(value: Column) -> Column:
    """The JSON value unless it is nothing."""
    return F.when(~value.isin(*EMPTY), value)


def direct_items(items: Column) -> Column:
    """Text, confidence and box of item objects, each by the first of its names that says something."""

    def one(i: Column) -> Column:
        text = F.coalesce(*[F.nullif(i[n], F.lit("")) for n in TEXTS[:-1]], i[TEXTS[-1]])
        return F.struct(
            text.alias("text"), F.coalesce(*[given(i[n]) for n in CONFIDENCES]).alias("confidence"),
            F.coalesce(*[given(i[n]) for n in BOXES]).alias("box")
        )

    return F.transform(items, one)


def boxed(raw: Column) -> Column:
    """RAW items with their box understood; those without text or box are dropped."""
    whole = F.transform(
        raw,
        lambda r: F.struct(r["text"].alias("text"), r["confidence"].try_cast("double").alias("confidence"), box_from_json(r["box"]).alias("box"))
    )
    return F.filter(whole, lambda r: r["text"].isNotNull() & r["box"].isNotNull())


_encode, _decode = json.JSONEncoder(ensure_ascii=False).encode, json.JSONDecoder().decode


def _plain(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else _encode(value)


def _some(node: dict, names: tuple[str, ...]) -> object:
    """The first value that says something, else the last name's."""
    found = None
    for n in names:
        if found := node.get(n):
            return found
    return found


def loose_items(node: object) -> Iterator[tuple[object, object, object, tuple | None]]:
    """Text, confidence and box anywhere in decoded JSON, outer before inner: objects with a text, parallel lists, and pairs of a box and [text, score].

    With them the corners of an object's box where that is ``_four_points``; these are not searched, as they hold nothing.
    """
    open_ = [node]
    while open_:
        node = open_.pop()
        if type(node) is dict:
            inner = [v for v in node.values() if type(v) in _INNER]
            if not _SAYING.isdisjoint(node):
                text = _some(node, TEXTS)
                if text is not None:
                    box_ = _some(node, BOXES) or None
                    corners = _four_points(box_)
                    yield text, _some(node, CONFIDENCES), box_, corners
                    if corners:
                        inner = [v for v in inner if v is not box_]
                texts = node.get("rec_texts")
                if type(texts) is list:
                    boxes = next((node[n] for n in BOX_LISTS if node.get(n)), None)
                    if type(boxes) is list:
                        scores = node["rec_scores"] if type(node.get("rec_scores")) is list else []
                        yield from zip(texts, scores + [None] * len(texts), boxes, [None] * len(texts))
        elif type(node) is list:
            inner = [v for v in node if type(v) in _INNER]
            for row in inner:
                if type(row) is list and len(row) > 1 and type(row[1]) is list and row[1]:
                    yield row[1][0], row[1][1] if len(row[1]) > 1 else None, row[0], None
        else:
            continue
        if inner:
            inner.reverse()
            open_ += inner


def _number(value: object, words: bool = False) -> float | None:
    """A number that is the same double to Python and to Spark; words: also a short decimal in a string."""
    kind = type(value)
    if kind is int:
        return float(value) if -_EXACT < value < _EXACT else None
    if kind is float:
        return value if math.isfinite(value) and (value or math.copysign(1, value) > 0) else None
    if words and kind is str and len(value) <= 15 and (value.isdigit() and value.isascii() or _DECIMAL.fullmatch(value)):
        return float(value)
    return None


def _four_points(shape: object) -> tuple[float, ...] | None:
    """Two opposite corners around four points of two plain numbers, as most engines give them; None for anything else, also for an edge at 0, which has two signs."""
    if type(shape) is not list or len(shape) != 4:
        return None
    try:
        (a, b), (c, d), (e, f), (g, h) = shape
        if {type(a), type(b), type(c), type(d), type(e), type(f), type(g), type(h)} <= _NUMBERS:
            x, y, u, v = min(a, c, e, g), min(b, d, f, h), max(a, c, e, g), max(b, d, f, h)
            if x and y and u and v and -_EXACT < x <= u < _EXACT and -_EXACT < y <= v < _EXACT:
                total = a + b + c + d + e + f + g + h
                return (x, y, u, v) if total == total else None  # not a number: compared, it says no to everything
    except (TypeError, ValueError, OverflowError):
        pass
    return None


def _corners(shape: object) -> tuple[float | None, ...] | None:
    """Two opposite corners of a box, the first one None if it is no box; None if only Spark's reading of the JSON can tell."""
    if type(shape) is dict:
        get = shape.get
        named = x, y, w, h = get("x"), get("y"), get("w"), get("h")
        sized = x is not None and y is not None and w is not None and h is not None
        if not sized:
            named = get("x1"), get("y1"), get("x2"), get("y2")
        x, y, u, v = (None if n is None else _number(n, True) for n in named)
        if x is None or y is None or u is None or v is None:
            return NO_BOX if None in named else None
        return (x, y, x + u, y + v) if sized else (x, y, u, v)
    if type(shape) is not list or not shape:
        return None
    if type(shape[0]) is not list:
        if len(shape) != 4:
            return NO_BOX
        four = tuple(map(_number, shape))
        return None if None in four else four
    if len(shape) < 4:
        return NO_BOX
    if four := _four_points(shape):
        return four
    xs, ys = [], []
    for p in shape:
        if type(p) is not list or len(p) < 2:
            return None
        xs.append(_number(p[0], True))
        ys.append(_number(p[1], True))
    return None if None in xs or None in ys else (min(xs), min(ys), max(xs), max(ys))


class _Odd(Exception):
    """What is given is not plain; Spark's reading of the JSON tells what it means."""


def _plain_shape(node: dict) -> list[int] | None:
    """As ``first_shape``."""
    if _SIZED.isdisjoint(node):
        return None
    more = node.get("metadata")
    if more is not None and type(more) is not dict:
        raise _Odd
    found = None
    for place in (node, more or {}):
        for n in SHAPES:
            value = place.get(n)
            if value is None:
                continue
            if type(value) is not list or any((x := _number(v)) is None or abs(x) >= 1 << 31 for v in value):
                raise _Odd
            if found is None and len(value) >= 2:
                found = [int(value[0]), int(value[1])]
    return found


def _plain_items(node: dict) -> list[tuple]:
    """As ``boxed`` ``direct_items``: text, confidence and corners."""
    items = node.get("items")
    if items is None:
        return []
    if type(items) is not list or "_corrupt_record" in node or not _LISTED.isdisjoint(node) and any(type(node.get(n) or []) is not list for n in LISTS):
        raise _Odd
    out = []
    for i in items:
        if type(i) is not dict:
            raise _Odd
        text = score = shape = None
        at = [len(_PLACES)] * 3
        for key, value in i.items():
            if value is None or (place := _PLACES.get(key)) is None:
                continue
            of, rank = place
            kind = type(value)
            if of == 0:
                if kind is not str:
                    raise _Odd
                if rank < at[0] and (value or key == TEXTS[-1]):
                    text, at[0] = value, rank
            elif rank > at[of]:
                continue
            elif of == 1:
                if kind is str and value in EMPTY:
                    continue
                number = _number(value, True)
                if number is None:
                    raise _Odd
                if kind is str or number:
                    score, at[1] = number, rank
            elif value if kind in (list, dict) else value not in EMPTY:
                shape = _corners(value)
                if shape is None:
                    raise _Odd
                at[2] = rank
        if text is not None and shape and shape[0] is not None:
            if not text.isascii() and text != text.encode("utf-8", "replace").decode():
                raise _Odd
            out.append((text, score, shape))
    return out


def _strings(values: list[str | None]) -> pa.Array:
    """Halves of surrogate pairs, which have no UTF-8, become question marks, as in the JVM."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


def _lists(values: list[list | None], of: pa.DataType, fill) -> pa.Array:
    """Lists, side by side in one array that fill makes."""
    ends = np.cumsum([0, *(0 if v is None else len(v) for v in values)], dtype=np.int32)
    flat = fill([x for v in values if v is not None for x in v])
    return pa.ListArray.from_arrays(pa.array(ends), flat, type=pa.list_(of), mask=pa.array([v is None for v in values], pa.bool_()))


def _boxes(rows: list[tuple]) -> pa.Array:
    """Items of plain texts, confidences and corners; their boxes as ``box`` gives them."""
    x1, y1, x2, y2 = np.fromiter(chain.from_iterable([r[2] for r in rows]), float, 4 * len(rows)).reshape(-1, 4).T
    left, right, top, low = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)
    with np.errstate(over="ignore", invalid="ignore"):
        sides = [left, top, right, low, (left + right) / 2, (top + low) / 2, right - left, low - top]
        around = pa.StructArray.from_arrays([pa.array(np.rint(v * 100) / 100) for v in sides], fields=list(_BOX))
    return pa.StructArray.from_arrays([_strings([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.float64()), around], fields=list(_ITEMS))


def _raws(rows: list[tuple]) -> pa.Array:
    return pa.StructArray.from_arrays([_strings([_plain(r[k]) for r in rows]) for k in range(3)], fields=list(_RAW))


def _understood(page: str | None) -> tuple[bool, list[int] | None, list | None, list | None]:
    """Whether the page is plain, its shape, and its items, boxed or else raw.

    Where it is not plain, the items are those of the search, for Spark to take if its own reading gives none.
    """
    plain, shape, found = False, None, None
    try:
        node = None if page is None else _decode(page)
    except (ValueError, RecursionError):
        page = None
    if page is None:
        return False, None, None, None
    try:
        if type(node) is dict:
            shape, found = _plain_shape(node), _plain_items(node)
        plain = type(node) is dict or type(node) is list and bool(node) and type(node[0]) is list
    except _Odd:
        shape = None
    if found:
        return True, shape, found, None
    rows = []
    for text, score, box_, corners in loose_items(node):
        if text is None or box_ is None:
            continue
        if corners is None:
            corners = _corners(box_)
            if corners is None:
                break
            if corners[0] is None:
                continue
        if score is not None:
            score = _number(score, True)
            if score is None:
                break
        rows.append((text if type(text) is str else _plain(text), score, corners))
    else:
        return plain, shape, rows, None
    return plain, shape, None, list(loose_items(node))


@F.arrow_udf(UNDERSTOOD)
def _read(pages: pa.Array) -> pa.Array:
    gc.disable()  # decoded JSON has no cycles, but makes so many objects that they would be looked for again and again
    try:
        plain, shapes, rows, raws = zip(*map(_understood, pages.to_pylist())) if len(pages) else [()] * 4
    finally:
        gc.enable()
    return pa.StructArray.from_arrays(
        [
            pa.array(plain, pa.bool_()), _lists(shapes, pa.int32(), lambda x: pa.array(x, pa.int32())),
            _lists(rows, _ITEMS, _boxes), _lists(raws, _RAW, _raws)
        ], names=["plain", "shape", "items", "raw"]
    )


def parse_pages(documents: DataFrame) -> DataFrame:
    """doc_id, image_shape, items, _corrupt_record from documents (doc_id, value: their JSON).

    Items come from ``items``; only where these give none the whole document is searched.  Pages whose values are
    plain (``_understood``) are read a batch at a time in Python; all others as Spark reads JSON.
    """
    marked = F.col("value").startswith("\ufeff")
    whole = documents.select("doc_id", F.when(marked, F.expr("substr(value, 2)")).otherwise(F.col("value")).alias("value"))
    read = whole.withColumn("u", _read("value")).select("doc_id", "value", "u.plain", "u.shape", F.col("u.items").alias("plain_items"), "u.raw")
    plain = F.col("plain")
    page = F.from_json("value", PAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    read = read.withColumn("p", F.when(~plain, page))
    places = [F.col(f"p.{n}") for n in SHAPES] + [F.col(f"p.metadata.{n}") for n in SHAPES]
    read = read.select(
        "doc_id", "plain", F.when(plain, F.col("shape")).otherwise(first_shape(places)).alias("image_shape"),
        F.col("p._corrupt_record").alias("_corrupt_record"), "plain_items",
        F.when(~plain | F.col("plain_items").isNull(), F.transform(F.array(direct_items(F.col("p.items")), "raw"), boxed)).alias("_boxed")  # one plan for both
    )
    read = read.select("doc_id", "image_shape", "_corrupt_record", F.col("_boxed")[0].alias("items"), F.coalesce("plain_items", F.col("_boxed")[1]).alias("_more"))
    none = F.col("items").isNull() | (F.size("items") == 0)
    items = F.when(none, F.coalesce("_more", "items")).otherwise(F.col("items"))
    broken = F.when(F.col("items").isNull() & F.col("_more").isNull(), F.col("_corrupt_record"))
    return read.select("doc_id", "image_shape", items.alias("items"), broken.alias("_corrupt_record"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per OCR document: doc_id (file name), image_shape, items; a broken file has _corrupt_record."""
    raw = spark.read.text(path, wholetext=True)
    return parse_pages(raw.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.[^./]*$", 1).alias("doc_id"), "value"))


def engine_items(result: DataFrame) -> DataFrame:
    """doc_id, id (running over a document's pages), page_index, text, score, bbox of whole pixels and poly of an engine's pages.

    result: doc_id, page_index, rec_texts, rec_scores, rec_boxes, rec_polys.  A box that is missing is taken
    from its polygon; coordinates are cut to whole numbers.
    """
    zipped = F.arrays_zip(F.col("rec_texts").alias("t"), F.col("rec_scores").alias("s"), F.col("rec_boxes").alias("b"), F.col("rec_polys").alias("p"))
    one = result.select("doc_id", "page_index", F.posexplode(F.slice(zipped, F.lit(1), F.size("rec_texts"))).alias("place", "z"))
    whole = lambda a: F.transform(a, lambda v: v.cast("int"))
    axis = lambda k: F.transform(F.col("z.p"), lambda q: q[k])
    around = whole(F.array(F.array_min(axis(0)), F.array_min(axis(1)), F.array_max(axis(0)), F.array_max(axis(1))))
    box = F.when(F.size("z.b") >= 4, whole(F.slice("z.b", 1, 4))).when(F.size("z.p") > 0, around)
    earlier = Window.partitionBy("doc_id").orderBy("page_index", "place").rowsBetween(Window.unboundedPreceding, -1)
    return one.select(
        "doc_id", F.count("*").over(earlier).cast("int").alias("id"), "page_index",
        F.coalesce("z.t", F.lit("")).alias("text"), F.col("z.s").alias("score"), box.alias("bbox"),
        F.col("z.p").alias("poly")
    )


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMAND).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).withColumn(
        "file_name", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    )


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def resolve_command(commands: DataFrame) -> DataFrame:
    """request_id, image and output with their fallbacks; what counts as nothing in JSON counts as missing."""
    given_ = lambda c: F.nullif(F.col(c), F.lit(""))
    request = F.coalesce(given(F.col("request_id")), stem(F.col("file_name")))
    image = F.coalesce(given_("image_path"), given_("image_file"))
    output = F.coalesce(given_("output_path"), given_("output_file"), F.concat(request, F.lit(".json")))
    return commands.withColumns({"request_id": request, "image": image, "output": output})


def resolve_images(commands: DataFrame, listing: DataFrame) -> DataFrame:
    """Resolved commands with ``image``, also found by the command's own name, and whether it ``exists``.

    listing: name of every input file.  Equi-joins on names, so neither side has to fit anywhere.
    """
    tried = commands.select(
        "file_name",
        F.posexplode(F.array(*[F.concat(stem(F.col("file_name")), F.lit(e)) for e in COMMAND_IMAGES])).alias("place", "name")
    )
    names = listing.select("name").distinct()
    own = tried.join(names, "name").groupBy("file_name").agg(F.min_by("name", "place").alias("_own"))
    out = commands.join(own, "file_name", "left").withColumn("image", F.coalesce("image", "_own")).drop("_own")
    there = names.select(F.col("name").alias("image"), F.lit(True).alias("exists"))
    return out.join(there, "image", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def collect_images(spark: SparkSession, *paths: str) -> DataFrame:
    """Image files below the paths, each once, with content only if it is selected."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return found.where(kind.isin(*IMAGES)).dropDuplicates(["path"])
