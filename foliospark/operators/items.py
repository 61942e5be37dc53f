"""Positioned text items: boxes in several shapes, deduplication, page zones, ordering.

``item_rows`` computes once for each item, in generated code, what field extraction asks of it (whether it
is a label, its dates and codes, its cleaned value for its zone), so that page-wise functions only group and join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T

FIELDS = {
    "text": "string", "norm": "string", "x1": "double", "y1": "double", "x2": "double", "y2": "double", "cx": "double", "cy": "double", "w": "double", "h": "double",
    "ord": "int", "confidence": "double", "label": "boolean", "dates": "array<string>", "codes": "array<string>", "digits": "string", "issuer": "string", "person": "string", "place": "string",
}
ITEM = f"struct<{','.join(f'{n}:{t}' for n, t in FIELDS.items())}>"
ZONES = ("top", "bottom", "right_vertical")


def item(**given: Column) -> Column:
    """An item of the fields given, the others null."""
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()])


def hundredth(x: Column) -> Column:
    """Two decimals, halves to even."""
    return F.rint(x * 100) / 100


def tenth(x: Column) -> Column:
    return F.rint(x * 10) / 10


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A box from two opposite corners in any order; null if one is missing."""
    left, right, top, low = F.least(x1, x2), F.greatest(x1, x2), F.least(y1, y2), F.greatest(y1, y2)
    there = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    sides = {"x1": left, "y1": top, "x2": right, "y2": low, "cx": (left + right) / 2, "cy": (top + low) / 2, "w": right - left, "h": low - top}
    return F.when(there, F.struct(*[hundredth(v).alias(n) for n, v in sides.items()]))


def box_from_size(x: Column, y: Column, w: Column, h: Column) -> Column:
    return box(x, y, x + w, y + h)


def box_from_list(numbers: Column) -> Column:
    """Four numbers x1, y1, x2, y2."""
    at = lambda i: F.try_element_at(numbers, F.lit(i))
    return F.when(F.size(numbers) == 4, box(at(1), at(2), at(3), at(4)))


def box_from_points(points: Column) -> Column:
    """At least four points [x, y]: their bounding box.  A point that is no pair of numbers does not count."""
    at = lambda i, k: F.try_element_at(F.try_element_at(points, F.lit(i)), F.lit(k))
    whole = F.lit(True)
    for i in range(1, 5):
        whole = whole & at(i, 1).isNotNull() & at(i, 2).isNotNull()
    edge = lambda pick, k: pick(*[at(i, k) for i in range(1, 5)])
    four = box(edge(F.least, 1), edge(F.least, 2), edge(F.greatest, 1), edge(F.greatest, 2))
    good = F.filter(points, lambda p: F.try_element_at(p, F.lit(1)).isNotNull() & F.try_element_at(p, F.lit(2)).isNotNull())
    xs, ys = F.transform(good, lambda p: p[0]), F.transform(good, lambda p: p[1])
    many = box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return F.when((F.size(points) == 4) & whole, four).when(F.size(points) >= 4, many)


def box_from_dict(fields: Column) -> Column:
    """A struct of strings x, y, w, h or x1, y1, x2, y2; the first four win if all of them are there."""
    n = lambda k: fields[k].try_cast("double")
    sized = fields["x"].isNotNull() & fields["y"].isNotNull() & fields["w"].isNotNull() & fields["h"].isNotNull()
    return F.when(sized, box_from_size(n("x"), n("y"), n("w"), n("h"))).otherwise(box(n("x1"), n("y1"), n("x2"), n("y2")))


def once(value: Column, use) -> Column:
    """use(value), where value is worked out once however often it is named; lambdas do not share what is equal in them."""
    return F.transform(F.array(value), use)[0]


def box_from_json(text: Column) -> Column:
    """Whatever shape the JSON has: a dictionary, points (also of strings) or four numbers.

    As ``box_from_dict``, ``box_from_points`` and ``box_from_list``, but the JSON is read once for each box.
    """
    corners = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    at = lambda a, i: F.try_element_at(a, F.lit(i))

    def by_name(f: Column) -> Column:
        n = lambda k: f[k].try_cast("double")
        sized = f["x"].isNotNull() & f["y"].isNotNull() & f["w"].isNotNull() & f["h"].isNotNull()
        return F.when(sized, once(corners(n("x"), n("y"), n("w"), n("h")), lambda c: corners(c["x1"], c["y1"], c["x1"] + c["x2"], c["y1"] + c["y2"]))).otherwise(
            corners(n("x1"), n("y1"), n("x2"), n("y2"))
        )

    def around(points: Column) -> Column:
        pairs = F.transform(points, lambda p: F.struct(at(p, 1).try_cast("double").alias("x"), at(p, 2).try_cast("double").alias("y")))
        good = F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
        edges = once(good, lambda g: once(
            F.struct(F.transform(g, lambda p: p["x"]).alias("x"), F.transform(g, lambda p: p["y"]).alias("y")),
            lambda s: corners(F.array_min(s["x"]), F.array_min(s["y"]), F.array_max(s["x"]), F.array_max(s["y"]))
        ))
        return F.when(F.size(points) >= 4, edges)

    fields = F.from_json(text, "x string, y string, w string, h string, x1 string, y1 string, x2 string, y2 string")
    found = F.when(text.startswith("{"), once(fields, by_name)).when(
        text.rlike(r"^\[\s*\["), once(F.from_json(text, "array<array<string>>"), around)
    ).otherwise(once(F.from_json(text, "array<double>"), lambda a: F.when(F.size(a) == 4, corners(at(a, 1), at(a, 2), at(a, 3), at(a, 4)))))
    return once(found, lambda c: box(c["x1"], c["y1"], c["x2"], c["y2"]))


def deduplicate(items: DataFrame, document: str, order: str) -> DataFrame:
    """The first of the items with equal normalised text and corners to one decimal."""
    same = [document, "norm", *[tenth(F.col(c)) for c in ("x1", "y1", "x2", "y2")]]
    first = Window.partitionBy(*same).orderBy(order)
    return items.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def is_right_vertical(cx: Column, w: Column, h: Column, norm: Column, width: Column) -> Column:
    """Items of the vertical number at the right edge; false on an unknown width."""
    narrow = F.greatest(w, F.lit(1.0)) <= 0.035 * width
    tall = F.greatest(h, F.lit(1.0)) >= 1.8 * F.greatest(w, F.lit(1.0))
    digits = F.length(F.regexp_replace(norm, "[^0-9]", "")) >= 4
    return F.coalesce((cx >= 0.84 * width) & (tall | narrow | digits), F.lit(False))


def zone(right: Column, cy: Column, height: Column) -> Column:
    """right_vertical, top or bottom; everything else is bottom when the height is unknown."""
    return F.when(right, "right_vertical").when((height > 0) & (cy < height / 2), "top").otherwise("bottom")


def item_rows(ocr: DataFrame) -> DataFrame:
    """One row per usable item of OCR documents (sources.ocr.read_pages): normalised, boxed, zoned, first of equals."""
    one = ocr.select(
        "doc_id", F.try_element_at("image_shape", F.lit(1)).alias("page_h"),
        F.try_element_at("image_shape", F.lit(2)).alias("page_w"), F.posexplode("items").alias("ord", "i")
    )
    out = one.select("doc_id", "page_h", "page_w", "ord", "i.text", "i.confidence", "i.box.*").where("text IS NOT NULL AND x1 IS NOT NULL")
    # One shuffle by document serves the window and the page.
    out = out.repartition("doc_id").withColumn("norm", T.normalize_text(F.col("text")))
    out = deduplicate(out, "doc_id", "ord")
    right = is_right_vertical(F.col("cx"), F.col("w"), F.col("h"), F.col("norm"), F.col("page_w"))
    return described(out.withColumn("zone", zone(right, F.col("cy"), F.col("page_h"))))


def described(items: DataFrame) -> DataFrame:
    """Adds what fields are made of: label, dates, codes, digits and, for values, the zone's cleaned texts ('' if nothing is left)."""
    norm, zoned = F.col("norm"), F.col("zone")
    out = items.withColumn("label", F.size(T.detect_label_types(norm)) > 0)
    value = lambda z, clean: F.when(F.col("label") | (zoned != z), "").otherwise(clean(norm))
    out = out.withColumns({
        "dates": F.when(zoned != "right_vertical", T.find_dates(norm)),
        "codes": F.when(zoned == "top", T.find_department_codes(norm)),
        "digits": F.when(zoned == "right_vertical", T.document_number_digits(norm)),
        "issuer": value("top", T.clean_issued_by_line),
        "person": value("bottom", T.clean_person_line),
        "place": value("bottom", T.clean_birth_place_line),
    })
    blank = {"issuer": T.is_empty_issued_by, "person": T.is_empty_person_value, "place": T.is_empty_birth_place}
    return out.withColumns({c: F.when(test(F.col(c)), "").otherwise(F.col(c)) for c, test in blank.items()})


def pages(items: DataFrame) -> DataFrame:
    """One row per document with the items of each zone as an array."""
    one = item(**{n: F.col(n) for n in FIELDS})
    zones = [F.collect_list(F.when(F.col("zone") == z, one)).alias(z) for z in ZONES]
    return items.groupBy("doc_id").agg(F.max("page_h").alias("page_h"), F.max("page_w").alias("page_w"), *zones)


def public_items(items: DataFrame) -> DataFrame:
    """The columns of items that are shown: text, normalised text, confidence, box, zone and the two flags."""
    bounds = F.struct("x1", "y1", "x2", "y2", "cx", "cy", "w", "h").alias("bbox")
    return items.select(
        "doc_id", "ord", "text", "norm", "confidence", bounds, "zone",
        T.is_service_label(F.col("norm")).alias("is_service_label"),
        (F.col("zone") == "right_vertical").alias("is_right_vertical")
    )


def sort_items(items: Column) -> Column:
    """By (cy, cx, normalised text), earlier items first on ties."""
    keyed = F.transform(
        items,
        lambda i: F.struct(i["cy"].alias("cy"), i["cx"].alias("cx"), i["norm"].alias("norm"), i["ord"].alias("ord"), i.alias("item"))
    )
    return F.transform(F.array_sort(keyed), lambda k: k["item"])


def raw_text(items: Column) -> Column:
    """Non-empty texts by whole cy, cx and order, a line each."""
    keyed = F.transform(
        items,
        lambda i: F.struct(i["cy"].cast("int").alias("cy"), i["cx"].cast("int").alias("cx"), i["ord"].alias("ord"), i["text"].alias("text"))
    )
    return F.array_join(F.transform(F.filter(F.array_sort(keyed), lambda k: k["text"] != ""), lambda k: k["text"]), "\n")
