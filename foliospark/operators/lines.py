"""Greedy grouping of items into lines, and telling labels from values within a line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import text as T

from .items import ITEM, sort_items

LINE = f"struct<cy:double,n:int,items:array<{ITEM}>>"


def tolerance(items: Column) -> Column:
    """max(12, 0.6 times the mean height, heights of at least 1)."""
    total = F.aggregate(items, F.lit(0.0), lambda acc, i: acc + F.greatest(i["h"], F.lit(1.0)))
    return F.greatest(F.lit(12.0), total / F.greatest(F.size(items), F.lit(1)) * 0.6)


def group_lines(items: Column) -> Column:
    """Lines in the order they begin: an item joins the first line whose running mean of cy is near, else begins one."""
    tol = tolerance(items)

    def place(state: Column, item: Column) -> Column:
        lines, near = state["lines"], state["tol"]
        at = F.array_position(F.transform(lines, lambda line: F.abs(line["cy"] - item["cy"]) <= near), F.lit(True))
        new = F.struct(item["cy"].alias("cy"), F.lit(1).alias("n"), F.array(item).alias("items"))

        def joined(at: Column) -> Column:
            grown = lambda line: F.struct(
                ((line["cy"] * line["n"] + item["cy"]) / (line["n"] + 1)).alias("cy"),
                (line["n"] + 1).cast("int").alias("n"), F.concat(line["items"], F.array(item)).alias("items")
            )
            return F.transform(lines, lambda line, i: F.when(i + 1 == at, grown(line)).otherwise(line))

        # A one-element array binds the position, so it is searched for once.
        after = F.element_at(
            F.transform(F.array(at), lambda at: F.when(at == 0, F.concat(lines, F.array(new))).otherwise(joined(at)).cast(f"array<{LINE}>")),
            1
        )
        return F.struct(near.alias("tol"), after.alias("lines"))

    # The tolerance is part of the state, so it is worked out once.
    return F.aggregate(
        sort_items(items), F.struct(tol.alias("tol"), F.array().cast(f"array<{LINE}>").alias("lines")), place,
        lambda state: state["lines"]
    )


def across(items: Column) -> Column:
    """A line's items from left to right (by cx, earlier first on ties)."""
    keyed = F.transform(items, lambda i, k: F.struct(i["cx"].alias("cx"), k.alias("k"), i.alias("item")))
    return F.transform(F.array_sort(keyed), lambda x: x["item"])


def line_text(line: Column) -> Column:
    return F.array_join(F.transform(across(line["items"]), lambda i: i["norm"]), " ")


def along(line: Column) -> Column:
    """A line's items by (x1, cx), as annotation and values take them."""
    keyed = F.transform(across(line["items"]), lambda i, k: F.struct(i["x1"].alias("x1"), i["cx"].alias("cx"), k.alias("k"), i.alias("item")))
    return F.transform(F.array_sort(keyed), lambda x: x["item"])


def tallest(line: Column) -> Column:
    return F.array_max(F.transform(line["items"], lambda i: i["h"]))


def height_ratio(item: Column, most: Column) -> Column:
    return F.when((item["h"] > 0) & (most > 0), item["h"] / most)


def annotate(line: Column) -> Column:
    """Each item of the line by (x1, cx): norm, height ratio (to three decimals), font class, label types, why it is a label, whether it is a value."""
    whole, many, most = line_text(line), F.size(line["items"]) >= 2, tallest(line)

    def note(i: Column, k: Column) -> Column:
        ratio = height_ratio(i, most)
        font = T.classify_font(ratio)
        types = T.refine_label_types(T.detect_label_types(i["norm"]), i["norm"], whole)
        by_text, by_font = F.size(types) > 0, (font == "small") & (k == 0) & many
        return F.struct(
            i["norm"].alias("norm"), i["cy"].alias("cy"), i["cx"].alias("cx"),
            (F.rint(ratio * 1000) / 1000).alias("height_ratio"), font.alias("font_class"), types.alias("label_types"),
            by_text.alias("by_text"), by_font.alias("by_font"), (~(by_text | by_font)).alias("value")
        )

    return F.transform(along(line), note)


def value_items(line: Column) -> Column:
    """The items of a line that are values: no labels by their text, nor small first ones of several."""
    # Bound once: how many items there are and the tallest of them.
    bound = F.array(F.struct(along(line).alias("row"), tallest(line).alias("most")))
    chosen = lambda b: F.filter(
        b["row"],
        lambda i, k: ~(
            i["label"] | F.coalesce((T.classify_font(height_ratio(i, b["most"])) == "small") & (k == 0) & (F.size(b["row"]) >= 2), F.lit(False))
        )
    )
    return F.flatten(F.transform(bound, chosen))


def value_text(values: Column, part: Callable[[Column], Column], chars: str = " .,-") -> Column:
    """What the value items have cleaned, joined; '' if nothing."""
    return T.joined(F.filter(F.transform(values, part), lambda p: p != ""), chars)
