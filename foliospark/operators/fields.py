"""Field assembly: the ten fields of a document page from its zones' lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T

from .items import hundredth
from .lines import annotate, group_lines, line_text, value_items, value_text

FIELDS = (
    "last_name", "first_name", "middle_name", "birth_date", "sex", "birth_place", "issue_date", "department_code",
    "issued_by", "document_number"
)


def candidates(items: Column, values: str) -> Column:
    """Every one of the items' ``values`` as (cy, cx, ord, value), nearest the top left first."""
    each = F.transform(
        items,
        lambda i: F.transform(i[values], lambda v: F.struct(i["cy"].alias("cy"), i["cx"].alias("cx"), i["ord"].alias("ord"), v.alias("value")))
    )
    return F.array_sort(F.flatten(F.filter(each, lambda c: c.isNotNull())))


def first_value(found: Column) -> Column:
    return F.try_element_at(found, F.lit(1))["value"]


def prepared(page: DataFrame) -> DataFrame:
    """The page with its zones' lines: arrays of (cy, text, and what the line's value items say)."""
    top = lambda x, v: F.struct(
        hundredth(x["cy"]).alias("cy"), line_text(x).alias("text"),
        value_text(v, lambda i: i["issuer"], " .,-;:").alias("issuer")
    )
    bottom = lambda x, v: F.struct(
        hundredth(x["cy"]).alias("cy"), line_text(x).alias("text"),
        value_text(v, lambda i: i["person"]).alias("person"), value_text(v, lambda i: i["place"]).alias("place")
    )

    def lines(groups: str, shape) -> Column:
        bound = F.transform(groups, lambda x: F.struct(x.alias("line"), value_items(x).alias("values")))
        return F.transform(bound, lambda b: shape(b["line"], b["values"]))

    out = page.withColumns({"top_groups": group_lines(F.col("top")), "bottom_groups": group_lines(F.col("bottom"))})
    return out.withColumns({"top_lines": lines("top_groups", top), "bottom_lines": lines("bottom_groups", bottom)})


def top_fields(page: DataFrame) -> DataFrame:
    """issue_date, department_code and issued_by: what stands above the first date or code."""
    out = page.withColumns({"_dates": candidates(F.col("top"), "dates"), "_codes": candidates(F.col("top"), "codes")})
    edge = F.array_min(F.transform(F.concat("_dates", "_codes"), lambda c: c["cy"]))
    out = out.withColumn("_edge", edge)
    above = F.filter("top_lines", lambda line: F.col("_edge").isNull() | (line["cy"] < F.col("_edge") - 10))

    def issuer(line: Column) -> Column:
        # A line whose values say nothing is read as a whole: its label and value may be one item.
        said = F.when(T.is_empty_issued_by(line["issuer"]), T.clean_issued_by_line(line["text"])).otherwise(line["issuer"])
        bound = F.transform(F.array(said), lambda t: F.when(T.is_empty_issued_by(t), "").otherwise(t))
        return F.element_at(bound, 1)

    said = F.filter(F.transform(above, issuer), lambda p: p != "")
    return out.withColumns(
        {
            "issue_date": first_value(F.col("_dates")), "department_code": first_value(F.col("_codes")),
            "issued_by": F.nullif(T.joined(said, " .,-;:"), F.lit(""))
        }
    ).drop("_dates", "_codes", "_edge")


def first_line(lines: Column, word: str) -> Column:
    """Place of the first line with the word, from 1; null if none."""
    return F.nullif(F.array_position(F.transform(lines, lambda line: line["text"].rlike(rf"(?U){word}(?<!\w{word})\b")), F.lit(True)), F.lit(0))


def nearest_line(lines: Column, cy: Column) -> Column:
    """Place of the line nearest to cy, the earliest on a tie, from 1; null without lines."""
    return F.array_min(F.transform(lines, lambda line, i: F.struct(F.abs(line["cy"] - cy).alias("d"), (i + 1).alias("i"))))["i"]


def bottom_fields(page: DataFrame) -> DataFrame:
    """Names between their labels, birth date, sex on its line and the birth place below it.

    Without a label the last and first name are the first two lines above the date that say anything as a whole.
    """
    lines = F.col("bottom_lines")
    out = page.withColumn("_date", F.try_element_at(candidates(F.col("bottom"), "dates"), F.lit(1)))
    at = {
        "_d": F.when(F.col("_date").isNotNull(), nearest_line(lines, F.col("_date")["cy"])),
        "_last": first_line(lines, "ФАМИЛИЯ"), "_first": first_line(lines, "ИМЯ"),
        "_middle": first_line(lines, "ОТЧЕСТВО")
    }
    out = out.withColumns({k: v.cast("int") for k, v in at.items()})
    size, day = F.size("bottom_lines"), F.col("_d")

    def between(start: Column, stop: Column, otherwise: Column) -> Column:
        """Parts of the lines start..stop-1; ``otherwise`` without a start."""
        end = F.coalesce(stop, size + 1)
        return F.when(start.isNull(), otherwise).otherwise(
            F.transform(F.slice("bottom_lines", F.greatest(start, F.lit(1)), F.greatest(end - start, F.lit(0))), lambda line: line["person"])
        )

    whole = F.transform(F.slice("bottom_lines", 1, F.greatest(F.coalesce(day - 1, size), F.lit(0))), lambda line: T.clean_person_line(line["text"]))
    unlabelled = F.col("_last").isNull() | F.col("_first").isNull()
    out = out.withColumn("_above", F.when(unlabelled, F.filter(whole, lambda p: ~T.is_empty_person_value(p))))
    nth = lambda n: F.slice("_above", n, 1)
    parts = {
        "_names": between(F.col("_last"), F.coalesce("_first", day), nth(1)),
        "_firsts": between(F.col("_first"), F.coalesce("_middle", day), nth(2)),
        "_middles": between(F.col("_middle"), day, F.array().cast("array<string>")),
        "_places": F.when(
            day.isNotNull(),
            F.filter(
                F.transform(F.slice("bottom_lines", F.coalesce(day, F.lit(0)) + 1, F.greatest(size - day, F.lit(0))), lambda line: line["place"]),
                lambda p: p != ""
            )
        ),
    }
    out = out.withColumns(parts)
    return out.withColumns({
        "last_name": T.join_person_parts(F.col("_names")),
        "first_name": T.join_person_parts(F.col("_firsts")),
        "middle_name": T.join_person_parts(F.col("_middles")),
        "birth_date": F.col("_date")["value"],
        "sex": F.when(day.isNotNull(), T.extract_sex(F.try_element_at(lines, day)["text"])),
        "birth_place": F.nullif(T.normalize_birth_place_value(F.array_join("_places", " ")), F.lit("")),
    }).drop("_date", "_d", "_last", "_first", "_middle", "_above", *parts)


def number_candidate(items: Column) -> Column:
    """The digits of the items from the top left on; the first ten of at least ten, formatted."""
    keyed = F.array_sort(
        F.transform(items, lambda i: F.struct(i["cy"].alias("cy"), i["cx"].alias("cx"), i["ord"].alias("ord"), i["digits"].alias("digits")))
    )
    return T.format_document_number(F.left(F.array_join(F.transform(keyed, lambda k: k["digits"]), ""), F.lit(10)))


def number_consensus(top: Column, bottom: Column, none: Column) -> Column:
    """value and status of the two copies of the number; ``none``: there were no items at all."""
    value = F.when(top.isNotNull() & bottom.isNotNull(), F.when(top == bottom, top)).otherwise(F.coalesce(top, bottom))
    status = F.when(none, "no_right_vertical_items").when(top == bottom, "matched_top_bottom").when(
        top.isNotNull() & bottom.isNotNull(), "conflict_top_bottom"
    ).when(value.isNotNull(), "single_candidate").otherwise("not_found")
    return F.struct(value.alias("value"), status.alias("status"))


def document_number(page: DataFrame) -> DataFrame:
    right, half = F.col("right_vertical"), F.col("page_h") / 2
    top = F.filter(right, lambda i: i["cy"] < half)
    low = F.filter(right, lambda i: ~F.coalesce(i["cy"] < half, F.lit(False)))
    got = number_consensus(number_candidate(top), number_candidate(low), F.size(right) == 0)
    return page.withColumns({"document_number": got["value"], "document_number_status": got["status"]})


def extract(page: DataFrame) -> DataFrame:
    """doc_id, the ten fields and the number's status, from pages (operators.items.pages)."""
    return document_number(bottom_fields(top_fields(prepared(page)))).select("doc_id", *FIELDS, "document_number_status")


def layout(page: DataFrame) -> DataFrame:
    """doc_id, zone, line (from 1), cy, text and each item's annotation: the diagnostic view, a row per item."""
    every = None
    for zone in ("top", "bottom", "right_vertical"):
        lines = F.transform(
            group_lines(F.col(zone)),
            lambda x: F.struct(hundredth(x["cy"]).alias("cy"), line_text(x).alias("text"), annotate(x).alias("notes"))
        )
        one = page.select("doc_id", F.lit(zone).alias("zone"), F.posexplode(lines).alias("line", "l")).select(
            "doc_id", "zone", (F.col("line") + 1).alias("line"), "l.cy", "l.text",
            F.posexplode("l.notes").alias("item", "n")
        )
        one = one.select(
            "doc_id", "zone", "line", "cy", "text", (F.col("item") + 1).alias("item"), "n.norm", "n.height_ratio",
            "n.font_class", "n.label_types", "n.by_text", "n.by_font", "n.value"
        )
        every = one if every is None else every.union(one)
    return every


def diagnostics(page: DataFrame) -> DataFrame:
    """The page's split, zone counts, right margin and all dates and codes outside the vertical number."""
    count = lambda c: F.size(c).alias(f"{c}_items")
    rest = F.concat("top", "bottom")
    out = page.select(
        "doc_id", "page_h", "page_w", (F.col("page_h") * 0.5).alias("split_y"),
        hundredth(F.col("page_w") * 0.84).alias("right_min_cx"),
        *[count(z) for z in ("top", "bottom", "right_vertical")], candidates(rest, "dates").alias("_dates"),
        candidates(F.col("top"), "codes").alias("_codes")
    )
    values = lambda c: F.transform(c, lambda x: x["value"])
    return out.select("*", values("_dates").alias("dates"), values("_codes").alias("top_codes")).drop("_dates", "_codes")
