"""The library's queries over the driver's tables, and the DuckDB SQL that states each result.

The tables hold no recognised pages, so inputs are derived: pages and labels from customers, numbers and
dates from orders, boxes from line items, lines from conversation turns, components from parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import candidates, fields, items, lines, validate
from foliospark.sources import ocr
from foliospark.streaming import queue

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LETTERS = "translate(cast(c_custkey AS {s}), '0123456789', 'АБВГДЖЗИКЛ')"


def layouts(k: str) -> list[tuple]:
    """Text, box and condition of the items of a customer's page; ``c_custkey % 6`` says what is unlike the whole page:

    0 nothing, 1 no labels of the first two names, 2 no birth date, 3 the numbers differ, 4 neither issue date nor
    code, 5 issuer and label in one item and no number.
    """
    key = LETTERS.format(s="string")
    return [
        ("'ПАСПОРТ ВЫДАН'", 50, 40, 200, 60, f"{k} <> 5"), ("'ОТДЕЛОМ MBД ГОР.ТЕСТОВСКА'", 250, 35, 700, 65, f"{k} <> 5"), (
            "'ПАСПОРТ ВЫДАН ОТДЕЛОМ MBД ГОР.ТЕСТОВСКА'", 50, 35, 700, 65, f"{k} = 5"
        ),
        ("'ДАТА ВЫДАЧИ'", 50, 190, 180, 205, "true"), ("'28.02.' || (1990 + c_custkey % 30)", 200, 185, 340, 215, f"{k} <> 4"),
        ("'КОД ПОДРАЗДЕЛЕНИЯ'", 360, 190, 520, 205, "true"), (
            "lpad(c_nationkey, 3, '0') || '-' || lpad(c_custkey % 1000, 3, '0')", 540, 185, 700, 215, f"{k} <> 4"
        ),
        ("'ФАМИЛИЯ'", 300, 795, 380, 810, f"{k} <> 1"), (
            f"'ТЕСТОВ' || {key}", 400, 785, 600, 815, "true"
        ), ("'ИМЯ'", 300, 855, 340, 870, f"{k} <> 1"), (f"'TECT' || {key}", 400, 845, 560, 875, "true"),
        ("'ОТЧЕСТВО'", 300, 915, 390, 930, "true"), ("'ТЕСТОВИЧ'", 400, 905, 560, 935, "true"), ("'ПОЛ'", 300, 975, 330, 990, "true"), (
            "CASE WHEN c_custkey % 2 = 0 THEN 'МУЖ.' ELSE 'ЖЕН.' END", 350, 965, 420, 995, "true"
        ),
        ("'ДАТА РОЖДЕНИЯ'", 440, 975, 560, 990, "true"), (
            "'31.01.' || (1950 + c_custkey % 50)", 600, 965, 760, 995, f"{k} <> 2"
        ), ("'МЕСТО РОЖДЕНИЯ'", 300, 1035, 420, 1050, "true"), ("'ГОП.ТЕСТОВСК'", 440, 1025, 640, 1055, "true"),
        ("lpad(c_custkey, 10, '4')", 940, 200, 960, 500, f"{k} <> 5"), (
            f"translate(lpad(c_custkey, 10, CASE WHEN {k} = 3 THEN '5' ELSE '4' END), '0', 'О')", 940, 900, 960, 1200,
            f"{k} <> 5"
        ),
    ]


def customer_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a recognised page of 1000 by 1400 pixels for each customer."""
    each = [
        f"CASE WHEN {there} THEN named_struct('text', {t}, 'x1', {a}D, 'y1', {b}D, 'x2', {c}D, 'y2', {d}D) END" for t, a, b, c, d, there in layouts("c_custkey % 6")
    ]
    ocr_ = read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS doc_id", "array(1400, 1000) AS image_shape", f"array_compact(array({', '.join(each)})) AS raw"
    )
    one = lambda r: F.struct(
        r["text"].alias("text"), F.lit(None).cast("double").alias("confidence"),
        items.box(r["x1"], r["y1"], r["x2"], r["y2"]).alias("box")
    )
    return items.item_rows(ocr_.withColumn("items", F.transform("raw", one)))


def customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.pages(customer_items(spark, sf_dir))


_KEY = LETTERS.format(s="varchar")
_FIELDS_SQL = f"""
SELECT c_custkey AS doc_id, 'ТЕСТОВ' || {_KEY} AS last_name, 'ТЕСТ' || {_KEY} AS first_name, CASE WHEN k = 2 THEN 'ТЕСТОВИЧ ГОП ТЕСТОВСК' ELSE 'ТЕСТОВИЧ' END AS middle_name,
  CASE WHEN k <> 2 THEN (1950 + c_custkey % 50) || '-01-31' END AS birth_date, CASE WHEN k = 2 THEN NULL WHEN c_custkey % 2 = 0 THEN 'МУЖ' ELSE 'ЖЕН' END AS sex, CASE WHEN k <> 2 THEN 'ГОР. ТЕСТОВСК' END AS birth_place,
  CASE WHEN k <> 4 THEN (1990 + c_custkey % 30) || '-02-28' END AS issue_date, CASE WHEN k <> 4 THEN lpad(c_nationkey::varchar, 3, '0') || '-' || lpad((c_custkey % 1000)::varchar, 3, '0') END AS department_code,
  'ОТДЕЛОМ МВД ГОР. ТЕСТОВСКА' AS issued_by, CASE WHEN k NOT IN (3, 5) THEN lpad(c_custkey::varchar, 10, '4')[1:4] || ' ' || lpad(c_custkey::varchar, 10, '4')[5:10] END AS document_number,
  CASE k WHEN 3 THEN 'conflict_top_bottom' WHEN 5 THEN 'no_right_vertical_items' ELSE 'matched_top_bottom' END AS document_number_status
FROM (SELECT *, c_custkey % 6 AS k FROM customer)
"""


@query(_FIELDS_SQL)
def extract_fields(spark, sf_dir):
    return fields.extract(customer_pages(spark, sf_dir))


flagship = extract_fields


@query("""
SELECT c_custkey AS doc_id, CASE WHEN k IN (2, 4) THEN 'error' WHEN k IN (3, 5) THEN 'warning' ELSE 'ok' END AS status, CASE k WHEN 2 THEN 3 WHEN 4 THEN 2 ELSE 0 END AS errors_count, CASE WHEN k IN (3, 5) THEN 1 ELSE 0 END AS warnings_count
FROM (SELECT *, c_custkey % 6 AS k FROM customer)""")
def validate_extracted(spark, sf_dir):
    v = validate.validate(extract_fields(spark, sf_dir))
    return v.select("doc_id", "validation.status", "validation.summary.errors_count", "validation.summary.warnings_count")


@query("""
SELECT c_custkey AS doc_id, CASE WHEN k IN (2, 4) THEN 'error' WHEN k IN (3, 5) THEN 'warning' ELSE 'ok' END AS status, 'r' || c_custkey AS request_id,
  CASE k WHEN 2 THEN 'birth_date:missing_required_field,sex:missing_required_field,birth_place:missing_required_field' WHEN 4 THEN 'issue_date:missing_required_field,department_code:missing_required_field' ELSE '' END AS errors,
  CASE WHEN k IN (3, 5) THEN 'document_number:missing_document_number' ELSE '' END AS warnings, CASE k WHEN 2 THEN 7 WHEN 4 THEN 8 WHEN 3 THEN 9 WHEN 5 THEN 9 ELSE 10 END AS fields_found
FROM (SELECT *, c_custkey % 6 AS k FROM customer)""")
def result_summaries(spark, sf_dir):
    v = validate.validate(extract_fields(spark, sf_dir))
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("r"), "c_custkey").alias("request_id"))
    told = validate.add_request_id(validate.summaries(v), asked)
    return told.select(
        "doc_id", "request_id", "status", F.array_join("errors", ",").alias("errors"),
        F.array_join("warnings", ",").alias("warnings"), "fields_found"
    )


def _broken(spark, sf_dir):
    """Fields of customers with one fault each, by key modulo 6."""
    k = F.col("c_custkey") % 6
    whole = {
        "last_name": F.when(k == 1, "X1").otherwise("ТЕСТОВ"), "first_name": F.lit("ТЕСТ"),
        "middle_name": F.lit(None).cast("string"), "birth_date": F.when(k == 2, "31.01.2099").otherwise("2099-01-31"),
        "sex": F.when(k == 3, "X").otherwise("МУЖ"), "birth_place": F.when(k == 4, "  ").otherwise("С. НОВОЕ"),
        "issue_date": F.lit("2099-02-28"), "department_code": F.when(k == 5, "12-3").otherwise("999-999"),
        "issued_by": F.lit("ОТДЕЛОМ"), "document_number": F.when(k == 0, "9999 999999").when(k == 5, "9999-99999")
    }
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), *[v.alias(n) for n, v in whole.items()])


@query("""
WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 6 AS k FROM customer)
SELECT doc_id, 'warning' AS severity, 'last_name' AS field, 'suspicious_name_format' AS code, 'Name field contains unexpected characters' AS message, 'X1' AS value FROM c WHERE k = 1
UNION ALL SELECT doc_id, 'error', 'birth_date', 'invalid_date_format', 'Expected YYYY-MM-DD', '31.01.2099' FROM c WHERE k = 2
UNION ALL SELECT doc_id, 'error', 'sex', 'invalid_sex_value', 'Expected МУЖ, ЖЕН, М or Ж', 'X' FROM c WHERE k = 3
UNION ALL SELECT doc_id, 'error', 'birth_place', 'missing_required_field', 'Required field is missing', '  ' FROM c WHERE k = 4
UNION ALL SELECT doc_id, 'error', 'department_code', 'invalid_department_code_format', 'Expected 000-000', '12-3' FROM c WHERE k = 5
UNION ALL SELECT doc_id, 'warning', 'document_number', 'missing_document_number', 'Document number is missing; field is currently debug/validation only', NULL FROM c WHERE k NOT IN (0, 5)
UNION ALL SELECT doc_id, 'warning', 'document_number', 'invalid_document_number_format', 'Expected 0000 000000', '9999-99999' FROM c WHERE k = 5""")
def validate_issues(spark, sf_dir):
    return validate.issues(validate.validate(_broken(spark, sf_dir)))


@query("""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM (SELECT doc_id, replace(upper(translate(translate(replace(coalesce(text, ''), 'ё', 'е'), 'ABCEHKMOPTXYabcehkmoptxyΔδΛλ', 'АВСЕНКМОРТХУАВСЕНКМОРТХУДДЛЛ'), '–—«»"`''’', '--')), 'ẞ', 'SS') AS text FROM documents))
SELECT doc_id, t AS norm, regexp_replace(t, '[^А-ЯA-Z0-9]+', '', 'g') AS compact FROM d""")
def normalize_text(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("norm"))
    return d.select("doc_id", "norm", T.compact_text(F.col("norm")).alias("compact"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS first_date, 2 AS n_dates FROM orders")
def date_candidates(spark, sf_dir):
    text = F.concat(F.lit("ВЫДАН "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" И "), F.date_format("o_orderdate", "dd/MM-yyyy"))
    found = T.find_dates(text)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.element_at(found, 1).alias("first_date"), F.size(found).alias("n_dates"))


@query("SELECT c_custkey, lpad((c_custkey % 1000)::varchar, 3, '0') || '-' || lpad(c_nationkey::varchar, 3, '0') AS code FROM customer")
def department_codes(spark, sf_dir):
    sep = F.element_at(F.array(F.lit("-"), F.lit(" "), F.lit("")), (F.col("c_custkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit("КОД "), F.lpad(F.col("c_custkey") % 1000, 3, "0"), sep, F.lpad("c_nationkey", 3, "0"), F.lit(" 1234567"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.explode(T.find_department_codes(text)).alias("code"))


_NUMBER = "lpad(((o_orderkey * 7919) % 10000000000)::varchar, 10, '0')"


@query(f"SELECT o_orderkey, {_NUMBER} AS digits, {_NUMBER}[1:4] || ' ' || {_NUMBER}[5:10] AS number FROM orders")
def document_number_format(spark, sf_dir):
    seen = F.translate(F.lpad((F.col("o_orderkey") * 7919) % 10_000_000_000, 10, "0"), "01358", "ОlЗSВ")
    digits = T.document_number_digits(seen)
    return read(spark, sf_dir, "orders").select("o_orderkey", digits.alias("digits"), T.format_document_number(digits).alias("number"))


@query("""
WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'T' || (o_custkey % 3) END AS t, CASE WHEN o_orderkey % 7 <> 0 THEN 'T' || (o_orderkey % 3) END AS b FROM orders)
SELECT o_orderkey, CASE WHEN t IS NULL THEN b WHEN b IS NULL OR t = b THEN t END AS value,
  CASE WHEN t = b THEN 'matched_top_bottom' WHEN t IS NOT NULL AND b IS NOT NULL THEN 'conflict_top_bottom' WHEN coalesce(t, b) IS NULL THEN 'not_found' ELSE 'single_candidate' END AS status FROM n""")
def document_number_consensus(spark, sf_dir):
    top = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("T"), F.col("o_custkey") % 3))
    low = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("T"), F.col("o_orderkey") % 3))
    got = fields.number_consensus(top, low, F.lit(False))
    return read(spark, sf_dir, "orders").select("o_orderkey", got["value"].alias("value"), got["status"].alias("status"))


#: Raw text, its label types, whether it is a service label, sex, and what the cleaners leave.
GOLDEN = (
    ("Паспорт выдан", "issued_by_label", True, None, "", "ПАСПОРТ ВЫДАН", "ПАСПОРТ ВЫДАН"),
    ("ФАМИЛИЯ ТЕСТОВ", "last_name_label", True, None, "ФАМИЛИЯ ТЕСТОВ", "ТЕСТОВ", "ФАМИЛИЯ ТЕСТОВ"),
    ("ИМЯ", "first_name_label", True, None, "ИМЯ", "", "ИМЯ"),
    ("дата рождения 31.01.2099", "birth_date_label", True, None, "РОЖДЕНИЯ", "", ""),
    ("пол муж. 31.01.2099", "", True, "МУЖ", "ПОЛ МУЖ", "", ""),
    ("Ж 31.01.2099", "", False, "Ж", "Ж", "Ж", "Ж"),
    ("МЕСТО РОЖДЕНИЯ ГОП.ТЕСТОВСК", "birth_place_label", True, None, "МЕСТО РОЖДЕНИЯ ГОП.ТЕСТОВСК", "ГОП ТЕСТОВСК", "ГОР. ТЕСТОВСК"),
    ("Г О Р. ТЕСТОВСК", "", False, None, "ГОР. ТЕСТОВСК", "ГОР ТЕСТОВСК", "ГОР. ТЕСТОВСК"),
    ("КОД ПОДРАЗДЕЛЕНИЯ 999-999", "department_code_label", True, None, "", "КОД ПОДРАЗДЕЛЕНИЯ", "КОД ПОДРАЗДЕЛЕНИЯ"),
)
_lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v + "'"
_GOLDEN_SQL = ", ".join(f"({i}, {', '.join(map(_lit, row))})" for i, row in enumerate(GOLDEN))


@query(f"""
SELECT c_custkey, types, service, sex, issuer, person, place FROM customer
JOIN (VALUES {_GOLDEN_SQL}) g(i, raw, types, service, sex, issuer, person, place) ON g.i = c_custkey % {len(GOLDEN)}""")
def classify_and_clean(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(r[0]) for r in GOLDEN]), (F.col("c_custkey") % len(GOLDEN) + 1).cast("int"))
    n = F.col("norm")
    c = read(spark, sf_dir, "customer").select("c_custkey", T.normalize_text(raw).alias("norm"))
    return c.select(
        "c_custkey", F.array_join(T.detect_label_types(n), ",").alias("types"), T.is_service_label(n).alias("service"),
        T.extract_sex(n).alias("sex"), T.clean_issued_by_line(n).alias("issuer"),
        T.clean_person_line(n).alias("person"), T.clean_birth_place_line(n).alias("place")
    )


@query("""
SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey)::double AS x1, greatest(l_partkey, l_suppkey)::double AS x2, l_linenumber::double AS y1, l_linenumber + l_quantity AS y2,
  (l_partkey + l_suppkey) / 2.0::double AS cx, abs(l_partkey - l_suppkey)::double AS w, l_quantity AS h FROM lineitem""")
def bbox_normalize(spark, sf_dir):
    x, y, u, v = F.col("l_partkey").cast("double"), F.col("l_linenumber").cast("double"), F.col("l_suppkey").cast("double"), F.col("l_linenumber") + F.col("l_quantity")
    shape = F.col("l_orderkey") % 3
    # The shapes are columns, as a reader gives them.
    given = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"), shape.alias("shape"),
        F.when(shape == 1, F.array(u, y, x, v)).alias("numbers"),
        F.when(shape == 2, F.array(F.array(x, y), F.array(u, y), F.array(u, v), F.array(x, v))).alias("points")
    )
    b = F.when(
        F.col("shape") == 0, items.box(F.col("x"), F.col("v"), F.col("u"), F.col("y"))
    ).when(F.col("shape") == 1, items.box_from_list(F.col("numbers"))).otherwise(items.box_from_points(F.col("points")))
    return given.select("l_orderkey", "l_linenumber", b.alias("b")).select(
        "l_orderkey", "l_linenumber", "b.x1", "b.x2", "b.y1", "b.y2", "b.cx", "b.w", "b.h"
    )


@query("""
SELECT l_orderkey AS doc_id, l_returnflag AS norm, min(l_linenumber) AS ord FROM lineitem GROUP BY l_orderkey, l_returnflag, floor(l_quantity / 10)""")
def dedup_first_wins(spark, sf_dir):
    q = F.floor(F.col("l_quantity") / 10).cast("double")
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("norm"), q.alias("x1"), (q + 0.04).alias("y1"),
        q.alias("x2"), q.alias("y2"), F.col("l_linenumber").alias("ord")
    )
    return items.deduplicate(rows, "doc_id", "ord").select("doc_id", "norm", "ord")


def turn_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversation turns laid out as items: a line each newline, jittered so that lines come near each other."""
    t = read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        F.posexplode(F.split("text", "\n")).alias("ln", "line")
    )
    w = t.select("doc_id", "ln", F.posexplode(F.split("line", " ")).alias("wn", "word")).where("word <> ''")
    long, cy = F.length("word"), (40 * F.col("ln") + (7 * F.col("doc_id") + 5 * F.col("wn")) % 27 + 12).cast("double")
    return w.select(
        "doc_id", "word", (60 * F.col("wn") + 5 * long).cast("double").alias("cx"), cy.alias("cy"),
        (10.0 * long).alias("w"), F.lit(24.0).alias("h"), (F.col("ln") * 100000 + F.col("wn")).cast("int").alias("ord")
    )


_LAYOUT = r"""
lines AS (SELECT conv_id * 1000 + turn AS doc_id, str_split(text, chr(10)) AS ls FROM conversations),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS ln FROM lines),
ws AS (SELECT doc_id, ln, str_split(line, ' ') AS w FROM l),
x AS (SELECT doc_id, ln, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS wn FROM ws),
item AS (SELECT doc_id, word, (60 * wn + 5 * length(word))::double AS cx, (40 * ln + (7 * doc_id + 5 * wn) % 27 + 12)::double AS cy, ln * 100000 + wn AS ord, 10.0 * length(word) AS w FROM x WHERE word <> '')
"""


@query(f"""
WITH {_LAYOUT},
sorted AS (SELECT doc_id, list(struct_pack(cy := cy, o := rn, cx := cx) ORDER BY rn) AS s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cy, cx, word, ord) AS rn FROM item) GROUP BY doc_id),
seed AS (SELECT doc_id, list_transform(s, lambda i: [struct_pack(cy := i.cy, n := 1)]) AS s FROM sorted),
folded AS (SELECT doc_id, list_reduce(s, lambda acc, i: CASE WHEN len(list_filter(acc, lambda z: abs(z.cy - i[1].cy) <= 14.4)) = 0 THEN list_concat(acc, i)
  ELSE list_transform(acc, lambda z, k: CASE WHEN k = list_position(list_transform(acc, lambda q: abs(q.cy - i[1].cy) <= 14.4), true) THEN struct_pack(cy := (z.cy * z.n + i[1].cy) / (z.n + 1), n := z.n + 1) ELSE z END) END) AS g FROM seed),
each AS (SELECT doc_id, unnest(g) AS z, generate_subscripts(g, 1) AS line FROM folded)
SELECT doc_id, line::int AS line, z.cy AS cy, z.n::int AS n FROM each""")
def group_lines(spark, sf_dir):
    i = turn_items(spark, sf_dir)
    one = items.item(text=F.col("word"), norm=F.col("word"), **{c: F.col(c) for c in ("cx", "cy", "w", "h", "ord")})
    page = i.groupBy("doc_id").agg(F.collect_list(one).alias("all"))
    return page.select(
        "doc_id", F.posexplode(lines.group_lines(F.col("all"))).alias("p", "g")
    ).select("doc_id", (F.col("p") + 1).cast("int").alias("line"), "g.cy", "g.n")


@query(f"""
WITH {_LAYOUT}
SELECT doc_id, ord, CASE WHEN cx >= 840 AND (24 >= 1.8 * greatest(w, 1) OR w <= 35 OR length(regexp_replace(word, '[^0-9]', '', 'g')) >= 4) THEN 'right_vertical' WHEN cy < 100 THEN 'top' ELSE 'bottom' END AS zone FROM item""")
def zone_assign(spark, sf_dir):
    i = turn_items(spark, sf_dir)
    right = items.is_right_vertical(F.col("cx"), F.col("w"), F.col("h"), F.col("word"), F.lit(1000.0))
    return i.select("doc_id", F.col("ord").cast("long").alias("ord"), items.zone(right, F.col("cy"), F.lit(200.0)).alias("zone"))


@query(f"""
WITH {_LAYOUT}, m AS (SELECT *, length(word) / max(length(word)) OVER (PARTITION BY doc_id)::double AS r FROM item)
SELECT doc_id, ord, CASE WHEN r <= 0.45 THEN 'small' WHEN r >= 0.80 THEN 'large' ELSE 'normal' END AS font_class FROM m""")
def font_class(spark, sf_dir):
    i = turn_items(spark, sf_dir)
    ratio = F.length("word") / F.max(F.length("word")).over(Window.partitionBy("doc_id"))
    return i.select("doc_id", F.col("ord").cast("long").alias("ord"), T.classify_font(ratio).alias("font_class"))


@query(
    f"WITH {_LAYOUT} SELECT doc_id, arg_min(word, (cy, cx, ord)) AS first_word, string_agg(word, chr(10) ORDER BY cy::int, cx::int, ord) AS raw_text FROM item GROUP BY doc_id"
)
def first_geo_and_raw_text(spark, sf_dir):
    i = turn_items(spark, sf_dir)
    one = F.struct("cy", "cx", "ord", F.col("word").alias("text"))
    return i.groupBy("doc_id").agg(
        F.min_by("word", F.struct("cy", "cx", "ord")).alias("first_word"),
        items.raw_text(F.collect_list(one)).alias("raw_text")
    )


@query("""
WITH c AS (SELECT p_partkey, p_size % 10 AS image_id, p_size / 100.0::double AS fill, (p_partkey % 97) / 97.0::double AS aspect, (p_partkey % 31) / 31.0::double AS distance FROM part),
s AS (SELECT *, fill * 2.0::double - abs(aspect - 0.7::double) - distance * 0.5::double AS score FROM c WHERE p_partkey % 20 <> 0)
SELECT image_id, p_partkey AS label_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, p_partkey)::int AS rank FROM s QUALIFY rank <= 8""")
def component_topk(spark, sf_dir):
    p = F.col("p_partkey")
    c = read(spark, sf_dir, "part").select(
        (F.col("p_size") % 10).alias("image_id"), p.alias("label_id"), (F.col("p_size") / 100.0).alias("fill"),
        ((p % 97) / 97.0).alias("aspect"), ((p % 31) / 31.0).alias("distance"),
        F.when(p % 20 == 0, 0.01).otherwise(0.5).alias("area_share")
    )
    return candidates.top_components(c, 8).select("image_id", "label_id", "rank")


@query("""
WITH c AS (SELECT p_partkey // 40 AS image_id, ((p_partkey // 2) % 4)::int AS rotation, p_partkey % 37 AS x, p_partkey % 41 AS y, p_partkey % 2 AS kind, ((p_partkey * 13) % 100) / 100.0::double AS a, ((p_partkey * 29) % 100) / 100.0::double AS b FROM part),
m AS (SELECT image_id, rotation, x, y, 10 AS w, 10 AS h, kind, CASE WHEN kind = 0 THEN 0.3 + 0.5 * a ELSE 0.14 + 0.5 * a END AS wr, CASE WHEN kind = 0 THEN 0.02 ELSE 0.2 END AS hr, 0.1 + 0.6 * b AS cx, CASE WHEN kind = 0 THEN 0.3 + 0.4 * b ELSE 0.5 + 0.4 * b END AS cy, CASE WHEN kind = 0 THEN 5.5 + 10 * a ELSE 0.5 + 3 * b END AS asp FROM c),
f AS (SELECT *, (1 - least(abs(cy - 0.5) / 0.15, 1)) * 4 + least((wr - 0.30) / 0.45, 1) * 3 + least((asp - 6) / 12, 1) * 2 - hr * 2 AS fs FROM m WHERE wr >= 0.3 AND cy BETWEEN 0.35 AND 0.65 AND asp >= 6 AND hr <= 0.12),
f5 AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY image_id, rotation ORDER BY fs DESC, y, x) <= 5),
p AS (SELECT * FROM m WHERE wr BETWEEN 0.14 AND 0.7 AND hr BETWEEN 0.1 AND 0.6 AND asp BETWEEN 0.35 AND 4.5 AND cx <= 0.68),
j AS (SELECT f5.image_id, f5.rotation, f5.x AS fx, f5.y AS fy, p.x AS px, p.y AS py, 3 * fs + 4 * (3 * least((p.cy - f5.cy) * 4, 2) + 3 * (1 - least(abs(p.cx - 0.28) / 0.45, 1)) + 2 * least((p.wr + p.hr) * 4, 2.5) + 2 * (1 - least(abs(p.asp - 1.2) / 3, 1))) AS total
  FROM f5 JOIN p ON p.image_id = f5.image_id AND p.rotation = f5.rotation AND p.cy > f5.cy + 0.06 AND NOT (abs(p.x - f5.x) < 5 AND abs(p.y - f5.y) < 5))
SELECT image_id, rotation, round(total, 6) AS total FROM j QUALIFY row_number() OVER (PARTITION BY image_id, rotation ORDER BY total DESC, fy, fx, py, px) = 1""")
def marker_layouts(spark, sf_dir):
    p = F.col("p_partkey")
    a, b, fold = ((p * 13) % 100) / 100.0, ((p * 29) % 100) / 100.0, p % 2 == 0
    c = read(spark, sf_dir, "part").select(
        F.floor(p / 40).alias("image_id"), (F.floor(p / 2) % 4).cast("int").alias("rotation"), (p % 37).alias("x"), (p % 41).alias("y"), F.lit(10).alias("w"), F.lit(10).alias("h"),
        F.when(fold, 0.3 + 0.5 * a).otherwise(0.14 + 0.5 * a).alias("width_ratio"), F.when(fold, 0.02).otherwise(0.2).alias("height_ratio"), (0.1 + 0.6 * b).alias("center_x_ratio"),
        F.when(fold, 0.3 + 0.4 * b).otherwise(0.5 + 0.4 * b).alias("center_y_ratio"), F.when(fold, 5.5 + 10 * a).otherwise(0.5 + 3 * b).alias("aspect"),
    )
    return candidates.marker_layouts(c).select("image_id", "rotation", F.round("total", 6).alias("total"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::int AS position FROM events")
def fifo_order(spark, sf_dir):
    return queue.fifo(read(spark, sf_dir, "events"), ("ts", "event_id"), "user_id").select("event_id", "position")


@query("""
SELECT user_id, count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS errors, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at, arg_max(event_id, (ts, event_id)) AS last_request_id,
  strftime(max(ts) FILTER (event_type <> 'error'), '%Y-%m-%d %H:%M:%S') AS last_ok, strftime(max(ts) FILTER (event_type = 'error'), '%Y-%m-%d %H:%M:%S') AS last_error, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'pipeline_error' END AS last_error_status FROM events GROUP BY user_id""")
def service_status(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("request_id"), F.col("ts").alias("finished_at"),
        F.when(F.col("event_type") == "error", "pipeline_error").otherwise("ok").alias("outcome")
    )
    s = queue.service_status(log, "user_id")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return s.select(
        "user_id", "processed", "errors", at("last_finished_at").alias("last_at"), "last_request_id",
        at("last_success_at").alias("last_ok"), at("last_error_at").alias("last_error"), "last_error_status"
    )


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::date < (SELECT max(o_orderdate)::date FROM orders) - 30")
def retention_days(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    today = o.agg(F.max(F.to_date("o_orderdate")).alias("today"))
    listing = o.select("o_orderkey", F.to_date("o_orderdate").alias("day")).crossJoin(F.broadcast(today))  # one row
    return queue.expired_by_days(listing, F.col("today"), 30).select("o_orderkey")


@query("""
SELECT o_orderkey FROM (SELECT o_orderkey, sum(o_totalprice::bigint) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kept FROM (SELECT * REPLACE (floor(o_totalprice) AS o_totalprice) FROM orders)) WHERE kept > 500000""")
def archive_eviction(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    listing = o.select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").alias("day"), F.col("o_orderdate").alias("mtime"),
        F.col("o_orderkey").alias("path"), F.floor("o_totalprice").alias("size_bytes")
    )
    return queue.expired_by_size(listing, 500_000, "o_custkey").select("o_orderkey")


@query("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'r' || page_id ELSE 'p' || page_id END AS request_id, CASE WHEN page_id % 2 = 0 THEN '/in/' || page_id || '.png' ELSE page_id || '.jpg' END AS image,
  CASE WHEN page_id % 3 = 0 THEN 'r' || page_id ELSE 'p' || page_id END || '.json' AS output FROM pages""")
def resolve_commands(spark, sf_dir):
    p = F.col("page_id")
    c = read(spark, sf_dir, "pages").select(
        "page_id", F.when(p % 3 == 0, F.concat(F.lit("r"), p)).otherwise("").alias("request_id"),
        F.when(p % 2 == 0, F.concat(F.lit("/in/"), p, F.lit(".png"))).alias("image_path"),
        F.concat(p, F.lit(".jpg")).alias("image_file"), F.lit("").alias("output_path"),
        F.lit(None).cast("string").alias("output_file"), F.concat(F.lit("p"), p, F.lit(".json")).alias("file_name")
    )
    return ocr.resolve_command(c).select("page_id", "request_id", "image", "output")


@query("""
SELECT c_custkey AS case_id, 'sex' AS field, CASE WHEN c_custkey % 3 <> 0 THEN 'A' END AS actual, CASE WHEN c_custkey % 5 <> 0 THEN 'A' END AS expected, (c_custkey % 3 = 0) = (c_custkey % 5 = 0) AS ok FROM customer""")
def compare_cases(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.lit("sex").alias("field"))
    a, e = (c.withColumn("value", F.when(F.col("case_id") % n != 0, "A")) for n in (3, 5))
    return validate.compare_fields(a, e).select("case_id", "field", "actual", "expected", "ok")


# Shapes in which engines give items, written as JSON from line items and read back.

_CORNERS = "least(l_partkey, l_suppkey)::double AS x1, greatest(l_partkey, l_suppkey)::double AS x2, l_linenumber::double AS y1, l_linenumber + l_quantity AS y2"


def _said(text: str, *values: str) -> str:
    """SQL of the text with the values for each of its ~; joined in generated code, where format_string makes a formatter for each row."""
    parts = [f"'{p}'" for p in text.split("~")]
    return "concat(" + ", ".join(x for pair in zip(parts, [f"coalesce(string({v}), 'null')" for v in values] + ["''"]) for x in pair) + ")"


def _line_json(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    """A document for each order: its line items as JSON items whose box has the shape (SQL over l_partkey, l_suppkey, l_linenumber, l_quantity)."""
    one = f"struct(l_linenumber, {shape} AS item)"
    grouped = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.expr(f"sort_array(collect_list({one}))").alias("rows")  # array_sort compares by a lambda, which is not generated code
    )
    return grouped.select("doc_id", F.concat(F.lit("["), F.array_join("rows.item", ","), F.lit("]")).alias("list"))


def _line_boxes(documents: DataFrame) -> DataFrame:
    # Spark asks explode's array first whether it is empty, and works it out again for that; the outer form is not asked.
    got = ocr.parse_pages(documents).select("doc_id", F.explode_outer("items").alias("i")).where("i IS NOT NULL")
    return got.select(
        F.col("doc_id").alias("l_orderkey"), F.col("i.text").cast("int").alias("l_linenumber"), "i.confidence",
        *[f"i.box.{c}" for c in ("x1", "x2", "y1", "y2")]
    )


_P, _S, _N = "l_partkey", "l_suppkey", "l_linenumber"
_LOW = f"({_N} + l_quantity)"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 0.5 END AS confidence, {_CORNERS} FROM lineitem")
def dict_boxes(spark, sf_dir):
    """Boxes as dictionaries: corners as strings, or a corner and a size."""
    half = f"CASE WHEN {_N} % 2 = 0 THEN '0.5' ELSE '0.0' END", f"CASE WHEN {_N} % 2 = 0 THEN '0.5' ELSE 'null' END"
    corners = _said('{"label":"~","score":~,"box":{"x1":"~","y1":~,"x2":~,"y2":~}}', _N, half[0], _P, _N, _S, _LOW)
    sized = _said('{"text":"~","rec_score":~,"bbox":{"x":~,"y":~,"w":~,"h":~}}', _N, half[1], _S, _N, f"{_P} - {_S}", "l_quantity")
    d = _line_json(spark, sf_dir, f"CASE WHEN {_P} % 2 = 0 THEN {corners} ELSE {sized} END")
    return _line_boxes(d.select("doc_id", F.concat(F.lit('{"items":'), "list", F.lit("}")).alias("value")))


@query(f"SELECT l_orderkey, l_linenumber, 0.25 AS confidence, {_CORNERS} FROM lineitem")
def legacy_items(spark, sf_dir):
    """Pairs of a polygon and [text, score]; some coordinates are strings."""
    pair = _said('[[["~",~],[~,~],[~,~],[~,~]],["~",0.25]]', _P, _N, _S, _N, _S, _LOW, _P, _LOW, _N)
    return _line_boxes(_line_json(spark, sf_dir, pair).select("doc_id", F.col("list").alias("value")))


@query(f"SELECT l_orderkey, l_linenumber, CAST(NULL AS DOUBLE) AS confidence, {_CORNERS} FROM lineitem")
def recursive_items(spark, sf_dir):
    """Items that only a search of the whole document finds: ``items`` is there, but says nothing."""
    one = _said('{"found":{"value":"~","dt_poly":[[~,~],[~,~],[~,~],[~,~]]}}', _N, _P, _N, _S, _N, _S, _LOW, _P, _LOW)
    d = _line_json(spark, sf_dir, one)
    return _line_boxes(d.select("doc_id", F.concat(F.lit('{"items":[{"text":"no box"}],"pages":[{"rows":'), "list", F.lit("}]}")).alias("value")))


@query(f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, '[' || l_partkey || ',' || l_linenumber || ',' || l_suppkey || ',' || (l_linenumber + l_quantity) || ']') AS place FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN place = 1 THEN 0.75 END AS confidence, {_CORNERS} FROM n WHERE place <= 3""")
def parallel_arrays(spark, sf_dir):
    """Texts, scores and boxes side by side; texts beyond the boxes, here three, are dropped and scores may end early."""
    l = read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS doc_id", "l_linenumber", f"format_string('[%d,%d,%d,%s]', {_P}, {_N}, {_S}, string({_LOW})) AS b"
    )
    g = l.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "b"))).alias("r"))
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    texts, boxes = listed(
        F.transform("r", lambda x: F.concat(F.lit('"'), x["l_linenumber"], F.lit('"')))
    ), listed(F.transform(F.slice("r", 1, 3), lambda x: x["b"]))
    return _line_boxes(
        g.select(
            "doc_id",
            F.concat(
                F.lit('{"result":{"rec_texts":'), texts, F.lit(',"rec_scores":[0.75],"dt_polys":[],"dt_boxes":'), boxes,
                F.lit("}}")
            ).alias("value")
        )
    )


@query(
    "SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 10 WHEN 2 THEN p_size END AS page_h, CASE p_partkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 20 WHEN 2 THEN 9 END AS page_w FROM part"
)
def page_shapes(spark, sf_dir):
    """A page's size from the first of six places that has two numbers."""
    n, size = F.col("p_partkey") % 4, F.col("p_size")
    value = F.when(
        n == 0, F.format_string('{"image_shape":[%d,7,3],"shape":[1,2]}', size)
    ).when(n == 1, F.lit('{"image_shape":[5],"metadata":{"shape":[10,20]}}')).when(n == 2, F.format_string('{"shape":null,"input_shape":[%d,9]}', size)).otherwise(F.lit('{"metadata":{}}'))
    got = ocr.parse_pages(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), value.alias("value")))
    return got.select("doc_id", F.try_element_at("image_shape", F.lit(1)).alias("page_h"), F.try_element_at("image_shape", F.lit(2)).alias("page_w"))


@query("""
SELECT l_orderkey AS doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_tax, l_returnflag, floor(l_discount * 100), l_quantity) - 1)::int AS id, l_linenumber AS page_index, l_returnflag AS text, l_tax AS score, floor(l_discount * 100)::int AS left_, (floor(l_discount * 100) + l_quantity)::int AS right_ FROM lineitem""")
def engine_items(spark, sf_dir):
    """An engine's pages, here a page for each line number: ids run on over a document's pages, boxes come from polygons where they are missing."""
    l = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_index"),
        F.struct("l_tax", "l_returnflag", F.floor(F.col("l_discount") * 100).cast("double").alias("d"), F.col("l_quantity").alias("q")).alias("r")
    )
    rows = l.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    box = lambda r: F.when(F.col("page_index") % 2 == 0, F.array(r["d"], F.lit(0.9), r["d"] + r["q"] + 0.5, F.lit(4.0)))
    poly = lambda r: F.array(
        F.array(r["d"] + 0.25, F.lit(0.0)), F.array(r["d"] + r["q"], F.lit(0.0)),
        F.array(r["d"] + r["q"] + 0.75, F.lit(3.5)), F.array(r["d"], F.lit(3.0))
    )
    each = {"rec_texts": lambda r: r["l_returnflag"], "rec_scores": lambda r: r["l_tax"], "rec_boxes": box, "rec_polys": poly}
    got = ocr.engine_items(rows.select("doc_id", "page_index", *[F.transform("rows", f).alias(n) for n, f in each.items()]))
    return got.select("doc_id", "id", "page_index", "text", "score", F.get("bbox", F.lit(0)).alias("left_"), F.get("bbox", F.lit(2)).alias("right_"))


# Diagnostic views of the customers' pages.


@query("""
SELECT c_custkey AS doc_id, 1400 AS page_h, 1000 AS page_w, 700.0::double AS split_y, 840.0::double AS right_min_cx, CASE k WHEN 4 THEN 4 WHEN 5 THEN 5 ELSE 6 END AS top_items, CASE k WHEN 1 THEN 10 WHEN 2 THEN 11 ELSE 12 END AS bottom_items, CASE WHEN k = 5 THEN 0 ELSE 2 END AS right_vertical_items,
  concat_ws(',', CASE WHEN k <> 4 THEN (1990 + c_custkey % 30) || '-02-28' END, CASE WHEN k <> 2 THEN (1950 + c_custkey % 50) || '-01-31' END) AS dates, CASE WHEN k <> 4 THEN lpad(c_nationkey::varchar, 3, '0') || '-' || lpad((c_custkey % 1000)::varchar, 3, '0') ELSE '' END AS top_codes
FROM (SELECT *, c_custkey % 6 AS k FROM customer)""")
def page_diagnostics(spark, sf_dir):
    d = fields.diagnostics(customer_pages(spark, sf_dir))
    return d.withColumns({c: F.array_join(c, ",") for c in ("dates", "top_codes")})


@query("""
WITH c AS (SELECT *, c_custkey % 6 AS k FROM customer)
SELECT c_custkey AS doc_id, CASE WHEN k = 1 THEN 4 ELSE 4 END AS line, 3 AS item, 'ДАТА РОЖДЕНИЯ' AS norm, 0.5::double AS height_ratio, 'normal' AS font_class, 'birth_date_label' AS label_types, true AS by_text, false AS by_font, false AS value FROM c
UNION ALL SELECT c_custkey, 4, 1, 'ПОЛ', 0.5, 'normal', 'sex_label', true, false, false FROM c
UNION ALL SELECT c_custkey, 4, 2, CASE WHEN c_custkey % 2 = 0 THEN 'МУЖ.' ELSE 'ЖЕН.' END, 1.0, 'large', '', false, false, true FROM c
UNION ALL SELECT c_custkey, 4, 4, '31.01.' || (1950 + c_custkey % 50), 1.0, 'large', '', false, false, true FROM c WHERE k <> 2""")
def layout_analysis(spark, sf_dir):
    """The annotation of the line with the birth date."""
    l = fields.layout(customer_pages(spark, sf_dir)).where("zone = 'bottom' AND line = 4")
    return l.select(
        "doc_id", "line", "item", "norm", "height_ratio", "font_class",
        F.array_join("label_types", ",").alias("label_types"), "by_text", "by_font", "value"
    )


@query("""
SELECT c_custkey AS doc_id, 'ФАМИЛИЯ' AS norm, 300.0::double AS x1, 15.0::double AS h, 'bottom' AS zone, true AS is_service_label, false AS is_right_vertical FROM customer WHERE c_custkey % 6 <> 1
UNION ALL SELECT c_custkey, 'ТЕСТОВИЧ', 400.0, 30.0, 'bottom', false, false FROM customer
UNION ALL SELECT c_custkey, lpad(c_custkey::varchar, 10, '4'), 940.0, 300.0, 'right_vertical', false, true FROM customer WHERE c_custkey % 6 <> 5""")
def public_items(spark, sf_dir):
    p = items.public_items(customer_items(spark, sf_dir))
    shown = F.col("norm").isin("ФАМИЛИЯ", "ТЕСТОВИЧ") | (F.col("is_right_vertical") & (F.col("bbox.cy") < 700))
    return p.where(shown).select("doc_id", "norm", "bbox.x1", "bbox.h", "zone", "is_service_label", "is_right_vertical")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ТЕСТ ОВ' WHEN 1 THEN 'ОВ' WHEN 2 THEN 'А-Б' END AS name FROM customer")
def person_parts(spark, sf_dir):
    n = F.col("c_custkey") % 4
    parts = F.when(
        n == 0, F.array(F.lit("ТЕСТ 12"), F.lit("ИМЯ"), F.lit("ОВ"))
    ).when(n == 1, F.array(F.lit("МУЖ."), F.lit("-ОВ-"))).when(n == 2, F.array(F.lit(" А-Б "), F.lit("7"))).otherwise(F.array(F.lit("ПОЛ"), F.lit("X")))
    return read(spark, sf_dir, "customer").select("c_custkey", T.join_person_parts(parts).alias("name"))


# Image geometry.


@query("""
WITH c AS (SELECT p_partkey, p_size % 10 AS image_id, (p_partkey % 4)::int AS rotation, p_partkey % 37 AS x, p_partkey % 41 AS y, ((p_partkey * 7) % 100) / 100.0::double AS wr, ((p_partkey * 11) % 30) / 100.0::double AS hr, ((p_partkey * 13) % 100) / 100.0::double AS cy, ((p_partkey * 17) % 300) / 10.0::double AS asp, ((p_partkey * 19) % 40) / 10000.0::double AS ar FROM part),
s AS (SELECT *, wr * 4 + least(asp / 10, 2) + least(ar * 150, 2) + (1 - least(abs(cy - 0.5) * 2, 1)) * 0.75 - hr * 2 AS score FROM c WHERE ar >= 0.0001 AND wr >= 0.18 AND asp >= 2.5 AND hr <= 0.25),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, rotation, y, x)::int AS rank FROM s QUALIFY rank <= 8)
SELECT image_id, rank, round(score, 6) AS score, CASE WHEN rank = 1 THEN round(greatest(least(score / 7, 1), 0), 6) END AS confidence FROM r""")
def red_fold_lines(spark, sf_dir):
    p = F.col("p_partkey")
    c = read(spark, sf_dir, "part").select(
        (F.col("p_size") % 10).alias("image_id"), (p % 4).cast("int").alias("rotation"), (p % 37).alias("x"),
        (p % 41).alias("y"), ((p * 7) % 100 / 100.0).alias("width_ratio"),
        ((p * 11) % 30 / 100.0).alias("height_ratio"), ((p * 13) % 100 / 100.0).alias("center_y_ratio"),
        ((p * 17) % 300 / 10.0).alias("aspect"), ((p * 19) % 40 / 10000.0).alias("area_ratio")
    )
    got = candidates.red_fold_lines(c)
    return got.select("image_id", "rank", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


@query("""
WITH c AS (SELECT p_partkey, (p_partkey % 300)::double AS x, (p_size * 20)::double AS bw FROM part),
t AS (SELECT *, round_even(bw * 1.10, 0) / 2 AS half, x + bw / 2 AS mid FROM c),
e AS (SELECT *, greatest(0, round_even(mid - half, 0))::int AS l, least(1000, round_even(mid + half, 0))::int AS r FROM t)
SELECT p_partkey, CASE WHEN bw >= 300 AND r > l AND r - l <= 980 THEN l END AS left_, CASE WHEN bw >= 300 AND r > l AND r - l <= 980 THEN r END AS right_ FROM e""")
def crop_intervals(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_partkey") % 300).cast("double").alias("x"),
        (F.col("p_size") * 20).cast("double").alias("bw")
    )
    got = candidates.crop_interval(F.col("x"), F.col("bw"), F.lit(1000))
    return p.select("p_partkey", got["left"].alias("left_"), got["right"].alias("right_"))


@query(
    "SELECT image_id, rotation, round(total, 6) AS total FROM (SELECT p_size % 20 AS image_id, (p_partkey % 4)::int AS rotation, ((p_partkey * 31) % 50)::double AS total FROM part) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY total DESC, rotation) = 1"
)
def best_orientation(spark, sf_dir):
    p = F.col("p_partkey")
    return candidates.best_orientation(
        read(spark, sf_dir, "part").select(
            (F.col("p_size") % 20).alias("image_id"), (p % 4).cast("int").alias("rotation"),
            ((p * 31) % 50).cast("double").alias("total")
        )
    )


@query(
    "SELECT p_partkey, 0.0::double AS tlx, (p_size + 1)::double AS tr_x, (p_partkey + 5)::double AS bry, 1.0::double AS blx, CASE WHEN greatest(p_size, p_partkey) > 100 THEN 100.0::double / greatest(p_size, p_partkey) ELSE 1.0 END AS scale FROM part"
)
def corners_and_scale(spark, sf_dir):
    w, h = F.col("p_size").cast("double"), F.col("p_partkey").cast("double")
    point = lambda x, y: F.array(x, y)
    zero = F.lit(0.0)
    o = candidates.corner_order(F.array(point(w + 1, h + 5), point(zero, zero), point(F.lit(1.0), h + 5), point(w + 1, F.lit(0.5))))
    return read(spark, sf_dir, "part").select(
        "p_partkey", o[0][0].alias("tlx"), o[1][0].alias("tr_x"), o[2][1].alias("bry"), o[3][0].alias("blx"),
        candidates.resize_scale(F.col("p_size"), F.col("p_partkey"), 100).alias("scale")
    )


# The queue.


@query("""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'given.png' WHEN 1 THEN 'c' || page_id || '.jpeg' WHEN 2 THEN 'c' || page_id || '.jpg' END AS image, page_id % 4 IN (1, 2) AS exists_ FROM pages""")
def image_fallback(spark, sf_dir):
    """Images found by the command's own name, in the order of kinds; one named by the command need not exist."""
    p, n = F.col("page_id"), F.col("page_id") % 4
    none = F.lit(None).cast("string")
    c = ocr.resolve_command(
        read(spark, sf_dir, "pages").select(
            "page_id", F.lit("").alias("request_id"), none.alias("image_path"),
            F.when(n == 0, "given.png").alias("image_file"), none.alias("output_path"), none.alias("output_file"),
            F.concat(F.lit("c"), p, F.lit(".json")).alias("file_name")
        )
    )
    kinds = F.when(n == 1, F.array(F.lit(".png"), F.lit(".jpeg"))).when(
        n == 2, F.array(F.lit(".jpg"), F.lit(".png"), F.lit(".jpeg"))
    ).otherwise(F.array(F.lit(".bmp")))
    listing = read(spark, sf_dir, "pages").select(F.explode(F.transform(kinds, lambda k: F.concat(F.lit("c"), p, k))).alias("name"))
    return ocr.resolve_images(c, listing).select("page_id", "image", F.col("exists").alias("exists_"))


@query("""
SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN 'command_error' WHEN event_id % 5 = 0 THEN 'input_error' WHEN event_id % 3 = 0 THEN 'pipeline_error' WHEN event_id % 2 = 0 THEN 'ok' ELSE 'validation_error' END AS outcome FROM events""")
def route_outcomes(spark, sf_dir):
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        "event_id",
        queue.outcome(F.when(e % 2 == 0, "ok").otherwise("warning"), e % 11 == 0, e % 7 != 0, e % 5 != 0, e % 3 == 0).alias("outcome")
    )


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, floor(o_totalprice)::bigint AS size, o_orderdate::date < (SELECT max(o_orderdate)::date FROM orders) - 400 AS old FROM orders),
n AS (SELECT *, sum(size) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kept FROM o WHERE NOT old)
SELECT o_orderkey, 'days' AS reason FROM o WHERE old UNION ALL SELECT o_orderkey, 'size' FROM n WHERE kept > 300000""")
def cleanup_archive(spark, sf_dir):
    """What retention takes from each customer's archive: by days first, then by size."""
    o = read(spark, sf_dir, "orders")
    today = o.agg(F.max(F.to_date("o_orderdate")).alias("today"))
    # one row
    listing = o.select(
        "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderdate").alias("mtime"),
        F.col("o_orderkey").alias("path"), F.floor("o_totalprice").alias("size_bytes")
    ).crossJoin(F.broadcast(today))
    return queue.archive_removals(listing, F.col("today"), 400, 300_000, "o_custkey").select("o_orderkey", "reason")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAY")
def expired_results(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    now = o.agg(F.max("o_orderdate").alias("now"))
    # one row
    return queue.expired_results(
        o.select("o_orderkey", F.col("o_orderdate").alias("mtime")).crossJoin(F.broadcast(now)), F.col("now"), 7
    ).select("o_orderkey")


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') || '/' || strftime(o_orderdate, '%Y-%m-%d') || '/' || CASE WHEN o_orderkey % 3 = 0 THEN 'request' WHEN o_orderkey % 3 = 1 THEN 'a_b-' || o_orderkey ELSE 'Заказ.' || o_orderkey END AS path FROM orders"
)
def archive_paths(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, "..").when(k % 3 == 1, F.concat(F.lit("_a/b-"), k)).otherwise(F.concat(F.lit("Заказ."), k, F.lit(".")))
    return read(spark, sf_dir, "orders").select("o_orderkey", queue.archive_path(name, F.col("o_orderdate")).alias("path"))


# Expected and actual results.


@query("""
SELECT c_custkey AS case_id, 'validation' AS field, CAST(NULL AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS actual FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, 'validation.status', 'ok', 'error' FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'validation.summary.errors_count', '0', '2' FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 = 0""")
def compare_validation(spark, sf_dir):
    k = F.col("case_id")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"))
    v = F.struct(
        F.when(k % 3 == 0, "error").otherwise("ok").alias("status"),
        F.struct(F.when(k % 3 == 0, 2).otherwise(0).alias("errors_count"), F.lit(7).alias("warnings_count")).alias("summary")
    )
    return validate.compare_validation(
        c.where(k % 5 != 0).withColumn("validation", v),
        c.select("case_id", F.lit("ok").alias("status"), F.lit(0).alias("errors_count"), F.lit(None).cast("int").alias("warnings_count"))
    )


@query("""
SELECT c_custkey AS case_id, CASE WHEN k = 0 THEN 'ok' WHEN k = 5 THEN 'failed' WHEN k = 3 THEN 'failed' WHEN k = 1 THEN 'ok' WHEN k = 2 THEN 'failed' ELSE 'missing_input' END AS status,
  CASE k WHEN 2 THEN 'birth_place,validation.status' WHEN 3 THEN 'document_number,validation.status' WHEN 5 THEN 'document_number,validation.status' ELSE '' END AS fields FROM (SELECT *, c_custkey % 6 AS k FROM customer)""")
def run_cases(spark, sf_dir):
    """Extracted fields against expected values and formats, case by case; cases of kind 4 have no input."""
    got = validate.validate(extract_fields(spark, sf_dir)).where("doc_id % 6 <> 4").withColumnRenamed("doc_id", "case_id")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"))
    none = F.lit(None).cast("string")
    want = c.select(
        "case_id", F.lit("birth_place").alias("field"), F.lit("ГОР. ТЕСТОВСК").alias("value"), none.alias("pattern")
    ).union(c.select("case_id", F.lit("document_number"), none, F.lit(r"\d{4} \d{6}")))
    checks = c.select(
        "case_id", F.lit("ok").alias("status"), F.lit(None).cast("int").alias("errors_count"),
        F.lit(None).cast("int").alias("warnings_count")
    )
    return validate.run_cases(got, want, checks).select(
        "case_id", "status", F.array_join(F.transform("errors", lambda e: e["field"]), ",").alias("fields")
    )


@query("""
SELECT 'r' || c_custkey AS request_id, CAST(NULL AS VARCHAR) AS last_name, 'error' AS status, '__service__' AS field, 'service_failed' AS code, 'no image' AS message, 'input' AS value, 1 AS errors_count, 'input' AS failed_stage FROM customer""")
def error_results(spark, sf_dir):
    r = validate.error_results(
        read(spark, sf_dir, "customer").select(F.concat(F.lit("r"), "c_custkey").alias("request_id")),
        F.lit("no image"), F.lit("input")
    )
    e = F.get("validation.errors", F.lit(0))
    return r.select(
        "request_id", "last_name", "validation.status", e["field"].alias("field"), e["code"].alias("code"),
        e["message"].alias("message"), e["value"].alias("value"), "validation.summary.errors_count",
        "pipeline.failed_stage"
    )
