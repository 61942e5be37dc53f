"""Queries against DuckDB on the smallest tables, golden texts, sources and the queue."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark import catalogue
from foliospark.functions import text as T
from foliospark.operators import candidates, items
from foliospark.sources import ocr
from foliospark.streaming import queue

SF = "/root/testdata/sf0.001"


def canonical(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    got = catalogue.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical(got.select(*columns).collect()) == canonical(want.fetchall())


PLACES = [
    ("ГОР.ТЕСТОВСК", "ГОР. ТЕСТОВСК"), ("ГОР. ТЕСТОВСК", "ГОР. ТЕСТОВСК"), ("ГОP.ТЕСТОВСК", "ГОР. ТЕСТОВСК"),
    ("ГОП.ТЕСТОВСК", "ГОР. ТЕСТОВСК"), ("ФОП.ТЕСТОВСК", "ГОР. ТЕСТОВСК"), ("Г0Р.ТЕСТОВСК", "ГОР. ТЕСТОВСК"),
    ("Г О Р. ТЕСТОВСК", "ГОР. ТЕСТОВСК"), ("Г О П. ТЕСТОВСК", "ГОР. ТЕСТОВСК"),
    ("МЕСТО РОЖДЕНИЯ ГОП.ТЕСТОВСК", "ГОР. ТЕСТОВСК"), ("С. НОВОЕ", "С. НОВОЕ"), ("Р-Н ТЕСТОВСКИЙ", "Р-Н ТЕСТОВСКИЙ")
]


def test_golden_birth_places(spark):
    rows = spark.createDataFrame(PLACES, "raw string, want string").select(
        "raw", "want", T.clean_birth_place_line(T.normalize_text(F.col("raw"))).alias("clean"),
        T.normalize_birth_place_value(T.normalize_text(F.col("raw"))).alias("value")
    ).collect()
    assert [r.clean for r in rows] == [r.want for r in rows]
    assert all(r.value == r.want for r in rows if not r.raw.startswith("МЕСТО"))
    empty = spark.createDataFrame([(x,) for x in ("", "МЕСТО РОЖДЕНИЯ", "ДАТА РОЖДЕНИЯ", "ПОЛ", "МУЖ")], "raw string")
    assert all(r[0] for r in empty.select(T.is_empty_birth_place(T.clean_birth_place_line(T.normalize_text(F.col("raw"))))).collect())


def test_normalisation_repeats_and_nulls(spark):
    df = spark.createDataFrame(
        [(None,), ("",), ("  Ёлка «ﬁ»  ",), ("Г О Р .ТЕСТ",), ("ΔΛ—x",)], "raw string"
    ).select(T.normalize_text(F.col("raw")).alias("n")).select("n", T.normalize_text(F.col("n")).alias("again")).collect()
    assert [r.n for r in df] == [r.again for r in df] and df[0].n == ""


def test_boxes(spark):
    df = spark.sql("SELECT array(5D, 6D, 1D, 2D) AS l, array(array(1D, 2D), array(5D, 2D), array(5D, 6D), array(1D, 6D)) AS p")
    r = df.select(
        items.box_from_list(F.col("l")).alias("a"), items.box_from_points(F.col("p")).alias("b"),
        items.box_from_size(F.lit(1.0), F.lit(2.0), F.lit(4.0), F.lit(4.0)).alias("c"),
        items.box_from_list(F.array(F.lit(1.0))).alias("none"), candidates.corner_order(F.col("p")).alias("o")
    ).first()
    assert r.a == r.b == r.c and r.none is None and r.o == [[1, 2], [5, 2], [5, 6], [1, 6]]
    x = spark.range(1).select(
        candidates.crop_interval(F.lit(100), F.lit(500), F.lit(1000)).alias("c"),
        candidates.crop_interval(F.lit(0), F.lit(100), F.lit(1000)).alias("short"),
        candidates.resize_scale(F.lit(4000), F.lit(1000), 2000).alias("s")
    ).first()
    assert (x.c.left, x.c.right, x.short, x.s) == (75, 625, None, 0.5)


def test_ocr_source(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        json.dumps(
            {
                "image_shape": [1400, 1000],
                "items": [
                    {"text": "ИМЯ", "bbox": [1, 2, 3, 4]}, {"text": "", "label": "X", "bbox": [1, 2, 3, 4]},
                    {"text": "ИМЯ", "bbox": [1.01, 2, 3, 4]}
                ]
            }
        )
    )
    (tmp_path / "b.json").write_text(
        "﻿" + json.dumps(
            {"metadata": {"shape": [10, 20]}, "rec_texts": ["A", "B"], "rec_scores": [0.5], "dt_polys": [[[0, 0], [2, 0], [2, 2], [0, 2]]]}
        )
    )
    (tmp_path / "c.json").write_text("{broken")
    pages = ocr.read_pages(spark, str(tmp_path))
    rows = items.item_rows(pages).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.norm, r.x2, r.page_h) for r in rows] == [("a", "ИМЯ", 3.0, 1400), ("a", "Х", 3.0, 1400), ("b", "А", 2.0, 10)]
    assert [r.doc_id for r in pages.collect() if r._corrupt_record] == ["c"]


def test_queue_runs_each_request_once(spark, tmp_path):
    source, log, check = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "check")
    source.mkdir()
    (source / "1.json").write_text('{"request_id": "r1", "image_file": "a.jpg"}')
    (source / "2.json").write_text("{bad")
    (source / "3.json").write_text('{"request_id": "r1", "image_file": "a.jpg"}')
    (source / "4.json.tmp").write_text("{}")

    def process(rows):
        o = queue.outcome(F.lit("ok"), F.col("_corrupt_record").isNotNull(), F.col("image").isNotNull(), F.lit(True), F.lit(False))
        return rows.select("request_id", o.alias("outcome"))

    for _ in range(2):
        queue.run(queue.read_stream(spark, str(source)), process, log, check).awaitTermination()
    done = spark.read.parquet(log).where("state = 'done'").select("request_id", "outcome").collect()
    assert sorted(map(tuple, done)) == [("2", "command_error"), ("r1", "ok")]


def test_entry_has_all_queries():
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def component(**given):
    whole = {
        "image_id": 1, "rotation": 0, "x": 0, "y": 0, "w": 10, "h": 10, "width_ratio": 0.5, "height_ratio": 0.02,
        "center_x_ratio": 0.5, "center_y_ratio": 0.5, "aspect": 18.0
    }
    return whole | given


#: Worked by hand: center 4, width 3 * 0.2 / 0.45, shape 2, minus 0.04.
FOLD = 4 + 3 * 0.2 / 0.45 + 2 - 0.04
PHOTO = {
    "x": 100, "y": 700, "w": 200, "h": 300, "width_ratio": 0.3, "height_ratio": 0.3, "center_x_ratio": 0.28,
    "center_y_ratio": 0.8, "aspect": 1.2
}


@pytest.mark.parametrize(("fold", "photo", "total"), [
    ({}, {}, 3 * FOLD + 4 * (1.2 * 3 + 3 + 2.4 * 2 + 2)),
    ({}, {"center_y_ratio": 0.56}, None),  # not below: 0.06 itself is too near
    ({}, {"center_y_ratio": 0.5601}, 3 * FOLD + 4 * (4 * 0.0601 * 3 + 3 + 4.8 + 2)),
    ({"center_y_ratio": 0.35}, {"center_y_ratio": 1.2}, 3 * (FOLD - 4) + 4 * (2.0 * 3 + 3 + 4.8 + 2)),  # below stops at 2
    ({"width_ratio": 0.2999}, {}, None),
    ({"width_ratio": 0.30}, {}, 3 * (4 + 2 - 0.04) + 4 * 13.4),
    ({"width_ratio": 0.9}, {}, 3 * (4 + 3 + 2 - 0.04) + 4 * 13.4),
    ({"aspect": 6.0}, {}, 3 * (FOLD - 2) + 4 * 13.4),
    ({"aspect": 5.99}, {}, None),
    ({"height_ratio": 0.12}, {}, 3 * (FOLD - 0.2) + 4 * 13.4),
    ({"height_ratio": 0.121}, {}, None),
    ({"center_y_ratio": 0.66}, {}, None),
    ({}, {"width_ratio": 0.14}, 3 * FOLD + 4 * (3.6 + 3 + 4 * 0.44 * 2 + 2)),
    ({}, {"width_ratio": 0.139}, None),
    ({}, {"width_ratio": 0.7}, 3 * FOLD + 4 * (3.6 + 3 + 2.5 * 2 + 2)),  # size stops at 2.5
    ({}, {"height_ratio": 0.61}, None),
    ({}, {"aspect": 4.5}, 3 * FOLD + 4 * (3.6 + 3 + 4.8)),
    ({}, {"aspect": 4.51}, None),
    ({}, {"center_x_ratio": 0.68}, 3 * FOLD + 4 * (3.6 + 3 * (1 - 0.4 / 0.45) + 4.8 + 2)),
    ({}, {"center_x_ratio": 0.681}, None),
])
def test_marker_gates(spark, fold, photo, total):
    rows = [component(**fold), component(**(PHOTO | photo))]
    got = candidates.marker_layouts(spark.createDataFrame(rows)).collect()
    assert [r.total for r in got] == ([] if total is None else [pytest.approx(total)])


def test_a_fold_is_not_its_own_photo(spark):
    one = component(width_ratio=0.5, height_ratio=0.12, aspect=6.0, center_y_ratio=0.4, center_x_ratio=0.28)
    # Almost the same place but below and of a photo's shape: it counts from 5 pixels off in any number.
    for off, n in ((4, 0), (5, 1)):
        other = one | {"x": off, "aspect": 4.0, "center_y_ratio": 0.6, "height_ratio": 0.15, "width_ratio": 0.2}
        assert candidates.marker_layouts(spark.createDataFrame([one, other])).count() == n


def test_wide_digits_are_digits(spark):
    got = spark.createDataFrame(
        [("１２３４ ５６７８９０",), ("12З4 O67B9Q",), (None,)], "t string"
    ).select(T.document_number_digits(F.col("t")).alias("d")).collect()
    assert [r.d for r in got] == ["1234567890", "1234067890", ""]


def test_values_over_items_are_normalised_together(spark):
    got = spark.createDataFrame(
        [(["ОТДЕЛ Г", "О", "Р. А"],), (["ФОП", "ТЕСТ"],), ([],)], "p array<string>"
    ).select(T.joined(F.col("p"), " .,-").alias("t")).collect()
    assert [r.t for r in got] == ["ОТДЕЛ ГОР. А", "ГОР. ТЕСТ", ""]


def test_files(spark, tmp_path):
    import datetime as dt
    import os

    from foliospark.streaming import files

    f = tmp_path / "a.json"
    files.save_json(f, {"k": "я"})
    assert files.read_json(f) == {"k": "я"} and files.read_json(tmp_path / "none") == {}
    (tmp_path / "bad.json").write_text("{")
    assert "read_error" in files.read_json(tmp_path / "bad.json") and not list(tmp_path.glob("*.tmp"))
    assert files.delete_file(tmp_path / "bad.json") and not files.delete_file(tmp_path / "bad.json") and not files.delete_file(None)
    one = files.claim(f, tmp_path / "processing")
    assert one == tmp_path / "processing" / "a.json" and files.claim(f, tmp_path / "processing") is None
    files.save_json(f, {})
    assert files.claim(f, tmp_path / "processing").name.startswith("a_")
    assert [p.parent.name for p in files.move_stale(tmp_path / "processing", tmp_path / "error")] == ["stale_processing"] * 2
    assert files.move_file(tmp_path / "gone", tmp_path) is None
    (tmp_path / "x_crop.jpg").write_bytes(b"1")
    assert files.find_crop(tmp_path, "other.jpg").name == "x_crop.jpg"
    (tmp_path / "y_crop.jpg").write_bytes(b"1")
    with pytest.raises(FileNotFoundError):
        files.find_crop(tmp_path, "other.jpg")

    now = dt.datetime(2026, 5, 17, 12)
    paths = [tmp_path / n for n in ("i", "c", "r")]
    for day in (1, 15, 16, 17):
        for p in paths:
            p.write_bytes(b"x" * 100)
        files.archive_case(tmp_path / "archive", "case", *paths, when=now.replace(day=day))
    again = files.archive_case(tmp_path / "archive", "case", *paths, when=now)
    assert again.name == "case_120000" and {p.name for p in again.iterdir()} == {"input.jpg", "command.json", "result.json"}
    got = files.cleanup_archive(spark, tmp_path / "archive", 10, 700 / (1 << 30), today=now.date())
    assert [
        p.split("/")[-2] for p in got["removed_by_days"]
    ] == ["2026-05-01"] and [p.split("/")[-2] for p in got["removed_by_size"]] == ["2026-05-15", "2026-05-16"]
    assert sorted(p.name for p in (tmp_path / "archive" / "2026-05").iterdir()) == ["2026-05-17"]

    old = tmp_path / "out" / "old.json"
    files.save_json(old, {})
    files.save_json(tmp_path / "out" / "new.json", {})
    os.utime(old, (1, 1))
    assert files.cleanup_results(tmp_path / "out", 0) == [] and files.cleanup_results(tmp_path / "out", 7) == [old]

    lock = files.ServiceLock(tmp_path / "lock")
    with pytest.raises(RuntimeError):
        files.ServiceLock(tmp_path / "lock")
    lock.release()
    files.ServiceLock(tmp_path / "lock").release()
    files.heartbeat(tmp_path / "status.json", {"status": "running"})
    assert "last_heartbeat_at" in files.read_json(tmp_path / "status.json")
    log = files.configure_logging(tmp_path / "logs" / "a.log", 10, 2)
    assert log.handlers[0].maxBytes == 5 << 20 and log.handlers[0].backupCount == 1
    log.handlers.clear()


def blank_engine():
    """An engine that reads an image's bytes as its recognised JSON."""
    return lambda content: json.dumps(json.loads(content))


PAGE = {"image_shape": [1400, 1000], "items": [{"text": t, "bbox": b} for t, b in (
    (
        "ПАСПОРТ ВЫДАН", [50, 40, 200, 60]
    ), ("ОТДЕЛОМ", [250, 35, 700, 65]), ("28.02.2099", [200, 185, 340, 215]), ("999-999", [540, 185, 700, 215]), ("ФАМИЛИЯ", [300, 795, 380, 810]), ("ТЕСТОВ", [400, 785, 600, 815]),
    ("ИМЯ", [300, 855, 340, 870]), ("ТЕСТ", [400, 845, 560, 875]), ("МУЖ.", [350, 965, 420, 995]), ("31.01.2099", [600, 965, 760, 995]), ("ГОР.ТЕСТОВСК", [440, 1025, 640, 1055]), ("1234567890", [940, 200, 960, 500]))]}


def test_service_and_command_line(spark, tmp_path, capsys):
    from foliospark import cli
    from foliospark.streaming import files

    folder = {n: tmp_path / n for n in ("commands", "input", "output", "error", "state", "archive")}
    for n in ("commands", "input"):
        folder[n].mkdir()
    whole, part = json.dumps(PAGE, ensure_ascii=False), json.dumps({**PAGE, "items": PAGE["items"][:3]}, ensure_ascii=False)
    (folder["input"] / "good.jpg").write_text(whole)
    (folder["input"] / "part.png").write_text(part)
    (folder["input"] / "junk.png").write_text("no engine reads this")
    for name, body in (("good", {"request_id": "g/1"}), ("part", {}), ("junk", {}), ("lost", {"image_file": "lost.jpg"}), ("none", {})):
        files.save_json(folder["commands"] / f"{name}.json", body)
    (folder["commands"] / "bad.json").write_text("{")
    arguments = [
        "service", "--engine", "tests.test_library:blank_engine", "--once", "--lock-file", str(tmp_path / "lock"),
        "--status-file", str(tmp_path / "status.json"), "--log-file", str(tmp_path / "logs" / "s.log")
    ]
    assert cli.main(arguments + [x for n, p in folder.items() for x in (f"--{n}", str(p))]) == 0
    done = {r.request_id: r.outcome for r in spark.read.parquet(str(folder["state"] / "log")).where("state = 'done'").collect()}
    assert done == {
        "g/1": "ok", "part": "validation_error", "junk": "pipeline_error", "lost": "input_error",
        "none": "command_error", "bad": "command_error"
    }
    assert {p.name for p in folder["error"].iterdir()} == {
        "part.json", "junk.json", "lost.json", "none.json", "bad.json"
    } and not list(folder["commands"].glob("*"))
    assert [p.name for p in folder["archive"].glob("*/*/*")] == ["g_1"] and {p.name for p in folder["input"].iterdir()} == {"part.png", "junk.png"}
    assert files.read_json(folder["output"] / "part.json")["validation"]["status"] == "error"

    (tmp_path / "page.json").write_text(whole)
    assert cli.main(["parse", str(tmp_path / "page.json"), "-o", str(tmp_path / "parsed.json"), "--debug"]) == 0
    parsed = files.read_json(tmp_path / "parsed.json")
    assert (
        parsed["last_name"], parsed["first_name"], parsed["sex"], parsed["document_number"],
        parsed["validation"]["status"]
    ) == ("ТЕСТОВ", "ТЕСТ", "МУЖ", "1234 567890", "ok")
    assert len(files.read_json(tmp_path / "parsed.layout.json")) == len(PAGE["items"]) and cli.main(["parse", str(tmp_path / "gone"), "-o", "x"]) == 2
    cases = {
        "a": {
            "input": str(tmp_path / "page.json"), "expected": {"sex": "МУЖ"},
            "expected_format": {"document_number": r"\d{4} \d{6}"},
            "expected_validation": {"status": "ok", "errors_count": 0}
        }
    }
    files.save_json(tmp_path / "cases.json", cases)
    assert cli.main(["compare", str(tmp_path / "cases.json")]) == 0
    files.save_json(tmp_path / "cases.json", cases | {"b": {**cases["a"], "expected": {"sex": "ЖЕН"}}, "c": {**cases["a"], "input": "gone"}})
    capsys.readouterr()
    assert cli.main(["compare", str(tmp_path / "cases.json")]) == 1
    assert capsys.readouterr().out.split("\n")[:5] == ["a ok", "b failed", "  sex: expected='ЖЕН', actual='МУЖ'", "c missing_input", ""]
    (tmp_path / "photo.jpg").write_text(whole)
    assert cli.main(
        ["photo", str(tmp_path / "photo.jpg"), "-o", str(tmp_path / "photo.json"), "--engine", "tests.test_library:blank_engine", "--keep-input"]
    ) == 0
    assert cli.main(["ocr", str(tmp_path / "photo.jpg"), "-o", str(tmp_path / "ocr.json"), "--engine", "tests.test_library:blank_engine"]) == 0
    assert files.read_json(tmp_path / "ocr.json") == PAGE


def drawn():
    """A dark table with a bright page, turned by a quarter; the page has a red fold and a red frame below it, on the left."""
    import numpy as np

    page = np.full((400, 280, 3), 230, np.uint8)
    page[195:203, 30:250] = (200, 20, 20)
    page[260:360, 30:38] = page[260:360, 110:118] = page[260:268, 30:118] = page[352:360, 30:118] = (200, 20, 20)
    table = np.full((420, 600, 3), 10, np.uint8)
    table[60:340, 100:500] = np.rot90(page)
    return page, table


def test_pixels(spark):
    import numpy as np

    from foliospark.operators import pixels

    page, table = drawn()
    assert (pixels.load_image(pixels.save_image(table)) == table).all()
    with pytest.raises(ValueError):
        pixels.load_image(b"GIF")
    small, scale = pixels.resized(table, 300)
    assert small.shape == (210, 300, 3) and scale == 0.5 and small[105, 150].tolist() == table[210, 300].tolist()
    mask = np.zeros((9, 9), bool)
    mask[2:7, 2:7] = True
    mask[4, 4] = False
    assert pixels.closed(mask, 3, 3)[4, 4] and not pixels.opened(np.eye(9, dtype=bool), 3, 3).any()
    groups = list(pixels.components(np.array([[1, 0, 1, 1], [0, 1, 0, 0], [0, 0, 0, 1], [1, 0, 0, 1]], bool)))
    assert sorted(int((g[:, 2] - g[:, 1]).sum()) for g in groups) == [1, 2, 4]
    box, a, b = pixels.least_rectangle(np.array([[0, 1], [1, 0], [3, 2], [2, 3], [1, 1]]))
    assert sorted((round(a, 6), round(b, 6))) == [pytest.approx(2**0.5), pytest.approx(8**0.5)]
    assert pixels.otsu(np.array([[10, 12, 200, 210]], np.uint8)) in range(12, 200)

    images = spark.createDataFrame(
        [("a", bytearray(pixels.save_image(table))), ("dark", bytearray(pixels.save_image(table * 0))), ("broken", bytearray(b"x"))],
        "image_id string, content binary"
    )
    report = {r.image_id: r for r in pixels.crop_report(images).collect()}
    assert report["a"].status == "ok" and report["broken"].status == report["dark"].status == "failed" and report["a"].rotation == 1
    got = pixels.load_image({r.image_id: r.content for r in pixels.crop_images(images).collect()}["a"])
    assert abs(got.shape[0] - 400) <= 4 and abs(got.shape[1] - 242) <= 4
    red = pixels.red_components(got)
    assert len(red) == 2 and max(red, key=lambda c: c["aspect"])["center_y_ratio"] < min(red, key=lambda c: c["aspect"])["center_y_ratio"]


def test_json_of_a_box_is_read_once(spark):
    for name in ("dict_boxes", "legacy_items", "recursive_items"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_json(") <= 8, (name, plan.count("from_json("))


def test_deep_pages_and_half_characters(spark):
    deep = "[" * 2000 + '[[1,2,3,4],["in",1]]' + "]" * 2000
    rows = ocr.parse_pages(spark.createDataFrame([(1, deep), (2, '[[[1,2,3,4],["a\\ud800",2]]]')], "doc_id long, value string")).orderBy("doc_id").collect()
    assert [[(i.text, i.confidence, i.box.x2) for i in r["items"]] for r in rows] == [[("in", 1.0, 3.0)], [("a?", 2.0, 3.0)]]


BOXES = [
    "[4,3,1,2]", "[1,2,3]", '[1,2,3,"4"]', "[[1,2],[3,4],[5,6.5],[7,8]]", '[["1",2],[3,"4.5"],[5,6],[7,8],[-1,9]]', "[[1,2],[3,4],[5,6]]", "[[1,2],[3,4],[5,6],[7,null],[9,9]]",
    '{"x":1,"y":"2","w":-3,"h":4.005}', '{"x1":"5","y1":1,"x2":2,"y2":"x"}', '{"x":1,"y":2,"w":3,"x1":5,"y1":6,"x2":7,"y2":8}', "{}", "[]", "0", "null", "[-0.0,0.0,1,2]",
]


def test_plain_pages_are_read_as_spark_reads_them(spark):
    one = '{"text":"","label":"a","score":%s,"conf":%s,"box":%s,"points":[9,8,7,6]}'
    scores = ("0.0", "0.00", "-0.0", "0", "1.50", '"0.0"', '"0.5"', "null", "false", "true", '"x"')
    # A key that only Spark understands makes a page one for Spark.
    pages = [f'{{{key}"image_shape":[5.9],"shape":[3,4],"items":[{one % (s, 0.7, b)}]}}' for b in BOXES for s in scores for key in ("", '"_corrupt_record":null,')]
    rows = ocr.parse_pages(spark.createDataFrame(list(enumerate(pages)), "doc_id long, value string")).orderBy("doc_id").collect()
    assert len(rows) == len(pages) and all(str(a[1:]) == str(b[1:]) for a, b in zip(rows[::2], rows[1::2]))
    assert all(r.image_shape == [3, 4] for r in rows) and {len(r["items"]) for r in rows} == {0, 1}


def test_search_reads_plain_points_once(spark):
    shapes = {
        "[[1,2],[9,2],[9,4.5],[1,4.5]]": (1, 2, 9, 4.5), "[[1,2],[9,2],[9,-0.0],[1,4.5]]": None, "[[true,2],[9,2],[9,4],[1,4]]": None, '[["1",2],[9,2],[9,4],[1,4]]': None,
        "[[1,2],[9,2],[NaN,4.5],[1,4.5]]": None, "[[1,2],[9,2],[9,1e999],[1,4]]": None, "[[1,2],[9,2],[9,9007199254740993],[1,4]]": None, '["12","34","56","78"]': None, "[[1,2],[9,2],[9,4]]": None,
        '[[1,2],[9,2],[9,4],[{"text":"in","box":[1,2,3,4]},4]]': None,
    }
    for shape, corners in shapes.items():
        found = list(ocr.loose_items(json.loads('{"a":{"text":"t","box":%s}}' % shape)))
        assert found[0][0] == "t" and found[0][3] == corners and [f[0] for f in found[1:]] == ["in"] * ("in" in shape), shape
    plan = catalogue.queries()["recursive_items"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") <= 4 and "array_sort" not in plan and "regexp_replace" not in plan
    marked = spark.createDataFrame([(1, '\ufeff{"a":{"text":"t","box":[1,2,3,4]}}')], "doc_id long, value string")
    assert [i.text for i in ocr.parse_pages(marked).first()["items"]] == ["t"]
