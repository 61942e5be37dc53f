"""Command line: ``python -m foliospark.cli parse|ocr|photo|crop|service|compare ...``; exit 0 done, 1 not all ok, 2 no input or not started.

Recognition is a plug-in: ``--engine module:function`` names a function without arguments that returns one
from an image's bytes to the engine's JSON.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import sanitize_archive_name
from foliospark.operators import fields, items, pixels, validate
from foliospark.sources import ocr, vision
from foliospark.streaming import files, queue


def session() -> SparkSession:
    return SparkSession.builder.appName("foliospark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parsed(documents: DataFrame) -> DataFrame:
    """Validated results of documents (doc_id, value: recognised JSON); a document without items has no fields."""
    read = ocr.parse_pages(documents)
    found = fields.extract(items.pages(items.item_rows(read)))
    return validate.validate(read.select("doc_id").join(found, "doc_id", "left"))


def result_json() -> F.Column:
    return F.to_json(F.struct(*fields.FIELDS, "validation"), {"ignoreNullFields": "false"})


def engine(name: str):
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


def recognised(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    images = spark.read.format("binaryFile").load(paths)
    return vision.ocr(images, engine(name), name).select(
        F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("doc_id"), F.col("ocr_json").alias("value"), "error"
    )


def print_results(rows: list) -> None:
    for row in rows:
        print(f"{row.doc_id}: {row.validation.status}")
        for name in fields.FIELDS:
            print(f"  {name}: {row[name]}")


def written(results: DataFrame, output: Path) -> list:
    """Saves each result of a small, local run beside ``output`` (a file, or a folder for several)."""
    rows = results.select("*", result_json().alias("_json")).collect()
    for row in rows:
        files.save_json(output if output.suffix else output / f"{row.doc_id}.json", json.loads(row["_json"]))
    print_results(rows)
    return rows


def run_parse(a: argparse.Namespace) -> int:
    if not Path(a.input).exists():
        print(f"no such input: {a.input}", file=sys.stderr)
        return 2
    spark = session()
    raw = spark.read.text(a.input, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.[^./]*$", 1).alias("doc_id"), "value")
    written(parsed(raw), Path(a.output))
    if a.debug:
        page = items.pages(items.item_rows(ocr.parse_pages(raw)))
        for name, view in (("layout", fields.layout(page)), ("diagnostics", fields.diagnostics(page))):
            files.save_json(Path(a.output).with_suffix(f".{name}.json"), [json.loads(x) for x in view.toJSON().collect()])
    return 0


def run_ocr(a: argparse.Namespace) -> int:
    if not Path(a.input).exists():
        return 2
    rows = recognised(session(), [a.input], a.engine).collect()
    for row in rows:
        files.save_json(Path(a.output), json.loads(row.value) if row.value else {"error": row.error})
    return 0 if all(r.value for r in rows) else 1


def run_photo(a: argparse.Namespace) -> int:
    if not Path(a.input).exists():
        return 2
    began = time.time()
    got = recognised(session(), [a.input], a.engine)
    rows = written(parsed(got.select("doc_id", "value")), Path(a.output))
    print(f"total_sec: {time.time() - began:.3f}")
    ok = bool(rows) and all(r.validation.status == "ok" for r in rows)
    if ok and not a.keep_input:
        files.delete_file(a.input)
    return 0 if ok else 1


def run_crop(a: argparse.Namespace) -> int:
    if not Path(a.input).exists():
        return 2
    images = session().read.format("binaryFile").load(a.input).select(F.col("path").alias("image_id"), "content")
    done = pixels.crop_images(images).collect()
    for row in done:
        Path(a.output).parent.mkdir(parents=True, exist_ok=True)
        Path(a.output).write_bytes(row.content)
    if a.debug_dir:
        files.save_json(Path(a.debug_dir) / "crop.json", [json.loads(x) for x in pixels.crop_report(images).toJSON().collect()])
    return 0 if done else 1


def run_compare(a: argparse.Namespace) -> int:
    """``cases``: JSON of case name to input, expected, expected_format and expected_validation."""
    spark, cases = session(), json.loads(Path(a.cases).read_text("utf-8"))
    raw = [(name, Path(c["input"]).read_text("utf-8")) for name, c in cases.items() if Path(c["input"]).exists()]
    results = parsed(spark.createDataFrame(raw, "doc_id string, value string")).withColumnRenamed("doc_id", "case_id")
    want = [(n, f, v, None) for n, c in cases.items() for f, v in c.get("expected", {}).items()] + [
        (n, f, None, p) for n, c in cases.items() for f, p in c.get("expected_format", {}).items()
    ]
    checks = [(n, *(c.get("expected_validation", {}).get(k) for k in ("status", "errors_count", "warnings_count"))) for n, c in cases.items()]
    done = validate.run_cases(
        results, spark.createDataFrame(want, "case_id string, field string, value string, pattern string"),
        spark.createDataFrame(checks, "case_id string, status string, errors_count int, warnings_count int")
    ).orderBy("case_id").collect()
    for row in done:
        print(row.case_id, row.status)
        for e in row.errors:
            print(f"  {e.field}: expected={e.expected!r}, actual={e.actual!r}")
    return 0 if all(r.status == "ok" for r in done) else 1


def run_service(a: argparse.Namespace) -> int:
    log = files.configure_logging(a.log_file, a.log_total_max_mb, a.log_files_count)
    try:
        lock = files.ServiceLock(a.lock_file)
    except RuntimeError as error:
        log.error(str(error))
        return 2
    spark = session()
    for name in ("commands", "input", "output", "error"):
        Path(getattr(a, name)).mkdir(parents=True, exist_ok=True)

    def process(claimed: DataFrame) -> DataFrame:
        names = spark.createDataFrame([(p.name,) for p in Path(a.input).iterdir()], "name string")
        resolved = ocr.resolve_images(claimed, names)
        full = resolved.withColumns(
            {
                c: F.when(F.col(c).startswith("/"), F.col(c)).otherwise(F.concat(F.lit(f"{folder}/"), c)) for c, folder in (
                    ("image", a.input), ("output", a.output)
                )
            }
        )
        there = [r.image for r in full.where("exists").select("image").collect()]
        got = recognised(spark, there, a.engine) if there else spark.createDataFrame([], "doc_id string, value string, error string")
        results = parsed(got.select("doc_id", "value")).join(got.select("doc_id", "error"), "doc_id").withColumn("result_json", result_json())
        named = full.withColumn("doc_id", ocr.stem(F.element_at(F.split("image", "/"), -1)))
        rows = named.join(results.select("doc_id", "validation", "result_json", "error"), "doc_id", "left")
        status = F.col("validation.status")
        outcome = queue.outcome(
            status, F.col("_corrupt_record").isNotNull(), F.col("image").isNotNull(), F.col("exists"),
            F.col("error").isNotNull() | status.isNull()
        )
        rows = rows.select(
            "request_id", outcome.alias("outcome"), sanitize_archive_name(F.col("request_id")).alias("archive_name"),
            "image", F.concat(F.lit(f"{a.commands}/"), "file_name").alias("command"), F.col("output").alias("result"),
            "result_json"
        )
        rows = spark.createDataFrame(rows.collect(), rows.schema)  # the files of one trigger
        for row in rows.collect():
            body = json.loads(row.result_json) if row.result_json else {
                "validation": {"status": "error"}, "pipeline": {"status": "error", "failed_stage": row.outcome}
            }
            files.save_json(row.result, {"request_id": row.request_id, **body})
        files.route(rows, a.error, a.archive, a.keep_input)
        if a.archive:
            files.cleanup_archive(spark, a.archive, a.archive_days, a.archive_max_gb)
        files.heartbeat(a.status_file, {"status": "running", "last_batch": [r.request_id for r in rows.select("request_id").collect()]})
        return rows.select("request_id", "outcome")

    stream = queue.run(queue.read_stream(spark, a.commands), process, f"{a.state}/log", f"{a.state}/checkpoint", a.once)
    files.heartbeat(a.status_file, {"status": "running"})
    while stream.isActive and not stream.awaitTermination(a.heartbeat_sec):
        files.heartbeat(a.status_file, {"status": "running"})
        files.cleanup_results(a.output, a.out_days)
    files.heartbeat(a.status_file, {"status": "stopped"})
    lock.release()
    return 0


def main(arguments: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="foliospark", description=__doc__.splitlines()[0])
    sub = top.add_subparsers(required=True)

    def command(name, run, *more):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for flags, options in more:
            p.add_argument(*flags, **options)

    out = (("-o", "--output"), {"required": True})
    with_engine = (("--engine",), {"required": True})
    source = (("input",), {})
    command("parse", run_parse, source, out, (("--debug",), {"action": "store_true"}))
    command("ocr", run_ocr, source, out, with_engine)
    command("photo", run_photo, source, out, with_engine, (("--keep-input",), {"action": "store_true"}))
    command("crop", run_crop, source, out, (("--debug-dir",), {}))
    command("compare", run_compare, (("cases",), {}))
    folders = [((f"--{n}",), {"required": True}) for n in ("commands", "input", "output", "error", "state")]
    numbers = [
        ((f"--{n}",), {"type": t, "default": d}) for n, t, d in (
            ("archive-days", int, 30), ("archive-max-gb", float, 5.0), ("out-days", int, 7),
            ("log-total-max-mb", int, 100), ("log-files-count", int, 5), ("heartbeat-sec", float, 10.0)
        )
    ]
    named = [
        ((f"--{n}",), {"default": d}) for n, d in (
            ("archive", None), ("lock-file", "service.lock"), ("status-file", "service_status.json"),
            ("log-file", "logs/service.log")
        )
    ]
    command(
        "service", run_service, with_engine, *folders, *numbers, *named, (("--once",), {"action": "store_true"}),
        (("--keep-input",), {"action": "store_true"})
    )
    a = top.parse_args(arguments)
    return a.run(a)


if __name__ == "__main__":
    raise SystemExit(main())
