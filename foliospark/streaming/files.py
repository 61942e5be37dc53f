"""What the queue does to files: atomic results, claims, routing by outcome, the archive and its retention, lock, heartbeat, log.

These run on the driver, a file or a few at a time, in the batch function of the stream; which files go is
decided by the queries of ``queue`` where a whole listing is looked at.
"""

from __future__ import annotations

import datetime as dt
import fcntl
import json
import logging
import logging.handlers
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.streaming import queue

MIB = 1 << 20


def now_iso() -> str:
    return dt.datetime.now().astimezone().isoformat(timespec="seconds")


def read_json(path: str | Path) -> dict:
    """The object in a file; {} if the file is missing, {"read_error": why} if it cannot be read as JSON."""
    try:
        return json.loads(Path(path).read_text("utf-8-sig"))
    except FileNotFoundError:
        return {}
    except (OSError, ValueError) as error:
        return {"read_error": str(error)}


def save_json(path: str | Path, data: object) -> None:
    """Written beside its place and renamed, so that no reader sees half of it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".tmp")
    part.write_text(json.dumps(data, ensure_ascii=False, indent=2, default=str), "utf-8")
    os.replace(part, path)


def delete_file(path: str | Path | None) -> bool:
    """Whether there was a file to delete."""
    there = path is not None and Path(path).is_file()
    if there:
        Path(path).unlink()
    return there


def free_name(folder: Path, name: str, stamp: str = "%Y%m%d_%H%M%S") -> Path:
    """A place for the name in the folder: with the time before its suffix if it is taken."""
    target = folder / name
    if target.exists():
        target = folder / f"{target.stem}_{dt.datetime.now().strftime(stamp)}{target.suffix}"
    return target


def move_file(path: str | Path, folder: str | Path) -> Path | None:
    """Where the file went; None if it is not there."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    if not Path(path).exists():
        return None
    return Path(shutil.move(str(path), str(free_name(folder, Path(path).name))))


def claim(command: str | Path, processing: str | Path) -> Path | None:
    """Takes a command for this service by one rename; None if another was first."""
    processing = Path(processing)
    processing.mkdir(parents=True, exist_ok=True)
    target = free_name(processing, Path(command).name)
    try:
        os.replace(command, target)
    except FileNotFoundError:
        return None
    return target


def move_stale(processing: str | Path, errors: str | Path) -> list[Path]:
    """Commands that an earlier run began and did not end are put aside, the oldest first, and never run again."""
    began = sorted(Path(processing).glob("*.json"), key=lambda p: (p.stat().st_mtime, p.name))
    return [move_file(p, Path(errors) / "stale_processing") for p in began if p.is_file()]


def find_crop(folder: str | Path, image: str | Path) -> Path:
    """The crop of an image: by its expected name, else the only one in the folder."""
    expected = Path(folder) / f"{Path(image).stem}_crop.jpg"
    if expected.exists():
        return expected
    found = sorted(Path(folder).glob("*_crop.jpg"))
    if len(found) != 1:
        raise FileNotFoundError(f"expected one crop in {folder}, found {len(found)}")
    return found[0]


def archive_case(archive: str | Path, request: str, image: Path, command: Path, result: Path, when: dt.datetime | None = None) -> Path:
    """Copies the three files to archive/yyyy-mm/yyyy-mm-dd/request at once: into a hidden folder, which is then renamed."""
    when = when or dt.datetime.now()
    day = Path(archive) / when.strftime("%Y-%m") / when.strftime("%Y-%m-%d")
    final = day / request
    if final.exists():
        final = day / f"{request}_{when.strftime('%H%M%S')}"
    part = day / f".{final.name}.tmp"
    shutil.rmtree(part, ignore_errors=True)
    part.mkdir(parents=True)
    try:
        for source, name in ((image, "input.jpg"), (command, "command.json"), (result, "result.json")):
            shutil.copy2(source, part / name)
        part.rename(final)
    except OSError:
        shutil.rmtree(part, ignore_errors=True)
        raise
    return final


def listing(archive: str | Path) -> list[tuple[dt.date, dt.datetime, str, int]]:
    """day, mtime, path and size in bytes of every archived case."""
    out = []
    for folder in Path(archive).glob("*/*/*"):
        try:
            day = dt.date.fromisoformat(folder.parent.name)
        except ValueError:
            continue
        if folder.is_dir():
            size = sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
            out.append((day, dt.datetime.fromtimestamp(folder.stat().st_mtime), str(folder), size))
    return out


def cleanup_archive(spark: SparkSession, archive: str | Path, days: int, most_gb: float, today: dt.date | None = None) -> dict[str, list[str]]:
    """Removes what ``queue.archive_removals`` names: by days first, then by size; empty folders go too."""
    cases = spark.createDataFrame(listing(archive), "day date, mtime timestamp, path string, size_bytes long").withColumn("archive", F.lit("one"))
    gone = queue.archive_removals(
        cases, F.lit(today or dt.date.today()), days, int(most_gb * (1 << 30)), "archive"
    ).orderBy("day", "mtime", "path").collect()
    for row in gone:
        shutil.rmtree(row.path)
    for folder in (*Path(archive).glob("*/*"), *Path(archive).glob("*")):
        if folder.is_dir() and not any(folder.iterdir()):
            folder.rmdir()
    return {f"removed_by_{why}": [r.path for r in gone if r.reason == why] for why in ("days", "size")}


def cleanup_results(folder: str | Path, days: int, now: float | None = None) -> list[Path]:
    """Deletes result files older than ``days``; 0 or less turns it off."""
    edge = (now if now is not None else dt.datetime.now().timestamp()) - days * 86400
    old = [p for p in sorted(Path(folder).glob("*.json")) if days > 0 and p.is_file() and p.stat().st_mtime < edge]
    for path in old:
        path.unlink(missing_ok=True)
    return old


def route(outcomes: DataFrame, errors: str | Path, archive: str | Path | None = None, keep_input: bool = False) -> list[dict]:
    """Files after processing: what is ok is archived and its image and command deleted; any other command goes to ``errors``, its image stays.

    outcomes: request_id, outcome, archive_name, image, command and result paths; one batch of the stream.
    """
    done = []
    for row in outcomes.select("request_id", "outcome", "archive_name", "image", "command", "result").collect():
        if row.outcome == "ok":
            kept = archive_case(archive, row.archive_name, Path(row.image), Path(row.command), Path(row.result)) if archive else None
            if not keep_input:
                delete_file(row.image)
            delete_file(row.command)
            done.append({"request_id": row.request_id, "archived": kept, "moved": None})
        else:
            done.append({"request_id": row.request_id, "archived": None, "moved": move_file(row.command, errors)})
    return done


class ServiceLock:
    """One service at a time: an exclusive lock that is not waited for."""

    def __init__(self, path: str | Path):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        self.handle = open(path, "w", encoding="utf-8")  # noqa: SIM115 - held as long as the service runs
        try:
            fcntl.flock(self.handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            self.handle.close()
            raise RuntimeError(f"another service holds {path}") from None
        self.handle.write(f"pid={os.getpid()}\nlocked_at={now_iso()}\n")
        self.handle.flush()

    def release(self) -> None:
        fcntl.flock(self.handle, fcntl.LOCK_UN)
        self.handle.close()


def heartbeat(path: str | Path, status: dict) -> None:
    """The service's status with the time of this sign of life."""
    save_json(path, {**status, "last_heartbeat_at": now_iso()})


def configure_logging(path: str | Path, total_mb: int = 100, files: int = 5) -> logging.Logger:
    """A rotating log of ``files`` files that share ``total_mb``, each of at least 1 MB, and the console."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    files = max(1, files)
    log = logging.getLogger("foliospark")
    log.handlers.clear()
    log.setLevel(logging.INFO)
    rotating = logging.handlers.RotatingFileHandler(path, maxBytes=max(MIB, max(1, total_mb) * MIB // files), backupCount=files - 1, encoding="utf-8")
    for handler in (rotating, logging.StreamHandler()):
        handler.setFormatter(logging.Formatter("%(asctime)s [%(levelname)s] %(message)s", "%Y-%m-%d %H:%M:%S"))
        log.addHandler(handler)
    return log
