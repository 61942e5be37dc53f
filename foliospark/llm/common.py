"""Shared-folder tables, Arrow batches and vectorised word scanning."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the operators' contracts: runs of anything but these six bytes.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
#: About how many bytes of text the numpy kernels work on at once.
CHUNK_BYTES = 1 << 18
#: Spark bounds an Arrow batch by rows only, unless this setting of the session says so; long texts need the bytes.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"
#: Without Hadoop's native library the JVM starts a process for each folder and file that it makes on a file: path, and each
#: counts as large as the JVM until it runs.  Files of this class have no checksum file beside them, so one process less.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Instead, the checksums that Parquet puts into its pages are held against them.
VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; only a local session may lack one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="folio-shared-"))
    return found or context.getCheckpointDir()


def table(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**PLAIN_FILES, **{"parquet.page.write-checksum.enabled": "true"}).parquet(path)
    out = spark.read.options(**VERIFIED).schema(df.schema).parquet(path)
    out.table_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what ``table`` wrote, once nothing that is still to run reads it."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.table_path)
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, *more) -> DataFrame:
    """doc_id and the text as UTF-8 bytes (null: empty), with ``more`` columns."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
        *more,
    )


def in_batches(df: DataFrame, schema, function) -> DataFrame:
    """``mapInArrow`` in batches of bounded bytes: the session's bound, which becomes BATCH_BYTES where it is unset."""
    if not df.sparkSession.conf.get(BATCH_SETTING, None):
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(function, schema)


def arrow_map(df: DataFrame, schema: str, function, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``mapInArrow`` with a function from one RecordBatch to one dict of columns, or to a generator of such."""

    def run(batches):
        for batch in batches:
            for piece in split_batch(batch, chunk):
                out = function(piece)
                for one in [out] if isinstance(out, dict) else out:
                    yield pa.RecordBatch.from_pydict(one)

    return in_batches(df, schema, run)


def split_batch(batch: pa.RecordBatch, chunk: int = CHUNK_BYTES):
    """Cuts a batch between rows so that each part has about ``chunk`` bytes of ``text``; a longer text stays whole."""
    at = batch.schema.get_field_index("text")
    if at < 0 or batch.num_rows == 0:
        yield batch
        return
    sizes = np.cumsum(lengths(batch.column(at)))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + chunk)))
        yield batch.slice(start, stop - start)
        start = stop


def lengths(column) -> np.ndarray:
    return np.diff(offsets(column))


def offsets(column) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column as one array, and where each row starts (one more for the end)."""
    at = offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: spreads every input bit over the word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit constants, the same in every process."""
    return mix((np.arange(n, dtype=U64) + U64(1 + salt * 1_000_003)) * U64(0x9E3779B97F4A7C15)) | U64(1)


#: Fingerprints are polynomials over two prime fields: no two contents collide by construction, as they would modulo a power of two.
_PRIMES = (2147483647, 2147483629)
_BASES = (1270543223, 833047117)
_BYTE = seeds(256, 7) >> U64(2)
_BYTE_LANES = tuple((_BYTE % U64(p)).astype(np.uint32) for p in _PRIMES)
_powers: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint32), np.ones(1, np.uint32)) for _ in _PRIMES]
#: Elements that the sums take at once, so that a very long text needs little beside its own sums.
_BLOCK = 1 << 18


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each field base**i and base**-i for i <= n, four bytes each."""
    for lane, (p, base) in enumerate(zip(_PRIMES, _BASES, strict=True)):
        size = len(_powers[lane][0])
        if size <= n:
            both = []
            for old, b in zip(_powers[lane], (base, pow(base, -1, p)), strict=True):
                new = np.empty(n + 1, np.uint32)
                new[:size] = old
                at = size
                while at <= n:
                    step = min(at, n + 1 - at, _BLOCK)
                    new[at : at + step] = new[:step].astype(U64) * U64(pow(b, at, p)) % U64(p)
                    at += step
                both.append(new)
            _powers[lane] = tuple(both)
    return _powers


def _sums(n: int, residues) -> np.ndarray:
    """Prefix sums, a row per field, of ``residues(field, first, stop)`` times the powers."""
    out = np.zeros((2, n + 1), U64)
    for row, (p, (up, _)) in enumerate(zip(_PRIMES, powers(n), strict=True)):
        for at in range(0, n, _BLOCK):
            stop = min(at + _BLOCK, n)
            out[row, at + 1 : stop + 1] = residues(row, at, stop) * up[at:stop].astype(U64) % U64(p)
        np.cumsum(out[row], out=out[row])
    return out


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums (a row per field) from which ``span_hash`` takes the hash of any span."""
    return _sums(len(codes), lambda row, a, b: codes[a:b] % U64(_PRIMES[row]))


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return _sums(len(data), lambda row, a, b: _BYTE_LANES[row][data[a:b]].astype(U64))


def _joined(lanes: list[np.ndarray], length) -> np.ndarray:
    return mix(lanes[0] + (lanes[1] << U64(32)) + np.multiply(length, U64(0xA24BAED4963EE407)))


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each span [start, stop); equal contents give equal hashes."""
    lanes = [
        (row[stop] - row[start]) % U64(p) * down[start] % U64(p) for row, p, (_, down) in zip(prefix, _PRIMES, powers(prefix.shape[1]), strict=True)
    ]
    return _joined(lanes, (stop - start).astype(U64))


def sliding_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """``span_hash`` of every span of ``width`` elements."""
    n = max(prefix.shape[1] - width, 0)
    out, length = np.empty(n, U64), np.full(1, width, U64)
    for at in range(0, n, _BLOCK):
        stop = min(at + _BLOCK, n)
        lanes = [
            (
                row[at + width : stop + width] - row[at:stop]
            ) % U64(p) * down[at:stop] % U64(p) for row, p, (_, down) in zip(prefix, _PRIMES, powers(n), strict=True)
        ]
        out[at:stop] = _joined(lanes, length)
    return out


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, at: np.ndarray, space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of every word, and where each row's words start (one more for the end)."""
    solid = ~(is_space(data) if space is None else space)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], solid))
    after = np.concatenate((solid, [False]))
    start = np.flatnonzero(after & (~before | edge))
    stop = np.flatnonzero(before & (~after | edge))
    return start, stop, np.searchsorted(start, at)


def windows(codes: np.ndarray, first: np.ndarray, k: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-element windows of each row and where each row's windows start."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    at = np.concatenate(([0], np.cumsum(n)))
    total = len(codes) - k + 1
    if total <= 0 or at[-1] == 0:
        return np.zeros(0, U64), at
    h = np.zeros(total, U64)
    for j, m in enumerate(seeds(k, salt)):
        h += codes[j : j + total] * m
    keep = np.zeros(len(codes) + 1, np.int64)
    some = n > 0
    np.add.at(keep, first[:-1][some], 1)
    np.add.at(keep, first[:-1][some] + n[some], -1)
    return mix(h[np.cumsum(keep[:-1])[:total] > 0]), at
