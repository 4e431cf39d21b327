"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of a per-worker cache before it starts again; bounds a Python worker's memory.
CACHE = 120_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the master is local and none is set, as in tests."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _folders[app] = _folders.get(app) or tempfile.mkdtemp(prefix="spark-shared-")
    return base.rstrip("/")


_folders: dict[str, str] = {}


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder that the session names."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


class Shelf:
    """Intermediate tables of one call: Parquet in the shared checkpoint folder, read again with a short plan, removed at the end."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow for a function that yields a dict of column name to list or array, for each output batch."""
    from pyspark.sql.types import _parse_datatype_string  # a DDL string's types
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema))
    small_batches(df.sparkSession)

    def run(batches):
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, type=f.type) for f in target], schema=target)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """At a task's end, give back what the worker, which goes on to other tasks, would keep."""
    pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Have Spark hand Python no more than so many bytes at a time; texts are long, and both sides hold a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) != f"{size}b":
        spark.conf.set(key, f"{size}b")


def ascii_lower(text: str) -> bytes:
    """UTF-8 with A-Z lowered and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower()


#: Words of up to so many bytes are hashed many at a time, longer ones alone.
LONG_WORD = 4096
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.Generator(np.random.PCG64(20))
#: A random number for each byte (0 for white space), and an odd one for each place in a word.
_BYTE = np.where(_SPACE, 0, _random.integers(1, 1 << 64, 256, dtype=np.uint64)).astype(np.uint64)
_PLACE = _random.integers(0, 1 << 64, LONG_WORD, dtype=np.uint64) | np.uint64(1)


def _piece_hashes(buf: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of the bytes buf; words end at ASCII white space and where a text begins."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[buf]
    before = np.append(True, space[:-1])
    before[begins] = True
    starts = np.flatnonzero(before & ~space)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    low = _LOWER[buf[starts[0] :]]
    size = np.diff(np.append(starts, len(buf)))
    place = np.arange(len(low)) - np.repeat(starts - starts[0], size)
    over = size > LONG_WORD
    if over.any():
        np.minimum(place, LONG_WORD - 1, out=place)
    with np.errstate(over="ignore"):
        h = mix(np.add.reduceat(_BYTE[low] * _PLACE[place], starts - starts[0]))
    for i in np.flatnonzero(over):
        word = low[starts[i] - starts[0] : starts[i] - starts[0] + size[i]].tobytes()
        word = word[: re.search(rb"[\x20\x09-\x0d]|\Z", word).start()]
        if len(word) > LONG_WORD:
            h[i] = xxhash.xxh3_64_intdigest(word)
    return h, starts


def hashed_words(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Row numbers and, for each row in turn, the 64-bit hashes of the words of a column of texts: A-Z lowered, cut at ASCII white space.

    About `size` bytes are hashed together; a longer text goes piece by piece.
    Equal words have equal hashes wherever they stand. Nulls have no words.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[stop])
        if hi - lo <= 2 * size:
            h, starts = _piece_hashes(data[lo:hi], (b := offsets[row:stop] - lo)[b < hi - lo])
            yield row, np.split(h, np.searchsorted(starts, offsets[row + 1 : stop] - lo))
        else:
            parts, at = [], lo
            while at < hi:
                end = min(hi, at + size)
                while end < hi and not _SPACE[data[end]]:
                    gap = np.flatnonzero(_SPACE[data[end : end + size]])
                    end = min(hi, end + (int(gap[0]) if len(gap) else size))
                parts.append(_piece_hashes(data[at:end], np.zeros(0, np.int64))[0])
                at = end
            yield row, [np.concatenate(parts)]
        row = stop


_B = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of h over the word (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words; empty when there are fewer."""
    if len(w) < n:
        return w[:0]
    out, h = None, w
    with np.errstate(over="ignore"):
        for i in range(n):  # Horner's rule over shifted views
            part = h[i : len(w) - n + 1 + i]
            out = part.copy() if out is None else out * _B + part
        return mix(out)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def bitmap(keys: DataFrame, column: str, bits: int = 26) -> np.ndarray:
    """2**bits bits (8 MB by default, whatever the input's size) with the bit of each key set.

    As a prefilter: a key that is absent may pass, one that is present always does.
    """
    h = F.pmod(F.col(column).cast("long"), F.lit(1 << bits))
    rows = keys.select(h.alias("h")).where("h is not null").groupBy(F.shiftright("h", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("h").bitwiseAND(32767)).alias("m")).collect()
    out = np.zeros((1 << (bits - 15), 4096), np.uint8)
    for r in rows:
        out[r["b"]] = np.frombuffer(r["m"], np.uint8)
    return out.ravel()


def in_bitmap(m: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys h have their bit set in the bitmap m."""
    h = h.view(np.uint64) & np.uint64(len(m) * 8 - 1)
    return (m[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 > 0


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def null_safe(text: str | None) -> str:
    return text or ""


def texts(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The strings of an Arrow column, a few at a time, so that a batch isn't held twice."""
    for start in range(0, len(column), rows):
        yield from column.slice(start, rows).to_pylist()

