"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime

#: Texts are handed to Python code in slices of about this many bytes, so memory
#: follows the slice and not the Arrow batch.
SLICE_BYTES = 4 << 20

#: While a table is stored, the job's shuffle files go with it (and not when the driver next collects garbage), and small
#: shuffles are read in partitions of the advised size, so that a small table is few files.
STORING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}

_written: list[tuple[SparkSession, str]] = []


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside one expression."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none, and in local mode only, a temporary one is used.
    """
    return runtime.shared_dir(spark)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and
    losing an executor loses nothing. The table is deleted when Python exits, or by ``drop_stored``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in STORING}
    for k, v in STORING.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**runtime.UNSUMMED).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def quoted(name: str) -> str:
    """A column's name as Spark's parser takes it, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def map_rows(df: DataFrame, fn: Callable[[Iterator], Iterator]) -> DataFrame:
    """``mapInArrow`` to rows of the same columns, by place: Spark's own looks columns up by name and fails on one with a dot."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(fn, plain.schema).toDF(*df.columns)


def written() -> int:
    """A mark for ``drop_since``."""
    return len(_written)


def drop_since(mark: int, *keep: DataFrame) -> None:
    """Delete what was stored since ``mark``, but for ``keep``."""
    left = {getattr(x, "_weft_path", None) for x in keep}
    for spark, path in _written[mark:]:
        if path not in left:
            runtime.delete_path(spark, path)
    _written[mark:] = [(spark, path) for spark, path in _written[mark:] if path in left]


def drop_stored(*frames: DataFrame) -> None:
    for frame in frames:
        runtime.delete_path(frame.sparkSession, frame._weft_path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            runtime.delete_path(spark, path)
        except Exception:  # the session may be gone; the folder is scratch space
            return


def slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; one longer row stands alone."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(df: DataFrame, each: int) -> int:
    """Partitions that hold about ``each`` bytes of ``df``; follows the input at any size (but for sources without statistics)."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    return least if size >= 1 << 60 else max(least, -(-size // each))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: One fixed pseudo-random 64-bit value for each byte.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_AS_IS = np.where(_SPACE, np.uint64(0), _BYTE)
_LOWERED = np.where(_SPACE, np.uint64(0), _BYTE[_LOWER])

#: Powers up to the size of a slice, made once; larger texts make their own.
KEPT_POWERS = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64 (not to be written to)."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        out = np.full(max(n, 1 << 14) if n > KEPT_POWERS else min(KEPT_POWERS, max(1 << 14, 2 * n)), base, np.uint64)
        out[:1] = 1
        got = np.multiply.accumulate(out)
        if len(got) <= KEPT_POWERS:
            _powers[int(base)] = got
    return got[:n]


class Words:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of joined texts, A-Z lower-cased.

    ``texts`` are UTF-8 byte strings; ``hashes`` has all words in order and
    ``bounds[i]:bounds[i+1]`` are those of text i. ``starts``/``ends`` are their
    byte places in ``data``.
    """

    def __init__(self, texts: list[bytes], lower: bool = True):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.data, self.offsets = data, np.concatenate([[0], np.cumsum(lengths)])
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[::2], edge[1::2]
        if len(self.starts):
            value = (_LOWERED if lower else _AS_IS)[data]  # white space counts nothing, so a word's sum may run up to the next word
            value *= powers(len(data))
            self.hashes = mix64(np.add.reduceat(value, self.starts) * powers(len(data), _INVERSE)[self.starts])
        else:
            self.hashes = np.zeros(0, np.uint64)
        self.bounds = np.searchsorted(self.starts, self.offsets)


#: Texts beyond this many bytes are hashed in pieces.
LONG = 1 << 20


def cut_words(text: bytes, size: int = LONG, overlap: int = 0) -> list[bytes]:
    """Pieces of about ``size`` bytes that end where words end; each begins with the last ``overlap`` words of the one before."""
    out, start = [], 0
    while len(text) - start > size:
        m = _BREAK.search(text, start + size)
        if not m:
            break
        out.append(text[start : m.start()])
        back = out[-1].rsplit(None, overlap) if overlap else []
        # the first part is what stands before the overlap; a piece of few words goes on without one
        start = start + len(back[0]) if len(back) > overlap else m.start()
    return [*out, text[start:]]


_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of a text's words, with a text of any length in bounded memory but for the hashes."""
    return Words([text]).hashes if len(text) <= LONG else np.concatenate([Words([x]).hashes for x in cut_words(text)])


def utf8(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    return [x or b"" for x in column.to_pylist()]


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Hand Python workers batches of about ``size`` bytes, unless the session names its own limit: long texts
    come a few at a time, and memory on both sides follows this and not the number of rows."""
    if spark.conf.get(BATCH_BYTES, None) in (None, _default_batch(spark)):
        spark.conf.set(BATCH_BYTES, size)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _default_batch(spark: SparkSession) -> str | None:
    return spark.newSession().conf.get(BATCH_BYTES, None)
