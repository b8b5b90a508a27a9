"""What the operators share: tables, scratch tables in the cluster's shared folder, hashing of texts."""

from __future__ import annotations

import atexit
import contextvars
import re
import uuid
from collections import defaultdict
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.lineage import shared_dir

#: The white space that the contracts name: space, and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch of rows with texts: bounds what the JVM and a worker hold of them at once.
BATCH = 2 << 20

#: Scratch tables by who made them; tables and files that stay till the end.
_scratch: dict[str | None, list[tuple[SparkSession, str]]] = defaultdict(list)
_tables: list[tuple[SparkSession, str]] = []
_owner: contextvars.ContextVar[str | None] = contextvars.ContextVar("owner", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Settings of the session that rows with whole texts need lower than Spark has them: rows and bytes of an Arrow
#: batch, and rows of a batch of columns, whose strings are one array on the heap.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH, "spark.sql.parquet.columnarReaderBatchSize": 128}


_UNITS = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's SETTINGS where they are higher or have no limit; sizes may have units."""
    for name, most in SETTINGS.items():
        value = spark.conf.get(name).strip().lower()
        number = re.match(r"-?\d+", value)
        size = int(number[0]) * _UNITS.get(value[number.end() :].strip().rstrip("b"), 1) if number else -1
        if size > most or size <= 0:  # Spark's sign for no limit
            spark.conf.set(name, str(most))


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow, in batches of at most BATCH bytes."""
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


@contextmanager
def owned(owner: str):
    """Scratch tables saved inside belong to the owner: release(owner) removes them and no others."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def save(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and returns the table as read back.

    An executor lost later costs nothing that was saved. The table lives until its owner's release()
    or the end of the program.
    """
    return written(df, label, _scratch[_owner.get()])


def written(df: DataFrame, label: str, kept: list | None = None) -> DataFrame:
    """As save(), but release() leaves the table: it lives until the end of the program."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    (_tables if kept is None else kept).append((spark, path.rpartition("/")[0]))
    return spark.read.schema(df.schema).parquet(path)


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a small file into the shared folder, through Spark's file systems, and returns its path."""
    jvm = spark.sparkContext._jvm
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/{name}"
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    _tables.append((spark, path.rpartition("/")[0]))
    return path


def release(owner: str | None = None) -> None:
    """Removes the owner's scratch tables. Only for when nothing that reads them is still to run."""
    _remove(_scratch.pop(owner, []))


def _remove(kept: list) -> None:
    while kept:
        spark, path = kept.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: its folder goes with it
            return


@atexit.register
def _remove_all() -> None:
    for owner in list(_scratch):
        release(owner)
    _remove(_tables)


def free_name(name: str, taken) -> str:
    """The name, or the first of name_found, name_found_, ... that isn't among the names taken, whatever their case."""
    taken = {t.lower() for t in taken}
    if name.lower() in taken:
        name += "_found"
    while name.lower() in taken:
        name += "_"
    return name


def tasks_for(rows: int, each: int = 25_000) -> int:
    """How many tasks rows after a shuffle are worth: small tables needn't be read in hundreds of parts.

    More than there are partitions changes nothing, so large tables keep the cluster's parallelism.
    """
    return max(6, -(-rows // each))


def bucket_of(key: str, modulus: int):
    """crc32 of the key as text, modulo: the folds that contracts name. Null counts as empty."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def text_or_empty(col):
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


# Vectorised hashing of words, on the UTF-8 bytes of many texts at once.

_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: By how many of eight bytes belong to a word.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(32))


def string_array(texts) -> pa.Array:
    """Texts as an Arrow array of strings without nulls; null counts as empty."""
    out = texts if isinstance(texts, pa.Array) else pa.array([None if t is None else t.encode("utf-8", "surrogatepass") for t in texts], pa.binary())
    return pc.fill_null(out, b"" if pa.types.is_binary(out.type) else "") if out.null_count else out


def spans(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, one text after another; where words begin and end there; and each text's first word.

    The last array has one entry more than there are texts. No text becomes a Python object.
    """
    texts = string_array(texts)
    if not len(texts):
        return np.zeros(0, np.uint8), *(np.zeros(n, np.int64) for n in (0, 0, 1))
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at -= at[0]
    word = np.zeros(len(data) + 2, bool)  # with a border on either side
    np.logical_not(_IS_SPACE[data], out=word[1:-1])
    begins, ends = word[1:] & ~word[:-1], word[:-1] & ~word[1:]  # at each border between bytes
    both = word[:-1] & word[1:]
    cut = at[1:-1][both[at[1:-1]]]  # texts that meet without white space
    begins[cut] = ends[cut] = True
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    return data, starts, stops, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, fold: bool = True, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words at the spans, with fold of A-Z as a-z; another seed gives an independent hash.

    Eight bytes at a time are mixed in by a bijection that isn't linear, so no words collide by their
    make-up. Words over LONG_WORD bytes go through XXH64. Memory is bounded by the number of words.
    """
    data = _LOWER[data] if fold else data
    sizes = stops - starts
    out = mix(sizes.astype(np.uint64) * _STEP + np.uint64(seed))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    rows = np.arange(len(starts)) if not len(sizes) or sizes.max() <= LONG_WORD else np.flatnonzero(sizes <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        if at:
            rows = rows[sizes[rows] > at]
        if not len(rows):
            break
        h = eight[starts[rows] + at] & _MASKS[np.minimum(sizes[rows] - at, 8)]
        out[rows] = mix(out[rows] ^ h) + _STEP
    long = np.flatnonzero(sizes > LONG_WORD)
    if len(long):
        import xxhash

        raw = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(starts[long].tolist(), stops[long].tolist())]
    return out


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, A-Z lower-cased, in order; and where each text's begin.

    The second array has one entry more than there are texts. Null has no words.
    """
    data, starts, stops, at = spans(texts)
    return span_hashes(data, starts, stops), at


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in the order of their first places, and which of them each value is."""
    coded = pa.array(h).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def slices(batches, col: int, most: int = 1 << 20, rows: int = 4096):
    """The batches in parts of about most bytes in a column of strings, or of so many rows; a longer text is alone."""
    for b in batches:
        texts = b.column(col)
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if b.num_rows else ()
        at = 0
        while at < b.num_rows:
            end = min(b.num_rows, at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1))
            yield b.slice(at, end - at)
            at = end


def chunks(texts: list[str | None], most: int = 1 << 18):
    """(first, last) ranges of the texts, each of about most characters; a longer text is alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)
