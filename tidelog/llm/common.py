"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of text that a worker's arrays are made for at once; a longer text is taken alone.
CHUNK = 256 << 10


#: Bytes of an Arrow batch. Spark's own bound is 10,000 rows, which is 30 MB of documents and more, on both sides of the pipe.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by BATCH for this session, unless it has set a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share. Without spark.checkpoint.dir a local master gets one of its own; a cluster is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


#: Rows up to which small() broadcasts a table of ids and hashes, 100 bytes each at most.
SMALL_ROWS = 300_000


def small(table: DataFrame) -> DataFrame:
    """A materialized table of ids and hashes, to be broadcast if its rows are few; else joins shuffle."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int):
    """crc32 of the id written as text, modulo: the fold a row belongs to."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def text_chunks(batches, column: str = "text", limit: int = CHUNK):
    """Cut Arrow batches so that each piece holds about `limit` bytes of text (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.array([0 if n is None else n for n in _lengths(batch.column(column))], dtype=np.int64)
        group = (np.cumsum(sizes) - sizes) // limit
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        ends = np.r_[starts[1:], batch.num_rows]
        for a, b in zip(starts.tolist(), ends.tolist()):
            yield batch.slice(a, b - a)


def string_chunks(array, limit: int = CHUNK):
    """Cut a string array so that each piece holds about `limit` bytes (one row at least)."""
    import pyarrow as pa

    for piece in text_chunks([pa.record_batch([array], names=["text"])], limit=limit):
        yield piece.column("text")


def make_room(df: DataFrame, *names: str):
    """df, in which columns with one of these names (in any case) are renamed to <name>_input, and a function from old names to new ones.

    An operator's result columns keep their names, and no column of the caller is lost.
    """
    wanted = {n.lower() for n in names}
    taken, moved = {c.lower() for c in df.columns} | wanted, {}
    for c in df.columns:
        if c.lower() in wanted:
            new = f"{c}_input"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            moved[c] = new
    return (df.withColumnsRenamed(moved) if moved else df), lambda name: moved.get(name, name)


def _lengths(array):
    import pyarrow.compute as pc

    return pc.binary_length(array).to_pylist()


def text_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array (nulls as empty) and the row offsets."""
    import pyarrow as pa

    array = array.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 18)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        ups, downs = np.full(size, _ODD, np.uint64), np.full(size, inverse, np.uint64)
        ups[0] = downs[0] = 1
        _powers[:] = [np.multiply.accumulate(ups), np.multiply.accumulate(downs)]
    return _powers[0], _powers[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: span_hashes() reads the hash of any span from them."""
    codes = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))
    ups, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * ups[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, independent of where the span stands."""
    _, downs = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * downs[starts] + (ends - starts).astype(np.uint64))


#: Bits of a Bloom filter of rows' keys: 1 MB, whatever the input. It only saves work: exact steps follow.
FILTER_BITS = 23


def _filter(df: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """df with the place of the row's columns in a Bloom filter of keys, and the filter's words of 64 bits: 131,072 rows at most."""
    spot = F.pmod(F.xxhash64(*columns), F.lit(1 << FILTER_BITS))
    word, bit = F.shiftright(spot, 6).cast("int"), F.pmod(spot, F.lit(64)).cast("int")
    one = keys.select(word.alias("__word"), bit.alias("__bit"))
    words = one.groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    return df.withColumn("__word", word).withColumn("__bit", bit), F.broadcast(words)


def passing(df: DataFrame, keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """df with a boolean column: whether the row's columns pass a Bloom filter of the same columns of keys. False means that keys does not have them."""
    placed, words = _filter(df, keys, columns)
    met = placed.join(words, "__word", "left")
    return met.withColumn(name, F.coalesce(F.expr("shiftright(__bits, __bit) & 1L") == 1, F.lit(False))).drop("__word", "__bit", "__bits")


def only_passing(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of df of which passing() holds; the join makes no others."""
    placed, words = _filter(df, keys, columns)
    words = words.withColumnRenamed("__word", "__other")
    return placed.join(words, F.expr("__word = __other and (shiftright(__bits, __bit) & 1L) = 1")).drop("__word", "__bit", "__bits", "__other")
