"""Shared helpers: tables, durable intermediates and vectorised text kernels."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as the body of a regular-expression class.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text only, so that extra columns can't clash with an operator's own.

    Columns of the right type stay plain attributes: with aliases, two uses of one exchange can look different."""
    types = dict(docs.select("doc_id", "text").dtypes)
    return docs.select(
        *(F.col(c) if types[c] == t else F.col(c).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string")))
    )


def words_of(text: Column) -> Column:
    """Array of words ``[^\\x20\\x09-\\x0D]+``; empty for null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{WS_CLASS}]+"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    Catalyst would otherwise copy an expression into every lambda that uses it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def work_dir(spark: SparkSession) -> str:
    """A folder that all executors share: spark.checkpoint.dir, else (only without a cluster) a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local"):
            root = getattr(work_dir, "own", None) or tempfile.mkdtemp(prefix="quillgraph-")
            work_dir.own = root
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return root.rstrip("/")


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut there,
    a lost executor costs no recomputation, and the files go when the application ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- vectorised kernels (executor side) --------------------------------------------------------------

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x5851F42D4C957F2D)
BASE_INV = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps like unsigned arithmetic."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))


class Powers:
    """Powers of the hash base and of its inverse, kept as long as the longest text seen."""

    base, inverse = BASE, BASE_INV
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", cls.base), ("down", cls.inverse)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up, cls.down


class OtherPowers(Powers):
    """Another base, for a second hash."""

    base, inverse = np.uint64(0xDA942042E4DD58B5), np.uint64(pow(0xDA942042E4DD58B5, -1, 1 << 64))
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)


def prefix_hash(codes: np.ndarray, powers: type[Powers] = Powers) -> np.ndarray:
    """H with H[j] - H[i] a polynomial hash of codes[i:j], to be scaled by base**-i."""
    up, _ = powers.get(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, powers: type[Powers] = Powers) -> np.ndarray:
    """64-bit hashes of the ranges [start, end) under ``prefix_hash``; equal content, equal hash."""
    _, down = powers.get(len(h))
    return mix((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64) * _GOLD)


def batches(rows, text_index: int, most_bytes: int = 1 << 20):
    """Slices of Arrow record batches of about ``most_bytes`` of text, one document at least:
    (slice, bytes, offsets); null texts count as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in rows:
        if not batch.num_rows:
            continue
        text = batch.column(text_index)
        if not pa.types.is_large_string(text.type) and not pa.types.is_large_binary(text.type):
            text = text.cast(pa.large_binary()) if pa.types.is_binary(text.type) else text.cast(pa.large_string())
        if text.null_count:
            text = pc.fill_null(text, b"" if pa.types.is_large_binary(text.type) else "")
        off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(off, off[at] + most_bytes, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word
    (one more entry at the end); words never cross documents."""
    n = len(data)
    ink = np.ones(n + 2, bool)
    ink[0] = ink[-1] = False
    ink[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    cut = off[1:-1]
    left = ink[1:-1] & ~ink[:-2]
    right = ink[1:-1] & ~ink[2:]
    inner = cut[(cut > 0) & (cut < n)]
    left[inner] = ink[inner + 1]
    right[inner - 1] = ink[inner]
    start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold_case: bool = False) -> np.ndarray:
    if fold_case:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    return range_hash(prefix_hash(BYTE_CODE[data]), start, end) if len(start) else np.zeros(0, np.uint64)
