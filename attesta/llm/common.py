"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: What separates words of letters (bytes of other alphabets count as letters).
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

_MULT = 0x9E3779B97F4A7C15
_SALT = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where that is unset and all tasks run in
    the driver's own process, as in tests. On a cluster without that setting there is no shared folder: an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="attesta-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class _Scratch(threading.local):
    """What each thread has staged inside its scratch()s, so that queries in several threads keep to their own."""

    def __init__(self):
        self.open: list[list[str]] = []


_SCRATCH = _Scratch()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged inside are deleted at the end, but for those staged with keep: an operator's result."""
    _SCRATCH.open.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.open.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """What is written inside has its shuffle files removed as soon as it is done, as nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stage(df: DataFrame, name: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH.open and not keep:
        _SCRATCH.open[-1].append(path)
    schema = df.schema
    with _freeing(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what stage() wrote for df inside a scratch(), before its end."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        name = path.rsplit("/", 1)[1]
        for mine in [x for x in _SCRATCH.open[-1] if x.rsplit("/", 1)[1] == name]:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(mine)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def bucketed(docs: DataFrame, bucket_bytes: int, chunks: int) -> DataFrame:
    """docs (with doc_id and text) and their chunk, in a table in the shared folder that is bucketed by it.

    Every later pass over a chunk's documents, also with what other tables have of the chunk, needs no shuffle of texts.
    """
    return bucket_table(*dealt(docs, bucket_bytes, chunks))


def dealt(docs: DataFrame, bucket_bytes: int, chunks: int) -> tuple[DataFrame, int]:
    """docs (with doc_id and text) and their chunk, in a partition for each bucket, and how many buckets these are."""
    docs = sized(docs)
    buckets = input_bytes(docs) // bucket_bytes + 1
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    rows = docs.withColumn("chunk", F.pmod(spread, F.lit(chunks * buckets)).cast("int"))
    return rows.repartition(buckets, "chunk"), buckets


def bucket_table(rows: DataFrame, buckets: int) -> DataFrame:
    """A table of rows in the shared folder, bucketed by chunk; rows are dealt out by it already."""
    spark, name = rows.sparkSession, f"attesta_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    if _SCRATCH.open:
        _SCRATCH.open[-1].append(path)
    with _freeing(spark):
        rows.write.bucketBy(buckets, "chunk").option("compression", "zstd").option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, as it is external
    return table


def input_bytes(df: DataFrame) -> int:
    """What the planner knows of the size of df's input, without a job; see sized()."""
    return max(1, sum(_leaf_bytes(df)))


def sized(df: DataFrame) -> DataFrame:
    """df if the planner knows its input's size, else df written to the shared folder, which makes the size known."""
    return df if max(_leaf_bytes(df), default=0) < 1 << 62 else stage(df, "sized")


def _leaf_bytes(df: DataFrame) -> list[int]:
    return [int(str(leaf.computeStats().sizeInBytes())) for leaf in _leaves(df)]


def _leaves(df: DataFrame) -> list:
    plan = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [plan.apply(i) for i in range(plan.length())]


def parts(df: DataFrame, target: int) -> int:
    """Groups to deal packets out to: of about target input bytes.

    Each chunk sends each group one packet, so the number goes by the input's size alone: with one for each of many shuffle
    partitions a small input would become very many tiny packets.
    """
    return input_bytes(df) // target + 1


def group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    """The group that each hash goes to, by its 32 low bits; the 48 high ones tell the keys of a group apart."""
    return ((keys & np.uint64(0xFFFFFFFF)) % np.uint64(groups)).astype(np.int32)


_LIBC = None


def give_back() -> None:
    """Return to the system what this worker has freed: workers live on, and an executor's memory counts them all."""
    global _LIBC
    pa.default_memory_pool().release_unused()
    if _LIBC is None:
        try:
            _LIBC = ctypes.CDLL("libc.so.6")
        except OSError:  # another C library
            _LIBC = False
    if _LIBC:
        _LIBC.malloc_trim(0)


def trimmed(f):
    """A function of batches that gives memory back when it is done."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def crc32_mod(col: str, n: int):
    """crc32(col as text) mod n; a null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def ensure_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns with the given types and no other; a missing or void one is all null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


# --- texts as bytes ---------------------------------------------------------------------------------------------


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of texts and where each text starts (one more than texts); a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def pieces(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Runs of whole texts of about size bytes; one longer text is a run of its own."""
    out, first, n = [], 0, len(starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + size, "right")) - 1)
        out.append((first, min(last, n)))
        first = out[-1][1]
    return out


def power(n: int, base: int = _MULT) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gram_hash(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of every n bytes in a row, by doubling; what crosses a text's end is for the caller to leave out."""
    full = _SALT[data]
    out, done, block, width = None, 0, full, 1
    while True:
        if n & width:
            if out is None:
                out, done = block.copy(), width
            else:
                m = max(0, len(data) - done)
                joined = out * power(width)
                joined[:m] += block[done : done + m]
                out, done = joined, done + width
        if done == n:
            return out
        m = max(0, len(data) - width)
        wider = block * power(width)
        wider[:m] += block[width : width + m]
        block, width = wider, width * 2


def words(data: np.ndarray, starts: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word [^\\x20\\x09-\\x0D]+, and how many words stand before each text; words don't cross texts.

    between: which bytes separate words.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    word = ~between[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = starts[(starts > 0) & (starts < n)]
    begin[inner] = word[inner]
    end = word.copy()
    end[:-1] &= ~word[1:]
    end[inner - 1] = word[inner - 1]
    b = np.flatnonzero(begin)
    return b, np.flatnonzero(end) + 1, np.searchsorted(b, starts)


_UP = np.zeros(0, np.uint64)
_DOWN = np.zeros(0, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for base in (_MULT, pow(_MULT, -1, 1 << 64)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * power(len(p), base)])
            out.append(p)
        _UP, _DOWN = out
    return _UP, _DOWN


def word_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SALT[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin])


def is_scan(df: DataFrame) -> bool:
    """Whether df only reads, picks and filters rows of files, so that its tasks give the same rows whenever they run."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return bool(plan.strip()) and all(re.match(r"[\s:+\-]*(Project|Filter|Relation|RelationV2)\b", line) for line in plan.splitlines() if line.strip())
