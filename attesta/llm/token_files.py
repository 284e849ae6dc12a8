"""Token ids in length-delimited binary files, with a separate offset index for shuffled reads.

One file (shard) for each range of doc_ids; in it one frame for each document, in ascending order:

    u64 length of the payload | u32 masked CRC-32 of those 8 bytes | payload | u32 masked CRC-32 of the payload | 0x0A

all little-endian; payload: i64 doc_id, u8 (1 if the doc_id is null), then the ids as u16, or as u32 where the
vocabulary is larger. A masked checksum is the CRC-32 rotated right by 15 bits plus a constant, so that a checksum of
data that holds checksums stays sound. Spark's own writer commits the files, so a lost task leaves none behind, and
Spark's own reader gets them back from any store.

The index (Parquet) has, for each document, its shard, the offset and length of its frame, the number of ids and the
number of ids before it in the shard; rows can so be read in any order, one frame at a time.

Defined results: a null text is an empty one: only the end id. Rows without a doc_id come first. Rows with equal doc_id
follow by the hash of their text, equal rows one after the other. An empty table gives no frames.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_columns, input_bytes, shared_dir, sized

SHARD_BYTES = 12 << 20
KEPT_WORDS = 1_000_000
#: So many words of texts in a row are looked up at once.
TOGETHER = 50_000
#: White space of Unicode, which splits a text where no token crosses: before the first of a run.
_WS = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_WORDS = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")


class CachedTokenizer:
    """A tokenizers file with a bounded table of words that are encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        #: Tokens that the library takes out of a text before it looks at the rest; what stands between them is a text each.
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.marks = added
        self.wide = self.library.get_vocab_size() > 1 << 16
        self.type = np.dtype("<u4" if self.wide else "<u2")
        self.cache: dict[str, bytes] = {}
        #: Bytes of each token, as a byte-level vocabulary spells a byte as a letter.
        self.width: np.ndarray | None = None

    def learn(self, words: set[str]) -> None:
        """Keep those of the words that aren't kept yet, once more if others had to go for them."""
        new = words.difference(self.cache)
        if self._learn(list(new)):
            self._learn(list(words.difference(self.cache)))

    def _learn(self, words: list[str]) -> bool:
        """Keep words that aren't kept yet; whether others had to go. A mark right after a letter is never in one token with it, so that the many
        words with a mark behind are put together from the word and the mark."""
        full = len(self.cache) + len(words) > KEPT_WORDS
        if full:
            for old in list(self.cache)[: max(KEPT_WORDS // 2, len(words))]:
                del self.cache[old]
        cache, joined, plain = self.cache, [], []
        for w in words:
            if w[-1] in ",." and len(w) > 1 and w[-2].isalpha():
                joined.append(w)
            else:
                plain.append(w)
        plain += {x for w in joined for x in (w[:-1], w[-1]) if x not in cache}.difference(plain)
        plain = self._in_rows(plain)
        code = "I" if self.wide else "H"
        for w, got in zip(plain, self.library.encode_batch_fast(plain, add_special_tokens=False), strict=True):
            cache[w] = array(code, got.ids).tobytes()
        for w in joined:
            cache[w] = cache[w[:-1]] + cache[w[-1]]
        return full

    def _in_rows(self, words: list[str]) -> list[str]:
        """Keep words that follow white space, encoded one behind the other: no token crosses from one to the next, and the bytes
        of tokens tell where each word ends. The words that are left to encode one by one."""
        rest, rows = [], []
        for w in words:
            (rows if w[0] in _WS and w[-1] not in _WS else rest).append(w)
        if len(rows) < 2:
            return words
        if self.width is None:
            vocabulary = self.library.get_vocab()
            self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]
        for at in range(0, len(rows), 20_000):
            some = rows[at : at + 20_000]
            texts = ["".join(some[i : i + 200]) for i in range(0, len(some), 200)]
            got = [array("I", x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            ids = np.concatenate([np.frombuffer(x, np.uint32) for x in got])
            ends, want = np.cumsum(self.width[ids]), np.cumsum([len(w.encode()) for w in some])
            cut = np.searchsorted(ends, want)
            if len(ids) == 0 or ends[-1] != want[-1] or (ends[cut] != want).any() or any(mark in t for t in texts for mark in self.marks):
                rest += some  # a tokenizer whose tokens aren't the text's bytes
                continue
            raw, size, start = ids.astype(self.type).tobytes(), self.type.itemsize, 0
            for w, end in zip(some, ((cut + 1) * size).tolist(), strict=True):
                self.cache[w] = raw[start:end]
                start = end
        return rest

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """encode() of each text; the new words of many texts are found and learnt at once."""
        out: list[bytes] = [b""] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            if any(mark in text for mark in self.marks):
                out[i] = self.encode(text)
            else:
                held.append((i, _WORDS.findall(text)))
                size += len(held[-1][1])
            if held and (size > TOGETHER or i == len(texts) - 1):
                if len(held) > 1:
                    self.learn(set().union(*(words for _, words in held)))
                    for k, words in held:
                        out[k] = self._joined(words)
                else:
                    out[held[0][0]] = self._plain(held[0][1])
                held, size = [], 0
        return out

    def encode(self, text: str) -> bytes:
        if any(mark in text for mark in self.marks):
            # the pieces at odd places are the added tokens themselves
            parts = self.added.split(text)
            return b"".join(self._alone(part) if k % 2 else self._plain(_WORDS.findall(part)) for k, part in enumerate(parts))
        return self._plain(_WORDS.findall(text))

    def _plain(self, words: list[str]) -> bytes:
        out = []
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            self.learn(set(some))
            out.append(self._joined(some))
        return b"".join(out)

    def _joined(self, words: list[str]) -> bytes:
        try:
            return b"".join(map(self.cache.__getitem__, words))
        except KeyError:  # learning others has pushed some of them out
            return b"".join(self.cache[w] if w in self.cache else self._alone(w) for w in words)

    def _alone(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, self.type).tobytes()


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """A frame without its last byte."""
    payload = struct.pack("<qB", doc_id or 0, doc_id is None) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def frames(content: bytes) -> Iterator[tuple[int, int, int | None, memoryview]]:
    """Offset, length, doc_id and id bytes of every frame; a wrong checksum or a torn frame is an error."""
    at, view = 0, memoryview(content)
    while at < len(view):
        if len(view) - at < 12 or struct.unpack_from("<I", view, at + 8)[0] != masked_crc(view[at : at + 8]):
            raise ValueError(f"wrong length checksum at byte {at}")
        (size,) = struct.unpack_from("<Q", view, at)
        end = at + 12 + size + 5
        if end > len(view) or view[end - 1] != 10 or struct.unpack_from("<I", view, end - 5)[0] != masked_crc(view[at + 12 : end - 5]):
            raise ValueError(f"wrong payload checksum at byte {at}")
        doc_id, null = struct.unpack_from("<qB", view, at + 12)
        yield at, end - at, None if null else doc_id, view[at + 21 : end - 5]
        at = end


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Write the shards under path."""
    rows = sized(ensure_columns(docs, doc_id="long", text="string")).withColumn("h", F.xxhash64("text"))
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), input_bytes(rows) // SHARD_BYTES + 1)
    ordered = rows.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(tokenizer_path)
        end = np.array([end_id], own.type).tobytes()
        for batch in batches:
            held, size = [], 0
            for at in range(0, len(batch), 200):  # texts as Python strings take several times their bytes
                some = batch.slice(at, 200)
                texts = [text or "" for text in some.column(1).to_pylist()]
                for i, (doc_id, ids) in enumerate(zip(some.column(0).to_pylist(), own.encode_all(texts), strict=True), at):
                    held.append(frame(doc_id, ids + end))
                    size += len(held[-1])
                    if size > 4 << 20 or i == len(batch) - 1:
                        # the writer ends each row with the frame's last byte
                        yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(held)], pa.binary())], names=["frames"])
                        held, size = [], 0

    ordered.mapInArrow(run, "frames binary").select(F.col("frames").cast("string")).write.option("lineSep", "\n").text(f"{path}/shards")


def read_index(spark, path: str, wide: bool = False) -> DataFrame:
    """Parse all shards: shard, offset, length, doc_id, n_tokens, before (ids before it in the shard), ids_crc32 (of u32)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    schema = pa.schema([("shard", pa.int32()), ("place", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                shard = int(re.search(r"/part-(\d+)", name.as_py())[1])
                rows, before = [], 0
                for place, (offset, length, doc_id, raw) in enumerate(frames(content.as_buffer())):
                    ids = np.frombuffer(raw, "<u4" if wide else "<u2")
                    rows.append((shard, place, offset, length, doc_id, len(ids), before, zlib.crc32(ids.astype("<u4"))))
                    before += len(ids)
                for at in range(0, len(rows), 10_000):
                    some = zip(*rows[at : at + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(k).type) for k, c in enumerate(some)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "shard int, place long, offset long, length long, doc_id long, n_tokens long, before long, ids_crc32 long")


def export(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None) -> tuple[str, DataFrame]:
    """Write shards and index, and return the folder and the index as read back, with start: the ids of all documents before."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer_path, end_id)
    parsed = read_index(spark, path, tokenizer(tokenizer_path).wide)
    schema = parsed.schema
    parsed.write.parquet(f"{path}/index")
    index = spark.read.schema(schema).parquet(f"{path}/index")
    # one row for each shard, so the running total over them is small
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    return path, index.join(bases, "shard").withColumn("start", F.col("base") + F.col("before")).drop("base")
