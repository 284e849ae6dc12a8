"""Removal of long strings that an earlier document has, by sorted suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. Which strings
are repeated is decided on the input; matches never cross documents.

1. Documents are dealt into chunks (a bucketed table, so later passes need no shuffle of the texts). Of the k-grams in
   every LENGTH bytes, the one of the smallest hash is the anchor: equal strings have equal anchors. Chunks send the
   anchors' hashes, once each, to the group of their low bits, which returns those that several documents have. Only
   strings with such an anchor can be repeated.
2. The suffixes that hold these strings (the bytes around an anchor, each distinct one once a chunk) are dealt out by
   ranges of the anchor's leading bytes. The ranges' splitters are quantiles of a sample of all chunks' anchors: of the
   first six bytes, and where many anchors of the sample begin with the same six, of the next six of these, and so on
   over an anchor.
3. Each bucket sorts its suffixes by multikey quicksort, eight bytes a step: equal ones stay together and only they go on
   to the next step. What is equal after LENGTH bytes is one string, and its smallest document is sent back to the chunks
   that have it from a later one. Splitters fall between different anchors, never between equal ones, so no run of equal
   suffixes crosses the border of two buckets; bucket() is the comparison that guarantees it.
4. Each chunk marks the covered bytes of its documents.

Copies of a whole text are found by its digest first and go as a whole (if LENGTH bytes long); only the first one's
suffixes are sorted. A passage that very many documents have is sent once by each chunk, so it can't fill a bucket.

Defined results: a null text is an empty one, with nothing removed; rows without doc_id neither lose nor take anything;
rows that share a doc_id take nothing from each other (a copy is a row: of two rows with one doc_id only the one whose
text an earlier document has goes as a whole); an empty table gives an empty table; further columns stay, but one that is
named like a result gives way to it.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import bucketed, flat, give_back, gram_hash, group_of, mix, parts, scratch, stage, word_hash

#: Bytes of a repeated string, and of the k-grams that are anchors.
LENGTH = 50
K = 32
_SPAN = LENGTH - K + 1
#: Bytes of input for each bucket of the table, with CHUNKS chunks; and for each group of anchors and bucket of suffixes.
TABLE_BUCKET = 4 << 20
CHUNKS = 2
GROUP = 4 << 20
#: Anchors that a chunk gives to the sample for splitters, and ranges that a frequent beginning is cut into.
SAMPLE = 32
INNER = 32
#: Bytes that splitters are found by at a time: as many as a double, which quantiles are kept as, holds exactly.
_STEP = 6
_PIECE = 1 << 18
_NOTE = "chunk int, kind int, grp int, a binary, b binary, c binary, value long"
_KINDS = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("grp", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("value", pa.int64())])
_COPY, _ANCHOR, _SAMPLE, _SUFFIX, _REPEAT = range(5)


def _ranges(starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first text, byte range) of runs of whole texts of about _PIECE bytes; a long text comes in overlapping parts."""
    n, i = len(starts) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _PIECE, "right")) - 1)
        j = min(j, n)
        at = int(starts[i])
        while True:
            end = min(int(starts[j]), at + 16 * _PIECE)
            yield i, at, end
            if end == starts[j]:
                break
            at = end - LENGTH + 1
        i = j


def suffixes(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of LENGTH-byte strings with one anchor: text, first and last start, anchor's place and hash."""
    found: dict[str, list] = {"text": [], "first": [], "last": [], "anchor": [], "key": []}
    for _, a, b in _ranges(starts):
        if b - a < LENGTH:
            continue
        part = data[a:b]
        h = mix(gram_hash(part, K)[: b - a - K + 1])
        packed = (h & ~np.uint64((1 << 23) - 1)) | np.arange(len(h), dtype=np.uint64)
        low, width = packed, 1
        while width * 2 <= _SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = _SPAN - width
        if rest:
            low = np.minimum(low[:-rest], low[rest:])
        at = (low & np.uint64((1 << 23) - 1)).astype(np.int64)
        begin = np.arange(a, a + len(at))
        text = np.searchsorted(starts, begin, "right") - 1
        whole = np.flatnonzero(begin + LENGTH <= starts[text + 1])
        if not len(whole):
            continue
        at, begin, text = at[whole], begin[whole], text[whole]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        for name, value in (("text", text[first]), ("first", begin[first]), ("last", begin[last]), ("anchor", at[first] + a), ("key", h[at[first]])):
            found[name].append(value)
    return {k: np.concatenate(v) if v else np.zeros(0, np.uint64 if k == "key" else np.int64) for k, v in found.items()}


class _Chunk:
    """A chunk's documents in ascending order, with the suffixes of those that aren't copies."""

    def __init__(self, docs: pa.Table, notes: pa.Table):
        docs = docs.combine_chunks()
        if docs["text"].null_count:
            docs = docs.set_column(docs.schema.get_field_index("text"), "text", pc.fill_null(docs["text"], ""))
        self.docs = docs.take(pc.sort_indices(docs, [("doc_id", "ascending"), ("text", "ascending")]))
        self.notes = notes
        self.data, self.starts = flat(self.docs["text"])
        ids = self.docs["doc_id"]
        self.null = np.asarray(pc.is_null(ids))
        self.ids = pc.fill_null(ids, 0).to_numpy()
        copies = self._of(_COPY)
        self.copy = np.asarray(pc.fill_null(pc.is_in(ids, value_set=copies["value"].combine_chunks()), False)) & ~self.null
        if self.copy.any():
            # rows that share a doc_id with a copy are told apart by their text
            named = set(zip(copies["value"].to_pylist(), copies["a"].to_pylist(), strict=True))
            for i in np.flatnonzero(self.copy):
                text = self.data[self.starts[i] : self.starts[i + 1]]
                self.copy[i] = (int(self.ids[i]), hashlib.sha256(text.tobytes()).digest()) in named
        s = suffixes(self.data, self.starts)
        use = ~(self.copy | self.null)[s["text"]] if len(s["text"]) else np.zeros(0, bool)
        self.s = {k: v[use] for k, v in s.items()}

    def _of(self, kind: int) -> pa.Table:
        return self.notes.filter(pc.equal(self.notes["kind"], kind))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, sorted, and whether several documents of the chunk have them."""
        order = np.argsort(self.s["key"], kind="stable")
        key, doc = self.s["key"][order], self.ids[self.s["text"][order]]
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        if not len(first):
            return key, new
        return key[first], np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)

    def repeated(self) -> None:
        """Keep the suffixes whose anchor several documents have; number the distinct ones, of which the first is least."""
        keys, several = self.anchors()
        known = [keys[several], *(np.frombuffer(x.as_py(), np.uint64) for x in self._of(_ANCHOR)["a"])]
        known = np.unique(np.concatenate(known))
        s = self.s
        if len(known):
            at = np.minimum(np.searchsorted(known, s["key"] & ~np.uint64(0)), len(known) - 1)
            keep = known[at] == s["key"]
        else:
            keep = np.zeros(len(s["key"]), bool)
        s = self.s = {k: v[keep] for k, v in s.items()}
        shape = (s["last"] - s["first"]) * 64 + s["anchor"] - s["first"]
        content = np.zeros(len(shape), np.uint64)
        for a in range(0, len(shape), 1 << 14):
            some = slice(a, a + (1 << 14))
            lo = int(s["first"][some][0]) if len(shape) else 0
            hi = int(s["last"][some].max()) + LENGTH
            content[some] = word_hash(self.data[lo:hi], s["first"][some] - lo, s["last"][some] + LENGTH - lo)
        content = mix(content + shape.astype(np.uint64))
        _, self.one, self.number = np.unique(content, return_index=True, return_inverse=True)
        self.least = self.ids[s["text"][self.one]] if len(self.one) else np.zeros(0, np.int64)


def _row(chunk: int, kind: int, grp: int, a: bytes | None = None, b: bytes | None = None, c: bytes | None = None, value: int | None = None) -> tuple:
    return chunk, kind, grp, a, b, c, value


def _table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_KINDS)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _KINDS, strict=True)], schema=_KINDS)


def _chunk_of(docs: pa.Table) -> int | None:
    return docs["chunk"][0].as_py() if len(docs) else None


def _send_anchors(groups: int):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        chunk, rows = _chunk_of(docs), []
        if chunk is not None:
            own = _Chunk(docs, notes)
            keys, several = own.anchors()
            group = group_of(keys, groups)
            order = np.argsort(group, kind="stable")
            keys, several, group = keys[order], several[order], group[order]
            cut = np.searchsorted(group, np.arange(groups + 1))
            for g in np.flatnonzero(np.diff(cut)):
                part = slice(cut[g], cut[g + 1])
                rest = keys[part] >> np.uint64(16)
                rows.append(_row(chunk, _ANCHOR, int(g), rest.astype(np.uint32).tobytes(), (rest >> np.uint64(32)).astype(np.uint16).tobytes(), np.packbits(several[part]).tobytes() + (keys[part] & np.uint64(0xFFFF)).astype(np.uint16).tobytes()))
            few = np.argsort(own.s["key"], kind="stable")[:SAMPLE]
            for at in own.s["anchor"][few].tolist():
                rows.append(_row(chunk, _SAMPLE, chunk % groups, own.data[at : at + K].tobytes()))
            del own, keys, several, group, order
        give_back()
        return _table(rows)

    return run


def _leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as a number that sorts like them."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[at + k]
    return out


def _leading_all(data: np.ndarray) -> np.ndarray:
    """_leading of every place, with zeros behind the end."""
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out[: max(0, len(data) - k)] |= data[k:]
    return out


def _several(table: pa.Table) -> pa.Table:
    """A group's anchors: back to each chunk go those that another chunk has too."""
    rows = [tuple(r.values()) for r in table.filter(pc.equal(table["kind"], _SAMPLE)).to_pylist()]
    packets = table.filter(pc.equal(table["kind"], _ANCHOR))
    if len(packets):
        low = [np.frombuffer(x.as_py(), np.uint32) for x in packets["a"]]
        high = [np.frombuffer(x.as_py(), np.uint16) for x in packets["b"]]
        tail = [np.frombuffer(x.as_py()[-2 * len(n) :], np.uint16) for x, n in zip(packets["c"], low, strict=True)]
        key = (np.concatenate(low).astype(np.uint64) << np.uint64(16)) | (np.concatenate(high).astype(np.uint64) << np.uint64(48)) | np.concatenate(tail)
        order = np.argsort(key)
        new = np.append(True, key[order][1:] != key[order][:-1])
        run = np.cumsum(new) - 1
        shared = np.empty(len(key), bool)
        shared[order] = np.bincount(run)[run] > 1
        at = 0
        for n, chunk in zip(low, packets["chunk"].to_pylist(), strict=True):
            part = slice(at, at + len(n))
            at += len(n)
            if shared[part].any():
                rows.append(_row(chunk, _ANCHOR, 0, key[part][shared[part]].tobytes()))
    return _table(rows)


def bucket(leading: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """The bucket of each suffix by its anchor; equal anchors are never on both sides of a splitter."""
    return np.searchsorted(splitters, leading, "right")


def _anchor_bytes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The K bytes of each anchor as strings that numpy compares byte by byte."""
    out = np.empty((len(at), K), np.uint8)
    for k in range(K):
        out[:, k] = data[at + k]
    return out.view(f"S{K}").ravel()


def _splitters(samples: DataFrame, many: int) -> list[bytes]:
    """Sorted prefixes (of one or more times _STEP bytes) that cut the sampled anchors (column a) into ranges.

    Of those that begin alike in two or more of many quantiles, the next bytes are cut in turn, into INNER ranges.
    """

    def word(k: int) -> Column:
        return F.conv(F.hex(F.substring("a", _STEP * k + 1, _STEP)), 16, 10).cast("long")

    def name(v: int) -> bytes:
        return int(v).to_bytes(_STEP, "big")

    cuts = [k / many for k in range(1, many)]
    first = (samples.agg(F.percentile_approx(word(0), cuts, 100_000).alias("q")).collect()[0].q or []) if cuts else []
    out = {name(v) for v in first}
    hot = {name(v) for v, n in Counter(first).items() if n > 1}
    for k in range(1, K // _STEP):
        if not hot:
            break
        head = F.substring("a", 1, _STEP * k)
        some = samples.join(F.broadcast(samples.sparkSession.createDataFrame([(bytearray(h),) for h in sorted(hot)], "head binary")), F.col("head") == head)
        inner = [j / INNER for j in range(1, INNER)]
        rows = some.groupBy("head").agg(F.percentile_approx(word(k), inner, 10_000).alias("q")).collect()
        hot = set()
        for r in rows:
            found = Counter(r.q)
            out |= {bytes(r.head) + name(v) for v in found}
            hot |= {bytes(r.head) + name(v) for v, n in found.items() if n > 1}
    return sorted(out)


def _send_suffixes(splitters: list[bytes]):
    cuts = np.array(splitters, f"S{K}")

    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        chunk, rows = _chunk_of(docs), []
        if chunk is not None:
            own = _Chunk(docs, notes)
            own.repeated()
            one = own.one
            first, last, anchor = (own.s[k][one] for k in ("first", "last", "anchor"))
            to = bucket(_anchor_bytes(own.data, anchor), cuts)
            order = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[order], np.arange(len(cuts) + 2))
            pack = zstandard.ZstdCompressor(1)
            for g in np.flatnonzero(np.diff(edges)):
                these = order[edges[g] : edges[g + 1]]
                sizes = last[these] - first[these] + LENGTH
                at = np.repeat(first[these] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
                rows.append(_row(chunk, _SUFFIX, int(g), these.astype(np.uint32).tobytes(), pack.compress(own.data[at].tobytes()), pack.compress(np.concatenate([sizes.astype(np.int64), own.least[these]]).tobytes())))
            del own, one, first, last, anchor, to, order
        give_back()
        return _table(rows)

    return run


def _places(n: int) -> type[np.signedinteger]:
    """The smallest kind of numbers for n places: what sorts a bucket is most of a worker's memory."""
    return np.int32 if n < 1 << 31 else np.int64


def equal_strings(n: int, steps: int, word: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of n strings by one word after the other: places of strings that have an equal, and their runs.

    word(k, at) are the k-th words of the strings at some places; only those that are equal so far are asked for.
    """
    small = _places(n)
    at, run = np.arange(n, dtype=small), np.zeros(n, small)
    for k in range(steps):
        w = word(k, at)
        order = np.argsort(w)
        w = w[order]
        rank = np.empty(len(at), small)
        rank[order] = np.cumsum(np.append(False, w[1:] != w[:-1]), dtype=small)[: len(at)]
        del w
        # by run, then by rank: two sorts of plain numbers are quicker than one of pairs
        key = run.astype(np.int64) << 32 | rank
        del rank
        order = np.argsort(key) if run.any() else order
        at, key = at[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        del key, order
        run = np.cumsum(new, dtype=small) - small(1)
        keep = np.bincount(run)[run] > 1 if len(run) else np.zeros(0, bool)
        at, run = at[keep], run[keep]
        if not len(at):
            break
    return at, run


def _sort(table: pa.Table) -> pa.Table:
    """A bucket: back to each chunk go its suffixes' strings that an earlier document has, as runs of starts."""
    unpack = zstandard.ZstdDecompressor()
    chunks = table["chunk"].to_pylist()
    numbers = [np.frombuffer(x.as_py(), np.uint32) for x in table["a"]]
    meta = [np.frombuffer(unpack.decompress(x.as_py()), np.int64).reshape(2, -1) for x in table["c"]]
    data = np.frombuffer(b"".join(unpack.decompress(x.as_py()) for x in table["b"]), np.uint8)
    sizes, least = np.concatenate([m[0] for m in meta]), np.concatenate([m[1] for m in meta])
    begin = np.cumsum(sizes) - sizes
    many = sizes - LENGTH + 1
    small = _places(len(data))
    owner = np.repeat(np.arange(len(sizes), dtype=small), many)
    place = np.arange(len(owner), dtype=small) - np.repeat((np.cumsum(many) - many).astype(small), many)
    start = begin.astype(small)[owner] + place
    eight = _leading_all(data)
    steps = (*range(0, LENGTH - 8, 8), LENGTH - 8)
    at, run = equal_strings(len(start), len(steps), lambda k, at: eight[start[at] + steps[k]])
    rows = []
    if len(at):
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        smallest = np.minimum.reduceat(least[owner[at]], first)[run - run[0]] if len(first) == run[-1] + 1 else np.repeat(np.minimum.reduceat(least[owner[at]], first), np.diff(np.append(first, len(at))))
        late = smallest < least[owner[at]]
        at, smallest = at[late], smallest[late]
        order = np.argsort(at)
        at, smallest = at[order], smallest[order]
        if len(at):
            own, where = owner[at], place[at]
            new = np.ones(len(at), bool)
            new[1:] = (own[1:] != own[:-1]) | (where[1:] != where[:-1] + 1) | (smallest[1:] != smallest[:-1])
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(at)) - 1
            edges = np.searchsorted(own[a], np.cumsum([0, *map(len, numbers)]))
            number = np.concatenate(numbers)
            pack = zstandard.ZstdCompressor(1)
            for k, chunk in enumerate(chunks):
                these = slice(edges[k], edges[k + 1])
                if edges[k + 1] > edges[k]:
                    found = np.stack([number[own[a[these]]].astype(np.int64), where[a[these]], where[b[these]], smallest[a[these]]])
                    rows.append(_row(chunk, _REPEAT, 0, pack.compress(found.tobytes())))
    del data, eight, sizes, least, start, owner, place
    give_back()
    return _table(rows)


def _mark(texts: bool, schema: pa.Schema):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not len(docs):
            return schema.empty_table()
        own = _Chunk(docs, notes)
        own.repeated()
        s, number = own.s, own.number
        doc = own.ids[s["text"]] if len(number) else np.zeros(0, np.int64)
        edge = np.zeros(len(own.data) + 1, np.int64)
        # the same bytes around the anchor in an earlier document of this chunk
        late = own.least[number] < doc if len(number) else np.zeros(0, bool)
        np.add.at(edge, s["first"][late], 1)
        np.add.at(edge, s["last"][late] + LENGTH, -1)
        order = np.argsort(number, kind="stable")
        cut = np.searchsorted(number[order], np.arange(len(own.one) + 1))
        unpack = zstandard.ZstdDecompressor()
        for packed in own._of(_REPEAT)["a"]:
            which, a, b, smallest = np.frombuffer(unpack.decompress(packed.as_py()), np.int64).reshape(4, -1)
            times = cut[which + 1] - cut[which]
            each = np.repeat(np.arange(len(which)), times)
            at = order[np.repeat(cut[which] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            ok = smallest[each] < doc[at]
            each, at = each[ok], at[ok]
            np.add.at(edge, s["first"][at] + a[each], 1)
            np.add.at(edge, s["first"][at] + b[each] + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        sizes = np.diff(own.starts)
        out: dict[str, list] = {"n_bytes": sizes.tolist(), "n_removed": [], "n_spans": [], "kept_sha256": [], "text": []}
        for i, (a, b) in enumerate(zip(own.starts[:-1].tolist(), own.starts[1:].tolist(), strict=True)):
            part = gone[a:b]
            if own.copy[i]:
                part = np.full(b - a, b - a >= LENGTH)
            n = int(part.sum())
            kept = (own.data[a:b] if not n else own.data[a:b][~part]).tobytes()
            out["n_removed"].append(n)
            out["n_spans"].append(int(part[0]) + int((part[1:] & ~part[:-1]).sum()) if n else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if texts:
                out["text"].append(kept.decode(errors="ignore"))
        columns = [pa.array(out[f.name], f.type) if f.name in out else own.docs[f.name].cast(f.type) for f in schema]
        del own, s, edge, gone, out
        give_back()
        return pa.table(columns, schema=schema)

    return run


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """docs' columns but text, with n_bytes, n_removed, n_spans and kept_sha256; with texts, also text: what is left.

    The text that is left is UTF-8 again: what remains of a character that was cut is dropped from it (not from the
    digest, which is of the remaining bytes). The result is a written table; what was written on the way is deleted.
    """
    with scratch(docs.sparkSession):
        results = {"n_bytes", "n_removed", "n_spans", "kept_sha256"}
        names = [c for c in docs.columns if c.lower() not in results]
        # columns by place, so that none has a name that is used on the way
        own = [c if c in ("doc_id", "text") else f"own_{k}" for k, c in enumerate(names)]
        kinds = {"doc_id": "long", "text": "string"}
        table = bucketed(docs.select(*[(F.col(f"`{c}`").cast(kinds[c]) if c in kinds else F.col(f"`{c}`")).alias(o) for c, o in zip(names, own, strict=True)]), TABLE_BUCKET, CHUNKS)
        spark = docs.sparkSession
        groups = parts(table, GROUP)
        digests = table.filter("doc_id is not null and text is not null").select("chunk", "doc_id", F.sha2("text", 256).alias("digest"))
        firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last")
        # a plain table, so that the join with a text of very many copies can be split
        copies = digests.join(stage(firsts.select("digest", "first"), "suffix-firsts"), "digest").filter("doc_id > first")
        empty = F.lit(None).cast("binary")
        notes = stage(copies.select("chunk", F.lit(_COPY).alias("kind"), F.lit(0).alias("grp"), F.unhex("digest").alias("a"), empty.alias("b"), empty.alias("c"), F.col("doc_id").alias("value")), "suffix-notes")

        def meet(f, columns: DataFrame, kind: str) -> DataFrame:
            return columns.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(f, kind)

        slim = table.select("chunk", "doc_id", "text")
        anchors = meet(_send_anchors(groups), slim, _NOTE).groupBy("grp").applyInArrow(_several, _NOTE)
        anchors = stage(anchors, "suffix-anchors")
        splitters = _splitters(anchors.filter(F.col("kind") == _SAMPLE).select("a"), groups)
        notes = notes.union(anchors.filter(F.col("kind") == _ANCHOR))
        repeats = meet(_send_suffixes(splitters), slim, _NOTE).groupBy("grp").applyInArrow(_sort, _NOTE)
        notes = notes.union(stage(repeats, "suffix-repeats"))
        kinds = {f.name: f.dataType.simpleString() for f in table.schema}
        result = {c: kinds[c] for c in own if c != "text"} | {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"} | ({"text": "string"} if texts else {})
        ddl = ", ".join(f"`{c}` {k}" for c, k in result.items())
        left = meet(_mark(texts, to_arrow_schema(_parse_datatype_string(ddl))), table, ddl)
        back = [F.col(o).alias(c) for c, o in zip(names, own, strict=True) if texts or c != "text"]
        return stage(left.select(*back, *[F.col(c) for c in result if c not in own]), "suffix-left", keep=True)
