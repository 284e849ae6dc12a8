"""Similarity join of documents on the Jaccard similarity of their word n-gram sets, by rare-first prefix filtering.

1. Documents are read in chunks; equal sets of a chunk are one class. Each chunk sends its classes' n-grams (hashes of 64
   bits) once to the group of their low bits, packed. A group counts in how many classes of all chunks each n-gram is, and
   sends those found at least twice back to the chunks, with that number. What is in one class only can't be shared.
2. A class keeps its shared n-grams, rarest first. It goes on only if they are enough to reach the threshold; what it has
   in its prefix beyond the n-grams of its own is what it is joined on (prefix and length filter). Equal sets of
   different chunks become one class here.
3. Classes that share a rare prefix n-gram are candidates if their lengths allow it and if, after their last shared prefix
   n-gram, enough n-grams are left on both sides (positional filter). A pair is verified once, after a comparison of both
   sets' counts by parts of the hash range (suffix filter).
4. A prefix n-gram of many classes (FREQUENT) would make a row of each pair of a large group of near copies. What such
   n-grams hold together is a family: its classes meet in blocks, where pairs are counted by matrix products; each class's
   number of links goes out, and edges that connect what links. A pair of one family isn't a candidate anywhere else.

Defined results: a text without words or a null one has an empty set, and is linked with nothing; with fewer than n words
the whole sequence is the one n-gram; equal sets are linked; rows without doc_id count as members but never name a
component (null if none of its documents has an id); repeated rows stay; further columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ensure_columns, flat, group_of, is_scan, mix, parts, pieces, scratch, stage, trimmed, word_hash, words
from .components import components

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 4 << 20
#: Bytes of input for each group of n-grams.
GROUP = 3 << 20
#: Links need 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
N = 5
#: Prefix n-grams of more classes hold families together, whose pairs are never made into rows.
FREQUENT = 24
#: Classes of a family's block at least; large families have blocks of up to 16 times as many.
BLOCK = 256
_PARTS = 16
#: Parts of a component's classes that are named apart.
SALTS = 256
#: Numbers of a matrix of sets by n-grams.
_MATRIX = 1 << 22


def sets(data: np.ndarray, starts: np.ndarray, n: int = N) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-grams of words, A-Z in lower case."""
    low = LOWER[data]
    begin, end, before = words(low, starts)
    h = word_hash(low, begin, end)
    m = max(len(h) - n + 1, 0)
    run = np.zeros(m, np.uint64)
    for k in range(n):
        run = mix(run * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(run[a : b - n + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            # a shorter sequence never equals one of n words: its length goes in
            short = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                short = mix(short * np.uint64(0x9E3779B97F4A7C15) + x)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _least(n: np.ndarray | int, threshold: int) -> np.ndarray | int:
    """How many n-grams a set of n must share with any set that it may be linked with."""
    return -(-threshold * n // 100)


_CHUNK_ROWS = "grp int, chunk long, header boolean, a binary, b binary, c binary, d binary"


def _chunks(groups: int, n: int):
    """Rows of (doc_id, text) to packets; a chunk's header has its documents' ids, set sizes, signatures and classes."""

    def emit(chunk: int, ids: list, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        signs = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"" for s in found]
        classes = {g: k for k, g in enumerate(dict.fromkeys(g for g in signs if g))}
        first = {g: i for i, g in reversed(list(enumerate(signs)))}
        reps = [found[first[g]] for g in classes]
        sizes = np.array([len(s) for s in reps], np.int64)
        id_bytes = np.array([i or 0 for i in ids], np.int64).tobytes() + np.array([i is None for i in ids]).tobytes()
        rows = [(chunk % groups, chunk, True, id_bytes, np.array([len(s) for s in found], np.int64).tobytes(), b"".join(g or bytes(16) for g in signs), np.array([classes.get(g, -1) for g in signs], np.int32).tobytes())]
        if reps:
            key = np.concatenate(reps)
            group = group_of(key, groups)
            own = np.repeat(np.arange(len(reps)), sizes)
            order = np.argsort(group, kind="stable")
            key, group, own = key[order] >> np.uint64(16), group[order], own[order]
            cut = np.searchsorted(group, np.arange(groups + 1))
            for g in np.flatnonzero(np.diff(cut)):
                part = slice(cut[g], cut[g + 1])
                counts = np.bincount(own[part], minlength=len(reps)).astype(np.uint32)
                rows.append((int(g), chunk, False, counts.tobytes(), key[part].astype(np.uint32).tobytes(), (key[part] >> np.uint64(32)).astype(np.uint16).tobytes(), None))
        for at in range(0, len(rows), 64):
            columns = zip(*rows[at : at + 64], strict=True)
            kinds = (pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["grp", "chunk", "header", "a", "b", "c", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        ids: list = []
        found: list[np.ndarray] = []
        size = 0
        for batch in batches:
            data, starts = flat(batch.column(1))
            all_ids = batch.column(0).to_pylist()
            for a, b in pieces(starts, 1 << 20):
                if found and (size + starts[b] - starts[a] > CHUNK or len(found) > 50_000):
                    yield from emit(chunk, ids, found)
                    chunk, ids, found, size = chunk + 1, [], [], 0
                found += sets(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], n)
                ids += all_ids[a:b]
                size += int(starts[b] - starts[a])
        if found:
            yield from emit(chunk, ids, found)

    return run


def _count(table: pa.Table) -> pa.Table:
    """All packets of a group: back to each chunk go the n-grams that are in several classes, and in how many."""
    packets = table.filter(pc.invert(table["header"]))
    group = table["grp"][0].as_py()
    out = table.filter(table["header"]).to_pylist()
    lows = [np.frombuffer(x.as_py(), np.uint32) for x in packets["b"]]
    if lows:
        highs = [np.frombuffer(x.as_py(), np.uint16) for x in packets["c"]]
        key = np.concatenate(lows).astype(np.uint64) | (np.concatenate(highs).astype(np.uint64) << np.uint64(32))
        order = np.argsort(key)
        new = np.append(True, key[order][1:] != key[order][:-1])
        run = np.cumsum(new) - 1
        many = np.bincount(run)
        df = np.empty(len(key), np.int64)
        df[order] = many[run]
        at = 0
        for low, chunk, counts in zip(lows, packets["chunk"].to_pylist(), packets["a"], strict=True):
            part = slice(at, at + len(low))
            at += len(low)
            shared = df[part] > 1
            if shared.any():
                each = np.frombuffer(counts.as_py(), np.uint32).astype(np.int64)
                left = np.bincount(np.repeat(np.arange(len(each)), each)[shared], minlength=len(each)).astype(np.uint32)
                out.append({"grp": group, "chunk": chunk, "header": False, "a": left.tobytes(), "b": key[part][shared].tobytes(), "c": np.minimum(df[part][shared], 0xFFFFFFFF).astype(np.uint32).tobytes(), "d": None})
    return pa.Table.from_pylist(out, schema=table.schema)


def _gather(threshold: int):
    """A chunk's header and answers: one row a document, with the shared n-grams (rarest first) of classes that may link."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sign", pa.binary()), ("shared", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["header"])
        n = np.frombuffer(head["b"], np.int64)
        ids, null = np.frombuffer(head["a"][: 8 * len(n)], np.int64), np.frombuffer(head["a"][8 * len(n) :], bool)
        cls = np.frombuffer(head["d"], np.int32)
        classes = int(cls.max()) + 1 if len(cls) else 0
        lists: list[bytes | None] = [None] * classes
        answers = sorted((r for r in rows if not r["header"]), key=lambda r: r["grp"])
        if answers:
            own = np.concatenate([np.repeat(np.arange(classes), np.frombuffer(r["a"], np.uint32).astype(np.int64)) for r in answers])
            key = np.concatenate([np.frombuffer(r["b"], np.uint64) << np.uint64(16) | np.uint64(r["grp"] & 0xFFFF) for r in answers])
            df = np.concatenate([np.frombuffer(r["c"], np.uint32) for r in answers])
            size = np.zeros(classes, np.int64)
            size[cls[cls >= 0]] = n[cls >= 0]
            have = np.bincount(own, minlength=classes)
            go = (have >= _least(size, threshold)) & (have > 0)
            keep = go[own]
            own, key, df = own[keep], key[keep], df[keep]
            order = np.lexsort((key, df, own))
            own, key = own[order], key[order]
            cut = np.searchsorted(own, np.arange(classes + 1))
            for k in np.flatnonzero(go):
                lists[k] = key[cut[k] : cut[k + 1]].tobytes()
        seen: set[int] = set()
        shared = []
        for c in cls.tolist():
            shared.append(lists[c] if c >= 0 and c not in seen else None)
            seen.add(c)
        signs = [head["c"][16 * i : 16 * i + 16] if n[i] else None for i in range(len(n))]
        return pa.table([pa.array([None if z else int(i) for i, z in zip(ids, null, strict=True)], pa.int64()), pa.array(n), pa.array(signs, pa.binary()), pa.array(shared, pa.binary())], schema=schema)

    return run


def _postings(threshold: int):
    """Classes (v, n, shared) to a row for each n-gram that they are joined on: gram, v, n, at (its place in the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, vs, ns, ats, held = [], [], [], [], 0
            for i, (v, n, shared) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
                key = np.frombuffer(shared.as_buffer(), np.uint64)
                alone = n - len(key)
                m = max(n - _least(n, threshold) + 1 - alone, 0)
                grams.append(key[:m].view(np.int64))
                vs.append(np.full(m, v, np.int64))
                ns.append(np.full(m, n, np.int64))
                ats.append(np.arange(alone, alone + m))
                held += m
                if held > 100_000 or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (grams, vs, ns, ats)], names=["gram", "v", "n", "at"])
                    grams, vs, ns, ats, held = [], [], [], [], 0

    return run


def _verify(threshold: int):
    """Pairs with both sets to those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint64))
            for i, (a, b, na, nb, x, y) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), batch.column(5), strict=True)):
                if b != last[0]:
                    last = (b, np.sort(np.frombuffer(y.as_buffer(), np.uint64)))
                need = -(-threshold * (na + nb) // (100 + threshold))
                left, right = np.sort(np.frombuffer(x.as_buffer(), np.uint64)), last[1]
                if min(len(left), len(right)) < need:
                    continue
                # suffix filter: both sets' counts in equal parts of the hash range
                edges = np.arange(1, _PARTS, dtype=np.uint64) << np.uint64(60)
                p, q = (np.diff(np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])) for s in (left, right))
                if np.minimum(p, q).sum() < need:
                    continue
                both = len(np.intersect1d(left, right, assume_unique=True))
                ok[i] = 100 * both >= threshold * (na + nb - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    return run


def _links(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b) those that link."""
    left = pairs.join(classes.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("shared").alias("x")), "a")
    both = left.join(classes.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("y")), "b")
    return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(_verify(threshold), "a long, b long")


def _meet(rows: DataFrame, threshold: int) -> DataFrame:
    """rows: one for each shared prefix n-gram of a pair (a, b, na, nb, at_a, at_b), to pairs that may still link."""
    need = F.ceil(F.lit(threshold) * (F.col("na") + F.col("nb")) / F.lit(100 + threshold))
    pair = rows.groupBy("a", "b").agg(F.count("*").alias("k"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return pair.filter(F.col("k") + F.least(F.col("na") - F.col("at_a") - 1, F.col("nb") - F.col("at_b") - 1) >= need).select("a", "b")


def _cell(threshold: int):
    """The classes of two blocks of a family that link between them: b, its links n here, and a, the smallest it reaches.

    a is b itself for the smallest; (a, b) only connects and need not link. Every pair is in one cell, so n adds up.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        table = table.sort_by("v")
        block, v, n = (table[c].to_numpy() for c in ("block", "v", "n"))
        keys = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in table["shared"].chunks for x in chunk]
        first, second = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        if not len(first) or not len(second):
            return schema.empty_table()
        both = np.zeros((len(first), len(second)), np.float32)
        own = np.repeat(np.arange(len(v)), [len(k) for k in keys])
        # each n-gram found twice is a column; columns are taken some at a time, so neither long texts nor many take more memory
        distinct, column, many = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        kept = many[column] > 1
        own, column = own[kept], (np.cumsum(many > 1) - 1)[column[kept]]
        order = np.argsort(column, kind="stable")
        own, column = own[order], column[order]
        place_a, place_b = np.full(len(v), -1), np.full(len(v), -1)
        place_a[first], place_b[second] = np.arange(len(first)), np.arange(len(second))
        step = max(256, _MATRIX // max(len(first), len(second)))
        for start in range(0, int((many > 1).sum()), step):
            part = slice(*np.searchsorted(column, [start, start + step]))
            x, y = np.zeros((len(first), step), np.float32), np.zeros((len(second), step), np.float32)
            for matrix, place in ((x, place_a), (y, place_b)):
                row = place[own[part]]
                ok = row >= 0
                matrix[row[ok], column[part][ok] - start] = 1
            both += x @ y.T
        links, label = np.zeros(len(v), np.int64), np.arange(len(v))
        # rows that link, some at a time
        near = [np.flatnonzero(100 * both[i] >= threshold * (n[first[i]] + n[second] - both[i])) for i in range(len(first))]
        near = [second[at] for at in near]
        near = [at[at != i] for at, i in zip(near, first.tolist(), strict=True)]
        for at, i in zip(near, first.tolist(), strict=True):
            links[i] += len(at)
            if lo != hi:
                links[at] += 1
        # each class takes the smallest number that it reaches
        moved = True
        while moved:
            moved = False
            for at, i in zip(near, first.tolist(), strict=True):
                if len(at):
                    least = min(label[i], label[at].min())
                    if label[i] != least or (label[at] != least).any():
                        label[i] = least
                        label[at] = least
                        moved = True
        at = np.flatnonzero(links)
        return pa.table([pa.array(v[label[at]]), pa.array(v[at]), pa.array(links[at])], schema=schema)

    return run


def _bands(threshold: int):
    """The band of a set's size: sets that may link are in one band or in two next to each other (length filter)."""
    # a little wider than the threshold's ratio, so that rounding can't part two sets that link
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / threshold * 1.0001))).cast("long") if threshold < 100 else F.col("n")


def _family_links(post: DataFrame, classes: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(v, family) of classes with a frequent prefix n-gram, and what links within families as rows of _cell.

    post: v and c, the smallest class of the n-gram, for each class with a frequent prefix n-gram.

    A family is what frequent n-grams hold together. Its classes are cut into bands of sizes, and these into blocks by a
    hash; two blocks of one band, or of bands next to each other, meet in a task of their own, where pairs are counted by
    matrix products; what goes out of a task is one row a class at most. Other bands can't link and never meet.
    """
    hubs = post.filter("v <> c").select(F.col("c").alias("a"), F.col("v").alias("b")).distinct()
    family = stage(components(hubs).withColumnRenamed("comp", "family"), "jaccard-families")
    banded = family.join(classes.select("v", "n"), "v").withColumn("band", _bands(threshold))
    size = banded.groupBy("family", "band").agg(F.count("*").alias("m"))
    block = F.greatest(F.lit(BLOCK), F.least(F.lit(16 * BLOCK), F.ceil(F.col("m") / 32)))
    blocks = stage(size.select("family", "band", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "jaccard-blocks")
    # what a block meets: its band's own blocks, all of the band above, all of the band below
    up, down = (blocks.select("family", (F.col("band") + k).alias("band"), F.col("blocks").alias(name)) for k, name in ((-1, "above"), (1, "below")))
    meets = blocks.join(up, ["family", "band"], "left").join(down, ["family", "band"], "left").na.fill(0, ["above", "below"])
    name = lambda band, k: F.struct(band.alias("band"), k.cast("int").alias("block"))
    number = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = banded.join(stage(meets, "jaccard-meets"), ["family", "band"]).withColumn("block", name(F.col("band"), F.pmod(F.xxhash64("v"), F.col("blocks"))))
    other = F.concat(
        F.transform(number(F.col("blocks")), lambda k: name(F.col("band"), k)),
        F.transform(number(F.col("above")), lambda k: name(F.col("band") + 1, k)),
        F.transform(number(F.col("below")), lambda k: name(F.col("band") - 1, k)),
    )
    spread = own.withColumn("other", F.explode(other)).join(classes.select("v", "shared"), "v")
    text = lambda x: F.concat_ws(":", F.col(f"{x}.band").cast("string"), F.col(f"{x}.block").cast("string"))
    cells = spread.select("family", text("block").alias("block"), text("other").alias("other"), "v", "n", "shared")
    cells = cells.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "v", "n", "shared")
    return family, cells.groupBy("family", "lo", "hi").applyInArrow(_cell(threshold), "a long, b long, n long")


def similar_classes(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents: doc_id, n, sign), (classes: v, n, sign, shared), (edges: a, b), (counts: v, n_links).

    Edges connect each component's classes, for components() only; counts have each class's number of verified links.
    """
    rows = ensure_columns(docs, doc_id="long", text="string")
    if not is_scan(rows):
        rows = stage(rows, "jaccard-documents")
    groups = parts(rows, GROUP)
    packets = rows.mapInArrow(trimmed(_chunks(groups, n)), _CHUNK_ROWS)
    answers = packets.groupBy("grp").applyInArrow(_count, _CHUNK_ROWS)
    gathered = answers.groupBy("chunk").applyInArrow(_gather(threshold), "doc_id long, n long, sign binary, shared binary")
    gathered = stage(gathered, "jaccard-sets")
    one = gathered.filter("shared is not null").groupBy("sign").agg(F.first("n").alias("n"), F.first("shared").alias("shared"))
    classes = stage(one.select(F.monotonically_increasing_id().alias("v"), "n", "sign", "shared"), "jaccard-classes")
    post = stage(classes.select("v", "n", "shared").mapInArrow(_postings(threshold), "gram long, v long, n long, at long"), "jaccard-postings")
    # one row for each n-gram: joins with it have a posting's rows at most, however many of them are frequent
    grams = post.groupBy("gram").agg(F.count("*").alias("m"), F.min("v").alias("c")).filter("m > 1")
    post = stage(post.join(stage(grams, "jaccard-grams"), "gram"), "jaccard-met")
    family, inside = _family_links(post.filter(F.col("m") > FREQUENT), classes, threshold)
    inside = stage(inside, "jaccard-links")
    rare = post.filter(F.col("m") <= FREQUENT).join(family, "v", "left")
    side = lambda x: rare.select("gram", F.col("v").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at_{x}"), F.col("family").alias(f"f{x}"))
    fits = (F.col("a") < F.col("b")) & (100 * F.col("nb") >= threshold * F.col("na")) & (100 * F.col("na") >= threshold * F.col("nb"))
    met = side("a").join(side("b"), "gram").filter(fits & ~F.coalesce(F.col("fa") == F.col("fb"), F.lit(False)))
    links = stage(_links(_meet(met, threshold), classes, threshold), "jaccard-links")
    edges = links.unionByName(inside.filter("a <> b").select("a", "b"))
    ends = inside.select(F.col("b").alias("v"), "n")
    for end in ("a", "b"):
        ends = ends.unionByName(links.select(F.col(end).alias("v"), F.lit(1).cast("long").alias("n")))
    return gathered.drop("shared"), classes, edges, ends.groupBy("v").agg(F.sum("n").alias("n_links"))


def join_documents(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id of an equal set), component_id (smallest one reachable by links), n_links.

    n_links is how many other distinct sets the document's set links with; the sum over a component's classes is twice the
    number of its pairs. The result is a written table; what was written on the way is deleted.
    """
    with scratch(docs.sparkSession):
        rows, classes, edges, counts = similar_classes(docs, n, threshold)
        comps = components(edges).join(counts, "v")
        named = stage(rows.filter("sign is not null").groupBy("sign").agg(F.min("doc_id").alias("class_id")), "jaccard-named")
        linked = stage(named.join(classes.select("sign", "v"), "sign").join(comps, "v").withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")), "jaccard-linked")
        # a component may hold most classes: its smallest id is found, and handed back, in SALTS parts
        some = linked.groupBy("comp", "part").agg(F.min("class_id").alias("least"))
        smallest = some.groupBy("comp").agg(F.min("least").alias("component_id"), F.collect_set("part").alias("part")).withColumn("part", F.explode("part"))
        of = linked.join(smallest, ["comp", "part"]).select("sign", "component_id", "n_links")
        # a plain table, so that the join with a hot set's many documents can be split
        out = rows.join(stage(named.join(of, "sign", "left"), "jaccard-names"), "sign", "left")
        alone = F.col("sign").isNull()
        class_id, component_id = F.col("class_id"), F.coalesce("component_id", "class_id")
        out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(class_id).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(component_id).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
        return stage(out, "jaccard-joined", keep=True)
