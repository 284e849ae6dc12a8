"""Order within compositions: neighbours, continuations and planes of ordered pairs.

Input is one row for each element: (seq, pos, item), pos counting from 0 without gaps within a seq. Pairs are made by lead
over one sequence's rows, so a sequence is sorted but never paired with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(texts: DataFrame, seq: str, text: str, pattern: str = r"[^\x20\x09-\x0D]+") -> DataFrame:
    """(seq, pos, item) of the words of texts, A-Z in lower case."""
    found = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"({pattern})"), 1)
    return texts.select(F.col(seq).alias("seq"), F.posexplode(found).alias("pos", "item"))


def sentences(texts: DataFrame, seq: str, text: str) -> DataFrame:
    """(seq, pos, item): the sentences of each text, cut after . ! ? or at line ends, without outer blanks."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")
    return texts.select(F.col(seq).alias("seq"), F.posexplode(parts).alias("pos", "item"))


def graphemes(words: DataFrame) -> DataFrame:
    """(seq, pos, item): the characters of each distinct item of words."""
    kinds = words.select("item").distinct()
    return kinds.select(F.col("item").alias("seq"), F.posexplode(F.split("item", "")).alias("pos", "item")).filter("item <> ''")


def _within(seqs: DataFrame, vocab: DataFrame | None) -> DataFrame:
    return seqs if vocab is None else seqs.join(vocab.select("item").distinct(), "item", "left_semi")


def ordered_pairs(seqs: DataFrame, gap: int = 1, vocab: DataFrame | None = None) -> DataFrame:
    """(seq, x, y) of items `gap` places apart in a sequence; with a vocabulary, only pairs of two of its items."""
    w = Window.partitionBy("seq").orderBy("pos")
    known = seqs if vocab is None else seqs.join(vocab.select("item", F.lit(True).alias("known")).distinct(), "item", "left")
    ok: Column = F.lit(True) if vocab is None else (F.col("known") & F.lead("known", gap).over(w))
    rows = known.select("seq", F.col("item").alias("x"), F.lead("item", gap).over(w).alias("y"), F.coalesce(ok, F.lit(False)).alias("ok"))
    return rows.filter("ok and y is not null").drop("ok")


def text_pairs(texts: DataFrame, seq: str, text: str, gap: int = 1, vocab: DataFrame | None = None, pattern: str = r"[^\x20\x09-\x0D]+") -> DataFrame:
    """ordered_pairs(tokens(texts)), made within each text's own array: nothing is shuffled or sorted to find neighbours."""
    found = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"({pattern})"), 1)
    rows = texts.select(F.col(seq).alias("seq"), found.alias("w")).filter(F.size("w") > gap)
    each = rows.select("seq", F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - gap).alias("x"), F.slice("w", gap + 1, F.size("w")).alias("y"))).alias("p"))
    pairs = each.select("seq", "p.x", "p.y")
    if vocab is None:
        return pairs
    known = vocab.select("item").distinct()
    return pairs.join(known.withColumnRenamed("item", "x"), "x", "left_semi").join(known.withColumnRenamed("item", "y"), "y", "left_semi")


def order_plane(seqs: DataFrame, gap: int = 1, vocab: DataFrame | None = None) -> DataFrame:
    """Counts of ordered pairs: x, y, w."""
    return ordered_pairs(seqs, gap, vocab).groupBy("x", "y").agg(F.count("*").alias("w"))


def window_plane(seqs: DataFrame, window: int = 8, points: DataFrame | None = None, backward: bool = False) -> DataFrame:
    """How often y stands up to `window` places after x (before it, if backward), each occurrence of x counted."""
    w = Window.partitionBy("seq").orderBy("pos")
    rows = seqs.select("seq", "pos", F.col("item").alias("x"), F.collect_list("item").over(w.rowsBetween(-window, -1) if backward else w.rowsBetween(1, window)).alias("near"))
    rows = rows if points is None else rows.join(points.select(F.col("item").alias("x")).distinct(), "x", "left_semi")
    return rows.select("x", F.explode("near").alias("y")).groupBy("x", "y").agg(F.count("*").alias("seen"))


def successors(seqs: DataFrame, points: DataFrame | None, limit: int = 20, window: int = 8, backward: bool = False) -> DataFrame:
    """Each point's most frequent successors (predecessors, if backward) within a window."""
    seen = window_plane(seqs, window, points, backward).filter("x <> y")
    place = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("seen"), "y"))
    return seen.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


def neighbours(seqs: DataFrame, points: DataFrame | None, limit: int = 20, window: int = 8) -> DataFrame:
    both = window_plane(seqs, window, points).unionByName(window_plane(seqs, window, points, True)).filter("x <> y")
    seen = both.groupBy("x", "y").agg(F.sum("seen").alias("seen"))
    place = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("seen"), "y"))
    return seen.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


def conditional_plane(pairs: DataFrame, vocab_size: int, smooth: float = 0.5, cap: int = 512) -> DataFrame:
    """ln((c + k) / (cx + k V)) of counted pairs (x, y, w), each x's most frequent, and a floor for the rest (y null)."""
    totals = pairs.groupBy("x").agg(F.sum("w").alias("cx"))
    place = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("w"), "y"))
    kept = pairs.withColumn("place", place).filter(F.col("place") <= cap).join(totals, "x")
    below = F.col("cx") + F.lit(smooth * vocab_size)
    rows = kept.select("x", "y", F.log((F.col("w") + F.lit(smooth)) / below).alias("w"))
    return rows.unionByName(totals.select("x", F.lit(None).cast("string").alias("y"), F.log(F.lit(smooth) / below).alias("w")))


def sentence_bridge(docs: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """Counts of (last word of a sentence, first word of the next one) within the vocabulary, if they differ.

    docs: (seq, pos, item) sentences."""
    words = F.regexp_extract_all(F.lower("item"), F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    each = docs.select("seq", "pos", F.posexplode(words).alias("at", "item"))
    ends = _within(each, vocab).groupBy("seq", "pos").agg(F.min_by("item", "at").alias("first"), F.max_by("item", "at").alias("last"))
    w = Window.partitionBy("seq").orderBy("pos")
    nexts = ends.select(F.col("last").alias("x"), F.when(F.lead("pos").over(w) == F.col("pos") + 1, F.lead("first").over(w)).alias("y"))
    return nexts.filter("y is not null and x <> y").groupBy("x", "y").agg(F.count("*").alias("w"))


def vocabulary(seqs: DataFrame, size: int) -> DataFrame:
    """The most frequent items: item, weight."""
    return seqs.groupBy("item").agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "item").limit(size)


def continuations(seqs: DataFrame, contexts: DataFrame, k: int, topk: int | None = None) -> DataFrame:
    """What follows each context (context: array of k items) wherever it stands: context, item, weight."""
    w = Window.partitionBy("seq").orderBy("pos")
    before = F.collect_list("item").over(w.rowsBetween(-k, -1))
    rows = seqs.select("item", before.alias("context")).filter(F.size("context") == k).join(contexts.select("context").distinct(), "context", "left_semi")
    seen = rows.groupBy("context", "item").agg(F.count("*").alias("weight"))
    if topk is None:
        return seen
    place = F.row_number().over(Window.partitionBy("context").orderBy(F.desc("weight"), "item"))
    return seen.withColumn("place", place).filter(F.col("place") <= topk).drop("place")


def containing(seqs: DataFrame, wanted: DataFrame, limit: int = 6, length: int = 7) -> DataFrame:
    """For each wanted item the sequences that hold it, those of a length nearest to `length` first."""
    sizes = seqs.groupBy("seq").agg(F.count("*").alias("n"))
    rows = seqs.join(wanted.select("item").distinct(), "item", "left_semi").select("item", "seq").distinct().join(sizes, "seq")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.abs(F.col("n") - length), "seq"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


def container_degree(seqs: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """In how many sequences an item is, and its inverse frequency 1 / log2(2 + n)."""
    rows = seqs if items is None else seqs.join(items.select("item").distinct(), "item", "left_semi")
    return rows.select("item", "seq").distinct().groupBy("item").agg(F.count("*").alias("degree")).withColumn("icf", 1 / F.log2(2 + F.col("degree")))


def class_transitions(seqs: DataFrame, classes: DataFrame, smooth: float = 0.5) -> DataFrame:
    """ln((c + k) / (cx + k V)) of pairs of classes that follow each other; classes: (item, cls)."""
    own = seqs.join(classes.select("item", "cls"), "item").select("seq", "pos", F.col("cls").alias("item"))
    pairs = order_plane(own)
    kinds = classes.select("cls").distinct().agg(F.count("*").alias("v"))
    totals = pairs.groupBy("x").agg(F.sum("w").alias("cx"))
    return pairs.join(totals, "x").crossJoin(F.broadcast(kinds)).select("x", "y", F.log((F.col("w") + F.lit(smooth)) / (F.col("cx") + F.lit(smooth) * F.col("v"))).alias("w"))


def run_lengths(seqs: DataFrame) -> DataFrame:
    """Runs of equal items: seq, ordinal (place of the run), item, run."""
    w = Window.partitionBy("seq").orderBy("pos")
    new = F.when(F.lag("item").over(w).eqNullSafe(F.col("item")) & (F.col("pos") > 0), 0).otherwise(1)
    numbered = seqs.withColumn("new", new).withColumn("ordinal", F.sum("new").over(w) - 1)
    return numbered.groupBy("seq", "ordinal").agg(F.first("item").alias("item"), F.count("*").alias("run"))


def anagrams(words: DataFrame) -> DataFrame:
    """Groups of words (item) of the same letters: letters, words."""
    letters = F.concat_ws("", F.array_sort(F.split("item", "")))
    groups = words.select("item").distinct().groupBy(letters.alias("letters")).agg(F.array_sort(F.collect_list("item")).alias("words"))
    return groups.filter(F.size("words") > 1)
