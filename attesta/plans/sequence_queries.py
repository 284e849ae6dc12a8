"""Queries on order: words of documents, event types of users, characters of words, turns of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequence
from .registry import query
from .world import table

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: (seq, pos, item) of the documents' words and of the users' events in DuckDB's SQL.
_WORDS = f"""toks AS (SELECT doc_id AS seq, unnest(w) AS item, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents))"""
_EVENTS = "toks AS (SELECT user_id AS seq, event_type AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"
_VOCAB = "vocab AS (SELECT item, count(*) AS weight FROM toks GROUP BY item ORDER BY weight DESC, item LIMIT 500)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.tokens(table(spark, sf_dir, "documents"), "doc_id", "text")


def happenings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), place.alias("pos"), F.col("event_type").alias("item"))


@query(f"WITH {_WORDS} SELECT item, count(*) AS weight FROM toks GROUP BY item ORDER BY weight DESC, item LIMIT 1000")
def corpus_word_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.vocabulary(words(spark, sf_dir), 1000)


@query(f"WITH {_WORDS}, {_VOCAB}, p AS (SELECT item AS x, lead(item) OVER (PARTITION BY seq ORDER BY pos) AS y FROM toks) SELECT x, y, count(*) AS w FROM p WHERE x IN (SELECT item FROM vocab) AND y IN (SELECT item FROM vocab) GROUP BY x, y")
def word_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sequence.text_pairs(table(spark, sf_dir, "documents"), "doc_id", "text", 1, sequence.vocabulary(words(spark, sf_dir), 500))
    return pairs.groupBy("x", "y").agg(F.count("*").alias("w"))


@query(f"WITH {_WORDS}, {_VOCAB}, p AS (SELECT seq, item AS x, lead(item, 2) OVER (PARTITION BY seq ORDER BY pos) AS y FROM toks) SELECT x, y, count(*) AS pairs, count(DISTINCT seq) AS witnesses FROM p WHERE x IN (SELECT item FROM vocab) AND y IN (SELECT item FROM vocab) GROUP BY x, y")
def word_adjacency_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.text_pairs(table(spark, sf_dir, "documents"), "doc_id", "text", 2, sequence.vocabulary(words(spark, sf_dir), 500))
    return rows.groupBy("x", "y").agg(F.count("*").alias("pairs"), F.countDistinct("seq").alias("witnesses"))


@query(f"WITH {_WORDS}, kinds AS (SELECT DISTINCT item AS seq FROM toks), g AS (SELECT seq, unnest(string_split(seq, '')) AS ch, unnest(range(length(seq))) AS pos FROM kinds), p AS (SELECT ch AS x, lead(ch) OVER (PARTITION BY seq ORDER BY pos) AS y FROM g) SELECT x, y, count(*) AS w FROM p WHERE y IS NOT NULL GROUP BY x, y")
def grapheme_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.order_plane(sequence.graphemes(words(spark, sf_dir)))


@query(f"WITH {_WORDS}, kinds AS (SELECT item, count(*) AS n FROM toks GROUP BY item), g AS (SELECT unnest(string_split(item, '')) AS ch, n FROM kinds) SELECT ch AS item, count(*) AS in_words, CAST(sum(n) AS BIGINT) AS in_text FROM g GROUP BY ch")
def grapheme_floor_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = words(spark, sf_dir).groupBy("item").agg(F.count("*").alias("n"))
    each = kinds.select(F.explode(F.split("item", "")).alias("ch"), "n").filter("ch <> ''")
    return each.groupBy(F.col("ch").alias("item")).agg(F.count("*").alias("in_words"), F.sum("n").alias("in_text"))


@query(f"WITH {_EVENTS}, p AS (SELECT item AS x, lead(item) OVER (PARTITION BY seq ORDER BY pos) AS y FROM toks) SELECT x, y, count(*) AS w FROM p WHERE y IS NOT NULL GROUP BY x, y")
def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.order_plane(happenings(spark, sf_dir))


_NEAR = "near AS (SELECT a.item AS x, b.item AS y, count(*) AS seen FROM toks a JOIN toks b ON a.seq = b.seq AND b.pos BETWEEN a.pos + 1 AND a.pos + 8 GROUP BY ALL)"


@query(f"WITH {_EVENTS}, {_NEAR}, placed AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY seen DESC, y) AS place FROM near WHERE x <> y) SELECT x, y, seen FROM placed WHERE place <= 20")
def geometry_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.successors(happenings(spark, sf_dir), None)


@query(f"WITH {_EVENTS}, {_NEAR}, placed AS (SELECT y AS x, x AS y, seen, row_number() OVER (PARTITION BY y ORDER BY seen DESC, x) AS place FROM near WHERE x <> y) SELECT x, y, seen FROM placed WHERE place <= 20")
def geometry_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.successors(happenings(spark, sf_dir), None, backward=True)


@query(f"WITH {_EVENTS}, {_NEAR}, both_ways AS (SELECT x, y, sum(seen) AS seen FROM (SELECT x, y, seen FROM near UNION ALL SELECT y, x, seen FROM near) WHERE x <> y GROUP BY x, y) SELECT x, y, CAST(seen AS BIGINT) AS seen FROM both_ways")
def geometry_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.neighbours(happenings(spark, sf_dir), None)


@query(f"WITH {_EVENTS}, p AS (SELECT item AS x, lead(item) OVER (PARTITION BY seq ORDER BY pos) AS y FROM toks), c AS (SELECT x, y, count(*) AS w FROM p WHERE y IS NOT NULL GROUP BY x, y), t AS (SELECT x, sum(w) AS cx FROM c GROUP BY x), v AS (SELECT count(DISTINCT item) AS v FROM toks) SELECT c.x, y, round(ln((w + 0.5) / (cx + 0.5 * v)), 9) AS w FROM c JOIN t USING (x), v UNION ALL SELECT x, NULL, round(ln(0.5 / (cx + 0.5 * v)), 9) FROM t, v")
def continuation_conditional_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = happenings(spark, sf_dir)
    size = h.select("item").distinct().count()
    return sequence.conditional_plane(sequence.order_plane(h), size).withColumn("w", F.round("w", 9))


@query(f"WITH {_EVENTS}, c AS (SELECT seq, pos, item, lag(item) OVER (PARTITION BY seq ORDER BY pos) AS b, lag(item, 2) OVER (PARTITION BY seq ORDER BY pos) AS a FROM toks) SELECT a || ' > ' || b AS context, item, count(*) AS weight FROM c WHERE a IS NOT NULL GROUP BY a, b, item")
def trajectory_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = happenings(spark, sf_dir)
    kinds = h.select("item").distinct()
    contexts = kinds.alias("a").crossJoin(kinds.alias("b")).select(F.array(F.col("a.item"), F.col("b.item")).alias("context"))
    return sequence.continuations(h, contexts, 2).withColumn("context", F.concat_ws(" > ", "context"))


@query(f"WITH {_WORDS} SELECT item, count(DISTINCT seq) AS degree, round(1 / log2(2 + count(DISTINCT seq)), 9) AS icf FROM toks GROUP BY item")
def entity_container_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.container_degree(words(spark, sf_dir)).withColumn("icf", F.round("icf", 9))


@query(f"WITH {_EVENTS}, n AS (SELECT seq, count(*) AS n FROM toks GROUP BY seq), own AS (SELECT DISTINCT item, seq FROM toks), placed AS (SELECT item, seq, n, row_number() OVER (PARTITION BY item ORDER BY abs(n - 7), seq) AS place FROM own JOIN n USING (seq)) SELECT item, seq, n FROM placed WHERE place <= 6")
def recall_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = happenings(spark, sf_dir)
    return sequence.containing(h, h.select("item").distinct())


_SENTENCES = r"""sents AS (SELECT doc_id AS seq, unnest(s) AS item, unnest(range(len(s))) AS pos FROM (SELECT doc_id, [trim(x, ' ') FOR x IN regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), '\x01|\n+') IF trim(x, ' ') <> ''] AS s FROM documents))"""


@query(f"WITH {_SENTENCES}, p AS (SELECT md5(item) AS x, md5(lead(item) OVER (PARTITION BY seq ORDER BY pos)) AS y FROM sents) SELECT x, y, count(*) AS w FROM p WHERE y IS NOT NULL GROUP BY x, y")
def sentence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sequence.sentences(table(spark, sf_dir, "documents"), "doc_id", "text")
    return sequence.order_plane(s.withColumn("item", F.md5("item")))


@query("""WITH toks AS (SELECT conv_id AS seq, role AS item, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
r AS (SELECT *, CASE WHEN lag(item) OVER (PARTITION BY seq ORDER BY pos) IS NOT DISTINCT FROM item AND pos > 0 THEN 0 ELSE 1 END AS new FROM toks),
n AS (SELECT *, sum(new) OVER (PARTITION BY seq ORDER BY pos) - 1 AS ordinal FROM r)
SELECT seq, CAST(ordinal AS BIGINT) AS ordinal, any_value(item) AS item, count(*) AS run FROM n GROUP BY seq, ordinal""")
def trajectory_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return sequence.run_lengths(turns.select(F.col("conv_id").alias("seq"), place.alias("pos"), F.col("role").alias("item")))


@query(f"WITH {_WORDS}, k AS (SELECT DISTINCT item FROM toks), g AS (SELECT array_to_string(list_sort(string_split(item, '')), '') AS letters, list_sort(list(item)) AS words FROM k GROUP BY 1) SELECT letters, len(words) AS n, words[1] AS first_word FROM g WHERE len(words) > 1")
def anagrams_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = sequence.anagrams(words(spark, sf_dir))
    return groups.select("letters", F.size("words").cast("long").alias("n"), F.element_at("words", 1).alias("first_word"))


@query(f"WITH {_EVENTS}, cls AS (SELECT DISTINCT item, substr(item, 1, 1) AS cls FROM toks), own AS (SELECT seq, pos, cls FROM toks JOIN cls USING (item)), p AS (SELECT cls AS x, lead(cls) OVER (PARTITION BY seq ORDER BY pos) AS y FROM own), c AS (SELECT x, y, count(*) AS w FROM p WHERE y IS NOT NULL GROUP BY x, y), t AS (SELECT x, sum(w) AS cx FROM c GROUP BY x), v AS (SELECT count(DISTINCT cls) AS v FROM cls) SELECT c.x, y, round(ln((w + 0.5) / (cx + 0.5 * v)), 9) AS w FROM c JOIN t USING (x), v")
def pos_class_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = happenings(spark, sf_dir)
    classes = h.select("item").distinct().withColumn("cls", F.substring("item", 1, 1))
    return sequence.class_transitions(h, classes).withColumn("w", F.round("w", 9))
