"""The driver's tables as evidence and rated edges, for the library's queries; and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.rating import INITIAL_RD, INITIAL_VOLATILITY, NEUTRAL, trust_rd
from ..operators import edges, model

RELATIONS = {
    "IS_A": "taxonomic",
    "IN_NATION": "partitive",
    "IN_REGION": "partitive",
    "SUPPLIES": "causal",
    "ORDERED": "associative",
    "HAS_BRAND": "scalar_valued",
}
#: Trust in an order's source, by its priority.
TRUST = {"1-URGENT": 1.0, "2-HIGH": 0.8, "3-MEDIUM": 0.6, "4-NOT SPECIFIED": 0.2, "5-LOW": 0.4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def law(spark: SparkSession) -> DataFrame:
    return model.relation_law(spark, RELATIONS)


def type_id(relation: str) -> bytes:
    import hashlib

    return hashlib.md5(relation.encode()).digest()


entity = type_id


def _name(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def assertions(spark: SparkSession, sf_dir: str, relations: Iterable[str] = tuple(RELATIONS)) -> DataFrame:
    """subject, relation, object, source, context (names), score_fp, opponent_rd_fp and ts of everything that the tables say
    under some relations; tables of the others aren't read."""
    t = lambda name: table(spark, sf_dir, name)
    epoch = F.lit("1992-01-01").cast("timestamp")
    phi = F.create_map(*[x for k, v in TRUST.items() for x in (F.lit(k), F.lit(trust_rd(v)))])

    def plain(rows: DataFrame, subject: Column, relation: str, obj: Column) -> DataFrame:
        return rows.select(subject.alias("subject"), F.lit(relation).alias("relation"), obj.alias("object"), F.lit("register").alias("source"), F.lit(None).cast("string").alias("context"), F.lit(1_000_000_000).cast("long").alias("score_fp"), F.lit(trust_rd(1.0)).cast("long").alias("opponent_rd_fp"), epoch.alias("ts"))

    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_shipdate")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ordered = bought.select(_name("customer", "o_custkey").alias("subject"), F.lit("ORDERED").alias("relation"), _name("part", "l_partkey").alias("object"), F.col("o_orderpriority").alias("source"), _name("order", "o_orderkey").alias("context"), F.round((1 - 5 * F.col("l_discount")) * 1e9).cast("long").alias("score_fp"), F.coalesce(phi[F.col("o_orderpriority")], F.lit(INITIAL_RD)).cast("long").alias("opponent_rd_fp"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    supplied = lines.select(_name("supplier", "l_suppkey").alias("subject"), F.lit("SUPPLIES").alias("relation"), _name("part", "l_partkey").alias("object"), F.lit("shipping").alias("source"), F.lit(None).cast("string").alias("context"), F.round(F.col("l_quantity") / 50 * 1e9).cast("long").alias("score_fp"), F.lit(trust_rd(0.7)).cast("long").alias("opponent_rd_fp"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    part = t("part").select("p_partkey", "p_brand", "p_type")
    kinds = part.select("p_type").distinct()
    words = F.split("p_type", " ")
    steps = kinds.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))).alias("kind")).distinct()
    up = steps.filter(F.contains(F.col("kind"), F.lit(" "))).select("kind", F.substring_index("kind", " ", -1).alias("last"), F.expr("substring(kind, instr(kind, ' ') + 1)").alias("next"))
    said = (
        ("ORDERED", ordered),
        ("SUPPLIES", supplied),
        ("IN_NATION", plain(t("customer"), _name("customer", "c_custkey"), "IN_NATION", _name("nation", "c_nationkey"))),
        ("IN_NATION", plain(t("supplier"), _name("supplier", "s_suppkey"), "IN_NATION", _name("nation", "s_nationkey"))),
        ("IN_REGION", plain(t("nation"), _name("nation", "n_nationkey"), "IN_REGION", _name("region", "n_regionkey"))),
        ("HAS_BRAND", plain(part, _name("part", "p_partkey"), "HAS_BRAND", _name("brand", "p_brand"))),
        ("IS_A", plain(part, _name("part", "p_partkey"), "IS_A", _name("kind", "p_type"))),
        ("IS_A", plain(up, _name("kind", "kind"), "IS_A", _name("kind", "next"))),
    )
    wanted = set(relations)
    return reduce(DataFrame.unionByName, [rows for relation, rows in said if relation in wanted])


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import fold

    rows = assertions(spark, sf_dir)
    named = rows.select(ids.canonical_id("subject").alias("subject_id"), ids.relation_type_id("relation").alias("type_id"), ids.canonical_id("object").alias("object_id"), ids.source_id("source").alias("source_id"), ids.canonical_id("context").alias("context_id"), "score_fp", "opponent_rd_fp", "ts")
    return fold.observe(named)


#: Where this process has written the consensus of some tables, by the session and the tables' state.
_STORED: dict[tuple, str] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files behind the consensus."""
    out = []
    for name in ("lineitem", "orders", "part", "customer", "supplier", "nation"):
        for file in sorted(table(spark, sf_dir, name).inputFiles()):
            where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
            status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
            out.append((file, status.getLen(), status.getModificationTime()))
    return tuple(out)


def counted(spark: SparkSession, sf_dir: str, relations: Iterable[str] = tuple(RELATIONS)) -> DataFrame:
    """Edges with a rating in closed form, from games and scores alone: reads can so be held against SQL exactly.

    Like any store's consensus they are written once, by relation and subject, and read from there until the tables change.
    Edges of some relations only have a store of their own, unless all edges are stored already.
    """
    kinds = frozenset(relations)
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir), kinds)
    if (whole := _STORED.get((*key[:3], frozenset(RELATIONS)))) and key not in _STORED:
        return spark.read.schema(model.CONSENSUS).parquet(whole).filter(F.col("type_id").isin(*[type_id(r) for r in sorted(kinds)]))
    if key not in _STORED:
        rows = _counted(spark, sf_dir, kinds).select(*[c.split()[0] for c in model.CONSENSUS.split(", ")])
        path = f"{model.work_dir(spark)}/consensus-{uuid.uuid4().hex}"
        rows.repartitionByRange("type_id", "subject_id").sortWithinPartitions("type_id", "subject_id").write.parquet(path)
        _STORED[key] = path
    return spark.read.schema(model.CONSENSUS).parquet(_STORED[key])


def _counted(spark: SparkSession, sf_dir: str, relations: Iterable[str]) -> DataFrame:
    q = assertions(spark, sf_dir, relations).groupBy("subject", "relation", "object").agg(F.count("*").alias("g"), F.sum("score_fp").alias("s"), F.max("ts").alias("last_observed_at"))
    rating = F.lit(NEUTRAL) + F.floor((2 * (F.col("s") / F.col("g")) / F.lit(1e9) - 1) * F.lit(400e9) * F.col("g") / (F.col("g") + 2))
    out = q.select(ids.canonical_id("subject").alias("subject_id"), ids.relation_type_id("relation").alias("type_id"), ids.canonical_id("object").alias("object_id"), rating.cast("long").alias("rating"), F.floor(F.lit(float(INITIAL_RD)) / F.sqrt(1.0 + F.col("g"))).cast("long").alias("rd"), F.lit(INITIAL_VOLATILITY).cast("long").alias("volatility"), F.col("g").alias("witness_count"), "last_observed_at")
    return out.withColumn("id", ids.triple_id())


def rated(spark: SparkSession, sf_dir: str, relations: Iterable[str] = tuple(RELATIONS)) -> DataFrame:
    return edges.ranked(counted(spark, sf_dir, relations), law(spark))


_RANKS = " ".join(f"WHEN '{r}' THEN {model.BAND_RANKS[b]}" for r, b in RELATIONS.items())
_BANDS = " ".join(f"WHEN '{r}' THEN '{b}'" for r, b in RELATIONS.items())

#: The same edges in DuckDB's SQL: ids as lower-case hex digits.
SQL = f"""
steps AS (SELECT DISTINCT array_to_string(list_slice(w, i, len(w)), ' ') AS kind
    FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT DISTINCT string_split(p_type, ' ') AS w FROM part))),
said AS (
    SELECT 'customer:' || o_custkey AS subject, 'ORDERED' AS relation, 'part:' || l_partkey AS object, CAST(round((1 - 5 * l_discount) * 1e9) AS BIGINT) AS score_fp, l_shipdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT 'supplier:' || l_suppkey, 'SUPPLIES', 'part:' || l_partkey, CAST(round(l_quantity / 50 * 1e9) AS BIGINT), l_shipdate FROM lineitem
    UNION ALL SELECT 'customer:' || c_custkey, 'IN_NATION', 'nation:' || c_nationkey, 1000000000, TIMESTAMP '1992-01-01' FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'IN_NATION', 'nation:' || s_nationkey, 1000000000, TIMESTAMP '1992-01-01' FROM supplier
    UNION ALL SELECT 'nation:' || n_nationkey, 'IN_REGION', 'region:' || n_regionkey, 1000000000, TIMESTAMP '1992-01-01' FROM nation
    UNION ALL SELECT 'part:' || p_partkey, 'HAS_BRAND', 'brand:' || p_brand, 1000000000, TIMESTAMP '1992-01-01' FROM part
    UNION ALL SELECT 'part:' || p_partkey, 'IS_A', 'kind:' || p_type, 1000000000, TIMESTAMP '1992-01-01' FROM part
    UNION ALL SELECT 'kind:' || kind, 'IS_A', 'kind:' || substr(kind, instr(kind, ' ') + 1), 1000000000, TIMESTAMP '1992-01-01' FROM steps WHERE contains(kind, ' ')),
summed AS (SELECT subject, relation, object, count(*) AS g, CAST(sum(score_fp) AS BIGINT) AS s, max(ts) AS last_observed_at FROM said GROUP BY ALL),
consensus AS (
    SELECT md5(subject) AS subject_id, md5(relation) AS type_id, md5(object) AS object_id, relation,
        CAST({NEUTRAL} + floor((2 * (s / g) / 1e9 - 1) * 400e9 * g / (g + 2)) AS BIGINT) AS rating,
        CAST(floor({INITIAL_RD}e0 / sqrt(1.0 + g)) AS BIGINT) AS rd, CAST({INITIAL_VOLATILITY} AS BIGINT) AS volatility, g AS witness_count, last_observed_at,
        CASE relation {_RANKS} ELSE 0.0 END::DOUBLE AS rank, CASE relation {_BANDS} END AS band
    FROM summed)
"""


def sql(body: str) -> str:
    """A query over `consensus` (the rated edges), with eff_mu(), refuted and the like written out."""
    return f"WITH {SQL}, {body}" if body.lstrip().lower().split(None, 2)[1:2] == ["as"] else f"WITH {SQL} {body}"
