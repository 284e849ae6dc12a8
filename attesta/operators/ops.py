"""Counts, runs, sources and checks of a whole store. Tables come as DataFrames; nothing here keeps state of its own.

entities: (id, name, type_id, tier, first_observed_by); evidence: as fold.observe; runs: (run_id, source, started_at, status);
files: (run_id, path, status).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import triple_id
from ..functions.rating import eff_mu
from . import fold

#: A file's states in the order in which they are listed; fixed values.
FILE_STATES = ["failed", "running", "pending", "done"]


def count(rows: DataFrame, **only: bytes) -> DataFrame:
    """One row, n: the rows whose columns have the given values."""
    for column, value in only.items():
        rows = rows.filter(F.col(column) == F.lit(value))
    return rows.agg(F.count("*").alias("n"))


def content_count(entities: DataFrame, placed: DataFrame, source: bytes | None = None) -> DataFrame:
    """One row, n: distinct entities that have a place (placed: entity_id), of one first observer if given."""
    own = entities if source is None else entities.filter(F.col("first_observed_by") == F.lit(source))
    return own.select("id").distinct().join(placed.select(F.col("entity_id").alias("id")).distinct(), "id", "left_semi").agg(F.count("*").alias("n"))


def type_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type_id", "tier").agg(F.count("*").alias("entities"))


def tiers_of_subjects(consensus: DataFrame, entities: DataFrame) -> DataFrame:
    """How many cells the subjects of each tier have; null for subjects that are no entity."""
    each = consensus.groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("n"))
    tier = entities.groupBy("id").agg(F.min("tier").alias("tier"))
    return each.join(tier, "id", "left").groupBy("tier").agg(F.sum("n").alias("relations"))


def source_tiers(entities: DataFrame, source: bytes) -> DataFrame:
    return entities.filter(F.col("first_observed_by") == F.lit(source)).groupBy("tier").agg(F.count("*").alias("entities"))


def surface_sample(entities: DataFrame, evidence: DataFrame, source: bytes, tier: int, limit: int = 20) -> DataFrame:
    """The names of a tier that a source observed most: entity_id, name, observations."""
    own = evidence.filter(F.col("source_id") == F.lit(source)).groupBy(F.col("subject_id").alias("id")).agg(F.sum("observation_count").alias("observations"))
    rows = entities.filter(F.col("tier") == tier).join(own, "id")
    return rows.select(F.col("id").alias("entity_id"), "name", "observations").orderBy(F.desc("observations"), "entity_id").limit(limit)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """metric, value: the rows of each table."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def pulse(tables: dict[str, DataFrame], flushes: DataFrame, now: Column, window: str = "60 seconds") -> DataFrame:
    """One row: the tables' sizes, the last flush (flushes: at) and how many there were in the window before now."""
    row = flushes.agg(F.max("at").alias("last_flush_at"), F.count_if(F.col("at") > now - F.expr(f"interval {window}")).alias("flushes_in_window"))
    for name, rows in tables.items():
        row = row.crossJoin(F.broadcast(rows.agg(F.count("*").alias(name))))
    return row


def modality_counts(entities: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """One row: for each modality how many names fit its pattern (LIKE, any case)."""
    return entities.agg(*[F.count_if(F.col("name").ilike(p)).alias(m) for m, p in patterns.items()])


def runs(journal: DataFrame, limit: int = 20) -> DataFrame:
    return journal.orderBy(F.desc("started_at"), "run_id").limit(limit)


def files(journal: DataFrame, run_id: object, limit: int = 200) -> DataFrame:
    """A run's files, those with trouble first."""
    state = F.coalesce(*[F.when(F.col("status") == s, F.lit(k)) for k, s in enumerate(FILE_STATES)], F.lit(len(FILE_STATES)))
    return journal.filter(F.col("run_id") == F.lit(run_id)).orderBy(state, "path").limit(limit)


def close_runs(journal: DataFrame, which: Column, status: str = "cancelled") -> DataFrame:
    """The journal with some open runs closed; runs that have ended stay as they are."""
    return journal.withColumn("status", F.when(which & (F.col("status") == "running"), F.lit(status)).otherwise(F.col("status")))


def integrity_gate(counted: DataFrame, since: Column | None = None) -> DataFrame:
    """Runs (run_id, started_at, entities, physicalities) with more places than entities: orphaned says how many more."""
    rows = counted if since is None else counted.filter(F.col("started_at") >= since)
    return rows.filter("physicalities > entities").withColumn("orphaned", F.col("physicalities") - F.col("entities"))


def source_status(journal: DataFrame, evidence: DataFrame, names: DataFrame) -> DataFrame:
    """Every source that has a run or evidence: source_id, source, ingested, known, evidence, last_status, last_run_at.

    names: (source_id, source) of the known ones; journal with source_id.
    """
    last = journal.groupBy("source_id").agg(F.max_by("status", F.struct("started_at", "run_id")).alias("last_status"), F.max("started_at").alias("last_run_at"))
    has = evidence.groupBy("source_id").agg(F.count("*").alias("evidence"))
    rows = last.join(has, "source_id", "full_outer").join(names.withColumn("known", F.lit(True)), "source_id", "left")
    ingested = F.coalesce(F.col("last_status") == "done", F.lit(False)) | (F.coalesce("evidence", F.lit(0)) > 0)
    return rows.select("source_id", "source", ingested.alias("ingested"), F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("evidence", F.lit(0).cast("long")).alias("evidence"), "last_status", "last_run_at")


def bootstrap_present(evidence: DataFrame, source: bytes, law_type: bytes) -> DataFrame:
    """One row, present: whether a source says anything under a relation."""
    return evidence.filter((F.col("source_id") == F.lit(source)) & (F.col("type_id") == F.lit(law_type))).agg((F.count("*") > 0).alias("present"))


def refold_source(evidence: DataFrame, consensus: DataFrame, source: bytes) -> DataFrame:
    """The consensus with every cell that the source has evidence for folded anew from all its evidence; cells that the
    consensus doesn't have aren't added."""
    touched = evidence.filter(F.col("source_id") == F.lit(source)).select(triple_id().alias("id")).distinct()
    mine = consensus.select("id").join(touched, "id", "left_semi")
    again = evidence.withColumn("cell", triple_id()).join(mine.withColumnRenamed("id", "cell"), "cell", "left_semi").drop("cell")
    return consensus.join(mine, "id", "left_anti").unionByName(fold.scoped_consensus(again).select(*consensus.columns))


def fidelity_positives(consensus: DataFrame, truth: DataFrame, type_id: bytes, limit: int = 200) -> DataFrame:
    """a, b, score of pairs of words that share an object of truth (word, object): the better rating either way, 0 at least.

    The pairs are those of the smallest hashes. Each word meets the next one of its object only, so a common object gives
    as many pairs as it has words.
    """
    w = Window.partitionBy("object").orderBy(F.xxhash64("word"), "word")
    pairs = truth.select("word", "object").distinct().withColumn("b", F.lead("word").over(w)).filter("b is not null").select(F.col("word").alias("a"), "b").distinct()
    some = pairs.orderBy(F.xxhash64("a", "b"), "a", "b").limit(limit)
    return _scored(consensus, some, type_id)


def fidelity_negatives(consensus: DataFrame, type_id: bytes, limit: int = 200) -> DataFrame:
    """The same for words paired with the one half a sample further, which says nothing of their relation."""
    some = consensus.filter(F.col("type_id") == F.lit(type_id)).select(F.col("subject_id").alias("a")).distinct().orderBy(F.xxhash64("a"), "a").limit(limit)
    # a sample of limit rows is numbered in one task
    placed = some.withColumn("k", F.row_number().over(Window.orderBy(F.xxhash64("a"), "a")) - 1)
    many = placed.agg(F.count("*").alias("n"))
    other = placed.select(F.col("a").alias("b"), "k")
    pairs = placed.crossJoin(F.broadcast(many)).withColumn("k", (F.col("k") + F.floor(F.col("n") / 2)) % F.col("n")).join(other, "k").filter("a <> b").select("a", "b")
    return _scored(consensus, pairs, type_id)


def _scored(consensus: DataFrame, pairs: DataFrame, type_id: bytes) -> DataFrame:
    from .census import pair_plane_score

    return pair_plane_score(consensus, pairs, type_id)


# --- identity -----------------------------------------------------------------------------------------------------

#: Atoms that there are (the code points), and the tiers of compositions; fixed values.
ATOMS = 0x110000
COMPOSED_TIERS = (1, 2, 3, 4)


def atom_census(entities: DataFrame, atoms: DataFrame) -> DataFrame:
    """One row: entities of tier 0, the window of atoms, how many too many there are, and ids that no atom (id) has."""
    base = entities.filter("tier = 0").select("id").distinct()
    n = base.agg(F.count("*").alias("tier0_count"))
    lost = base.join(atoms.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("unresolvable_ids"))
    return n.crossJoin(lost).select("tier0_count", F.lit(ATOMS).cast("long").alias("atom_window"), F.greatest(F.col("tier0_count") - ATOMS, F.lit(0)).alias("over_window"), "unresolvable_ids")


def composed_tiers(entities: DataFrame, types: list[bytes]) -> DataFrame:
    return entities.filter(F.col("type_id").isin(*types)).groupBy("tier").agg(F.count("*").alias("n"))


def health(entities: DataFrame, violations: DataFrame | None = None, bootstrap: bytes | None = None) -> DataFrame:
    """One row: ok, entities in bands of tiers that nothing mints, violations (if looked for), entities of the bootstrap source."""
    fake = F.count_if((F.col("tier") < 0) | (F.col("tier") > max(COMPOSED_TIERS)))
    own = F.count_if(F.col("first_observed_by") == F.lit(bootstrap)) if bootstrap else F.count("*")
    row = entities.agg(fake.alias("fake_tier_bands"), own.alias("bootstrap_entities"))
    bad = entities.sparkSession.range(1).select(F.lit(None).cast("long").alias("identity_violations")) if violations is None else violations.agg(F.count("*").alias("identity_violations"))
    out = row.crossJoin(F.broadcast(bad)).withColumn("deep_checked", F.lit(violations is not None))
    return out.withColumn("ok", (F.col("fake_tier_bands") == 0) & (F.coalesce("identity_violations", F.lit(0)) == 0) & (F.col("bootstrap_entities") > 0))


# --- the session --------------------------------------------------------------------------------------------------


def api(spark: SparkSession, modules: list[object], like: str = "") -> DataFrame:
    """The public functions of some modules: name, module, arguments."""
    import inspect as look

    rows = [(name, m.__name__, str(look.signature(f))) for m in modules for name, f in vars(m).items() if look.isfunction(f) and f.__module__ == m.__name__ and not name.startswith("_") and like in name]
    return spark.createDataFrame(sorted(rows), "name string, module string, arguments string")


def activity(spark: SparkSession) -> DataFrame:
    """What the session's scheduler is doing: job, status, stages."""
    status = spark.sparkContext.statusTracker()
    infos = [(j, status.getJobInfo(j)) for j in status.getActiveJobsIds()]
    return spark.createDataFrame([(j, i.status, list(i.stageIds)) for j, i in infos if i], "job int, status string, stages array<int>")


def cancel(spark: SparkSession, group: str | None = None) -> None:
    """Cancel the jobs of a group, or all of them."""
    spark.sparkContext.cancelJobGroup(group) if group else spark.sparkContext.cancelAllJobs()


def top_strength(consensus: DataFrame) -> DataFrame:
    return consensus.agg(F.max(eff_mu()).alias("top_eff_mu"))
