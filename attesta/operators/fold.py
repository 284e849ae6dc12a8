"""Evidence merged by content id, and its fold into one rating for each distinct triple."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.rating import INITIAL_RD, INITIAL_VOLATILITY, NEUTRAL, Rating, eff_mu, outcome, uniform_period

_STATE = "rating long, rd long, volatility long, witness_count long"


def observe(rows: DataFrame) -> DataFrame:
    """Assertions (subject_id, type_id, object_id, source_id, context_id, score_fp, opponent_rd_fp, ts) as evidence.

    What one source says again in one context is added up; two sources stay two rows. Partial sums are made before the
    shuffle, so a triple that is asserted very often costs one row for each task.
    """
    keyed = rows.withColumn("id", ids.evidence_id())
    keys = ["id", "subject_id", "type_id", "object_id", "source_id", "context_id"]
    merged = keyed.groupBy(*keys).agg(F.count("*").alias("observation_count"), F.sum("score_fp").alias("sum_score_fp"), F.max("opponent_rd_fp").alias("opponent_rd_fp"), F.max("ts").alias("last_observed_at"))
    return merged.withColumn("outcome", outcome("observation_count", "sum_score_fp"))


def merge(*evidence: DataFrame) -> DataFrame:
    """Evidence of several deposits by id: counts and sums add, the time is the latest, the deviation stays."""
    every = evidence[0]
    for more in evidence[1:]:
        every = every.unionByName(more)
    keys = ["id", "subject_id", "type_id", "object_id", "source_id", "context_id"]
    out = every.groupBy(*keys).agg(F.sum("observation_count").alias("observation_count"), F.sum("sum_score_fp").alias("sum_score_fp"), F.max("opponent_rd_fp").alias("opponent_rd_fp"), F.max("last_observed_at").alias("last_observed_at"))
    return out.withColumn("outcome", outcome("observation_count", "sum_score_fp"))


def deltas(evidence: DataFrame) -> DataFrame:
    """One row for each triple and deviation: the games, the sum of scores and the latest time of one period."""
    out = evidence.groupBy("subject_id", "type_id", "object_id", F.col("opponent_rd_fp").alias("phi")).agg(F.sum("observation_count").alias("games"), F.sum("sum_score_fp").alias("sum_score"), F.max("last_observed_at").alias("last_observed_at"))
    return out.withColumn("id", ids.triple_id())


_PERIOD = ["rating", "rd", "volatility", "witness_count", "phi", "games", "sum_score"]


def _rate(rows: pd.DataFrame) -> np.ndarray:
    """The state after each row's period, as four columns; each distinct combination of state and period is rated once."""
    number, distinct = pd.factorize(pd.MultiIndex.from_frame(rows[_PERIOD]))
    rated = [uniform_period(Rating(*map(int, r[:4])), int(r[4]), int(r[5]), int(r[6])) for r in distinct]
    return np.array(rated, np.int64).reshape(-1, 4)[number]


def _uniform(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        if len(rows):
            rows[_PERIOD[:4]] = _rate(rows)
        yield rows[_NAMES]


_RATED = "id binary, subject_id binary, type_id binary, object_id binary, rating long, rd long, volatility long, witness_count long, last_observed_at timestamp"


def upsert(consensus: DataFrame | None, changes: DataFrame) -> DataFrame:
    """Fold one batch of deltas onto the priors: the whole new consensus.

    A cell may have one delta in a batch; two are an error, since periods do not commute.
    """
    once = changes.groupBy("id").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("subject_id", "type_id", "object_id", "phi", "games", "sum_score", "last_observed_at")])
    checked = once.withColumn("games", F.when(F.col("n") == 1, F.col("games")).otherwise(F.raise_error(F.lit("a cell has several deltas in one batch"))))
    if consensus is None:
        start = checked.withColumns({"rating": F.lit(NEUTRAL), "rd": F.lit(INITIAL_RD), "volatility": F.lit(INITIAL_VOLATILITY), "witness_count": F.lit(0).cast("long")})
        return start.mapInPandas(_uniform, _RATED)
    prior = consensus.select("id", "rating", "rd", "volatility", "witness_count", F.col("last_observed_at").alias("prior_at"))
    joined = checked.join(prior, "id", "left")
    start = joined.withColumns({
        "rating": F.coalesce("rating", F.lit(NEUTRAL)),
        "rd": F.coalesce("rd", F.lit(INITIAL_RD)),
        "volatility": F.coalesce("volatility", F.lit(INITIAL_VOLATILITY)),
        "witness_count": F.coalesce("witness_count", F.lit(0).cast("long")),
        "last_observed_at": F.greatest("last_observed_at", "prior_at"),
    })
    untouched = consensus.join(checked.select("id"), "id", "left_anti")
    return untouched.unionByName(start.mapInPandas(_uniform, _RATED))


def fold(evidence: DataFrame) -> DataFrame:
    """All evidence as one period for each triple and deviation, those of the smallest deviation first."""
    return _ordered(deltas(evidence), "phi")


def fold_onto(consensus: DataFrame, changes: DataFrame) -> DataFrame:
    """The consensus after one batch of deltas, each cell's periods by their deviation, the smallest first; in one pass.

    Deltas of a cell follow each other in the order that fold() has them, starting from the cell's prior state.
    """
    prior = consensus.select("id", F.struct("rating", "rd", "volatility", "witness_count").alias("prior"), F.col("last_observed_at").alias("prior_at"))
    joined = changes.join(prior, "id", "left")
    untouched = consensus.join(changes.select("id").distinct(), "id", "left_anti")
    return untouched.unionByName(_ordered(joined, "phi"))


def scoped_consensus(evidence: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """The fold of the evidence of some sources (source_id), each row a period of its own, in the order of time and id."""
    own = evidence.join(sources.select("source_id").distinct(), "source_id", "left_semi") if sources is not None else evidence
    rows = own.select(ids.triple_id().alias("id"), F.col("id").alias("row_id"), "subject_id", "type_id", "object_id", F.col("opponent_rd_fp").alias("phi"), F.col("observation_count").alias("games"), F.col("sum_score_fp").alias("sum_score"), "last_observed_at")
    return _ordered(rows, "last_observed_at", "row_id")


def _ordered(rows: DataFrame, *order: str) -> DataFrame:
    """Fold each triple's periods in order. Periods are sorted beside each other, never gathered into one group's memory."""
    columns = ["id", "subject_id", "type_id", "object_id", "phi", "games", "sum_score", "last_observed_at"]
    if "prior" in rows.columns:
        rows = rows.withColumns({f"was_{c}": F.col("prior")[c] for c in _PERIOD[:4]}).withColumn("last_observed_at", F.greatest("last_observed_at", "prior_at"))
    else:
        rows = rows.withColumns({f"was_{c}": F.lit(None).cast("long") for c in _PERIOD[:4]})
    columns += [f"was_{c}" for c in _PERIOD[:4]]
    dealt = rows.repartition("id").sortWithinPartitions("id", *order).select(*columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: pd.DataFrame | None = None  # the last cell so far, which the next batch may go on with
        for batch in batches:
            if not len(batch):
                continue
            new = (batch["id"] != batch["id"].shift()).to_numpy()
            cell = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            cells = batch.iloc[first][columns[:4]].reset_index(drop=True)
            state = np.stack([batch[f"was_{c}"].iloc[first].fillna(start).to_numpy().astype(np.int64) for c, start in zip(_PERIOD[:4], Rating(), strict=True)], 1)
            at = batch.groupby(cell)["last_observed_at"].max()
            if open_ is not None:
                if open_["id"].iloc[0] == cells["id"].iloc[0]:
                    state[0] = open_[_PERIOD[:4]].to_numpy()[0]
                    at.iloc[0] = max(at.iloc[0], open_["last_observed_at"].iloc[0])
                else:
                    yield open_
            # all cells' first periods, then all second ones, and so on
            turn = np.arange(len(batch)) - first[cell]
            by_turn = np.argsort(turn, kind="stable")
            for rows in np.split(by_turn, np.flatnonzero(np.diff(turn[by_turn])) + 1):
                period = batch.iloc[rows][_PERIOD[4:]].reset_index(drop=True)
                period[_PERIOD[:4]] = state[cell[rows]]
                state[cell[rows]] = _rate(period)
            cells[_PERIOD[:4]] = state
            cells["last_observed_at"] = at.to_numpy()
            open_ = cells.iloc[-1:][_NAMES]
            yield cells.iloc[:-1][_NAMES]
        if open_ is not None:
            yield open_

    return dealt.mapInPandas(run, _RATED)


_NAMES = [c.split()[0] for c in _RATED.split(", ")]


def evict(evidence: DataFrame, consensus: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence and consensus without some sources (source_id): cells they had a part in are folded anew, in order;
    cells that were theirs alone are gone; all others stay as they are."""
    gone = evidence.join(sources.select("source_id").distinct(), "source_id", "left_semi")
    left = evidence.join(sources.select("source_id").distinct(), "source_id", "left_anti")
    touched = gone.select(ids.triple_id().alias("id")).distinct()
    again = left.withColumn("cell", ids.triple_id()).join(touched.withColumnRenamed("id", "cell"), "cell", "left_semi").drop("cell")
    return left, consensus.join(touched, "id", "left_anti").unionByName(scoped_consensus(again).select(*consensus.columns))


def decay(consensus: DataFrame, which: Column, factor: float = 0.95) -> DataFrame:
    """Less certainty for some cells: the deviation grows by 1 / factor, up to the initial one."""
    wider = F.least(F.floor(F.col("rd") / F.lit(factor)).cast("long"), F.lit(INITIAL_RD))
    return consensus.withColumn("rd", F.when(which, wider).otherwise(F.col("rd")))


def prune(consensus: DataFrame, max_eff_mu: int = 0, dry_run: bool = True) -> DataFrame:
    """The number of cells below a floor (dry run), or the consensus without them."""
    below = eff_mu() < max_eff_mu
    return consensus.filter(below).agg(F.count("*").alias("affected_rows")) if dry_run else consensus.filter(~below)


def witness(consensus: DataFrame, seen: DataFrame, opponent_rd: int) -> DataFrame:
    """One more observation of each triple in seen (subject_id, type_id, object_id, score_fp, ts)."""
    change = seen.groupBy("subject_id", "type_id", "object_id").agg(F.count("*").alias("games"), F.sum("score_fp").alias("sum_score"), F.max("ts").alias("last_observed_at"))
    return upsert(consensus, change.withColumns({"id": ids.triple_id(), "phi": F.lit(opponent_rd)}))
