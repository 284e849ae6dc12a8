"""Every query of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import census_queries, edge_queries, game_queries, graph_queries, inspect_queries, lexicon, ops_queries, realize_queries, sequence_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "census_queries", "edge_queries", "flagship", "game_queries", "graph_queries", "inspect_queries", "lexicon", "ops_queries", "realize_queries", "sequence_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence from the order tables, folded into rated edges, the 50 strongest of them."""
    from ..functions.rating import edge_rank, eff_mu_display
    from ..operators import edges, fold
    from . import world

    rated = edges.ranked(fold.fold(world.evidence(spark, sf_dir)), world.law(spark))
    rows = edges.top_relations(rated, 50)
    return edge_queries._hex(rows.select("subject_id", "relation", "object_id", eff_mu_display().alias("eff_mu"), edge_rank().alias("edge_rank"), "witness_count"))
