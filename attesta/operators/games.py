"""Games of two players: records, ratings by opponent, openings, learned moves.

games: (event_id, white_id, black_id, result, opening, played_on), result '1-0', '0-1', '1/2-1/2' or anything else.
moves: (event_id, ply, move_id), ply from 0; white moves first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcome(as_white: str | Column, result: str | Column) -> Column:
    """2 won, 1 drawn, 0 lost for that colour; null without a result."""
    w = F.col(as_white) if isinstance(as_white, str) else as_white
    r = F.col(result) if isinstance(result, str) else result
    return F.when(r == "1/2-1/2", 1).when(r.isin("1-0", "0-1"), F.when((r == "1-0") == w, 2).otherwise(0)).cast("short")


def sides(games: DataFrame) -> DataFrame:
    """One row for each player of a game: player_id, opponent_id, as_white, outcome."""
    rest = [c for c in games.columns if c not in ("white_id", "black_id")]
    white = games.select(*rest, F.col("white_id").alias("player_id"), F.col("black_id").alias("opponent_id"), F.lit(True).alias("as_white"))
    black = games.select(*rest, F.col("black_id").alias("player_id"), F.col("white_id").alias("opponent_id"), F.lit(False).alias("as_white"))
    return white.unionByName(black).withColumn("outcome", outcome("as_white", "result"))


def _score() -> list[Column]:
    o = F.col("outcome")
    return [F.count("*").alias("games"), F.count_if(o == 2).alias("wins"), F.count_if(o == 1).alias("draws"), F.count_if(o == 0).alias("losses"), F.count_if(o.isNull()).alias("unscored"), (F.avg(o) / 2).alias("score")]


def player_record(games: DataFrame) -> DataFrame:
    """Every player's results by colour and in all (as_white null), as grouping sets."""
    rows = sides(games)
    return rows.groupingSets([[F.col("player_id"), F.col("as_white")], [F.col("player_id")]], "player_id", "as_white").agg(*_score())


def head_to_head(games: DataFrame, limit: int = 25) -> DataFrame:
    rows = sides(games).groupBy("player_id", "opponent_id").agg(*_score())
    place = F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("games"), "opponent_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


def player_games(games: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """Each player's games, newest first, one page of them."""
    place = F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc_nulls_last("played_on"), "event_id", "as_white"))
    return sides(games).withColumn("place", place).filter((F.col("place") > offset) & (F.col("place") <= offset + limit))


def ranked(games: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """The roster by number of games, one page of it."""
    rows = sides(games).groupBy("player_id").agg(*_score())
    return rows.orderBy(F.desc("games"), F.desc("score"), "player_id").offset(offset).limit(limit)


def opening_record(games: DataFrame) -> DataFrame:
    """Openings: how many players chose them as white, playings, white's mean score."""
    return games.groupBy("opening").agg(F.countDistinct("white_id").alias("players"), F.count("*").alias("playings"), (F.avg(outcome(F.lit(True), "result")) / 2).alias("score"))


def opening_preference(games: DataFrame, limit: int = 12) -> DataFrame:
    rows = sides(games).groupBy("player_id", "opening").agg(F.count("*").alias("games"))
    place = F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("games"), "opening"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


def learned_moves(games: DataFrame, moves: DataFrame) -> DataFrame:
    """Each move's plays and the mean score of the one who moved; a ply's parity tells who that was."""
    rows = moves.join(games.select("event_id", "result"), "event_id")
    o = outcome(F.col("ply") % 2 == 0, "result")
    return rows.groupBy("move_id").agg(F.count("*").alias("plays"), (F.avg(o) / 2).alias("mover_score"))


def next_moves(games: DataFrame, moves: DataFrame, limit: int = 12) -> DataFrame:
    """What follows each move, how often and with what score for the one who plays it."""
    w = Window.partitionBy("event_id").orderBy("ply")
    pairs = moves.select("event_id", "ply", "move_id", F.lead("move_id").over(w).alias("next_id")).filter("next_id is not null")
    o = outcome(F.col("ply") % 2 == 1, "result")
    rows = pairs.join(games.select("event_id", "result"), "event_id").groupBy("move_id", "next_id").agg(F.count("*").alias("games"), (F.avg(o) / 2).alias("score"))
    place = F.row_number().over(Window.partitionBy("move_id").orderBy(F.desc("games"), "next_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


def opening_match(lines: DataFrame, openings: DataFrame) -> DataFrame:
    """The longest opening (opening, moves) that each line (event_id, moves) begins with.

    Joined on the hash of every prefix as long as some opening, so no line meets an opening that it doesn't begin with.
    """
    lengths = openings.select(F.size("moves").alias("n")).distinct()
    prefixes = lines.join(F.broadcast(lengths), F.size("moves") >= F.col("n")).select("event_id", "n", F.slice("moves", 1, F.col("n")).alias("moves"))
    found = prefixes.join(openings.select("moves", "opening"), "moves")
    return found.groupBy("event_id").agg(F.max_by("opening", F.struct("n", "opening")).alias("opening"), F.max("n").alias("plies"))


def player_search(players: DataFrame, queries: DataFrame, limit: int | None = 600) -> DataFrame:
    """Players (player_id, name, games) whose names hold every letter and digit of a query of two or more; all of them without a limit.

    Queries are sent to all tasks, players stay where they are.
    """
    letters = F.array_distinct(F.filter(F.split(F.lower("query"), ""), lambda c: c.rlike("[a-z0-9]")))
    q = queries.select("query", letters.alias("letters")).filter(F.size("letters") >= 2)
    n = players.withColumn("has", F.array_distinct(F.split(F.lower("name"), "")))
    # one letter of the query finds the candidates, the others decide
    rows = n.withColumn("letter", F.explode("has")).join(F.broadcast(q.withColumn("letter", F.element_at("letters", 1))), "letter")
    rows = rows.filter(F.size(F.array_except("letters", "has")) == 0)
    if limit is None:
        return rows.select("query", "player_id", "name", "games")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("games"), "player_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit).select("query", "player_id", "name", "games")


# --- lines, positions, openings -----------------------------------------------------------------------------------


def headers(games: DataFrame, names: DataFrame) -> DataFrame:
    """A game's header with both players' names (names: player_id, name)."""
    white = names.select(F.col("player_id").alias("white_id"), F.col("name").alias("white"))
    black = names.select(F.col("player_id").alias("black_id"), F.col("name").alias("black"))
    return games.join(white, "white_id", "left").join(black, "black_id", "left").select("event_id", "white_id", "white", "black_id", "black", "result", "played_on", "opening")


def lines(moves: DataFrame) -> DataFrame:
    """event_id, moves in order."""
    return moves.groupBy("event_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ply", "move_id"))), lambda s: s["move_id"]).alias("moves"))


def line_playings(moves: DataFrame, games: DataFrame) -> DataFrame:
    """moves, times_played, score and last_played of each distinct line."""
    rows = lines(moves).join(games.select("event_id", "result", "played_on"), "event_id")
    return rows.groupBy("moves").agg(F.count("*").alias("times_played"), (F.avg(outcome(F.lit(True), "result")) / 2).alias("score"), F.max("played_on").alias("last_played"))


def opening_games(games: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """A page of each opening's games, the newest first."""
    place = F.row_number().over(Window.partitionBy("opening").orderBy(F.desc_nulls_last("played_on"), "event_id"))
    return games.withColumn("place", place).filter((F.col("place") > offset) & (F.col("place") <= offset + limit))


def line_facts(moves: DataFrame, facts: DataFrame, limit: int = 64) -> DataFrame:
    """event_id, ply, move_id, wdl, dtz: what a table of endings (move_id, wdl, dtz) says along each line."""
    rows = moves.join(facts, "move_id")
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("ply"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit).select("event_id", "ply", "move_id", "wdl", "dtz")


def distance_to_facts(moves: DataFrame, facts: DataFrame) -> DataFrame:
    """event_id, ply, wdl, dtz: the first place on each line that the table of endings knows."""
    return moves.join(facts, "move_id").groupBy("event_id").agg(F.min(F.struct("ply", "wdl", "dtz")).alias("x")).select("event_id", "x.ply", "x.wdl", "x.dtz")


def missed_finishes(moves: DataFrame, facts: DataFrame) -> DataFrame:
    """event_id, ply, from_wdl, to_wdl: a won place followed by one that isn't lost for the other side."""
    w = Window.partitionBy("event_id").orderBy("ply")
    known = moves.join(facts, "move_id", "left")
    rows = known.select("event_id", "ply", F.col("wdl").alias("from_wdl"), F.lead("wdl").over(w).alias("to_wdl"))
    return rows.filter((F.col("from_wdl") == "win") & F.col("to_wdl").isNotNull() & ~F.col("to_wdl").isin("loss", "blessed-loss"))


def opening_endgames(games: DataFrame, moves: DataFrame, facts: DataFrame) -> DataFrame:
    """opening, wdl, positions, lines: what endings each opening reaches."""
    rows = moves.join(facts, "move_id").join(games.select("event_id", "opening"), "event_id")
    return rows.groupBy("opening", "wdl").agg(F.countDistinct("move_id").alias("positions"), F.countDistinct("event_id").alias("lines"))


def ratings(games: DataFrame, rating: str = "rating") -> DataFrame:
    """player_id, rating, games: how many games each player has with each recorded rating (a text that may be no number)."""
    rows = games.withColumn("_rating", F.expr(f"try_cast({rating} as int)")).filter("_rating is not null")
    return rows.groupBy("player_id", F.col("_rating").alias("rating")).agg(F.count("*").alias("games"))


def think_classes(plays: DataFrame, classes: list[str]) -> DataFrame:
    """think_class, positions, plays, mean of value, a row for every class asked for."""
    own = plays.groupBy("think_class").agg(F.countDistinct("move_id").alias("positions"), F.count("*").alias("plays"), F.avg("value").alias("mean"))
    listed = plays.sparkSession.createDataFrame([(c,) for c in classes], "think_class string")
    return listed.join(own, "think_class", "left").fillna(0, ["positions", "plays"])


def players_page(players: DataFrame, initials: list[str], limit: int, offset: int = 0, sort: str = "name", descending: bool = False) -> DataFrame:
    """A page of the players whose names begin with some letters, by a column."""
    rows = players.filter(F.upper(F.substring("name", 1, 1)).isin(*initials))
    return rows.orderBy(F.desc(sort) if descending else F.asc(sort), "player_id").offset(offset).limit(limit)
