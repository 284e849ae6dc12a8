"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

The cells are the combinations of source, language and topic that occur. Their token weights start at the tokens they
have and are raked in turn so that each margin's sums become its targets. Targets can be given for each margin as shares of
its values (those not named get nothing; shares are taken relative to the sum of those that occur); a margin without given
ones has the shares of the square roots of its values' tokens, which lifts what is rare without emptying what is common.
margins() says how near the raked weights came. A document is then kept with its cell's
probability min(1, s * weight / tokens), where s makes the expected tokens KEEP of all: cells that can't give more are
taken whole, the others share the rest (water filling).

A document's luck is a hash of its id, so runs agree. Defined results: a null source or language is the value '(none)';
a null text is an empty one; rows without doc_id share one luck; repeated rows are kept or dropped together; a cell
without any token is kept whole; an empty table gives an empty table. sample() returns the input's own columns whatever
their names; mix() adds its columns, and an input column of the same name (in any case) gives way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Rounds of raking over all margins, and the share of all tokens to keep.
ROUNDS = 10
KEEP = 0.8
MARGINS = ("mix_source", "mix_lang", "mix_topic")
#: Up to so many cells are raked in one task and sent to all tasks; the number of documents has no part in it.
SMALL = 50_000
_NONE = "(none)"


def topic() -> Column:
    """A document's topic by plain marks in its text; the first that fits."""
    text = F.coalesce("text", F.lit(""))
    return F.when(text.contains("icense") | text.contains("opyright"), "legal").when(text.contains(" | "), "table").when(text.contains(' = "'), "code").when(text.contains("555-") | text.contains("@"), "contact").otherwise("prose")


def features(docs: DataFrame, subject: Column | None = None) -> DataFrame:
    """row (all columns of docs) with the three margins' values, mix_tokens (words) and mix_luck (0 to 1).

    subject: an expression over docs for the topic instead of topic().
    """
    luck = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col("source").cast("string"), F.lit(_NONE)).alias("mix_source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(_NONE)).alias("mix_lang"),
        F.coalesce(topic() if subject is None else subject.cast("string"), F.lit(_NONE)).alias("mix_topic"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("mix_tokens"),
        luck.alias("mix_luck"),
    )


def _given(m: str, shares: dict[str, float]) -> Column:
    """The given share of a margin's value, 0 for one that isn't named."""
    named = F.create_map(*[F.lit(x) for value, share in shares.items() for x in (value, float(share))]) if shares else None
    return F.coalesce(F.element_at(named, F.col(m)), F.lit(0.0)) if shares else F.lit(0.0)


def raked(cells: DataFrame, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """cells (margins, tokens) with weight: shares of the target mix that fit all margins, as near as rounds come; and with
    each margin's target t_<margin>."""
    targets, out = targets or {}, cells
    if wrong := set(targets) - set(MARGINS):
        raise ValueError(f"no such margin: {', '.join(sorted(wrong))}")
    for m in MARGINS:
        own = _given(m, targets[m]) if m in targets else F.sqrt(F.sum("tokens").over(Window.partitionBy(m)).cast("double"))
        out = out.withColumn(f"t_{m}", own)
    for m in MARGINS:
        # each value counts once, whatever its number of cells
        once = F.row_number().over(Window.partitionBy(m).orderBy(*[x for x in MARGINS if x != m])) == 1
        out = out.withColumn(f"o_{m}", F.when(once, F.col(f"t_{m}")).otherwise(0.0))
    every = Window.partitionBy()
    for m in MARGINS:
        whole = F.sum(f"o_{m}").over(every)
        out = out.withColumn(f"t_{m}", F.when(whole > 0, F.col(f"t_{m}") / whole).otherwise(0.0))
    out = out.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for m in MARGINS:
            total = F.sum("weight").over(Window.partitionBy(m))
            out = out.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"t_{m}") / total).otherwise(0.0))
    return out.select(*MARGINS, "tokens", "weight", *[f"t_{m}" for m in MARGINS])


def margins(cells: DataFrame, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """margin, value, target and share: how near the raked weights came to each target."""
    fitted = raked(cells, rounds, targets)
    every = None
    for m in MARGINS:
        one = fitted.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.first(f"t_{m}").alias("target"), F.sum("weight").alias("share"))
        every = one if every is None else every.unionByName(one)
    return every


def probabilities(cells: DataFrame, keep: float = KEEP, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """cells (margins, tokens) with weight and prob."""
    out = raked(cells, rounds, targets).withColumn("rate", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    down = Window.partitionBy().orderBy(F.desc("rate"), *MARGINS)
    every = Window.partitionBy()
    before = F.sum("tokens").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    rest = F.sum("weight").over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = out.withColumns({"place": F.row_number().over(down), "s": F.when(rest > 0, (F.lit(keep) * F.sum("tokens").over(every) - before) / rest)})
    out = out.withColumn("scale", F.min_by(F.when(F.col("s") * F.col("rate") <= 1, F.col("s")), F.when(F.col("s") * F.col("rate") <= 1, F.col("place"))).over(every))
    # without a scale every cell that has a weight is taken whole
    prob = F.when(F.col("tokens") == 0, 1.0).when(F.col("scale").isNull(), (F.col("rate") > 0).cast("double")).otherwise(F.least(F.lit(1.0), F.col("scale") * F.col("rate")))
    return out.select(*MARGINS, "tokens", "weight", prob.alias("prob"))


def _mixed(docs: DataFrame, keep: float, rounds: int, targets: dict[str, dict[str, float]] | None, subject: Column | None) -> DataFrame:
    rows = features(docs, subject)
    cells = stage(rows.groupBy(*MARGINS).agg(F.sum("mix_tokens").alias("tokens")), "mix-cells")
    small = cells.limit(SMALL + 1).count() <= SMALL
    table = stage(probabilities(cells.coalesce(1) if small else cells, keep, rounds, targets).drop("tokens"), "mix-probabilities")
    joined = rows.join(F.broadcast(table) if small else table, list(MARGINS))
    return joined.withColumn("kept", F.col("mix_luck") < F.col("prob"))


def mix(docs: DataFrame, keep: float = KEEP, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None, subject: Column | None = None) -> DataFrame:
    """docs with the margins, mix_tokens, mix_luck, weight and prob of the cell, and kept."""
    added = [*MARGINS, "mix_tokens", "mix_luck", "weight", "prob", "kept"]
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in added]
    return _mixed(docs, keep, rounds, targets, subject).select(*own, *added)


def sample(docs: DataFrame, keep: float = KEEP, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None, subject: Column | None = None) -> DataFrame:
    """The kept rows of docs, with the columns of docs."""
    return _mixed(docs, keep, rounds, targets, subject).filter("kept").select("row.*")


def oracle_sql(keep: float = KEEP, rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL, the rounds written out."""
    a, b, c = MARGINS
    parts = [f"""docs AS (
    SELECT doc_id, coalesce(source, '{_NONE}') AS {a}, coalesce(lang, '{_NONE}') AS {b},
        CASE WHEN contains(t, 'icense') OR contains(t, 'opyright') THEN 'legal' WHEN contains(t, ' | ') THEN 'table'
             WHEN contains(t, ' = "') THEN 'code' WHEN contains(t, '555-') OR contains(t, '@') THEN 'contact' ELSE 'prose' END AS {c},
        CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
        CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0 AS luck
    FROM (SELECT *, coalesce(text, '') AS t FROM documents))""",
        f"cells AS (SELECT {a}, {b}, {c}, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM docs GROUP BY ALL)"]
    for m in MARGINS:
        parts.append(f"{m}_t AS (SELECT {m}, sqrt(CAST(sum(tokens) AS DOUBLE)) / sum(sqrt(CAST(sum(tokens) AS DOUBLE))) OVER () AS t_{m} FROM cells GROUP BY {m})")
    parts.append(f"r0 AS (SELECT cells.*, t_{a}, t_{b}, t_{c}, CAST(tokens AS DOUBLE) AS weight FROM cells JOIN {a}_t USING ({a}) JOIN {b}_t USING ({b}) JOIN {c}_t USING ({c}))")
    k = 0
    for _ in range(rounds):
        for m in MARGINS:
            parts.append(f"r{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {m}) > 0 THEN weight * t_{m} / sum(weight) OVER (PARTITION BY {m}) ELSE 0 END AS weight) FROM r{k})")
            k += 1
    parts.append(f"rated AS (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS rate FROM r{k})")
    order = f"ORDER BY rate DESC, {a}, {b}, {c}"
    parts.append(f"""filled AS (SELECT *, row_number() OVER ({order}) AS place,
        ({keep} * sum(tokens) OVER () - (sum(tokens) OVER ({order} ROWS UNBOUNDED PRECEDING) - tokens)) / nullif(sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS s FROM rated)""")
    parts.append("scaled AS (SELECT *, (SELECT arg_min(s, place) FROM filled WHERE s * rate <= 1) AS scale FROM filled)")
    parts.append(f"probs AS (SELECT {a}, {b}, {c}, weight, CASE WHEN tokens = 0 OR scale IS NULL THEN 1.0 ELSE least(1.0, scale * rate) END AS prob FROM scaled)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, {a} AS source, {b} AS lang, {c} AS topic, n_tokens, round(weight, 9) AS weight, round(prob, 9) AS prob, luck < prob AS kept FROM docs JOIN probs USING ({a}, {b}, {c})"
