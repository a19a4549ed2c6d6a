"""Timeline, risk features and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import average_rank
from tidemark.sources.tables import checkpointed

TOKEN = "token_address"


def _capped(x: Column) -> Column:
    """At most 1; null stays null (least() would pass over it)."""
    return F.when(x > 1, 1.0).otherwise(x)


def incident_timeline(events: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per token and phase (pre: before the incident's block): events, blocks and times. incidents: token_address, incident_block."""
    phase = F.when(F.col("block_number") < F.col("incident_block"), "pre").otherwise("post")
    return events.join(incidents, TOKEN).groupBy(TOKEN, phase.alias("phase")).agg(
        F.count("*").alias("events"), F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"), F.min("block_timestamp").alias("first_time"), F.max("block_timestamp").alias("last_time"),
    )


def crash_window(events: DataFrame, incidents: DataFrame, before: int = 100, after: int = 50) -> DataFrame:
    inside = F.col("block_number").between(F.col("incident_block") - before, F.col("incident_block") + after)
    return events.join(incidents, TOKEN).where(inside)


def liquidity_migration(liq: DataFrame, max_blocks: int = 5) -> DataFrame:
    """Removals followed by an addition within max_blocks where the actors are the same, or the recipients are: equal joins on
    role, who and block. Each removal is sent to the max_blocks + 1 blocks it can meet, so no range is searched."""
    roles = [r for r in ("actor", "recipient") if r in liq.columns]
    named = F.filter(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("who")) for r in roles]), lambda x: x["who"].isNotNull())
    who = lambda rows: rows.withColumn("_w", F.explode(named)).select("*", "_w.*")
    removed = who(liq.where("event_type = 'LIQUIDITY_REMOVE'")).select(
        TOKEN, "role", "who", F.col("actor").alias("_by"), F.col("block_number").alias("remove_block"), F.col("pool_address").alias("from_pool"), F.explode(F.sequence("block_number", F.col("block_number") + max_blocks)).alias("block_number")
    )
    added = who(liq.where("event_type = 'LIQUIDITY_ADD'")).select(TOKEN, "role", "who", F.col("actor").alias("_to"), "block_number", F.col("pool_address").alias("to_pool"))
    met = removed.join(added, [TOKEN, "role", "who", "block_number"])
    return met.select(TOKEN, F.coalesce("_by", "_to").alias("actor"), "remove_block", F.col("block_number").alias("add_block"), "from_pool", "to_pool", (F.col("from_pool") == F.col("to_pool")).alias("same_pool")).distinct()


def migration_flag(migration: DataFrame, liq: DataFrame, keep: int = 5) -> DataFrame:
    """Per token: whether liquidity was moved, within a pool or to another, the first few moves, and whether anyone is named at all."""
    order = Window.partitionBy(TOKEN).orderBy("remove_block", "add_block", "from_pool", "to_pool", "actor")
    moves = migration.withColumn("_r", F.row_number().over(order))
    found = moves.groupBy(TOKEN).agg(F.count("*").alias("moves"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= keep, F.struct("_r", "remove_block")))), lambda x: x["remove_block"].cast("string")), ",").alias("first_blocks"))
    named = F.coalesce(F.col("actor"), F.col("recipient")) if "recipient" in liq.columns else F.col("actor")
    actors = liq.groupBy(TOKEN).agg((F.count(named) > 0).alias("actors_known"))
    rows = actors.join(found, TOKEN, "left")
    return rows.select(TOKEN, F.coalesce("moves", F.lit(0)).alias("moves"), (F.coalesce("moves", F.lit(0)) > 0).alias("migration_detected"), F.coalesce("first_blocks", F.lit("")).alias("first_blocks"), "actors_known")


def alternative_causes(transfers: DataFrame, min_count: int = 10) -> DataFrame:
    return transfers.groupBy(TOKEN, F.col("from_address").alias("sender")).agg(F.count("*").alias("n")).where(F.col("n") > min_count)


def incidents(liq: DataFrame) -> DataFrame:
    """token, incident_block: the block of the token's largest removal by liquidity delta, the first of equals."""
    size = F.struct(F.abs("liquidity_delta"), -F.col("block_number"))
    return liq.where("event_type = 'LIQUIDITY_REMOVE'").groupBy(TOKEN).agg(F.max_by("block_number", size).alias("incident_block"))


def temporal_proximity(tokens: DataFrame, liq: DataFrame, incidents: DataFrame, block_seconds: int = 12) -> DataFrame:
    """Per token: time from the nearest removal at or before the incident, as a score; without an incident (null or 0) by
    the number of removals; 0 where there is none."""
    gone = liq.where("event_type = 'LIQUIDITY_REMOVE'").join(incidents, TOKEN, "left")
    last = gone.groupBy(TOKEN).agg(F.count("*").alias("removals"), F.max(F.when(F.col("block_number") <= F.col("incident_block"), F.col("block_number"))).alias("_b"))
    rows = tokens.select(TOKEN).distinct().join(last, TOKEN, "left").join(incidents, TOKEN, "left")
    n, s = F.coalesce("removals", F.lit(0)), (F.col("incident_block") - F.col("_b")) * block_seconds
    by_count = F.when(n >= 10, 0.45).when(n >= 3, 0.25).when(n >= 1, 0.1).otherwise(0.0)
    by_time = F.when(s < 3600, 1.0).when(s < 21_600, 0.8).when(s < 86_400, 0.5).when(s < 604_800, 0.3).when(s.isNotNull(), 0.1).otherwise(0.0)
    known = F.coalesce("incident_block", F.lit(0)) != 0
    return rows.select(TOKEN, n.alias("removals"), F.when(known, s).alias("seconds"), F.when(known, by_time).otherwise(by_count).alias("score"))


def role_sensitivity(tokens: DataFrame, labels: DataFrame, deployers: DataFrame) -> DataFrame:
    """Per token: 0.8 where the deployer bears a label, 0.6 where others share a pool with it, else 0.3; without a known
    deployer 0.5 if a label sounds like one, else 0. labels: token_address, address, label, category."""
    known = tokens.select(TOKEN).distinct().join(deployers.select(TOKEN, F.lower("deployer").alias("deployer")), TOKEN, "left")
    rows = known.join(labels, TOKEN, "left")
    name = F.lower(F.concat(F.coalesce("label", F.lit("")), F.coalesce("category", F.lit(""))))
    facts = rows.groupBy(TOKEN, "deployer").agg(
        F.coalesce(F.bool_or(F.lower("address") == F.col("deployer")), F.lit(False)).alias("own"), F.coalesce(F.bool_or(F.contains("label", F.lit("Co-LP"))), F.lit(False)).alias("beside"),
        F.coalesce(F.bool_or(name.rlike("deployer|owner|admin|rug")), F.lit(False)).alias("named"),
    )
    score = F.when(F.col("deployer").isNull(), F.when(F.col("named"), 0.5).otherwise(0.0)).when(F.col("own"), 0.8).when(F.col("beside"), 0.6).otherwise(0.3)
    return facts.select(TOKEN, score.alias("score"))


def market_impact(tokens: DataFrame, prices: DataFrame, incidents: DataFrame) -> DataFrame:
    """Mean of positive prices up to and after the incident, and the relative fall, at most 1, 0 unless both are known.
    prices: token_address, block_number, price (decimal or double)."""
    rows = prices.where("price > 0").join(incidents.where("incident_block <> 0"), TOKEN)
    pre, exact = F.col("block_number") <= F.col("incident_block"), F.round("price", 9).cast("decimal(28,9)")
    mean = lambda cond: F.try_divide(F.sum(F.when(cond, exact)).cast("double"), F.count_if(cond).cast("double"))
    out = tokens.select(TOKEN).distinct().join(rows.groupBy(TOKEN).agg(mean(pre).alias("before"), mean(~pre).alias("after")), TOKEN, "left")
    score = F.coalesce(_capped((F.col("before") - F.col("after")) / F.col("before")), F.lit(0.0))
    return out.select(TOKEN, F.round("before", 9).alias("before"), F.round("after", 9).alias("after"), F.round(score, 9).alias("score"))


# Weights of the features of the risk score, what migration takes off, and the limits of the levels.
RISK_WEIGHTS = {"pool": 0.15, "lp": 0.15, "severity": 0.20, "proximity": 0.15, "role": 0.15, "impact": 0.15, "combined": 0.05}
MIGRATION, RISK_HIGH, RISK_MEDIUM = 0.3, 0.7, 0.4


def risk_score(tokens: DataFrame, pool_share: DataFrame, lp_share: DataFrame, withdrawals: DataFrame, proximity: DataFrame, role: DataFrame, impact: DataFrame, migration: DataFrame) -> DataFrame:
    """Per token: seven weighted features, less MIGRATION where liquidity migrated, within 0 and 1, times the evidence.

    Each argument has token_address and: main_pool_share; top_lp_share (percent); severity, removals, large_sells; score
    (three times); nothing more. Features that are missing count 0. Evidence: .55 and .09 for each kind found, at most 1.
    """
    rows = tokens.select(TOKEN).distinct()
    parts = [
        pool_share.select(TOKEN, _capped(F.col("main_pool_share")).alias("pool")), lp_share.select(TOKEN, _capped(F.col("top_lp_share") / 100).alias("lp")),
        withdrawals.select(TOKEN, _capped(F.col("severity")).alias("severity"), "removals", "large_sells"), proximity.select(TOKEN, F.col("score").alias("proximity")),
        role.select(TOKEN, F.col("score").alias("role")), impact.select(TOKEN, F.col("score").alias("impact")), migration.select(TOKEN).distinct().withColumn("_moved", F.lit(True)),
    ]
    for part in parts:
        rows = rows.join(part, TOKEN, "left")
    n, large = F.coalesce("removals", F.lit(0)), F.coalesce("large_sells", F.lit(False))
    rows = rows.withColumns({"combined": F.when((n > 3) & large, 1.0).when((n > 1) | large, 0.5).otherwise(0.0), "migrated": F.coalesce("_moved", F.lit(False))})
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = rows.withColumn("_raw", sum(F.lit(w) * value(c) for c, w in RISK_WEIGHTS.items()))
    found = [value("pool") > 0, value("lp") > 0, (value("severity") > 0) | (n > 0), value("proximity") > 0, value("impact") > 0, value("role") > 0]
    rows = rows.withColumn("_evidence", F.least(F.lit(1.0), 0.55 + 0.09 * sum(x.cast("int") for x in found)))
    final = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_raw") - F.when(F.col("migrated"), MIGRATION).otherwise(0.0))) * F.col("_evidence")
    rows = rows.withColumn("_final", final)
    level = F.when(F.col("_final") >= RISK_HIGH, "HIGH").when(F.col("_final") >= RISK_MEDIUM, "MEDIUM").otherwise("LOW")
    return rows.select(
        TOKEN, *[F.round(value(c), 4).alias(f"f_{c}") for c in RISK_WEIGHTS], "migrated", F.round("_raw", 4).alias("raw_score"), F.round("_evidence", 4).alias("evidence_confidence"), F.round("_final", 4).alias("final_score"), level.alias("risk_level")
    )


def report_events(events: DataFrame, incidents: DataFrame, n: int = 30, around: int = 100) -> DataFrame:
    """The first n events within `around` blocks of the incident; of a token without an incident the last n."""
    rows = events.join(incidents, TOKEN, "left")
    near = F.abs(F.col("block_number") - F.col("incident_block")) <= around
    known = F.coalesce("incident_block", F.lit(0)) != 0
    rows = rows.where(~known | near).withColumn("_known", known)
    sign = F.when(F.col("_known"), 1).otherwise(-1)
    order = Window.partitionBy(TOKEN).orderBy(F.col("block_number") * sign, F.col("log_index") * sign)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("_known")


def pearson(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """r and n of the pairs without null; null r under 3 pairs or without variance (corr() would divide by zero)."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0))).alias("_r"))
    return out.select(*by, "n", F.when(F.col("n") >= 3, F.round("_r", 6)).alias("r"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson of average ranks, ranked by ranges of values after pairs with a null are gone."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c in (x, y):
        rows = average_rank(rows, by, c, f"_{c}")
    return pearson(rows, f"_{x}", f"_{y}", by)


def lead_lag(series: DataFrame, x: str, y: str, order: str, by: list[str], max_lag: int = 6) -> DataFrame:
    """Pearson of x now and y lag rows later, for each lag; the strongest (earliest of equals) and that at lag 0."""
    numbered = series.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    left = numbered.select(*by, F.col("i").alias("j"), x, F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")).withColumn("i", F.col("j") + F.col("lag"))
    pairs = left.join(numbered.select(*by, "i", y), [*by, "i"])
    r = pearson(pairs, x, y, [*by, "lag"]).where("r is not null")
    return r.groupBy(*by).agg(F.max_by(F.struct("lag", "r", "n"), F.struct(F.abs("r"), -F.col("lag"))).alias("b"), F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("zero_lag")).select(*by, "b.*", "zero_lag")


def contiguous(series: DataFrame, order: str, by: list[str], step: int) -> DataFrame:
    gap = F.col(order) - F.lag(order).over(Window.partitionBy(*by).orderBy(order))
    return series.withColumn("_g", gap).groupBy(*by).agg(F.coalesce(F.bool_and(F.col("_g") == step), F.lit(True)).alias("ok"), F.count("*").alias("n"))


def feature_log1p(x: Column) -> Column:
    """ln(1 + x); null for what is negative."""
    return F.when(x >= 0, F.log1p(x))


def correlations(series: DataFrame, features: list[str], by: list[str], min_pairs: int = 8) -> DataFrame:
    """by, x, y, method, r, n: Pearson and Spearman of every two features over rows where both are known, n at least min_pairs.

    Rows are unfolded to pairs of features, bounded by the number of features, so one pass serves all pairs.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).cast("double").alias("u"), F.col(b).cast("double").alias("v")) for i, a in enumerate(features) for b in features[i + 1 :]])
    rows = checkpointed(series.select(*by, *features))  # read for each method and side
    rows = rows.select(*by, F.explode(pairs).alias("p")).select(*by, "p.*")
    keys = [*by, "x", "y"]
    both = pearson(rows, "u", "v", keys).withColumn("method", F.lit("pearson")).unionByName(spearman(rows, "u", "v", keys).withColumn("method", F.lit("spearman")))
    return both.where(F.col("n") >= min_pairs)


def strongest(correlated: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """The k strongest of each group, without the undefined."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.abs("r")), "x", "y", "method")
    return correlated.where("r is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def corr_matrix(series: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """r of every ordered pair of features, 0 where undefined, 1 of a feature with itself if it varies."""
    pairs = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).cast("double").alias("u"), F.col(b).cast("double").alias("v")) for a in features for b in features])
    rows = series.select(*by, F.explode(pairs).alias("p")).select(*by, "p.*")
    return pearson(rows, "u", "v", [*by, "x", "y"]).withColumn("r", F.coalesce("r", F.lit(0.0)))


def activity_series(spine: DataFrame, metrics: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Every bucket of the spine with the metrics (name -> frame with `by` and a column of that name), 0 where there is none."""
    rows = spine
    for name, frame in metrics.items():
        rows = rows.join(frame.select(*by, name), by, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return rows


def lead_lag_matrix(series: DataFrame, features: list[str], order: str, by: list[str], max_lag: int = 6) -> DataFrame:
    """r of every ordered pair of different features at each lag (y so many rows after x), 0 where undefined."""
    numbered = series.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    each = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in features])
    values = numbered.select(*by, "i", F.explode(each).alias("e")).select(*by, "i", "e.*")
    left = values.select(*by, F.col("f").alias("x"), F.col("v").alias("u"), F.col("i").alias("j"), F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")).withColumn("i", F.col("j") + F.col("lag"))
    pairs = left.join(values.select(*by, "i", F.col("f").alias("y"), "v"), [*by, "i"]).where("x <> y")
    return pearson(pairs, "u", "v", [*by, "x", "y", "lag"]).withColumn("r", F.coalesce("r", F.lit(0.0)))
