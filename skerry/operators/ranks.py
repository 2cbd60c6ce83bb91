"""Ranks, empirical distribution functions, ties and other ordered operators.

Ranks come from counts of distinct values: one partial aggregation, a distributed running total over the values, and a
join back by value. No window sees all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.normal import ndtri_sql
from skerry.plans.storage import join_null_safe, running_total, settle


def finite(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is neither NULL nor NaN nor infinite."""
    value = F.col(column).cast("double")
    return df.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n, upto (rows with a value up to this one)."""
    counts = finite(df, column).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    return running_total(counts, ["value"], "n")


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the rank from 1, ties averaged; NULL for values that are not finite."""
    ranks = value_counts(df, column).select(F.col("value").alias("v_"), (F.col("upto") - (F.col("n") - 1) / 2).alias(name))
    return df.join(ranks, F.col(column).cast("double") == F.col("v_"), "left").drop("v_")


def _long(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """keep, coord (place of the column) and value: a row a column and finite value."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("coord"), F.col(c).cast("double").alias("value")) for k, c in enumerate(columns))))
    return finite(df.select(*keep, pairs.alias("p")).select(*keep, "p.*"), "value")


#: Score tables of up to so many rows, all columns together, go to every task: about 10 MB.
BROADCAST_ROWS = 200_000
#: Up to so many columns beyond that are joined one after the other; more go as one long table, which moves fewer bytes.
_JOINS = 4


def normal_scores(df: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """coord (place of the column), group, value and z_, the normal quantile of average rank / (n + 1), for each distinct finite
    value of each column: one long count with one running total, whatever the number of columns and groups."""
    group = group or []
    if len(columns) == 1:
        long = finite(df, columns[0]).select(*group, F.lit(0).alias("coord"), F.col(columns[0]).cast("double").alias("value"))
    else:
        long = _long(df, columns, *group)
    keys = ["coord", *group]
    counts = running_total(long.groupBy(*keys, "value").agg(F.count("*").alias("n")), ["value"], "n", group=keys)
    totals = counts.groupBy(*keys).agg(F.max("upto").alias("total_"))  # a row a column and group
    p = "((upto - (n - 1) / 2.0) / CAST(total_ + 1 AS DOUBLE))"
    return join_null_safe(counts, totals if group else F.broadcast(totals), keys).select(*keys, "value", F.expr(ndtri_sql(p)).alias("z_"))


def rank_gaussianize(df: DataFrame, columns: list[str], suffix: str = "_z", group: list[str] | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds the normal quantile of average rank / (n + 1) for each column, ranks being those within the group's columns if
    there are any. NULL for values that are not finite; null groups are one group.

    The quantiles come back by joins on the values. Columns of few distinct values, whose score tables are counted and
    broadcast under a bound, move no rows. Others are plain joins, of which Spark splits the partitions of frequent values;
    where they are many, all go as one long table with one join and one aggregation by row.
    """
    group = group or []
    scores = settle(normal_scores(df, columns, group))
    sizes = {r["coord"]: r["count"] for r in scores.groupBy("coord").count().collect()}  # a row a column
    small, used = [], 0
    for k in sorted(range(len(columns)), key=lambda k: sizes.get(k, 0))[: 2 * _JOINS if len(columns) <= 3 * _JOINS else 0]:
        if used + sizes.get(k, 0) <= broadcast_rows:
            small.append(k)
            used += sizes.get(k, 0)
    large = [k for k in range(len(columns)) if k not in small]
    out = df
    for k in small:
        out = _scored(out, F.broadcast(scores.where(F.col("coord") == k)), columns[k], suffix, group)
    if len(large) <= _JOINS:
        for k in large:
            out = _scored(out, scores.where(F.col("coord") == k), columns[k], suffix, group)
    else:
        rows = settle(out.withColumn("row_", F.monotonically_increasing_id()))  # written, so that the numbers stay
        picked = scores.where(F.col("coord").isin(large))
        found = join_null_safe(_long(rows, columns, "row_", *group).where(F.col("coord").isin(large)), picked, ["coord", *group, "value"])
        back = found.groupBy("row_").agg(*(F.max(F.when(F.col("coord") == k, F.col("z_"))).alias(f"{columns[k]}{suffix}") for k in large))
        out = rows.join(back, "row_", "left")
    return out.select(*df.columns, *(f"{c}{suffix}" for c in columns))


def _scored(df: DataFrame, scores: DataFrame, column: str, suffix: str, group: list[str]) -> DataFrame:
    table = scores.select(*(F.col(g).alias(f"{g}_of_") for g in group), F.col("value").alias("v_"), F.col("z_").alias(f"{column}{suffix}"))
    met = F.col(column).cast("double") == F.col("v_")
    for g in group:
        met = met & F.col(g).eqNullSafe(F.col(f"{g}_of_"))
    return df.join(table, met, "left").drop("v_", *(f"{g}_of_" for g in group))


def ecdf_grid(df: DataFrame, column: str) -> DataFrame:
    """value, n, ecdf: the largest k / (n + 1) at each distinct value, k the place in sorted order."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("upto") / (F.col("total") + 1)).alias("ecdf"))  # one row


def tie_jitter(df: DataFrame, column: str, tie_break: list[str]) -> DataFrame:
    """Adds k * 1e-10 * (max |x| + 1) to the k-th value in order if any two are tied; else leaves all as they are."""
    rows = finite(df, column).select(F.col(column).cast("double").alias("x"), *tie_break)
    stats = rows.agg(F.max(F.abs("x")).alias("top"), (F.count("*") > F.countDistinct("x")).alias("tied"))
    placed = running_total(rows.withColumn("one_", F.lit(1)), ["x", *tie_break], "one_", "k")
    moved = F.col("x") + F.when(F.col("tied"), (F.col("k") - 1) * 1e-10 * (F.col("top") + 1)).otherwise(0.0)
    return placed.crossJoin(F.broadcast(stats)).select(*tie_break, "x", moved.alias("jittered"))  # one row


def asof_values(pool: DataFrame, queries: DataFrame, column: str, group: list[str] | None = None) -> DataFrame:
    """x, below: for each distinct finite value of the queries the number of pool values up to it.

    A running total over the distinct values of both sides, not a range join; a value that a third of the rows share is one row.
    """
    group = group or []
    a = finite(pool, column).select(*group, F.col(column).cast("double").alias("x"), F.lit(1).alias("w_"), F.lit(False).alias("q_"))
    b = finite(queries, column).select(*group, F.col(column).cast("double").alias("x"), F.lit(0).alias("w_"), F.lit(True).alias("q_"))
    counts = a.unionByName(b).groupBy(*group, "x").agg(F.sum("w_").alias("w_"), F.bool_or("q_").alias("q_"))
    return running_total(counts, ["x"], "w_", "below", group).where("q_").select(*group, "x", "below")


def asof_counts(pool: DataFrame, queries: DataFrame, column: str, id_column: str, group: list[str] | None = None) -> DataFrame:
    """id, x, below: for each query row the number of pool values up to its x, joined back by value: Spark splits the join's
    large partitions."""
    group = group or []
    b = finite(queries, column).select(*group, F.col(column).cast("double").alias("x"), F.col(id_column).cast("bigint").alias("id"))
    return b.join(asof_values(pool, queries, column, group), [*group, "x"]).select(*group, "id", "x", "below")


def asof_cdf(pool: DataFrame, queries: DataFrame, column: str, id_column: str, rule: str = "half") -> DataFrame:
    """id, x, cdf. rule half: (count + 1/2) / (n + 1); clip: count / (n + 1) within [1, n] / (n + 1)."""
    n = finite(pool, column).count()
    found = asof_counts(pool, queries, column, id_column)
    cdf = (F.col("below") + 0.5) / (n + 1) if rule == "half" else F.greatest(F.lit(1), F.least(F.lit(n), F.col("below"))) / (n + 1)
    return found.select("id", "x", cdf.cast("double").alias("cdf"))


def trimmed_mean(df: DataFrame, group: str, value: str, share: float = 0.05, least: int = 20) -> DataFrame:
    """group, n, trimmed: the mean without int(share * n) values at each end; NULL below `least` values."""
    rows = finite(df, value)
    counts = rows.groupBy(group, F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c"))
    upto = running_total(counts, ["x"], "c", "upto", [group])
    n = rows.groupBy(group).agg(F.count("*").alias("n"))
    cut = F.floor(F.col("n") * share)
    inside = F.greatest(F.lit(0), F.least(F.col("upto"), F.col("n") - cut) - F.greatest(F.col("upto") - F.col("c"), cut))
    sums = upto.join(n, group).groupBy(group, "n").agg((F.sum(F.col("x") * inside) / F.sum(inside)).alias("t"))
    return sums.select(group, "n", F.when(F.col("n") >= least, F.col("t")).alias("trimmed"))


def contiguous_blocks(df: DataFrame, order: list[str], blocks: int, name: str = "block") -> DataFrame:
    """Adds the number of the contiguous block of n // blocks rows; the last block takes the rest."""
    n = df.count()
    size = max(1, n // blocks)
    last = min(blocks, max(1, n // size)) - 1
    placed = running_total(df.withColumn("one_", F.lit(1)), order, "one_", "k_")
    return placed.withColumn(name, F.least(F.lit(last), F.floor((F.col("k_") - 1) / size)).cast("int")).drop("one_", "k_")


def not_sorted(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Per group: rows, drops (steps down in the given order) and spread: a check of sorted pools.

    Steps are taken inside range partitions; the edges between partitions are a row a group and partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(df.select(group, order, value).repartitionByRange(parts, group, order).withColumn("part_", F.spark_partition_id()))
    down = lambda w: F.coalesce((F.col(value) < F.lag(value).over(w)).cast("bigint"), F.lit(0))
    inside = ranged.withColumn("s_", down(Window.partitionBy("part_", group).orderBy(order)))
    ends = inside.groupBy(group, "part_").agg(
        F.count("*").alias("n"), F.sum("s_").alias("s_"), F.min(value).alias("lo_"), F.max(value).alias("hi_"), F.min_by(value, order).alias("first_"), F.max_by(value, order).alias("last_")
    )
    edge = F.coalesce((F.col("first_") < F.lag("last_").over(Window.partitionBy(group).orderBy("part_"))).cast("bigint"), F.lit(0))  # a row a partition
    sums = ends.withColumn("e_", edge).groupBy(group)
    return sums.agg(F.sum("n").alias("n"), F.sum(F.col("s_") + F.col("e_")).alias("drops"), (F.max("hi_") - F.min("lo_")).alias("spread"))


def quantiles(df: DataFrame, value: str, shares: dict[str, float], group: list[str]) -> DataFrame:
    """group and a column for each share: linearly interpolated quantiles, from counts of distinct values and a running total.

    No task sees all values of a group: the two order statistics of each quantile are picked by their places.
    """
    rows = finite(df, value)
    counts = rows.groupBy(*group, F.col(value).cast("double").alias("v_")).agg(F.count("*").alias("n_"))
    counts = settle(running_total(counts, ["v_"], "n_", "upto_", group))
    totals = counts.groupBy(*group).agg(F.sum("n_").alias("rows_"))
    placed = counts.join(totals, group) if group else counts.crossJoin(F.broadcast(totals))  # without groups one row
    made, parts = [], []
    for k, (name, share) in enumerate(shares.items()):
        at = (F.col("rows_") - 1) * F.lit(float(share))
        for end, place in (("a", F.floor(at)), ("b", F.ceil(at))):
            here = (F.col("upto_") - F.col("n_") <= place) & (place < F.col("upto_"))
            made.append(F.max(F.when(here, F.col("v_"))).alias(f"{end}{k}_"))
        parts.append((F.col(f"a{k}_") + (F.col(f"b{k}_") - F.col(f"a{k}_")) * (at - F.floor(at))).alias(name))
    return placed.groupBy(*group, "rows_").agg(*made).select(*group, *parts)


def cumulative_trapezoid(df: DataFrame, group: str, x: str, density: str) -> DataFrame:
    """Adds cdf: the running trapezoid integral of the density over x in each group's grid, scaled to end at 1."""
    order = Window.partitionBy(group).orderBy(x)
    area = F.coalesce((F.col(x) - F.lag(x).over(order)) * (F.col(density) + F.lag(density).over(order)) / 2, F.lit(0.0))
    df = df.withColumn("a_", area)
    total = F.sum("a_").over(Window.partitionBy(group))
    return df.withColumn("cdf", F.sum("a_").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total).drop("a_")


def cumulative_sum_cdf(df: DataFrame, group: str, x: str, density: str) -> DataFrame:
    """Adds cdf: the running sum of the density over the group's sum (a uniform grid's rectangles)."""
    order = Window.partitionBy(group).orderBy(x)
    return df.withColumn("cdf", F.sum(density).over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(density).over(Window.partitionBy(group)))


def hash_halves(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Adds fold 0 or 1 of sizes that differ by one at most: places in the order of a hash."""
    return hash_parts(df, key, [2], "fold", seed)


#: Leading digits of a hash whose counts come to the driver: 65,536 rows at most, and one for rows without a key.
_DIGITS = 4


def hash_parts(df: DataFrame, key: str, divisors: list[int], name: str, seed: int = 0) -> DataFrame:
    """Adds how many of the places n // divisor a row lies beyond, in the order of a hash of the key.

    The rows stay where they are: counts by the hashes' first digits tell which digits a place falls among, and the few rows
    there which hash it ends at. Only where a place falls among rows of one key are all rows put in order.
    """
    hashed = df.withColumn("h_", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")).cast("binary")))
    lead = F.coalesce(F.substring("h_", 1, _DIGITS), F.lit(""))  # rows without a key come first
    counts = sorted(tuple(r) for r in hashed.groupBy(lead.alias("lead_")).count().collect())
    n, among = sum(c for _, c in counts), {}
    places = [n // x for x in divisors]
    for p in filter(None, places):
        upto = 0
        for digits, c in counts:
            if upto < p <= upto + c:
                among[p] = (digits, upto)
                break
            upto += c
    near: dict[str, list[tuple[str | None, int]]] = {}
    if among:
        for digits, h, c in hashed.where(lead.isin(sorted({d for d, _ in among.values()}))).groupBy(lead.alias("lead_"), "h_").count().collect():
            near.setdefault(digits, []).append((h, c))
    beyond = []
    for p in places:
        if not p:
            beyond.append(F.lit(True))
            continue
        (digits, upto), last = among[p], None
        for last, c in sorted(near[digits], key=lambda x: x[0] or ""):
            upto += c
            if upto >= p:
                break
        if upto > p:  # among rows that the key doesn't tell apart
            placed = running_total(hashed.withColumn("one_", F.lit(1)), ["h_", key], "one_", "k_")
            return placed.withColumn(name, sum(((F.col("k_") > x).cast("int") for x in places), F.lit(0))).drop("h_", "one_", "k_")
        beyond.append(F.col("h_").isNotNull() if last is None else F.coalesce(F.col("h_") > last, F.lit(False)))
    return hashed.withColumn(name, sum((x.cast("int") for x in beyond), F.lit(0))).drop("h_")
