"""Statistics of searches, latencies and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(rows: DataFrame, by: str, value: str, order: str, last: int = 1000, levels: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Percentiles by index, sorted[n * p / 100], of the last rows of each group."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    recent = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= last)
    s = recent.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias("s"))
    at = lambda p: F.get("s", F.least(F.size("s") - 1, F.floor(F.size("s") * p / 100).cast("int")))
    return s.select(by, *[at(p).alias(f"p{p}") for p in levels])


def growth(series: DataFrame, time: str, value: str) -> DataFrame:
    """Change and change in percent against the point before. The series is already one row a point."""
    before = F.lag(value).over(Window.orderBy(time))
    return series.select(time, value, (F.col(value) - before).alias("change"), F.round(F.when(before != 0, 100 * (F.col(value) - before) / before), 6).alias("percent"))


def latency_classes(ms: Column) -> Column:
    return F.when(ms < 100, "fast").when(ms < 1000, "medium").otherwise("slow")


def search_log(rows: DataFrame, kind: str, ms: str, time: str) -> DataFrame:
    """By kind: searches, share of all in percent, latency classes, mean."""
    g = rows.groupBy(kind).agg(F.count("*").alias("searches"), *[F.count(F.when(latency_classes(F.col(ms)) == c, 1)).alias(c) for c in ("fast", "medium", "slow")], F.round(F.avg(ms), 6).alias("avg_ms"), F.count_distinct(F.hour(time)).alias("hours"))
    return g.withColumn("share", F.round(100 * F.col("searches") / F.sum("searches").over(Window.partitionBy()), 6))


def cooccurrence(rows: DataFrame, by: str, order: list[str], item: str, reach: int = 4) -> DataFrame:
    """Pairs of items at most `reach` rows apart in their group, with counts."""
    w = Window.partitionBy(by).orderBy(*order)
    near = rows.select(F.col(item).alias("a"), F.array(*[F.lead(item, i).over(w) for i in range(1, reach + 1)]).alias("near"))
    ahead = near.select("a", F.explode("near").alias("b"))
    return ahead.where("b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").count().withColumnRenamed("count", "n")


def sequences(rows: DataFrame, by: str, order: list[str], item: str) -> DataFrame:
    """Distinct runs of three items."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.select(F.lag(item, 2).over(w).alias("x"), F.lag(item, 1).over(w).alias("y"), F.col(item).alias("z")).where("x is not null").distinct()


def anomalies(rows: DataFrame, by: str, value: str, z: float = 2.0) -> DataFrame:
    """Rows beyond z standard deviations of their group. Groups are aggregated, and meet their rows by a join; no group is sorted."""
    stats = rows.groupBy(F.col(by).alias("__by")).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd"))
    joined = rows.join(stats, F.col(by).eqNullSafe(F.col("__by")))
    return joined.withColumn("z", F.round((F.col(value) - F.col("__mean")) / F.nullif("__sd", F.lit(0.0)), 6)).where(F.abs("z") > z).drop("__by", "__mean", "__sd")


def sessions(rows: DataFrame, by: str, time: str, gap: str) -> DataFrame:
    return rows.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def histogram(rows: DataFrame, value: str, width: float) -> DataFrame:
    """low, n: how many values fall in each bin of that width."""
    return rows.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).cast("double").alias("low")).agg(F.count("*").alias("n"))


def summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """By group: rows, mean, sd, least, median and greatest value."""
    v = F.col(value)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("sd"), F.min(v).alias("low"), F.round(F.median(v), 6).alias("median"), F.max(v).alias("high"))


def rolling(rows: DataFrame, by: str, order: str, value: str, last: int = 1000) -> DataFrame:
    """Mean, greatest value and running mean of the last rows up to each one, within its group."""
    frame = Window.partitionBy(by).orderBy(order)
    some = frame.rowsBetween(1 - last, 0)
    return rows.select(by, order, F.round(F.avg(value).over(some), 6).alias("mean"), F.max(value).over(some).alias("high"), F.round(F.avg(value).over(frame.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("running"))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0)


def outliers_iqr(rows: DataFrame, by: str, value: str, reach: float = 1.5) -> DataFrame:
    """Rows further than `reach` interquartile ranges outside of their group's quartiles, which are interpolated."""
    q = rows.groupBy(F.col(by).alias("__by")).agg(F.percentile(value, F.lit(0.25)).alias("__q1"), F.percentile(value, F.lit(0.75)).alias("__q3"))
    joined = rows.join(q, F.col(by).eqNullSafe(F.col("__by")))
    far = reach * (F.col("__q3") - F.col("__q1"))
    return joined.where((F.col(value) < F.col("__q1") - far) | (F.col(value) > F.col("__q3") + far)).drop("__by", "__q1", "__q3")


def off_moving_average(rows: DataFrame, by: str, order: list[str], value: str, window: int = 10, factor: float = 2.0) -> DataFrame:
    """Rows whose value is over `factor` times the mean of the `window` rows before; the mean is compared as it is, and returned rounded."""
    before = F.avg(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(-window, -1))
    return rows.withColumn("before", before).where(F.col(value) > factor * F.col("before")).withColumn("before", F.round("before", 6))


def followed_by(rows: DataFrame, by: str, time: str, order: list[str], kind: str, pattern: list[str], within: str) -> DataFrame:
    """by, start, end of each run of consecutive rows of a group whose kinds are the pattern, from first to last no longer than `within`."""
    w = Window.partitionBy(by).orderBy(*order)
    steps = [F.lead(kind, i).over(w) == p for i, p in enumerate(pattern)] if pattern else []
    hit = steps[0]
    for s in steps[1:]:
        hit = hit & s
    ends = rows.select(by, F.col(time).alias("start"), F.lead(time, len(pattern) - 1).over(w).alias("end"), hit.alias("hit"))
    return ends.where(F.col("hit") & (F.col("end") <= F.col("start") + F.expr(f"interval {within}"))).select(by, "start", "end")


#: How urgent kinds of events are.
PRIORITIES = {"error": 100, "purchase": 80, "signup": 60, "click": 40}


def priority(kind: Column, priorities: dict[str, int] | None = None, other: int = 20) -> Column:
    out = F.lit(other)
    for name, n in (priorities or PRIORITIES).items():
        out = F.when(kind == name, n).otherwise(out)
    return out


def facts_of_events(events: DataFrame, subject: str, kind: str, time: str, hours: dict[str, int], other: int = 1) -> DataFrame:
    """subject, predicate, valid_from, valid_to: what each event says, and how long it holds. No state: expiry is a range filter."""
    valid = F.lit(other)
    for name, n in hours.items():
        valid = F.when(F.col(kind) == name, n).otherwise(valid)
    return events.select(F.col(subject).alias("subject"), F.col(kind).alias("predicate"), F.col(time).alias("valid_from"), (F.col(time) + F.make_dt_interval(hours=valid)).alias("valid_to"))


def overall(*scores: Column) -> Column:
    """The mean of scores, in percent."""
    return 100 * sum(scores[1:], scores[0]) / len(scores)
