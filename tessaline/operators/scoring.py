"""Scores, ranks and fusion of result lists (query_id, id, distance, and metadata)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline.session import written

#: Fixed values of the scoring model.
SIGMOID_WEIGHT, METADATA_WEIGHT = 0.8, 0.2
DISTANCE_PART, CONFIDENCE_PART, METADATA_PART = 0.6, 0.3, 0.1
NOW = 1640995200
DAY = 86400


def recency(modified: Column, now: int = NOW) -> Column:
    days = F.floor((F.lit(now) - modified) / DAY)
    return F.when(days < 30, 1.0).when(days < 365, 0.8).otherwise(0.6)


def size_confidence(size: Column) -> Column:
    return F.when(size > 1_000_000, 0.9).when(size > 100_000, 0.8).otherwise(0.7)


def type_confidence(kind: Column) -> Column:
    return F.when(kind == "float32", 1.0).when(kind == "float16", 0.9).when(kind.isin("int8", "int16"), 0.8).otherwise(0.7)


def metadata_confidence(modified: Column, size: Column, kind: Column, now: int = NOW) -> Column:
    return (recency(modified, now) + size_confidence(size) + type_confidence(kind)) / 3


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def scored(results: DataFrame, metadata: Column, method: str = "hybrid", invert_confidence: bool = False) -> DataFrame:
    """Add confidence, score, rank and normalized to (query_id, id, distance) rows."""
    w = Window.partitionBy("query_id")
    mean, sigma = F.avg("distance").over(w), F.stddev_pop("distance").over(w)
    z = (F.col("distance") - mean) / sigma * (-1 if invert_confidence else 1)
    sure = F.when(sigma > 0, 1 / (1 + F.exp(-z))).otherwise(0.5)
    r = results.withColumn("__m", metadata).withColumn("confidence", clamp(SIGMOID_WEIGHT * sure + METADATA_WEIGHT * F.col("__m")))
    near = 1 / (1 + F.col("distance"))
    score = {"distance": near, "confidence": F.col("confidence"), "hybrid": clamp(DISTANCE_PART * near + CONFIDENCE_PART * F.col("confidence") + METADATA_PART * F.col("__m"))}[method]
    r = r.withColumn("score", F.round(score, 6)).withColumn("confidence", F.round("confidence", 6)).drop("__m")
    return normalized(ranked(r))


def ranked(r: DataFrame) -> DataFrame:
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")))


def normalized(r: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return r.withColumn("normalized", F.round(F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0), 6))


def quality_flags(confidence: Column, distance: Column, modified: Column, size: Column, now: int = NOW) -> Column:
    bits = [confidence > 0.8, distance < 0.1, (F.lit(now) - modified) < 7 * DAY, size > 1_000_000, distance > 2.0]
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))


def quality(r: DataFrame) -> DataFrame:
    """Per query: means and spread of distance, confident share, diversity and coverage."""
    d = F.col("distance")
    return r.groupBy("query_id").agg(
        F.round(F.avg(d), 6).alias("avg_distance"), F.round(F.stddev_pop(d), 6).alias("sd_distance"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.count(F.when(F.col("confidence") > 0.8, 1)).alias("confident"),
        F.round(F.stddev_pop(d) / (F.avg(d) + 1e-10), 6).alias("diversity"), F.round(F.when(F.max(d) > 0, (F.max(d) - F.min(d)) / F.max(d)).otherwise(0.0), 6).alias("coverage"),
    )


def ranked_overall(rows: DataFrame, *order: Column, alone: int = 1_000_000) -> DataFrame:
    """Add `rank` over all rows. Up to `alone` of them are sorted in one task; more are sorted by ranges, and each range starts behind the rows of those before it."""
    rows = written(rows, "unranked")
    if rows.count() <= alone:
        return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    sorted_ = written(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    ranges = sorted_.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # one row a range
    ranges = ranges.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    return sorted_.join(F.broadcast(ranges), part == F.col("__part")).withColumn("rank", (F.col("__before") + place + 1).cast("int")).drop("__at", "__part", "__before")


def fuse(lists: DataFrame, method: str = "rrf", c: int = 60, weights: dict | None = None) -> DataFrame:
    """id, score, rank from rows (list, id, rank, and score for the last two methods): rrf, borda, weighted_sum (weights by list, which sum to 1) or max_score."""
    if method == "borda":
        sizes = lists.groupBy("list").agg(F.count("*").alias("__n"))
        points = F.sum((F.col("__n") - F.col("rank") + 1).cast("double"))
        lists = lists.join(sizes, "list")
    elif method == "rrf":
        points = F.sum((1 / (c + F.col("rank"))).cast("double"))
    elif method == "weighted_sum":
        if not weights or abs(sum(weights.values()) - 1) > 1e-9:
            raise ValueError("weights must sum to 1")
        weight = F.coalesce(*[F.when(F.col("list") == k, F.lit(float(w))) for k, w in weights.items()], F.lit(0.0))
        points = F.sum(weight * F.col("score"))
    elif method == "max_score":
        points = F.max("score")
    else:
        raise ValueError(f"unknown method {method}")
    out = lists.groupBy("id").agg(F.round(points, 6).alias("score"))
    return ranked_overall(out, F.col("score").desc(), F.col("id"))


def diverse(r: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy, in order of rank: drop a row whose relative distance to any kept one is under 1 - threshold. Lists are short (k rows)."""
    near = lambda a, b: F.abs(a - b) / (a + b + 1e-10) < 1 - threshold
    rows = F.array_sort(F.collect_list(F.struct("rank", "id", "distance")))
    keep = F.aggregate(rows, F.filter(rows, lambda x: F.lit(False)), lambda kept, x: F.when(F.exists(kept, lambda y: near(x["distance"], y["distance"])), kept).otherwise(F.concat(kept, F.array(x))))
    return r.groupBy("query_id").agg(keep.alias("k")).select("query_id", F.explode("k").alias("x")).select("query_id", "x.id", "x.rank", "x.distance")
