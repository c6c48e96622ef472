"""Mixing sources to target weights, by Efraimidis-Spirakis sampling. DataFrame operations only.

A source's target is its share, by weight, of `budget` times all words, at most `most` times its own
words; what is above goes to the others by weight until none is above. A document is first taken in
whole epochs, as often as its source's words fit in the target. The rest of the target is filled by
weighted sampling without replacement: each document has the exponential key -ln(u) / w, u uniform
from a hash of the document and w its quality weight; keys are sorted within the source, sizes are
prefix-summed in that order, and documents are taken while that brings the sum nearer to the target.

Scale: no sort ever holds a whole source. Keys fall in about sqrt(n) buckets of a source of n documents;
sums of buckets find the one in which the budget ends, and only that one's documents are sorted. The
outcome is one cut per source, a key, so a document needs to know only its source's cut; the cuts are
broadcast if there are at most `broadcast_sources`, and joined otherwise. Everything is a pure function of
the rows, so reruns agree.

Defined cases: a null or empty text has size 0 and is taken with 0 words; a null source is a source of
its own that sorts last; equal keys, which only rows of equal id, size and length have, are taken
together or not at all; a null id is hashed as an empty one; an empty table gives an empty result;
other columns are carried along, whatever their names, but columns named like an output are replaced;
a text of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline.session import written

WORDS = r"[^\x20\x09-\x0D]+"
OUTPUTS = ("size", "source_size", "target", "copies", "taken")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """The default weight, over 0 to 1: long enough, and of words of a usual length."""
    usual = F.length(text) <= 13 * size
    return F.greatest(size / (size + 50) * F.when(usual & (F.length(text) >= 3 * size), 1.0).otherwise(0.25), F.lit(1e-6))


def _key(doc_id: Column, text: Column, size: Column, weight: Column, seed: str) -> Column:
    what = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"), F.coalesce(F.length(text), F.lit(0)).cast("string"))
    uniform = (F.conv(F.substring(F.md5(what), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(uniform) / weight


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add `target` to rows (source, source_size, ...); weights repeat over the sources by code point, null last."""
    named = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(named) - 1) % len(weights)
    weight = F.lit(float(weights[0]))
    for i, w in enumerate(weights):
        weight = F.when(place == i, F.lit(float(w))).otherwise(weight)
    everything = Window.partitionBy()
    rows = sizes.withColumn("w", weight).withColumn("cap", most * F.col("source_size")).withColumn("all", budget * F.sum("source_size").over(everything))
    full_first = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(full_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("all") - before) / F.sum("w").over(full_first.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("full", F.col("cap") <= level * F.col("w"))
    spare = F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))
    share = spare / F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    return rows.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(share * F.col("w"))).drop("w", "cap", "all", "full")


def cuts(keyed: DataFrame, **shares) -> DataFrame:
    """source, source_size, target, epochs, cut of each source, from rows (source, size, key); a document's key up to cut is taken once more."""
    keyed = written(keyed.groupBy("source", "key").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "mix")
    sources = targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n")), **shares)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    sources = sources.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("buckets", F.ceil(F.sqrt("n")))
    sources = written(sources, "sources")
    of = sources.select(F.col("source").alias("s"), "rest", "buckets")
    dealt = keyed.join(of, F.col("source").eqNullSafe(F.col("s"))).withColumn("bucket", F.floor(F.col("buckets") * (F.col("key") / (F.col("key") + 1))))
    sums = dealt.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("size"), F.max("key").alias("last"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    whole = sums.where(F.col("before") + F.col("size") <= F.col("rest")).groupBy("source").agg(F.max("last").alias("cut"))
    end = sums.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest"))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", F.col("rest").alias("r"))
    inside = dealt.select("source", "bucket", "key", "size").join(end, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    by_key = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum("size").over(by_key), F.lit(0))
    some = inside.withColumn("at", at).where(F.col("at") + F.col("size") / 2 <= F.col("r")).groupBy("source").agg(F.max("key").alias("cut"))
    cut = whole.unionByName(some).groupBy("source").agg(F.max("cut").alias("cut")).withColumnRenamed("source", "s")
    return sources.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "epochs", "cut")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: str = "mix", broadcast_sources: int = 100_000, **shares) -> DataFrame:
    """The rows of `docs` with size, source_size, target, copies (how often the mix takes it) and taken (words in all copies)."""
    kept = [c for c in docs.columns if c.lower() not in OUTPUTS]
    text = F.col(text_col).cast("string")
    size = size_of(text)
    w = weight if weight is not None else quality_weight(F.coalesce(text, F.lit("")), size)
    # a name that no column begins with, so that none is overwritten
    own = next(n for n in (f"mix{i}" for i in range(len(kept) + 1)) if not any(c.lower().startswith(n) for c in kept))
    made = F.struct(size.alias("size"), _key(F.col(id_col), text, size, w, seed).alias("key"), F.col(source_col).cast("string").alias("source"))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], made.alias(own))
    found = cuts(rows.select(f"{own}.source", f"{own}.size", f"{own}.key"), **shares)
    found = written(found, "cuts").select(F.struct("source", "source_size", "target", "epochs", "cut").alias(f"{own}_source"))
    if found.count() <= broadcast_sources:
        found = F.broadcast(found)
    mine, of = F.col(own), F.col(f"{own}_source")
    copies = (of["epochs"] + F.coalesce((mine["key"] <= of["cut"]).cast("int"), F.lit(0))).cast("int")
    joined = rows.join(found, mine["source"].eqNullSafe(of["source"]))
    return joined.select(
        *[F.col(f"`{c}`") for c in kept], mine["size"].alias("size"), of["source_size"].alias("source_size"), of["target"].alias("target"), copies.alias("copies"), (copies * mine["size"]).cast("long").alias("taken")
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, length(coalesce(text, '')) AS chars FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR || ':' || chars::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
    / greatest(size / (size + 50) * CASE WHEN chars <= 13 * size AND chars >= 3 * size THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END, 1e-6::DOUBLE) AS key FROM sized),
sources AS (
  SELECT source, sum(size)::DOUBLE AS source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w FROM keyed GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM sources),
filled AS (SELECT *, 2 * source_size <= level * w AS full_ FROM levels),
aimed AS (
  SELECT source, source_size, CASE WHEN full_ THEN 2 * source_size ELSE
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) FILTER (WHERE full_) OVER (), 0)) / sum(w) FILTER (WHERE NOT full_) OVER () * w END AS target FROM filled),
split AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM aimed),
grouped AS (SELECT source, key, sum(size) AS size FROM keyed GROUP BY source, key),
placed AS (SELECT source, key, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM grouped),
cut AS (
  SELECT p.source, max(p.key) AS cut FROM placed p JOIN split s ON p.source IS NOT DISTINCT FROM s.source
  WHERE p.at + p.size / 2 <= s.target - s.epochs * s.source_size GROUP BY p.source)
SELECT k.doc_id, k.source, k.size, s.source_size::BIGINT AS source_size, s.target,
  (s.epochs + CASE WHEN k.key <= c.cut THEN 1 ELSE 0 END)::INTEGER AS copies,
  ((s.epochs + CASE WHEN k.key <= c.cut THEN 1 ELSE 0 END) * k.size)::BIGINT AS taken
FROM keyed k JOIN split s ON k.source IS NOT DISTINCT FROM s.source LEFT JOIN cut c ON k.source IS NOT DISTINCT FROM c.source
"""
