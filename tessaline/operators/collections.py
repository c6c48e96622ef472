"""Collections as tables: create, upsert, update, delete, scroll, count. Every change is a set operation that returns a new DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Collection:
    name: str
    rows: DataFrame
    dim: int | None = None
    metric: str = "cosine"
    id_col: str = "id"
    vector_col: str = "embedding"

    def with_rows(self, rows: DataFrame) -> Collection:
        return Collection(self.name, rows, self.dim, self.metric, self.id_col, self.vector_col)

    def upsert(self, new: DataFrame, order: Column | None = None) -> Collection:
        """Last writer wins: rows of `new` replace rows of their id; of several new rows of one id, the last by `order` stays."""
        if self.dim is not None:
            ok = F.col(self.vector_col).isNull() | (F.size(self.vector_col) == self.dim)
            new = new.withColumn(self.vector_col, F.when(ok, F.col(self.vector_col)).otherwise(F.raise_error(F.lit("dimension mismatch"))))
        w = Window.partitionBy(self.id_col).orderBy((order if order is not None else F.lit(0)).desc())
        last = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
        return self.with_rows(self.rows.join(last.select(self.id_col), self.id_col, "left_anti").unionByName(last, allowMissingColumns=True))

    def update(self, changes: DataFrame, strict: bool = False) -> Collection:
        """Only fields that `changes` supplies change; an unknown id is ignored, or an error if strict."""
        if strict and not changes.join(self.rows, self.id_col, "left_anti").isEmpty():
            raise KeyError("unknown id")
        c = changes.select(F.col(self.id_col), *[F.col(x).alias(f"__{x}") for x in changes.columns if x != self.id_col])
        joined = self.rows.join(c, self.id_col, "left")
        return self.with_rows(joined.select(*[F.coalesce(f"__{x}", x).alias(x) if f"__{x}" in c.columns else F.col(x) for x in self.rows.columns]))

    def delete(self, ids: DataFrame) -> Collection:
        return self.with_rows(self.rows.join(ids.select(self.id_col), self.id_col, "left_anti"))

    def scroll(self, limit: int = 10, after: int | None = None, condition: Column | None = None) -> DataFrame:
        """A page in order of id, from behind `after`; the last row's id continues it."""
        rows = self.rows.where(condition) if condition is not None else self.rows
        rows = rows.where(F.col(self.id_col) > after) if after is not None else rows
        return rows.orderBy(self.id_col).limit(limit)

    def get(self, key) -> DataFrame:
        return self.rows.where(F.col(self.id_col) == key)


def listing(rows: DataFrame, name_col: str, vector_col: str) -> DataFrame:
    return rows.groupBy(F.col(name_col).alias("collection")).agg(F.count("*").alias("points"), F.count(vector_col).alias("vectors"))


def visible(rows: DataFrame, allowed: list[str], name_col: str) -> DataFrame:
    """Rows of collections that a role may read."""
    return rows.where(F.col(name_col).isin(allowed))


def as_of(versions: DataFrame, key: str, at: Column, created: str = "created", deleted: str = "deleted") -> DataFrame:
    """The version of each key that is visible at a time: the last one created by then and not deleted by then."""
    seen = versions.where((F.col(created) <= at) & (F.col(deleted).isNull() | (F.col(deleted) > at)))
    w = Window.partitionBy(key).orderBy(F.col(created).desc())
    return seen.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def changed(new: DataFrame, old: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Rows of `new` that `old` lacks or holds with other content: what an idempotent ingest has to do."""
    return new.join(old.select(key, *content), [key, *content], "left_anti")


def projected(rows: DataFrame, payload: list[str], id_col: str = "id", vector_col: str = "embedding", with_payload: bool = True, with_vector: bool = False, include: list[str] | None = None, parts: dict[str, list[str]] | None = None) -> DataFrame:
    """The columns a caller asked for: ids, and payload and vector by flags, or the named parts of `include`."""
    if include is not None:
        known = parts or {"documents": ["document"], "metadatas": payload, "distances": ["distance"], "embeddings": [vector_col]}
        unknown = set(include) - set(known)
        if unknown:
            raise ValueError(f"unknown parts {sorted(unknown)}")
        columns = [c for part in include for c in known[part]]
    else:
        columns = [*(payload if with_payload else []), *([vector_col] if with_vector else [])]
    return rows.select(id_col, *columns)


def set_payload(rows: DataFrame, ids: DataFrame, values: dict[str, Column], id_col: str = "id") -> DataFrame:
    """Rows of `ids` get the given values, null ones too; other columns and rows stay."""
    named = ids.select(F.col(id_col).alias("__named")).distinct()
    joined = rows.join(named, F.col(id_col) == F.col("__named"), "left")
    return joined.select(*[F.when(F.col("__named").isNotNull(), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def batch_upsert(collection: Collection, operations: DataFrame, order: str = "operation") -> tuple[Collection, DataFrame]:
    """Applies upserts in their order; operations of a wrong dimension or without id are left out. Returns the collection and (operation, status)."""
    size = F.size(collection.vector_col)
    wrong = F.col(collection.vector_col).isNotNull() & (size != collection.dim) if collection.dim is not None else F.lit(False)
    status = F.when(F.col(collection.id_col).isNull(), "no id").when(wrong, "wrong dimension").otherwise("completed")
    judged = operations.withColumn("status", status)
    good = judged.where("status = 'completed'")
    return collection.with_rows(collection.upsert(good.drop("status"), F.col(order)).rows.drop(order)), judged.select(order, "status")


def similarity_within(rows: DataFrame, by: str, id_col: str = "vec_id", vector_col: str = "embedding", least: int = 10, most: int = 100) -> DataFrame:
    """by, n, sparsity and similarity: the mean clamped cosine over all pairs of a group's first n / 10 rows by id, at least 10 and at most 100 of them."""
    from tessaline.functions import vectors as V

    w = Window.partitionBy(by)
    v = V.vec(vector_col)
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(V.sparsity(v, 0.05)), 6).alias("sparsity"))
    first = rows.withColumn("place", F.row_number().over(w.orderBy(id_col))).join(sizes, by)
    first = first.where(F.col("place") <= F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.col("n") / 10)))).select(by, "place", v.alias("v"))
    two = first.select(F.col(by).alias("other"), F.col("place").alias("place2"), F.col("v").alias("w"))
    met = first.join(two, (F.col(by) == F.col("other")) & (F.col("place") < F.col("place2")))
    met = met.groupBy(by).agg(F.round(F.avg(V.clamped_cosine(F.col("v"), F.col("w"))), 6).alias("similarity"))
    return sizes.join(met, by, "left").select(by, "n", "sparsity", "similarity")
