"""A corpus pipeline: language, repeated lines, near copies, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; `run` writes each
stage's rows as Parquet to the shared folder and reads them again as the next one's docs. All stages but the
last return the columns of `docs`, whatever their names: columns that a stage does not work on travel under
names of their own, so none is replaced by an output of its operator.

Defined cases, for every stage: an empty table gives an empty result with the same columns; a null doc_id or
source is kept as a value of its own; repeated rows and ties have the result that the stage states; long texts are
read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessaline.llm.language import identify_language
from tessaline.llm.line_dedup import line_dedup
from tessaline.llm.mixing import mix_sources
from tessaline.llm.ngram_join import ngram_jaccard_join
from tessaline.llm.packing import pack_documents
from tessaline.session import table, written


def sealed(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with all but the needed columns under names that no operator uses, and what gives the names back."""
    names = {c: c if c in needed else f"column{i}" for i, c in enumerate(docs.columns)}
    inside = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return inside, lambda out: out.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without any letter (null and empty ones too) and those that no language is likely for.

    Without a labelled row there is no model, and nothing is likely. Repeated rows stay or go together.
    """
    inside, names = sealed(docs, "doc_id", "text", "lang")
    out = identify_language(inside)
    return names(out.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)))


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; a document goes if nothing but repeated lines was in it.

    Null and empty texts stay. Of repeated rows the first keeps its lines. n_chars follows the text, if it is a column of integers.
    """
    inside, names = sealed(docs, "doc_id", "text")
    out = line_dedup(inside)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, IntegralType):
        count = f"column{docs.columns.index('n_chars')}"
        now = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn(count, F.when(F.col("n_removed") > 0, now).otherwise(F.col(f"`{count}`")))
    return names(out)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each class of near copies, and one of rows of equal doc_id and text.

    Documents without words are in no class and stay, as do rows without doc_id.
    """
    inside, names = sealed(docs, "doc_id", "text")
    classes = ngram_jaccard_join(inside.select("doc_id", "text"), n=5, percent=80).where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("copy")).distinct()
    kept = inside.join(classes, F.col("doc_id") == F.col("copy"), "left_anti")
    repeated = kept.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias("twice"))
    once = kept.join(repeated, F.col("doc_id") == F.col("twice"), "left_anti")
    return names(once.unionByName(kept.join(repeated, F.col("doc_id") == F.col("twice"), "left_semi").dropDuplicates(["doc_id", "text"])))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null and empty texts have no words, and come as often as their source's epochs."""
    inside, names = sealed(docs, "doc_id", "text", "source")
    out = mix_sources(inside).where("copies > 0")
    return names(out.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids (unsigned little-endian 32-bit) and places in training sequences; a null text is one piece of the end id."""
    return pack_documents(docs, keep_ids=True)


STAGES = [
    ("language ID", language_id),
    ("line dedup", fuzzy_lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", sequences),
]
#: No SQL: stages 1, 2 and 5 learn a model, hash lines and tokenise. tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k + 1}")
    return docs
