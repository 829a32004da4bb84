"""From raw documents to token files: quality, near duplicates, benchmark passages, source mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

Near-duplicate removal names rows by a stored number, so rows that repeat a doc_id or have none are each judged by their own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.llm import decontaminate, mixture, near_duplicates, quality, token_files
from tapeflow.llm.common import flagged, stored, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores at its threshold or above."""
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, "score__").where(F.col("score__") >= quality.THRESHOLD).drop("score__")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest id. Texts without words are their own class, so their rows all stay."""
    rows = stored(docs.withColumn("row__", F.monotonically_increasing_id()), "rows")  # stored, so that every pass sees the same numbers
    found = stored(near_duplicates.joined(rows.select(F.col("row__").alias("doc_id"), "text")).select(F.col("doc_id").alias("row__"), "class_id"), "classes")
    shared = found.where("row__ <> class_id").select("class_id").distinct()
    members = stored(rows.select("row__", "doc_id").join(found.join(shared, "class_id"), "row__"), "members")
    kept = members.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row__")).alias("first")).select(F.col("first.row__").alias("row__"))
    extra = stored(members.join(kept, "row__", "left_anti").select("row__"), "extra")
    # Few texts are moved: those that a bitmap of the extra rows lets through.
    marked = flagged(rows, extra, "row__")
    some = marked.where("maybe__").join(extra, "row__", "left_anti")
    return marked.where("not maybe__").select(*docs.columns).unionByName(some.select(*docs.columns))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Texts are told apart by a 64-bit fingerprint."""
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    found = decontaminate.contaminated(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = stored(found.where("contaminated").select(F.col("doc_id").alias("text__")).distinct(), "contaminated")
    marked = flagged(docs.withColumn("text__", key), hit, "text__")
    some = marked.where("maybe__").join(hit, "text__", "left_anti")
    return marked.where("not maybe__").select(*docs.columns).unionByName(some.select(*docs.columns))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The share of each source that the target weights ask for; one epoch, so no document comes twice."""
    taken = mixture.mixed(docs, mixture.Plan(max_epochs=1), prefix="mix__")
    return taken.where("mix__copies > 0").select(*docs.columns)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Grammar-compressed shards in the shared folder; returns their index of documents."""
    return token_files.encoded(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("source mixture", mixed_sources),
    ("token files", token_shards),
]

#: The classifier and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
