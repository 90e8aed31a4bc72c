"""A corpus pipeline of four stages over documents: quality, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage that
fits a model fits it on the documents it is given, and deletes what stages before it have saved, unless its docs read that. run() writes each stage's rows to the shared folder and reads them as the next one's.
"""

from __future__ import annotations

from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import jaccard, language, quality, queries
from tidelog.llm.shared import drop_unread, save, save_result, saved_paths

#: Share of a text's most likely language below which the text is no document of any language.
MIN_LANGUAGE_SHARE = 0.3
#: Gain over equal trigram probabilities that a text in learned languages exceeds.
MIN_LANGUAGE_GAIN = 0.0
#: Columns of a stage's own: a row's key, and a row's columns.
KEY = "_row_key"
ROW = "_row"


#: Tables that stages have saved and that their results may read.
_LEFT: list[str] = []


def _stage(make):
    """A stage that first deletes what earlier stages saved, unless its docs read it: write a stage's result before the next stage is called."""

    @wraps(make)
    def run(spark, docs, sf_dir):
        drop_unread(spark, _LEFT, docs)
        before = set(saved_paths())
        out = make(spark, docs, sf_dir)
        _LEFT[:] = [p for p in saved_paths() if p in _LEFT or p not in before]
        return out

    return run


def _with_keys(docs: DataFrame) -> DataFrame:
    """docs with a key for each row: its doc_id, if no other row has that; else a 64-bit hash of all its columns, so that only equal
    rows share a key (collisions are not checked). The doc_ids that several rows have are saved once."""
    repeated = save(docs.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").select(F.col("doc_id").alias("_repeated")), "repeated")
    whole = F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))
    key = F.when(F.col("doc_id").isNull() | F.col("_repeated").isNotNull(), whole).otherwise(F.col("doc_id"))
    return docs.join(repeated, docs["doc_id"] == repeated["_repeated"], "left").select(*docs.columns, key.alias(KEY))


def _keep(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of keyed whose key is in keys (a column id)."""
    return keyed.join(keys.select(F.col("id").alias(KEY)).distinct(), KEY, "left_semi")


def _with_rows(docs: DataFrame) -> DataFrame:
    """docs with a struct of each row's columns, which an operator hands through: its verdicts hold for rows, whatever their ids."""
    return docs.select("*", F.struct(*docs.columns).alias(ROW))


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, their own and their host's. Rows with a null text go; rows with a null id or host are judged like others."""
    return quality.judge(_with_rows(docs), carry=ROW).where("kept").select(f"{ROW}.*")


@_stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows. Rows with a null or empty text go; without labelled rows nothing is known and all go."""
    found = language.identify(_with_rows(docs), language.fit(docs), carry=ROW)
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SHARE) & (F.col("gain") > MIN_LANGUAGE_GAIN)
    return found.where(known).select(f"{ROW}.*")


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, similarity 0.8), that with the smallest id, those without an id last;
    rows without words are no copies unless all their columns are equal."""
    keyed = _with_keys(docs)
    own = F.col(KEY).eqNullSafe(F.col("doc_id"))
    found = jaccard.jaccard_components(keyed, id_col=KEY)
    named = found.join(keyed.select(F.col(KEY).alias("id"), "doc_id").distinct(), "id")
    best = named.groupBy("component_id").agg(F.min_by("id", F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("id"))
    kept = _keep(keyed, best)
    # equal rows share a key
    return kept.where(own).unionByName(kept.where(~own).dropDuplicates([KEY])).select(docs.columns)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens, each row's own; null texts are a separator alone."""
    return queries.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: SQL cannot express the mixture model or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save_result(partial(stage, spark, docs, sf_dir), spark, f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
