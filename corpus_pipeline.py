"""A corpus pipeline of five stages over ``documents``, each written as Parquet and read again by the next.

quality rules -> line dedup -> n-gram Jaccard join -> PII masking -> packing.  All stages but the last return the
columns of documents, with n_chars as of the new text.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roomweave.llm import line_dedup, ngram_join, packing, pii, quality
from roomweave.llm.storage import checkpointed, set_checkpoint_dir


def _with_text(columns: list[str], text) -> list:
    return [text.alias("text") if c == "text" else F.char_length(text).cast("long").alias("n_chars") if c == "n_chars" else F.col(f"row.{c}").alias(c) for c in columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: also null, empty and short texts. Equal rows are judged alike and all stay or go."""
    return quality.judge(docs).where("kept").select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller document holds too are dropped; documents that had text and lose all of it go."""
    made = line_dedup.dedup_lines(docs)
    return made.where((F.btrim("kept", F.lit(line_dedup.SPACE)) != "") | (F.col("n_dropped") == 0)).select(*_with_text(docs.columns, F.col("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with linked sets of five-word shingles, one row of the smallest id stays.

    Rows without an id link with nothing and stay. An id with different texts can be the smallest of several groups and
    then has a row in each; of several rows of this id in a group, that of smallest set_id and then of smallest text stays.
    """
    n = 5
    groups = checkpointed(ngram_join.join_ngrams(docs, n=n, percent=80).where("doc_id IS NOT NULL"))
    ids = groups.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.max("component_id").alias("component_id"))
    single = docs.join(ids.where("n_rows = 1 AND doc_id = component_id").select("doc_id"), "doc_id", "left_semi")
    several = ngram_join.with_set_ids(docs.join(ids.where("n_rows > 1").select("doc_id"), "doc_id", "left_semi"), n)
    least = groups.where("doc_id = component_id").groupBy("doc_id", "group_id").agg(F.min("set_id").alias("least")).select(F.col("doc_id").alias("id"), "least")
    one = W.partitionBy("row.doc_id", "set_id").orderBy(F.col("row.text"), F.to_json("row"))
    chosen = several.join(least, F.expr("row.doc_id = id AND set_id <=> least"), "left_semi").withColumn("rank", F.row_number().over(one)).where("rank = 1").select("row.*")
    return docs.where("doc_id IS NULL").unionByName(single.select(*docs.columns)).unionByName(chosen.select(*docs.columns))


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind; a null text becomes an empty one, equal rows all stay."""
    found = pii.with_masked(pii.find_spans(docs))
    return found.select(*_with_text(docs.columns, F.col("masked")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens. A null or empty text is the end token alone; each of equal rows is packed."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup_stage), ("n-gram Jaccard join", near_duplicates), ("PII", pii_masking), ("packing", packing_stage)]

#: Tokenisation, similarity joins and estimation are beyond SQL. tests/llm/test_pipeline.py compares stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, from the table of documents; what is between them goes to a new folder within that of checkpoints.

    All stages but the last are computed at once; the result is lazy and reads what the last but one has written.
    """
    set_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    docs, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{folder}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{own}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
