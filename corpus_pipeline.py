"""The corpus pipeline: quality, near copies, repeated passages, personal data, packing.

Each stage reads what the one before it wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.llm.jaccard import jaccard_join
from fieldbook.llm.packing import pack_documents
from fieldbook.llm.pii import mask_pii
from fieldbook.llm.quality import learn, score
from fieldbook.llm.queries import vocabulary
from fieldbook.llm.substring import substring_dedup
from fieldbook.session import checkpoint_folder, table


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (a score under 0.3) go.

    Null and empty texts are scored like any other, equal texts alike; repeated rows and null ids stay or go one by one; columns may
    have any names; very long texts are scored whole. An empty table gives an empty result.
    """
    name = unused(docs, "_score")
    trees = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, trees, into=name).where(F.col(name) >= 0.3).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id; documents without words or id stay.

    Rows that share an id are one document and stay or go together; null and empty texts have no words; very long texts are compared whole;
    columns may have any names; an empty table gives an empty result.
    """
    groups = jaccard_join(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut; texts without any stay as they are.

    Null and empty texts stay so; a row with a null id is left whole; repeated rows, and rows that share an id, cut nothing from each other; very long
    texts are cut whole; columns may have any names; an empty table gives an empty result.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    cut = substring_dedup(docs, keep=rest, whole=True)
    places = {c: f"c{i}" for i, c in enumerate(rest)} | {"text": "kept", "n_chars": "length"}
    cut = cut.toDF(*(places[c] for c in rest), "n_words", "n_removed", "kept").withColumn("length", F.length("kept").cast("bigint"))
    return cut.select(*(F.col(places[c]).alias(c) for c in docs.columns))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become the name of their kind in brackets. Null texts stay null; repeated rows are masked alike; very long texts are masked whole; columns may have any names; an empty table gives an empty result."""
    return mask_pii(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; null texts are a closing token alone, repeated rows are packed once each, very long texts are cut into pieces of 4096 tokens, other columns go; an empty table gives an empty result."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("near_copies", keep_one_of_each), ("repeats", cut_repeats), ("personal_data", mask), ("packing", pack)]
#: SQL can express neither the trees nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
