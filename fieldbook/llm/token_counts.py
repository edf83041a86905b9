"""Token counts from a cache of digests: only content that was never counted is encoded.

A row's key is the SHA-256 of its normalised text together with the tokenizer's version. Where the tokenizer drops white space, each sign of it
counts as a blank and none at the ends, so equal keys have equal counts; for other tokenizers the text stays as it is. Keys join the
stored counts; distinct misses alone are encoded, and their counts are appended to the store before the final join. Digests alone
are shuffled for that join; texts are shuffled once, the distinct ones of each map task, to find the distinct misses. A digest that very
many rows share meets its count by a broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.llm import wordpieces
from fieldbook.llm.common import utf8
from fieldbook.operators.skew import hot_keys, spread_join
from fieldbook.session import checkpoint_folder, ship, written

STORE_SCHEMA = "digest binary, version string, n_tokens bigint"


def digest(text: str, blanks: bool):
    """Key of a text column's normalised content; blanks: white space only parts words."""
    own = F.coalesce(F.col(text), F.lit(""))
    return F.unhex(F.sha2(F.encode(F.trim(F.translate(own, "\t\n\x0b\x0c\r", " " * 5)) if blanks else own, "UTF-8"), 256))


def _encode(path: str):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = wordpieces.counts(path)
        for batch in source:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(count, utf8(batch.column(1))), pa.int64())], ["digest", "n_tokens"])

    return run


def stored(spark: SparkSession, store: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; an append that ran twice does no harm."""
    return spark.read.schema(STORE_SCHEMA).parquet(store).where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, store: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; over_limit: more than `limit` tokens.

    store: a folder that all executors reach, which may hold counts of earlier runs (none: a new one under the
    checkpoint folder). A run that finds all its digests there reads no text again. Null texts count as empty: 0 bytes, 0 tokens.
    Repeated rows and null ids are kept; an empty table gives an empty result; other columns don't matter; long texts are encoded whole.
    tokenizer: a .json file of the tokenizers library, or a .model file of SentencePiece.
    """
    spark = docs.sparkSession
    ship(spark)
    store = store or f"{checkpoint_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    version = wordpieces.version(tokenizer)
    blanks = wordpieces.drops_blanks(tokenizer)
    spark.createDataFrame([], STORE_SCHEMA).write.mode("append").parquet(store)
    rows = written(docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"), digest(text_col, blanks).alias("digest")))
    keys = rows.groupBy("digest").agg(F.count("*").alias("times"))
    misses = keys.join(stored(spark, store, version), "digest", "left_anti")
    if not misses.isEmpty():
        texts = docs.select(digest(text_col, blanks).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["digest"])
        texts = texts.join(stored(spark, store, version), "digest", "left_anti")
        texts.mapInArrow(_encode(tokenizer), "digest binary, n_tokens bigint").select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(store)
    found = spread_join(rows, stored(spark, store, version), "digest", hot_keys(rows, "digest"), "left")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
