"""Sizes of texts in tokens of the public tokenizers, for the filling and splitting operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.bpe_encode import PATTERN, TOKENIZERS_DIR, read_ranks
from folioflow.sources.tables import table


_LOADED: dict[str, object] = {}


def sent_ranks(spark: SparkSession, names: list[str], tokenizers_dir: str = TOKENIZERS_DIR):
    """The rank files of tokenizers, read once on the driver and broadcast: each of a fixed size, a vocabulary."""
    return spark.sparkContext.broadcast({n: read_ranks(f"{tokenizers_dir}/{n}.tiktoken") for n in names})


def rank_encoding(name: str, ranks: dict):
    """The tokenizer of a rank table, built once per worker."""
    if name not in _LOADED:
        import tiktoken

        _LOADED[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks[name], special_tokens={})
    return _LOADED[name]


def limits(spark: SparkSession, d: str, purpose: str) -> list:
    """The rows of size_limits with a purpose, by limit_id: parameters, a handful of rows."""
    return table(spark, d, "size_limits").where(F.col("purpose") == purpose).orderBy("limit_id").collect()


def token_counts(df: DataFrame, key: str, text: str, names: list[str], tokenizers_dir: str = TOKENIZERS_DIR) -> DataFrame:
    """(key, n array<int>): each row's tokens by each of the tokenizers; a null or empty text has 0."""

    sent = sent_ranks(df.sparkSession, names, tokenizers_dir)

    def run(batches):
        encs = [rank_encoding(n, sent.value) for n in names]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [[len(e.encode_ordinary(t)) if t else 0 for e in encs] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["k", "n"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n array<int>").withColumnRenamed("k", key)
