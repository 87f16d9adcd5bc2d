"""Token counts through a cache of digests: only texts never counted before are encoded."""

import pyarrow as pa
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import bounded_batches, free_name, texts
from .tokens import Encoder, version_digest

CACHE_DDL = "content binary, tokenizer string, n_tokens long"


def content_digest(column="text"):
    """Digest of the normalised content. Only what cannot change a count is merged: a null text is an empty one."""
    return F.unhex(F.sha2(F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8"), 256))


def read_cache(spark, cache):
    """The stored counts; a cache that does not exist yet is empty."""
    try:
        return spark.read.schema(CACHE_DDL).parquet(cache)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], CACHE_DDL)


def token_counts(docs, tokenizer, cache=None):
    """``docs`` with n_bytes (of the text in UTF-8) and n_tokens, looked up in ``cache`` or counted and added to it.

    ``cache`` is the path of a Parquet table (content digest, tokenizer digest, n_tokens) in a folder that all
    executors share; without one, a new table is begun in the session's shared folder. Of each distinct text that has
    no stored count under this tokenizer's version, one row is encoded; a hot group of copies costs one encoding and a
    join that adaptive execution can split. Two jobs that add to one cache at once may store a count twice, which
    changes nothing.

    A null or empty text has 0 tokens; a null doc_id is kept; repeated rows are returned each. Columns of ``docs``
    stay; those named n_bytes or n_tokens are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    cache = cache or scratch_path(spark, "token-counts")
    version = version_digest(tokenizer)

    def known():
        stored = read_cache(spark, cache).where(F.col("tokenizer") == version)
        return stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    digested = docs.select(F.col("doc_id").alias("_doc"), "text", content_digest().alias("content"))
    missing = digested.join(known(), "content", "left_anti").groupBy("content").agg(F.min("_doc").alias("_doc"))
    # a row is encoded if its id is the least of its content: join on both, so that copies do not meet in one task
    chosen = digested.alias("a").join(
        missing.alias("b"),
        (F.col("a.content") == F.col("b.content")) & F.col("a._doc").eqNullSafe(F.col("b._doc")),
        "left_semi",
    )

    def count(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            counts = [encoder.count(text) for text in texts(batch)]
            columns = [batch.column("content"), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["content", "n_tokens"])

    counted = chosen.select("content", "text").mapInArrow(count, "content binary, n_tokens long")
    (
        counted.groupBy("content")
        .agg(F.max("n_tokens").alias("n_tokens"))
        .select("content", F.lit(version).alias("tokenizer"), "n_tokens")
        .write.mode("append")
        .parquet(cache)
    )
    kept, content = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens")], free_name(docs, "_content")
    return (
        docs.select(
            *kept,
            F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
            content_digest().alias(content),
        )
        .join(known().withColumnRenamed("content", content), content, "left")
        .select(*kept, "n_bytes", "n_tokens")
    )
