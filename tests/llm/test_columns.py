"""Input columns with the names that operators use inside."""

from corpus import frame
from pyspark.sql import functions as F

from retailspark.llm import decontamination, substring_dedup, suffix_dedup, token_counts
from retailspark.llm.queries import TOKENIZER

INNER = ("_KEY", "_spans", "_spans_", "_hits", "_words", "_items", "_content")


def test_columns_stay(spark):
    docs = frame(spark).where("doc_id is null or doc_id < 60")
    clash = docs
    for name in INNER:
        clash = clash.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    items = docs.where("doc_id in (3, 11, 17)").select(F.col("doc_id").cast("string").alias("item_id"), "text")
    operators = [
        substring_dedup.remove_repeats,
        suffix_dedup.remove_repeats,
        lambda d: decontamination.decontaminate(d, items),
        lambda d: token_counts.token_counts(d, TOKENIZER),
    ]
    for operator in operators:
        got = operator(clash)
        assert got.columns[: len(clash.columns)] == clash.columns
        rows = got.select("doc_id", "text", *INNER).collect()
        assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in rows for n in INNER)
        key = lambda r: (str(r.doc_id), str(r.text))
        plain = operator(docs).select("doc_id", "text").collect()
        assert sorted(map(key, rows)) == sorted(map(key, plain))
