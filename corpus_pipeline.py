"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes what the one before kept, as a Parquet table, and its decisions take effect.
"""

from pyspark.sql import functions as F

from retailspark.llm import decontamination, language, near_dedup, packing, substring_dedup
from retailspark.llm.queries import TOKENIZER
from retailspark.llm.repeats import written

#: A document whose language the network is less sure of goes. Chance is 0.25 for four languages, and a clean document
#: in two languages scores 0.4 to 0.5.
LEAST_SCORE = 0.3
#: A document goes as a whole if benchmark windows cover more than this share of its words.
MOST_COVERED = 0.5


def language_id(spark, docs, sf_dir):
    """Keeps documents in a known language; a document without letters has none. The network learns from ``lang``."""
    labelled = language.predict(docs, language.train(docs))
    return labelled.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """Keeps one document of each group of near duplicates."""
    return near_dedup.deduplicate(docs)


def substrings(spark, docs, sf_dir):
    """Cuts passages of 20 words and more that stand earlier in the corpus."""
    return substring_dedup.remove_repeats(docs)


def benchmark_windows(spark, docs, sf_dir):
    """Cuts passages of benchmark items, and drops documents that consist of them."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.decontaminate(docs, items, max_coverage=MOST_COVERED)


def pack(spark, docs, sf_dir):
    """Cuts the documents into sequences of power-of-two length, by bucket."""
    return packing.pieces(docs, TOKENIZER)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", benchmark_windows),
    ("packing", pack),
]

#: No SQL expresses the network, the signatures or the tokenizer; a test holds the stages against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
