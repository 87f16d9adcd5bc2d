"""Document quality by hierarchical empirical Bayes over sites.

Three levels of evidence meet: what a document looks like (a naive Bayes classifier over binned measures of its text),
what the labelled documents of its host are like, and what those of its path within the host are like. Hosts shrink
towards the global share of good documents and paths towards their host, the more so the fewer labels they have.
"""

from pyspark.sql import functions as F

from .repeats import written

#: Bins per measure; the classifier's table has measures x bins rows.
BINS = 24


def measures(text):
    """Bins of a text's measures: length, word length, distinct words, signs, capitals, digits, lines said twice."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n_words, n_chars = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(text), F.lit(1))

    def share(pattern):
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / n_chars

    def binned(value):
        return F.least(F.floor(value), F.lit(BINS - 1)).cast("int")

    lines = F.split(text, "\n")
    return {
        "size": binned(F.log2(n_words)),
        "word": binned(n_chars / n_words),
        "distinct": binned(F.size(F.array_distinct(words)) / n_words * (BINS - 1)),
        "signs": binned(F.sqrt(share(r"[^\p{L}\p{N}\s]+")) * BINS),
        "capitals": binned(F.sqrt(share(r"\p{Lu}+")) * BINS),
        "digits": binned(F.sqrt(share(r"\p{N}+")) * BINS),
        "lines": binned(F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)) * (BINS - 1)),
    }


def _prior_strength(groups, mean):
    """How many labels a level's mean is worth, by the method of moments: sites that differ little shrink more."""
    n, good = F.col("n"), F.col("good")
    row = groups.agg(
        F.sum(F.when(n > 1, n)).alias("n"),
        F.sum(F.when(n > 1, n * F.pow(good / n - mean, 2))).alias("spread"),
        F.count(F.when(n > 1, True)).alias("k"),
    ).first()
    if not row["n"] or mean <= 0 or mean >= 1:
        return 1e6
    noise = mean * (1 - mean)
    between = max(0.0, (row["spread"] - row["k"] * noise) / row["n"])
    return min(1e6, max(1.0, noise / between - 1)) if between > 0 else 1e6


def score(docs, labels, host="source", path="lang", smoothing=1.0):
    """Per row of ``docs``: doc_id, evidence, host_share, path_share, score and kept.

    ``labels`` has doc_id and quality (0 or 1). evidence is the log odds that the text's measures give; host_share and
    path_share are the posterior shares of good documents of its host and of the path within it; score is the
    probability that all give together, and kept says that it is 0.5 or more. All sums come from grouped aggregations
    that reduce in each task first, so a host with a third of all rows is no burden; the driver sees a table of
    measures x bins and one row per level.

    A doc_id labelled several times counts with its mean. A host or path that is null is a site of its own. A null
    text is an empty one. Labels that are null, or of documents that are not there, are left out. Without labels
    everything scores 0.5. Repeated rows get equal results.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(host).cast("string"), F.lit("\0null")).alias("host"),
        F.coalesce(F.col(path).cast("string"), F.lit("\0null")).alias("path"),
        *[value.alias(f"m_{name}") for name, value in measures(F.col("text")).items()],
    )
    rows = written(rows, "measures")
    names = [c for c in rows.columns if c.startswith("m_")]
    given = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    labelled = written(rows.join(given.agg(F.avg(F.col("quality").cast("double")).alias("good")), "doc_id"), "labelled")
    total = labelled.agg(F.count("*").alias("n"), F.sum("good").alias("good")).first()
    if not total["n"]:
        half = F.lit(0.5)
        return rows.select(
            "doc_id",
            F.lit(0.0).alias("evidence"),
            half.alias("host_share"),
            half.alias("path_share"),
            half.alias("score"),
            F.lit(True).alias("kept"),
        )
    good, n = float(total["good"]), total["n"]
    bad = n - good
    mean = (good + smoothing) / (n + 2 * smoothing)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("bin")) for c in names])).alias("p")
    table = (
        labelled.select("good", pairs)
        .groupBy("p.measure", "p.bin")
        .agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
        .select(
            "measure",
            "bin",
            F.log((F.col("good") + smoothing) / (good + smoothing * BINS)).alias("g"),
            F.log((F.col("bad") + smoothing) / (bad + smoothing * BINS)).alias("b"),
        )
        .collect()
    )
    unseen = F.lit(0.0)
    evidence = F.lit(0.0)
    for name in names:
        odds = [(r["bin"], r["g"] - r["b"]) for r in sorted(table, key=lambda r: r["bin"]) if r["measure"] == name]
        known = F.create_map(*[F.lit(v) for entry in odds for v in entry])
        evidence = evidence + F.coalesce(F.try_element_at(known, F.col(name)), unseen)
    by_path = labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    by_path = written(by_path, "paths")
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    host_weight = _prior_strength(by_host, mean)
    path_weight = _prior_strength(by_path, mean)
    hosts = by_host.select(
        "host", ((F.col("good") + host_weight * mean) / (F.col("n") + host_weight)).alias("host_share")
    )
    paths = by_path.select("host", "path", "n", "good")
    joined = rows.join(paths, ["host", "path"], "left").join(hosts, "host", "left")
    host_share = F.coalesce("host_share", F.lit(mean))
    path_share = (F.coalesce("good", F.lit(0.0)) + path_weight * host_share) / (F.coalesce("n", F.lit(0)) + path_weight)
    scored = joined.select(
        "doc_id", evidence.alias("evidence"), host_share.alias("host_share"), path_share.alias("path_share")
    )
    odds = F.col("evidence") + F.log(F.col("path_share") / (1 - F.col("path_share")))
    probability = 1 / (1 + F.exp(-odds))
    return scored.withColumn("score", probability).withColumn("kept", F.col("score") >= 0.5)
