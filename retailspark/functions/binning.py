"""Binning of a numeric column by ordered breaks."""

from pyspark.sql import Column, functions as F


def _tally(breaks, test):
    return F.size(F.filter(breaks, test))


def cut_expr(value, breaks, labels, right=True, include_lowest=True, on_degenerate="raise"):
    """Label of the bin that holds ``value``.

    ``breaks`` is a list of k+1 numbers or an array column of that length; ``labels`` has k entries.
    Bins are closed on the right, or on the left with ``right=False``; ``include_lowest`` also closes
    the outermost edge on the open side. Values outside the breaks get null.

    Equal breaks: ``raise`` stops the job, ``collapse`` merges them and a value on the merged edge
    gets the highest label that touches it.
    """
    if on_degenerate not in ("raise", "collapse"):
        raise ValueError(f"on_degenerate must be 'raise' or 'collapse', not {on_degenerate!r}")
    k = len(labels)
    x = value.cast("double")
    known = not isinstance(breaks, Column)
    if known:
        if len(breaks) != k + 1:
            raise ValueError(f"{k} labels need {k + 1} breaks, got {len(breaks)}")
        if on_degenerate == "raise" and any(a >= b for a, b in zip(breaks, breaks[1:])):
            raise ValueError(f"breaks are not strictly increasing: {list(breaks)}")
        edges = F.array(*[F.lit(float(b)) for b in breaks])
    else:
        edges = breaks
    low, high = F.get(edges, F.lit(0)), F.get(edges, F.lit(k))
    if right:
        # breaks below x, or for the lowest value the whole run of breaks equal to it
        place = F.greatest(_tally(edges, lambda b: b < x), _tally(edges, lambda b: b <= low))
        inside = (x <= high) & ((x >= low) if include_lowest else (x > low))
    else:
        place = _tally(edges, lambda b: b <= x)
        inside = (x >= low) & ((x <= high) if include_lowest else (x < high))
    names = F.array(*[F.lit(name) for name in labels])
    label = F.when(inside, F.element_at(names, F.least(place, F.lit(k))))
    if on_degenerate == "raise" and not known:
        repeated = edges.isNotNull() & (F.size(F.array_distinct(edges)) < k + 1)
        label = F.when(repeated, F.raise_error(F.lit("breaks are not strictly increasing"))).otherwise(label)
    return label


def cut(df, col, breaks, labels, right=True, include_lowest=True, out=None, on_degenerate="raise"):
    """``df`` with the bin label of ``col`` in column ``out``."""
    out = out or f"{col}_GROUP"
    if isinstance(breaks, Column):
        # evaluated once into a column: the label refers to each break several times
        edged = df.withColumn("_edges", breaks)
        label = cut_expr(F.col(col), F.col("_edges"), labels, right, include_lowest, on_degenerate)
        return edged.withColumn(out, label).drop("_edges")
    return df.withColumn(out, cut_expr(F.col(col), breaks, labels, right, include_lowest, on_degenerate))
