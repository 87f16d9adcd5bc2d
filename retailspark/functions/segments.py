"""Customer segments from recency, frequency and monetary levels."""

from itertools import chain

from pyspark.sql import functions as F

# Segment per (recency level, frequency level).
RF_SEGMENTS = {
    ("LOW", "LOW"): "One-Timer",
    ("LOW", "MEDIUM"): "Engaged",
    ("LOW", "HIGH"): "Top",
    ("MEDIUM", "LOW"): "One-Timer",
    ("MEDIUM", "MEDIUM"): "Engaged",
    ("MEDIUM", "HIGH"): "Top",
    ("HIGH", "LOW"): "Leaving",
    ("HIGH", "MEDIUM"): "Leaving",
    ("HIGH", "HIGH"): "Leaving Top",
}

# Class per (segment, monetary level).
RFM_CLASSES = {
    ("One-Timer", "LOW"): "Cheap",
    ("One-Timer", "MEDIUM"): "Tin",
    ("One-Timer", "HIGH"): "Copper",
    ("Leaving", "LOW"): "Tin",
    ("Leaving", "MEDIUM"): "Copper",
    ("Leaving", "HIGH"): "Bronze",
    ("Engaged", "LOW"): "Copper",
    ("Engaged", "MEDIUM"): "Bronze",
    ("Engaged", "HIGH"): "Silver",
    ("Leaving Top", "LOW"): "Bronze",
    ("Leaving Top", "MEDIUM"): "Silver",
    ("Leaving Top", "HIGH"): "Gold",
    ("Top", "LOW"): "Silver",
    ("Top", "MEDIUM"): "Gold",
    ("Top", "HIGH"): "Diamond",
}


def _lookup(table, first, second):
    cells = F.create_map(*chain.from_iterable((F.lit("|".join(k)), F.lit(v)) for k, v in table.items()))
    return F.try_element_at(cells, F.concat_ws("|", first, second))


def rf_segment(recency_group, frequency_group):
    return _lookup(RF_SEGMENTS, F.col(recency_group), F.col(frequency_group))


def rfm_class(rf, monetary_group):
    return _lookup(RFM_CLASSES, F.col(rf), F.col(monetary_group))
