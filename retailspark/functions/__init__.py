"""Column expressions: dates, arithmetic, text, binning and customer classes."""

from .arithmetic import difference, fraction, midpoint, sum_or_null
from .binning import cut, cut_expr
from .dates import days_between, parse_day
from .segments import RF_SEGMENTS, RFM_CLASSES, rf_segment, rfm_class
from .text import concat_label, join_members

__all__ = [
    "RF_SEGMENTS",
    "RFM_CLASSES",
    "concat_label",
    "cut",
    "cut_expr",
    "days_between",
    "difference",
    "fraction",
    "join_members",
    "midpoint",
    "parse_day",
    "rf_segment",
    "rfm_class",
    "sum_or_null",
]
