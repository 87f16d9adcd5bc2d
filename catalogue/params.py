"""Windows, thresholds and model settings shared by the queries and their SQL."""

import datetime as dt

AS_OF = dt.date(2001, 8, 1)
START = dt.date(2000, 8, 1)  # excluded
SHORT_START = dt.date(2001, 4, 4)  # 119 days: frequency breaks coincide
MAX_DAYS = 95

REF = dt.date(2000, 1, 1)
LOOKBACK = dt.date(1999, 1, 1)  # excluded
HOLDOUT_END = dt.date(2000, 6, 30)  # excluded
EARLY = dt.date(1996, 1, 1)

SPLIT = 0.7
SEED = 123456
BAGS = 20  # trees with an out-of-bag estimate

TYPE_SUPPORT, TYPE_CONFIDENCE = 0.001, 0.5
BRAND_SUPPORT, BRAND_CONFIDENCE = 0.001, 0.05
ARTICLE_SUPPORT, ARTICLE_CONFIDENCE = 0.0001, 0.02
