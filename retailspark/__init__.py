"""Retail customer analytics on Spark: RFM segmentation, churn models, market baskets."""
