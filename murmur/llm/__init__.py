"""Operators of a training-data pipeline (URL filters, toxicity, top-k search,
chat formatting, nearest neighbours, packing, near-duplicates, mixing, personal
data, page text). Nothing outside this package imports it."""
