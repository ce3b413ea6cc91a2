"""murmur: customer-feedback mining as Spark jobs.

Operators live in ``murmur.operators`` (standardisation, enrichment,
clustering, insights, reports), readers and segmenters in ``murmur.sources``,
column helpers in ``murmur.functions``, fixtures and the query registry in
``murmur.plans`` and the streaming ingest in ``murmur.streaming``."""

__version__ = "0.1.0"
