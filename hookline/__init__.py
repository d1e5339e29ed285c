"""hookline: URL threat analytics on Spark DataFrames.

Column functions live in ``hookline.functions``, DataFrame-level operators in
``hookline.operators``, readers and writers in ``hookline.sources``, the
registered queries (and their DuckDB oracles) in ``hookline.plans`` and the
Structured Streaming jobs in ``hookline.streaming``.
"""

from hookline.session import get_spark, checkpoint_dir  # noqa: F401

CLASSES = ("benign", "defacement", "malware", "phishing")
