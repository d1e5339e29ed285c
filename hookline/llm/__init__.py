"""Operators for training-data pipelines: packing, quality rules, decontamination,
language-model scoring, near-duplicate joins, sharding, token counts, toxicity and
licence scans.  Nothing else in the library imports this subpackage.

Executors import it by name: on a cluster ship the package with ``--py-files``
or install it on the workers.
"""
