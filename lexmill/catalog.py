"""Named queries of the core and their SQL."""

from lexmill.plans import compose, folds, mining, ranking, registry, text  # noqa: F401

QUERIES, ORACLE = registry.QUERIES, registry.ORACLE
