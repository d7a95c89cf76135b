"""Import every query module so that ``catalog.QUERIES`` is complete."""

from velocis.plans import catalog
from velocis.plans import (  # noqa: F401
    function_queries, rolling_queries, scoring_queries, serving_queries, stream_queries, training_queries,
)


def all_queries():
    return dict(catalog.QUERIES)


def all_oracle_sql():
    return dict(catalog.ORACLE)
