"""Registered queries over the driver tables, with the SQL each is checked against."""


def _catalog():
    from hedgerow.plans import catalog
    from hedgerow.plans import (  # noqa: F401  (they register themselves)
        corpus_queries, document_queries, policy_queries, review_queries, route_queries, source_queries,
    )

    return catalog


def all_queries():
    return dict(_catalog().QUERIES)


def all_oracles():
    return dict(_catalog().ORACLES)
