"""Whole reports, and the registered queries over the given tables."""


def _load():
    from evalgrain.plans import catalog
    from evalgrain.plans import (  # noqa: F401
        case_queries, execution_queries, judge_queries, routing_queries, source_queries,
        trajectory_queries,
    )

    return catalog


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
