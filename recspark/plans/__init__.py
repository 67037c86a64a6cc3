from recspark.plans.registry import QUERIES, ORACLE, load_all, normalise

__all__ = ["QUERIES", "ORACLE", "load_all", "normalise", "queries", "oracle_sql"]


def queries():
    load_all()
    return dict(QUERIES)


def oracle_sql():
    load_all()
    return dict(ORACLE)
