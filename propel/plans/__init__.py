"""Keyed query plans and their SQL oracles."""


def load_all():
    """Import every query module so the registry is filled."""
    from propel.plans import q_decisions, q_features, q_ml, q_reports, q_sources, q_streaming  # noqa: F401
    from propel.plans.registry import ORACLE, QUERIES
    return QUERIES, ORACLE
