"""Registered queries (Spark builders + DuckDB twins) and derived views."""


MODULES = ("queries_sales", "queries_clean", "queries_dates", "queries_prep", "queries_profile",
           "queries_merge", "queries_model", "queries_extra", "queries_keys")


def load_all():
    """Import every query module so that the registry is complete."""
    import importlib
    for m in MODULES:
        importlib.import_module(f"tabloom.plans.{m}")
    from tabloom.plans.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
