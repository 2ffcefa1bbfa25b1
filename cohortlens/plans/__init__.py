"""Stand-in views and the registered queries."""

from importlib import import_module

PARTS = ("q_tables", "q_metrics", "q_inference", "q_models", "q_audit")


def load_all() -> None:
    """Importing a part registers its queries."""
    for part in PARTS:
        import_module(f"cohortlens.plans.{part}")
