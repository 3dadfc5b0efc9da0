"""Domain mapping of the given tables and the registered queries."""

from importlib import import_module


def load() -> None:
    for name in ("bars", "indicators", "patterns", "labels", "stats", "models", "trading", "logs", "flows"):
        try:
            import_module(f"barflow.plans.{name}")
        except ModuleNotFoundError as e:
            if f"barflow.plans.{name}" not in str(e):
                raise
