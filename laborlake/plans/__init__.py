"""Query plans: the registry of named jobs, their oracle SQL and the pipeline run."""

_MODULES = ("laborlake.plans.catalog", "laborlake.plans.catalog_matching",
            "laborlake.plans.catalog_tracking", "laborlake.plans.catalog_text",
            "laborlake.plans.catalog_io")


def load_all() -> None:
    import importlib
    for m in _MODULES:
        try:
            importlib.import_module(m)
        except ModuleNotFoundError as e:
            if e.name != m:
                raise
