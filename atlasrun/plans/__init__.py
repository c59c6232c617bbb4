"""Registered queries: jobs over the driver tables, with SQL to check them."""

from importlib import import_module

_MODULES = ("run_queries", "geometry_queries", "resolve_queries", "quality_queries", "stream_queries", "source_queries")


def _load() -> None:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")


def all_queries() -> dict:
    _load()
    from .registry import QUERIES

    return dict(QUERIES)


def all_checks() -> dict[str, str]:
    _load()
    from .registry import CHECKS

    return dict(CHECKS)
