"""Sources of records: a registry of functions from a session and options to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Scan = Callable[..., DataFrame]
VERSION = 1
_sources: dict[str, Scan] = {}


def source(name: str, version: int = VERSION) -> Callable[[Scan], Scan]:
    """Register a scan under a name; a source written for another version or a name taken is refused."""

    def register(scan: Scan) -> Scan:
        if version != VERSION:
            raise ValueError(f"{name} is for version {version}, this is {VERSION}")
        if name in _sources and _sources[name] is not scan:
            raise ValueError(f"{name} is taken")
        _sources[name] = scan
        return scan

    return register


def names() -> list[str]:
    return sorted(_sources)


def scan(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in _sources:
        raise LookupError(f"no source {name!r}; there are {', '.join(names())}")
    return _sources[name](spark, **options)
