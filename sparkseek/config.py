"""Settings from key=value files, kept within their bounds."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass
class Config:
    threads: int = 4
    batch: int = 10_000
    limit: int = 200
    max_content: int = 1 << 20
    cache_entries: int = 64


BOUNDS = {"threads": (1, 1024), "batch": (100, 10_000_000), "limit": (1, 1_000_000), "max_content": (0, 1 << 31), "cache_entries": (1, 10_000)}


def load(text: str) -> Config:
    """Lines key=value; blank lines and those that begin with # or ; are skipped, unknown keys and values that are no numbers ignored."""
    config = Config()
    names = {f.name for f in fields(Config)}
    for line in text.splitlines():
        key, eq, value = line.strip().partition("=")
        key, value = key.strip().lower(), value.strip()
        if not eq or key.startswith(("#", ";")) or key not in names or not value.lstrip("-").isdigit():
            continue
        low, high = BOUNDS[key]
        setattr(config, key, min(high, max(low, int(value))))
    return config
