"""Parts of files for Python data sources: any store that Arrow's file systems reach, read by ranges of bytes."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual


def opened(path: str):
    """A file to read from at any place; path: a URI, or a local one."""
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def part(path: str, start: int, size: int | None = None) -> bytes:
    with opened(path) as f:
        return f.read_at(size if size is not None else f.size() - start, start)


def length(path: str) -> int:
    with opened(path) as f:
        return f.size()


def limits(filters: list[Filter], columns: set[str]) -> tuple[dict[str, tuple[float, float]], list[Filter]]:
    """Of each column the least and the largest value that filters let through, and filters that say something else.

    Limits may be wider than what a filter says (< counts as <=), so all filters are to be applied again.
    """
    out, other = {}, []
    for f in filters:
        name = f.attribute[0] if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 else None
        if name not in columns:
            other.append(f)
            continue
        low, high = out.get(name, (float("-inf"), float("inf")))
        if not isinstance(f, (LessThan, LessThanOrEqual)):
            low = max(low, f.value)
        if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            high = min(high, f.value)
        out[name] = (low, high)
    return out, other
