"""Keys and names derived from file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is part of the name."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def with_suffix(path: Column, suffix: str) -> Column:
    """Same path with another suffix (given with its dot)."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), F.lit(suffix))


def parent(path: Column) -> Column:
    """Everything before the last slash; '' without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def relative_to(path: Column, root: Column | str) -> Column:
    """Path below ``root``; the path itself where it lies elsewhere."""
    base = F.lit(root) if isinstance(root, str) else root
    base = F.concat(F.regexp_replace(base, r"/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)
