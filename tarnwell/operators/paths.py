"""Path predicates and guards that the searches share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def required(value: str | None, what: str, least: int = 1) -> str:
    if value is None or len(value.strip()) < least:
        raise ValueError(f"{what} must have {least} characters or more")
    return value


def like(column: Column, text: str, before: str = "%", after: str = "%", escape: bool = False) -> Column:
    """Case-insensitive LIKE of a text between two patterns; _ and % in the text are wildcards unless escaped."""
    if escape:
        for c in "\\%_":
            text = text.replace(c, "\\" + c)
    return column.ilike(before + text + after)


def path_filter(path: Column, paths: Sequence[str] | None = None, directory: str | None = None, package: str | None = None, query: str | None = None) -> Column:
    """Exact files, a directory prefix, a package in dots (at the start or below any folder) and a substring, all of them."""
    out = F.lit(True)
    if paths is not None:
        out = out & path.isin(*paths)
    if directory:
        prefix = directory.replace("\\", "/").rstrip("/").lower() + "/"
        out = out & F.startswith(F.lower(path), F.lit(prefix))
    if package:
        inner = package.replace(".", "/").lower() + "/"
        out = out & (F.startswith(F.lower(path), F.lit(inner)) | F.contains(F.lower(path), F.lit("/" + inner)))
    if query:
        out = out & like(path, query)
    return out
