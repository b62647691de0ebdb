"""Names of columns that operators add for themselves."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def unused(names: Iterable[str], wanted: str) -> str:
    """wanted, with underscores where a column of this name is there already."""
    taken = {x.lower() for x in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def content_key(text: Column) -> Column:
    """A hash of a text (null: of the empty one): with the id it tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
