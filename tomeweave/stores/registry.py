"""Source name to mapping.  Add a source by adding an entry: ``DataFrame -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from . import amazon, audible, bookbub, goodreads, kobo, openlibrary

MAPPINGS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "openlibrary": openlibrary.to_records, "goodreads": goodreads.to_records, "amazon": amazon.to_records,
    "bookbub": bookbub.to_records, "kobo": kobo.to_records, "audible": audible.to_records,
}


def map_sources(captured: dict[str, DataFrame], mappings: dict = MAPPINGS) -> DataFrame:
    """All captured sources mapped to the common record shape; a narrow job per source."""
    return reduce(DataFrame.unionByName, [mappings[name](df) for name, df in captured.items()])
