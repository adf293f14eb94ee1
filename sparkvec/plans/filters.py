"""Metadata filters: a dict of equalities compiled to a predicate over a VARIANT column.

All pairs must hold.  A missing key equals null; numbers are equal across int and
float, and 1 and 0 equal true and false; lists and objects compare deeply, without
regard to the order of keys.  There are no operators: a nested dict is a value.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _member(metadata: Column, key: str) -> Column:
    if "'" in key or "\\" in key:  # no path can spell it
        return F.try_variant_get(metadata, "$", "map<string,variant>")[key]
    return F.try_variant_get(metadata, f"$['{key}']", "variant")


def _spellings(value) -> list[str]:
    """Canonical JSON of a value, in every form that it may be stored in."""
    if isinstance(value, bool):
        return [json.dumps(value), *_spellings(int(value))[:2]]
    if isinstance(value, (int, float)) and value == int(value):
        own = [str(int(value)), f"{int(value)}.0"]
        return own + [json.dumps(bool(value))] * (value in (0, 1))
    if isinstance(value, (dict, list)):
        return [json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)]
    return [json.dumps(value, ensure_ascii=False)]


def equals(metadata: Column, key: str, value) -> Column:
    found = _member(metadata, key)
    if value is None:
        return found.isNull() | F.is_variant_null(found)
    return F.coalesce(F.to_json(found).isin(_spellings(value)), F.lit(False))


def compile_filter(wanted: dict | None, metadata: Column | None = None) -> Column | None:
    """The predicate of a filter; None for no filter, which an empty dict is too."""
    if not wanted:
        return None
    metadata = F.col("metadata") if metadata is None else metadata
    return reduce(lambda a, b: a & b, [equals(metadata, k, v) for k, v in wanted.items()])
