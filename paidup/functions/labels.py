"""Fixed lookups as expressions (a handful of entries each)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from paidup.config import BAND_NAMES, ORIGIN_DEFAULT, ORIGIN_LABELS, PRIORITIES, STAGE_DEFAULT, STAGE_LABELS, STAGE_OF_BAND


def mapped(key: Column, entries: Mapping[str, str], default: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def position(key: Column, names: Sequence[str]) -> Column:
    """0-based position in a fixed list, null when absent."""
    chain = None
    for i, name in enumerate(names):
        chain = (F if chain is None else chain).when(key == name, F.lit(i))
    return chain


def origin_label(match_method: Column) -> Column:
    return mapped(F.coalesce(match_method, F.lit("")), ORIGIN_LABELS, ORIGIN_DEFAULT)


def band_position(band: Column) -> Column:
    return position(band, BAND_NAMES)


def priority_position(priority: Column) -> Column:
    return position(priority, PRIORITIES)


def dunning_stage(band: Column) -> Column:
    return mapped(F.coalesce(band, F.lit("")), STAGE_OF_BAND, STAGE_DEFAULT)


def stage_label(stage: Column) -> Column:
    return mapped(stage, STAGE_LABELS)
