"""Slots, presets and flags of a row's versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_slot(store: Column, slot: str, version: Column) -> Column:
    """The store with one slot replaced."""
    return store.withField(slot, version)


def row_preset(shipped: Column, last_attempt: Column) -> Column:
    """The preset of what was shipped, else of the last attempt."""
    return F.coalesce(shipped["preset"], last_attempt)


def display_sizes(original: Column, shipped: Column) -> Column:
    """Bytes before and after; null unless something was shipped."""
    return F.when(shipped.isNotNull(), F.struct(original.alias("before"), shipped["bytes"].alias("after")))


def flagged(flags: Column, url: Column, value: Column) -> Column:
    """The flags with one address set; a missing flag stays missing, which is not false."""
    return F.map_concat(F.map_filter(flags, lambda k, _: k != url), F.create_map(url, value))


def provenance(flags: Column, url: Column, original: Column) -> Column:
    """The address a version came from and what its flag says, null where nobody said."""
    return F.struct(original.alias("original"), F.try_element_at(flags, url).alias("searchable"))
