"""Attribute-value rows to one wide row per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most columns a wide table may get; the catalogue decides which.
MAX_ATTRIBUTES = 10_000
TYPES = ("double", "bigint", "boolean", "string")


def resolve_cells(facts: DataFrame, entity: str, attribute: str, value: str, order: str) -> DataFrame:
    """Latest non-null ``value`` of each (entity, attribute), by ``order``.

    ``max_by`` combines on the map side, so an entity that holds a third of all
    rows shuffles no more than its attributes. Ties in ``order`` go to the
    larger value; null keys are dropped, as a cell needs both.
    """
    kept = facts.where(F.col(value).isNotNull() & F.col(entity).isNotNull() & F.col(attribute).isNotNull())
    return kept.groupBy(entity, attribute).agg(
        F.max(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))["v"].alias(value)
    )


def typed(value: Column, kind: str) -> Column:
    """``value`` (double) as ``kind``, null where it is not exactly one."""
    if kind == "double":
        return value
    if kind == "bigint":
        whole = (F.floor(value).cast("double") == value) & (F.abs(value) < 9.2e18)
        return F.when(whole, value.cast("bigint"))
    if kind == "boolean":
        return F.when(value == 1, F.lit(True)).when(value == 0, F.lit(False))
    if kind == "string":
        return value.cast("string")
    raise ValueError(f"unknown value type {kind!r}")


def widen(facts: DataFrame, catalog: list[tuple[str, str]], entity: str = "entity_canonical",
          attribute: str = "attribute_canonical", value: str = "canonical_value_num", order: str = "ingest_seq") -> DataFrame:
    """One row per entity: ``entity``, a column per catalogue attribute, ``cells``, ``cast_failures``.

    Each entity's resolved pairs go into one key-value map, ``cells`` (at most
    one entry per catalogue attribute), from which the known keys are projected
    into columns of their type. A value that its type can't hold leaves the
    column null and stays in ``cast_failures``. Entities without any catalogue
    value have no row; an empty input gives no rows, an empty catalogue no
    columns. A catalogue attribute named like ``entity`` or a map column is
    given a trailing underscore.
    """
    if len(catalog) > MAX_ATTRIBUTES:
        raise ValueError(f"a wide table of {len(catalog)} columns; the bound is {MAX_ATTRIBUTES}")
    kinds = dict(catalog)
    cells = resolve_cells(facts.where(F.col(attribute).isin(*kinds) if kinds else F.lit(False)), entity, attribute, value, order)
    maps = cells.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct(attribute, value))).alias("cells"))
    at = lambda k: F.try_element_at(F.col("cells"), F.lit(k))
    taken = {entity, "cells", "cast_failures"}
    columns = [typed(at(k), kind).alias(k + "_" if k in taken else k) for k, kind in kinds.items()]
    by_kind = {t: [k for k, kind in kinds.items() if kind == t] for t in TYPES}
    failed = F.lit(False)
    return maps.select(entity, *columns, "cells", F.map_filter("cells", lambda k, v: _fails(k, v, by_kind, failed)).alias("cast_failures"))


def _fails(k: Column, v: Column, by_kind: dict[str, list[str]], out: Column) -> Column:
    for kind in ("bigint", "boolean"):
        if by_kind[kind]:
            out = out | (k.isin(*by_kind[kind]) & typed(v, kind).isNull())
    return out


def cells_of(wide: DataFrame, entity: str = "entity_canonical") -> DataFrame:
    """The filled cells of a wide table, long again: (entity, attribute_canonical, value)."""
    return wide.select(entity, F.explode("cells").alias("attribute_canonical", "value"))
