"""Quantities in mixed units and scales, brought to one unit per attribute."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.units import DIMENSIONS, to_common


_MOST = 2**63 - 1


@F.pandas_udf(T.StructType([T.StructField("common_unit", T.StringType()), T.StructField("value_milli", T.LongType())]))
def _common(raw: pd.Series, unit: pd.Series, quote: pd.Series, dimension: pd.Series, common: pd.Series) -> pd.DataFrame:
    found: dict[tuple, tuple] = {}
    rows = []
    for row in zip(raw, unit, quote, dimension, common):
        # repeated expressions of a batch are parsed once
        if row not in found:
            found[row] = to_common(*(None if x is pd.NA else x for x in row)) or (None, None)
        rows.append(found[row])
    inside = [None if v is None or abs(v) > _MOST else v for _, v in rows]
    return pd.DataFrame({"common_unit": [u for u, _ in rows], "value_milli": pd.array(inside, dtype="Int64")})


def convert_quantities(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """(fact_id, common_unit, value_milli) of every fact that states a quantity.

    ``raw_value`` is parsed by a grammar (``functions.units``): numbers in any
    grouping or script, with powers of ten and fractions, or in words, unit expressions as exponent vectors that must equal
    the attribute's dimension, scale words, currencies. Whatever it leaves open
    comes from ``canonical_unit`` or, where that says RAW, from the quote.
    Scale and offset to the common unit are applied as exact fractions.

    Facts whose attribute has no dimension, whose value states no number, or
    that state money without any currency give no row; nor do values beyond
    the range of a bigint. Null columns count as not stated. Repeated
    deliveries that mean the same give one row.
    """
    units = catalog.where(F.col("dimension").isin(*DIMENSIONS)).select("attribute_canonical", "dimension", "common_unit")
    # the catalogue is small by nature; whether it is broadcast is left to its size
    quantities = facts.where(F.col("raw_value").isNotNull()).select(
        "fact_id", "attribute_canonical", "raw_value", "canonical_unit",
        F.when(F.upper(F.trim("canonical_unit")) == "RAW", F.col("verbatim_quote")).alias("quote"),
    ).join(units, "attribute_canonical")
    parsed = quantities.select("fact_id", _common("raw_value", "canonical_unit", "quote", "dimension", "common_unit").alias("q"))
    return parsed.where("q.value_milli IS NOT NULL").select("fact_id", "q.common_unit", "q.value_milli").distinct()
