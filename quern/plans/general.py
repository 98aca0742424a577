"""Queries of the general data problems (periods, instants, wide tables, quantities)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.instants import fact_instants
from quern.operators.periods import fact_periods
from quern.operators.quantities import convert_quantities
from quern.operators.wide import MAX_ATTRIBUTES, cells_of, widen
from quern.session import collect_bounded, spread, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_periods(table(spark, sf_dir, "facts", "entity_canonical", "start_date", "end_date", "granularity"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "facts", "fact_id", "doc_hash", "temporal_raw", "start_date", "end_date", "granularity")
    return fact_instants(spread(facts), table(spark, sf_dir, "source_docs", "doc_hash", "time_zone", "date_order"))


def catalog_types(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """The columns of the wide table: (attribute, type), in order of the attribute."""
    kinds = table(spark, sf_dir, "attribute_catalog", "attribute_canonical", "value_type").distinct()
    return sorted((r[0], r[1]) for r in collect_bounded(kinds, MAX_ATTRIBUTES, "attribute_catalog"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "facts", "entity_canonical", "attribute_canonical", "canonical_value_num", "ingest_seq")
    return widen(facts, catalog_types(spark, sf_dir))


def p6_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir)
    # maps have no order that a comparison could rely on
    text = F.array_join(F.transform(F.array_sort(F.map_keys("cast_failures")), lambda k: k), "|")
    return wide.withColumn("cast_failures", text).drop("cells")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    milli = F.round(F.col("value") * 1000).try_cast("bigint")
    return cells_of(_wide(spark, sf_dir)).select("entity_canonical", "attribute_canonical", milli.alias("value_milli"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "facts", "fact_id", "attribute_canonical", "raw_value", "canonical_unit", "verbatim_quote")
    return convert_quantities(spread(facts), table(spark, sf_dir, "attribute_catalog", "attribute_canonical", "dimension", "common_unit"))


QUERIES = {"p2_found": p2_found, "p5_found": p5_found, "p6_found": p6_found, "p6_wide": p6_wide, "p7_found": p7_found}

_DAY = """CASE WHEN regexp_full_match(trim({c}), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST(trim({c}) AS DATE)
      WHEN regexp_full_match(trim({c}), '\\d{{4}}-\\d{{2}}') THEN {month}
      WHEN regexp_full_match(trim({c}), '\\d{{4}}') THEN TRY_CAST(trim({c}) || '{year}' AS DATE) END"""
_START = _DAY.format(c="start_date", month="TRY_CAST(trim(start_date) || '-01' AS DATE)", year="-01-01")
_END = _DAY.format(c="end_date", month="last_day(TRY_CAST(trim(end_date) || '-01' AS DATE))", year="-12-31")

SQL = {
    "p2_found": f"""
WITH p AS (
  SELECT entity_canonical AS k, {_START} AS s, {_END} AS e FROM facts
  WHERE upper(trim(granularity)) IN ('YEAR', 'QUARTER', 'MONTH')
), valid AS (SELECT DISTINCT k, s, e FROM p WHERE s <= e),
reached AS (
  SELECT k, s, e, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM valid
), islands AS (
  SELECT k, s, e, sum(CASE WHEN s <= r + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM reached
), merged AS (SELECT k, i, min(s) AS s, max(e) AS e FROM islands GROUP BY k, i),
gaps AS (SELECT k, lag(e) OVER (PARTITION BY k ORDER BY i) + 1 AS s, s - 1 AS e FROM merged)
SELECT k AS entity_canonical, 'period' AS kind, strftime(s, '%Y-%m-%d') AS start_date, strftime(e, '%Y-%m-%d') AS end_date FROM merged
UNION ALL
SELECT k, 'gap', strftime(s, '%Y-%m-%d'), strftime(e, '%Y-%m-%d') FROM gaps WHERE s IS NOT NULL
""",
    "p6_found": """
SELECT entity_canonical, attribute_canonical, CAST(round(arg_max(canonical_value_num, ingest_seq) * 1000) AS BIGINT) AS value_milli
FROM facts WHERE canonical_value_num IS NOT NULL AND entity_canonical IS NOT NULL
  AND attribute_canonical IN (SELECT attribute_canonical FROM attribute_catalog)
GROUP BY entity_canonical, attribute_canonical
""",
}
