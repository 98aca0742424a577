"""Declared schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(),
    "binary": T.BinaryType(), "array<string>": T.ArrayType(T.StringType()),
}


def _struct(text: str) -> T.StructType:
    """Schema from "name type, ..."; unlike Spark's own parser this needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (field.split() for field in text.split(","))])


FACTS = _struct(
    "fact_id string, entity_canonical string, attribute_canonical string, entity_raw string, attribute_raw string, raw_value string, "
    "canonical_value_str string, canonical_value_num double, start_date string, end_date string, granularity string, temporal_raw string, "
    "scope string, canonical_unit string, doc_hash string, source_doc_name string, page_number int, verbatim_quote string, "
    "provenance_modality string, confidence_score double, is_quarantined boolean, quarantine_reason string, ingest_seq bigint"
)
RELATIONSHIPS = _struct("fact_id_a string, fact_id_b string, case_type string, rationale string, differing_dimensions array<string>")
PAGE_CHUNKS = _struct(
    "doc_name string, doc_hash string, page_number int, clean_text string, has_tables boolean, token_estimate int, has_images boolean, "
    "image_bytes binary, provenance_modality string, chunk_index int"
)
# What the enumerated columns may hold.
GRANULARITIES = ("EXACT_DATE", "MONTH", "QUARTER", "YEAR", "PERPETUAL", "UNKNOWN")
MODALITIES = ("TEXT", "VISUAL_CHART", "HYBRID")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; missing ones are null, others dropped."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def violations() -> Column:
    """array<string> of the constraints that a fact row breaks, empty for sound rows."""
    checks = {
        "page_number": F.col("page_number") >= 1,
        "confidence_score": F.col("confidence_score").between(0.0, 1.0),
        "granularity": F.col("granularity").isNull() | F.col("granularity").isin(*GRANULARITIES),
        "provenance_modality": F.col("provenance_modality").isNull() | F.col("provenance_modality").isin(*MODALITIES),
        "fact_id": F.col("fact_id").isNotNull(),
        "doc_hash": F.col("doc_hash").isNotNull(),
    }
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda x: x.isNotNull())


def nested(facts: DataFrame) -> DataFrame:
    """Facts as nested records: number before text as the value, modality TEXT where none is recorded."""
    c = F.col
    temporal = F.struct("start_date", "end_date", F.coalesce("granularity", F.lit("UNKNOWN")).alias("granularity"), c("temporal_raw").alias("raw_expression"))
    return facts.select(
        "fact_id", c("entity_raw").alias("entity"), c("attribute_raw").alias("attribute"), "raw_value",
        F.struct(c("canonical_value_num").alias("num"), F.when(c("canonical_value_num").isNull(), c("canonical_value_str")).alias("str")).alias("canonical_value"),
        F.struct(temporal.alias("temporal"), "scope", "canonical_unit").alias("context"),
        F.struct("source_doc_name", "doc_hash", "page_number", "verbatim_quote", F.coalesce("provenance_modality", F.lit("TEXT")).alias("provenance_modality")).alias("provenance"),
        "confidence_score", "is_quarantined", "quarantine_reason",
    )


def dimensions_json(dimensions: Column) -> Column:
    """An array of texts as JSON in ASCII with a blank after each comma; other characters as escapes, null as null."""
    hexed = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def char(c: Column) -> Column:
        n = F.ascii(c)
        beyond = n - 0x10000
        pair = F.concat(hexed(F.lit(0xD800) + F.shiftright(beyond, 10)), hexed(F.lit(0xDC00) + beyond.bitwiseAND(F.lit(0x3FF))))
        short = F.when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").when(c == "\b", "\\b").when(c == "\f", "\\f")
        return F.when(c.isin('"', "\\"), F.concat(F.lit("\\"), c)).when(n > 0xFFFF, pair).when((n > 126) | (n < 32), F.coalesce(short, hexed(n))).otherwise(c)

    quoted = lambda t: F.concat(F.lit('"'), F.array_join(F.transform(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), char), ""), F.lit('"'))
    return F.concat(F.lit("["), F.array_join(F.transform(dimensions, quoted), ", "), F.lit("]"))
