"""Reports over facts and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import short_name, title


def chosen(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose ``column`` is one of ``values``; no values mean no restriction."""
    return df.where(F.col(column).isin(*values)) if values else df


def valid(facts: DataFrame) -> DataFrame:
    return facts.where(~F.coalesce(F.col("is_quarantined"), F.lit(False)))


def quarantined(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("is_quarantined"))


def case_counts(relations: DataFrame, case: str = "case_type") -> DataFrame:
    """(case_type, n)."""
    return relations.groupBy(F.col(case).alias("case_type")).agg(F.count("*").alias("n"))


def quarantine_report(facts: DataFrame) -> DataFrame:
    c = F.col
    return quarantined(facts).select(
        c("entity_raw").alias("entity"), c("attribute_raw").alias("attribute"), c("raw_value").alias("value"), c("quarantine_reason").alias("reason"),
        short_name(c("source_doc_name")).alias("document"), c("page_number").alias("page"), c("verbatim_quote").alias("quote"),
        F.coalesce("provenance_modality", F.lit("TEXT")).alias("modality"),
    )


def fact_directory(facts: DataFrame) -> DataFrame:
    c = F.col
    return valid(facts).select(
        c("fact_id"), c("entity_raw").alias("entity"), c("attribute_raw").alias("attribute"), c("raw_value").alias("raw"), c("canonical_value_num").alias("value"),
        c("canonical_unit").alias("unit"), c("scope"), c("temporal_raw").alias("period"), short_name(c("source_doc_name")).alias("document"), c("page_number").alias("page"),
        c("confidence_score").alias("confidence"), title(F.replace(c("attribute_canonical"), F.lit("_"), F.lit(" "))).alias("heading"),
    )


def store_stats(facts: DataFrame) -> DataFrame:
    """One row: valid and quarantined facts, attributes, documents, most recent arrival."""
    ok = ~F.coalesce(F.col("is_quarantined"), F.lit(False))
    return facts.agg(
        F.count_if(ok).alias("valid_facts"), F.count_if(~ok).alias("quarantined_facts"),
        F.count_distinct(F.when(ok, F.lower("attribute_raw"))).alias("attributes"), F.count_distinct(F.when(ok, F.col("doc_hash"))).alias("documents"),
        F.max("ingest_seq").alias("last_seq"),
    )


def bounds_differ(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether two dated facts differ in a bound; both starts must be known."""
    either = ~s1.eqNullSafe(s2) | ~e1.eqNullSafe(e2)
    return s1.isNotNull() & s2.isNotNull() & either


def classification_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1) per label of either column; 0 where undefined."""
    both = df.select(F.col(truth).alias("t"), F.col(predicted).alias("p")).groupBy("t", "p").agg(F.count("*").alias("n"))
    rows = both.select(F.explode(F.array_distinct(F.array("t", "p"))).alias("label"), "t", "p", "n").where(F.col("label").isNotNull())
    hit = F.sum(F.when((F.col("t") == F.col("label")) & (F.col("p") == F.col("label")), F.col("n")).otherwise(0))
    real = F.sum(F.when(F.col("t") == F.col("label"), F.col("n")).otherwise(0))
    said = F.sum(F.when(F.col("p") == F.col("label"), F.col("n")).otherwise(0))
    sums = rows.groupBy("label").agg(hit.alias("hit"), real.alias("real"), said.alias("said"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    pr = sums.select("label", F.col("real").alias("support"), share(F.col("hit"), F.col("said")).alias("precision"), share(F.col("hit"), F.col("real")).alias("recall"))
    return pr.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_scores(scores: DataFrame) -> DataFrame:
    """Unweighted means of ``classification_scores``."""
    return scores.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))


def scorecard(scores: Column, passed_from: float = 8.0) -> Column:
    """struct(score, passed): mean of an array of scores, each clamped to 0..10."""
    clamped = F.transform(scores, lambda s: F.greatest(F.lit(0.0), F.least(F.lit(10.0), s)))
    mean = F.try_divide(F.aggregate(clamped, F.lit(0.0), lambda a, x: a + x), F.size(scores))
    return F.struct(mean.alias("score"), (mean >= passed_from).alias("passed"))


def relative_scale_error(a: Column, b: Column) -> Column:
    return F.try_divide(F.abs(a - b), F.greatest(a, b))


def document_names(facts: DataFrame) -> DataFrame:
    """(source_doc_name): the documents, in order."""
    return facts.select("source_doc_name").where("source_doc_name IS NOT NULL").distinct().orderBy("source_doc_name")


def is_visual_badge(modality: Column) -> Column:
    """Whether a fact is shown with the badge of visual charts."""
    return F.coalesce((modality == "VISUAL_CHART") | F.contains(F.lower(modality), F.lit("visual chart")), F.lit(False))


def card_title(entity: Column, attribute: Column) -> Column:
    """Entity and attribute of an evidence card."""
    named = lambda c, none: F.coalesce(F.nullif(title(c), F.lit("")), F.lit(none))
    return F.concat(named(entity, "Entity"), F.lit(" — "), named(F.replace(attribute, F.lit("_"), F.lit(" ")), "Attribute"))


def evidence_cards(pairs: DataFrame) -> DataFrame:
    """(id, title, document_a, page_a, visual_a, document_b, page_b, visual_b, bounds_differ) of recorded pairs."""
    c = F.col
    side = lambda p: (short_name(c(f"{p}_source_doc_name")).alias(f"document_{p}"), c(f"{p}_page_number").alias(f"page_{p}"), is_visual_badge(c(f"{p}_provenance_modality")).alias(f"visual_{p}"))
    differ = bounds_differ(c("a_start_date"), c("a_end_date"), c("b_start_date"), c("b_end_date"))
    return pairs.select("id", card_title(c("a_entity_raw"), c("a_attribute_raw")).alias("title"), *side("a"), *side("b"), differ.alias("bounds_differ"))
