"""Integrity gate: is a fact's quote on its page, and does a numeric claim have a horizon."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.similarity import quote_is_near
from quern.functions.text import grounding_text, strip

# Words that make an attribute numeric, the mark of chart quotes, and the reasons given.
NUMERIC_WORDS = (
    "revenue", "arr", "mrr", "ebitda", "income", "growth", "margin", "percentage", "count", "amount", "headcount", "price", "cost", "valuation",
)
CHART_QUOTE, CHART = "[Visual Chart]", "VISUAL_CHART"
UNVERIFIED = "UNVERIFIED_SOURCE_QUOTE: Quote not found in page text"
NO_AXIS = "DEGENERATE_CHART_AXIS: Missing time horizon on graph legend or axis"
NO_HORIZON = "DEGENERATE_TEMPORAL_BOUND: Numeric claim lacks time horizon"


def is_numeric(value: Column, raw: Column, attribute: Column) -> Column:
    """A number, a digit in the raw value, or a numeric word inside the attribute."""
    low = F.lower(F.coalesce(attribute, F.lit("")))
    named = reduce(lambda c, w: c | F.contains(low, F.lit(w)), NUMERIC_WORDS[1:], F.contains(low, F.lit(NUMERIC_WORDS[0])))
    return value.isNotNull() | F.coalesce(F.regexp_like(raw, F.lit(r"\p{Nd}")), F.lit(False)) | named


def is_visual(modality: Column, quote: Column) -> Column:
    return F.coalesce(modality == CHART, F.lit(False)) | F.coalesce(F.startswith(quote, F.lit(CHART_QUOTE)), F.lit(False))


def page_texts(chunks: DataFrame) -> DataFrame:
    """(doc_hash, page_number, page_text): the chunks of each page in order; repeated chunks once."""
    order = F.array_sort(F.collect_set(F.struct("chunk_index", "clean_text")))
    kept = chunks.where(F.col("clean_text").isNotNull())
    return kept.groupBy("doc_hash", "page_number").agg(F.array_join(F.transform(order, lambda c: c["clean_text"]), "\n\n").alias("page_text"))


def with_page_text(facts: DataFrame, pages: DataFrame, grounding: bool = False) -> DataFrame:
    """Facts with ``page_text`` of their page, '' where the page is unknown; with ``grounding``, with ``page_ground`` instead, its grounding form, made once a page."""
    name, text = ("page_ground", grounding_text(F.col("page_text"))) if grounding else ("page_text", F.col("page_text"))
    texts = pages.select("doc_hash", "page_number", text.alias("_page"))
    return facts.join(texts, ["doc_hash", "page_number"], "left").withColumn(name, F.coalesce("_page", F.lit(""))).drop("_page")


def exactly_grounded(quote: Column, page: Column) -> Column:
    """A quote that isn't blank and is part of the page, both in grounding form."""
    return F.coalesce(strip(quote) != "", F.lit(False)) & F.contains(grounding_text(page), grounding_text(quote))


def ground(facts: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Facts with ``is_grounded``; needs ``verbatim_quote`` and ``page_ground`` or ``page_text``.

    The plain search runs in the JVM. Only what it leaves, and only where there
    is a page and a quote with words, goes to Python for the fuzzy search: the
    frame is split, as a UDF behind a condition would see every row.
    """
    page = F.col("page_ground") if "page_ground" in facts.columns else grounding_text(F.col("page_text"))
    quote = grounding_text(F.col("verbatim_quote"))
    exact = facts.withColumn("_exact", F.coalesce(strip(F.col("verbatim_quote")) != "", F.lit(False)) & F.contains(page, quote))
    if not fuzzy:
        return exact.withColumnRenamed("_exact", "is_grounded")
    chance = ~F.col("_exact") & (quote != "") & (page != "")
    sure = exact.where(~chance).withColumn("is_grounded", F.col("_exact"))
    doubtful = exact.where(chance).withColumn("is_grounded", quote_is_near(quote, page))
    return sure.unionByName(doubtful).drop("_exact")


def gate(facts: DataFrame, pages: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Facts with new ``is_quarantined`` and ``quarantine_reason``.

    A reason from before is kept where the fact passes; a flag from before
    without a reason is dropped. Facts of unknown pages count as ungrounded
    unless they describe a chart.
    """
    texts = ground(with_page_text(facts, pages, grounding=True), fuzzy)
    visual = is_visual(F.col("provenance_modality"), F.col("verbatim_quote"))
    numeric = is_numeric(F.col("canonical_value_num"), F.col("raw_value"), F.col("attribute_raw"))
    adrift = F.coalesce(strip(F.col("temporal_raw")) == "", F.lit(True)) | F.coalesce(F.col("granularity") == "UNKNOWN", F.lit(True))
    failed = (
        F.when(~visual & ~F.col("is_grounded"), F.lit(UNVERIFIED))
        .when((numeric | visual) & adrift, F.when(visual, F.lit(NO_AXIS)).otherwise(F.lit(NO_HORIZON)))
    )
    reason = F.coalesce(failed, F.nullif(F.col("quarantine_reason"), F.lit("")))
    return texts.withColumn("_reason", reason).drop("page_ground", "is_grounded", "is_quarantined", "quarantine_reason").select(
        "*", F.col("_reason").isNotNull().alias("is_quarantined"), F.col("_reason").alias("quarantine_reason")
    ).drop("_reason")
