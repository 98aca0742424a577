"""Candidate facts from page text by declarative rules.

Each rule is a pattern with a label part and a value part. One scan of the pages
collects the matches of all rules by ``regexp_extract_all`` into one array, with
their positions, and explodes it once; what is needed of the page besides (the
organisation it names, the period it hints at) is read before, so that no page
text travels with the matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.periods import hinted_period, page_hints
from quern.functions.text import let, short_name, strip, title
from quern.functions.values import extracted_number
from quern.session import checkpointed, spread

# The rules' vocabulary. Money and count amounts, scales, the words between label and value, notes and what follows a label.
_MONEY = r"(?:₹|Rs\.?|INR|\$)\s*\d+(?:\.\d+)?"
_GROUPED = r"\d{1,3}(?:,\d{3})*"
_SCALE = r"(?:Cr|crore|crores|million|billion|Mn|Bn|Lakh|Lakhs|M|B)"
_SHORT_SCALE = r"(?:million|Cr|crores|billion)"
_VERBS = r"(?:of|was|reached|grew to|aggregating to|is|stood at)"
_NOTE = r"(?:\(\d+(?:,\d+)?\))?"
_MARK = r"(?:\(\d+\))?"
_TAIL = r"[A-Za-z\s\n]*"
# Measures that documents state beside or above their name: (pattern, attribute, unit).
KPI_RULES = (
    (rf"[>~]?\d+(?:\.\d+)?\s*(?:Bn|billion|Mn|million)?\s*{_MARK}\s*\n?\s*Express parcel shipments{_TAIL}", "Express Parcel Volume", "PARCELS"),
    (rf"(?:{_GROUPED}|\d+)\s*{_MARK}\s*\n?\s*(?:Pin codes covered|pin codes)", "PIN Code Coverage", "PIN_CODES"),
    (rf"[>~]?\d+(?:\.\d+)?\s*(?:Mn|million|K)?\s*tonnes\s*{_NOTE}\s*\n?\s*Part-truckload freight{_TAIL}", "PTL Freight Delivered", "TONNES"),
    (rf"(?:{_GROUPED}|\d+)\s*{_NOTE}\s*\n?\s*(?:Workforce strength|employees|workforce)", "Workforce Strength", "COUNT"),
    (rf"\d+(?:\.\d+)?\s*(?:Mn|million)?\s*Sq ft\s*{_MARK}\s*\n?\s*Logistics area{_TAIL}", "Logistics Area Under Management", "SQ_FT"),
    (rf"(?:[>~]?{_GROUPED}|\d+)\s*{_NOTE}\s*\n?\s*Active customers", "Active Customers", "COUNT"),
    (r"\d+(?:\.\d+)?\s*(?:Mn|million|Bn|billion|K)?\s*Express parcels shipped", "Express Parcel Volume", "PARCELS"),
    (rf"(?:{_MONEY}|{_GROUPED})\s*(?:Mn|million|Cr|crore|crores|Bn|billion)?\s*Revenue from services", "Revenue from Services", "INR"),
    (rf"(?:{_MONEY}|{_GROUPED})\s*(?:Mn|million|Cr|crore|crores|Bn|billion)?\s*EBITDA\b", "EBITDA", "INR"),
)
#: Number inside a KPI match; its first alternative stops before a comma.
KPI_NUMBER = rf"[>~]?\d+(?:\.\d+)?\s*(?:Bn|Mn|million|billion|K)?|{_GROUPED}"
MONEY_RULE = rf"([A-Z][A-Za-z0-9\s,\(\)]{{3,40}}?)\s*{_VERBS}\s*({_MONEY}\s*{_SCALE}?|{_GROUPED}(?:\.\d+)?\s*{_SHORT_SCALE})"
PERCENT_RULE = r"([A-Z][A-Za-z0-9\s]{2,30}?)\s*(?:of|margin|growth|cagr|share)?\s*[:=]?\s*(\d+(?:\.\d+)?\s*%)"
CHART_RULE = (
    r"(?:Chart|Graph|Figure|Plot|Infographic)\s*[:\-]?\s*([A-Za-z0-9\s,\(\)]{3,40}?)\s*(?:stood at|reached|was|grew to)?\s*"
    rf"({_MONEY}\s*{_SCALE}?|{_GROUPED}(?:\.\d+)?\s*{_SHORT_SCALE}?)"
)
SKIPPED_LABELS = ("table", "page", "section", "dated")
RUPEE_MARKS = ("₹", "Rs", "INR", "Cr")
LONGEST_LABEL = 35


# Endings of the names of organisations, words in the names of documents of the state, and who speaks in those.
ORGANISATIONS = "Limited|Ltd|Corporation|Corp|Bank|Ministry|Department|Government|Inc|LLP|Authority|Council|Institute|Company"
STATE_DOCUMENTS, STATE = "economic survey|pib|press release|bulletin|budget", "Government of India"


@dataclass(frozen=True)
class Rule:
    """How the matches of patterns become facts: ``patterns`` are (pattern, attribute, unit), None where the match tells."""

    number: int
    scope: str
    confidence: float
    patterns: tuple[tuple[str, str | None, str | None], ...]
    fallback: str | None = None
    modality: str = "TEXT"


KPI = Rule(1, "India", 0.92, KPI_RULES)
MONEY = Rule(2, "Consolidated", 0.90, ((MONEY_RULE, None, None),), "Financial Metric")
PERCENT = Rule(3, "GLOBAL", 0.88, ((PERCENT_RULE, None, "PERCENT"),))
CHART = Rule(4, "Consolidated", 0.92, ((CHART_RULE, None, None),), "Visual Chart Metric", "VISUAL_CHART")


def rupees_or_dollars(value: Column) -> Column:
    """INR if the value has a rupee mark, else USD."""
    marked = F.lit(False)
    for m in RUPEE_MARKS:
        marked = marked | F.contains(value, F.lit(m))
    return F.when(marked, F.lit("INR")).otherwise(F.lit("USD"))


def document_speaker(doc_name: Column) -> Column:
    """Who a document's name tells that it is by: the state, or the name itself without number and endings."""
    bare = F.translate(short_name(F.regexp_replace(doc_name, r"^\d+\s*[\-_]?", "")), "-_", "  ")
    return let(strip(bare), lambda stem: F.when(F.regexp_like(F.lower(stem), F.lit(STATE_DOCUMENTS)), F.lit(STATE)).otherwise(title(stem)))


def entity_of_page(doc_name: Column, text: Column) -> Column:
    """The first organisation that the text names, else the document's speaker."""
    named = F.regexp_extract(text, rf"\b([A-Z][A-Za-z0-9&.\s]{{2,35}}\s+(?:{ORGANISATIONS}))\b", 1)
    return F.coalesce(F.nullif(strip(named), F.lit("")), document_speaker(doc_name))


def _found(rule: Rule, n: int, where: Column) -> Column:
    """array<struct> of the facts that a pattern finds in ``clean_text``; ``where`` is the note that charts add to their quotes."""
    pattern, attribute, unit = rule.patterns[n]
    part = lambda m, i: F.regexp_extract(m, "(?i)^" + pattern, i)

    def fact(m: Column, i: Column) -> Column:
        quote = strip(m)
        if attribute is not None:
            label, name = F.lit(""), F.lit(attribute)
            number = strip(F.regexp_extract(quote, KPI_NUMBER, 0))
            value = F.coalesce(F.nullif(number, F.lit("")), quote)
        else:
            label, value = part(m, 1), strip(part(m, 2))
            name = strip(label)
            if rule.fallback is not None:
                name = F.when(F.length(name) < LONGEST_LABEL, name).otherwise(F.lit(rule.fallback))
        if rule is CHART:
            quote = F.concat(F.lit("[Visual Chart]: "), quote, where)
        return F.struct(
            F.lit(rule.number).alias("rule"), F.lit(n).alias("pattern_no"), i.alias("match_pos"), name.alias("attribute"), value.alias("raw_value"),
            (F.lit(unit) if unit else rupees_or_dollars(value)).alias("canonical_unit"), F.lit(rule.scope).alias("scope"), F.lit(rule.confidence).alias("confidence_score"),
            quote.alias("verbatim_quote"), F.lit(rule.modality).alias("provenance_modality"), label.alias("label"),
        )

    facts = F.transform(F.regexp_extract_all("clean_text", F.lit("(?i)" + pattern), F.lit(0)), fact)
    if rule is MONEY:
        return F.filter(facts, lambda f: ~F.regexp_like(F.lower(f["label"]), F.lit("|".join(SKIPPED_LABELS))))
    return F.filter(facts, lambda f: f["raw_value"] != "") if rule is CHART else facts


def rule_facts(pages: DataFrame, *rules: Rule) -> DataFrame:
    """The columns of ``pages`` but its text, with one row per match of the rules' patterns.

    The page is searched once per pattern; the parts are read off the short matches.
    """
    where = F.concat(F.lit(" (X-Axis: "), F.col("doc_name"), F.lit(" Pg "), F.col("page_number").cast("string"), F.lit(")"))
    kept = [c for c in pages.columns if c != "clean_text"]
    found = F.concat(*(_found(rule, n, where) for rule in rules for n in range(len(rule.patterns))))
    return spread(pages).select(*kept, F.inline(found)).drop("label")


def kpi_facts(pages: DataFrame) -> DataFrame:
    return rule_facts(pages, KPI)


def money_facts(pages: DataFrame) -> DataFrame:
    return rule_facts(pages, MONEY)


def percent_facts(pages: DataFrame) -> DataFrame:
    return rule_facts(pages, PERCENT)


def chart_facts(pages: DataFrame) -> DataFrame:
    return rule_facts(pages, CHART)


def extract_facts(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Facts of page chunks: one row per quote and chunk, the first rule and match winning.

    ``chunks`` has ``key``, doc_name, doc_hash, page_number, clean_text. Chunks
    with a null or empty text give nothing.
    """
    pages = spread(chunks.where(F.col("clean_text") != "")).select(
        key, "doc_name", "doc_hash", "page_number", "clean_text", entity_of_page(F.col("doc_name"), F.col("clean_text")).alias("entity"), page_hints(F.col("clean_text")).alias("hints")
    )
    every = rule_facts(pages, KPI, MONEY, PERCENT, CHART)
    first = Window.partitionBy(key, F.lower(strip(F.col("verbatim_quote")))).orderBy("rule", "pattern_no", "match_pos")
    once = every.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.withColumn("canonical_value_num", extracted_number(F.col("raw_value"))).withColumn("temporal", hinted_period(F.col("verbatim_quote"), F.col("hints"))).drop("hints")


MODEL_FACT = "entity string, attribute string, raw_value string, canonical_value_num double, canonical_unit string, scope string, confidence_score double, temporal_raw string, verbatim_quote string"


def model_facts(chunks: DataFrame, model: Callable[[dict], Iterable[dict]], key: str = "chunk_id") -> DataFrame:
    """Facts that ``model`` reads from chunks; the rules read those on which it fails.

    ``model`` gets a chunk as a dict (the columns of ``chunks``) and gives dicts
    with the fields of ``MODEL_FACT``, missing ones being null. Whatever it says
    of their source, facts belong to their chunk: document, page and modality are
    the chunk's (charts where the quote says so or the page has pictures). A
    chunk without text and pictures isn't shown to it. The result has the
    columns of ``extract_facts`` that both ways have.
    """
    fields = [f.split()[0] for f in MODEL_FACT.split(", ")]
    source = f"{key} {dict(chunks.dtypes)[key]}, doc_name string, doc_hash string, page_number int, provenance_modality string"
    columns = [c.split()[0] for c in source.split(", ")]
    has_images = F.coalesce("has_images", F.lit(False)) if "has_images" in chunks.columns else F.lit(False)
    shown = chunks.where((F.coalesce("clean_text", F.lit("")) != "") | has_images)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk in batch.to_dict("records"):
                own = [chunk[key], chunk["doc_name"], chunk["doc_hash"], chunk["page_number"]]
                try:
                    facts = [dict(f) for f in model(dict(chunk))]
                except Exception:  # whatever a model raises, the rules take over
                    rows.append([*own, None, True, *[None] * len(fields)])
                    continue
                for f in facts:
                    chart = "[visual chart]" in str(f.get("verbatim_quote") or "").lower() or chunk.get("has_images") is True
                    rows.append([*own, CHART.modality if chart else chunk.get("provenance_modality") or "TEXT", False, *(f.get(x) for x in fields)])
            yield pd.DataFrame(rows, columns=[*columns, "failed", *fields])

    found = checkpointed(shown.mapInPandas(read, f"{source}, failed boolean, {MODEL_FACT}"))
    kept = [*columns, *(f for f in fields if f != "temporal_raw")]
    ruled = extract_facts(chunks.join(found.where("failed").select(key).distinct(), key, "left_semi"), key).withColumn("temporal_raw", F.col("temporal.raw"))
    return found.where("NOT failed").select(*kept, "temporal_raw").unionByName(ruled.select(*kept, "temporal_raw"))
