"""Text expressions: cleaning, token estimates, canonical keys, paragraph packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name a legal form, and the keys of names without any other word.
LEGAL_NOISE = ("limited", "ltd", "inc", "corp", "corporation", "llp", "pvt", "private")
NO_ENTITY, ONLY_NOISE = "unknown_entity", "entity"
NO_ATTRIBUTE, ONLY_MARKS = "general_attribute", "attribute"
TOKENS_PER_WORD = 1.3

#: Blank characters beyond ASCII, as a Java character class body.
BLANK = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """``text`` without blanks of any kind at its ends."""
    return F.regexp_replace(text, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.regexp_extract_all(text, F.lit(rf"[^{BLANK}]+"), F.lit(0))


def estimate_tokens(text: Column) -> Column:
    """1.3 tokens a word, rounded down, at least 1; null and empty texts count 1."""
    n = F.size(words(F.coalesce(text, F.lit("")))).cast("double")
    return F.greatest(F.lit(1), F.floor(n * F.lit(TOKENS_PER_WORD)).cast("int"))


def title(text: Column) -> Column:
    """Each run of letters with a capital first letter and small others, digits and marks separating runs."""
    parts = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000_000)))), "")


def short_name(doc: Column) -> Column:
    """A document's name without its file endings."""
    return F.replace(F.replace(doc, F.lit("-excerpt.pdf"), F.lit("")), F.lit(".pdf"), F.lit(""))


def clean_page_text(raw: Column) -> Column:
    """Line ends as LF, no-break spaces as spaces, no blanks at line ends, at most three line ends in a row."""
    t = F.regexp_replace(raw, r"\r\n?", "\n")
    t = F.replace(t, F.lit("\u00a0"), F.lit(" "))
    t = F.regexp_replace(t, r"[ \t\x0b\f]+(?=\n|$)", "")
    return strip(F.regexp_replace(t, r"\n{4,}", "\n\n\n"))


def grounding_text(text: Column) -> Column:
    """Lower case, marks deleted, blanks collapsed: the form in which quotes are looked for. Null gives ''."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^\p{{L}}\p{{N}}_{BLANK}]", "")
    return strip(F.regexp_replace(t, rf"[{BLANK}]+", " "))


def token_set(text: Column) -> Column:
    """Distinct words of ``text`` in lower case, marks read as blanks."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " ")
    return F.array_distinct(words(t))


def entity_key(entity: Column) -> Column:
    """Words without legal forms, sorted by code point, joined by underscores."""
    kept = F.array_except(token_set(entity), F.array(*map(F.lit, LEGAL_NOISE)))
    key = F.array_join(F.array_sort(kept), "_")
    return F.when(entity.isNull() | (entity == ""), F.lit(NO_ENTITY)).otherwise(let(key, lambda k: F.when(k == "", F.lit(ONLY_NOISE)).otherwise(k)))


def attribute_key(attribute: Column) -> Column:
    """All words, sorted by code point, joined by underscores."""
    key = F.array_join(F.array_sort(token_set(attribute)), "_")
    return F.when(attribute.isNull() | (attribute == ""), F.lit(NO_ATTRIBUTE)).otherwise(let(key, lambda k: F.when(k == "", F.lit(ONLY_MARKS)).otherwise(k)))


def fact_id(entity: Column, attribute: Column, doc_hash: Column, page: Column, raw_value: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a fact's coordinates."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = [F.lower(strip(text(entity))), F.lower(strip(text(attribute))), text(doc_hash), text(page), strip(text(raw_value))]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def pack_paragraphs(text: Column, max_tokens: int, separator: str = "\n\n") -> Column:
    """array<string>: consecutive paragraphs together while they stay within ``max_tokens``.

    A paragraph that exceeds the limit alone stays whole; a text within the
    limit is one piece.
    """
    paragraphs = F.transform(F.split(text, separator), lambda p: F.struct(p.alias("p"), estimate_tokens(p).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"), F.lit(False).alias("open"))

    def add(acc: Column, x: Column) -> Column:
        flush = acc["open"] & (acc["n"] + x["n"] > max_tokens)
        return F.struct(
            F.when(flush, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(acc["open"] & ~flush, F.concat(acc["cur"], F.lit(separator), x["p"])).otherwise(x["p"]).alias("cur"),
            F.when(acc["open"] & ~flush, acc["n"] + x["n"]).otherwise(x["n"]).alias("n"),
            F.lit(True).alias("open"),
        )

    packed = F.aggregate(paragraphs, start, add, lambda a: F.when(a["open"], F.array_append(a["done"], a["cur"])).otherwise(a["done"]))
    return F.when(estimate_tokens(text) > max_tokens, packed).otherwise(F.array(text))
