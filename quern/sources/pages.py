"""Documents as pages: files, texts and (where a PDF library is installed) PDFs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import clean_page_text, estimate_tokens, pack_paragraphs

MAX_TOKENS = 2048
#: Token estimate and text of a page that has pictures but no text.
VISUAL_TOKENS, VISUAL_TEXT = 50, "[Visual Page]"
# The name of a document without one, and the resolution of rendered pages.
DEFAULT_NAME, RENDER_DPI = "document.pdf", 150


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(doc_name, doc_hash, content): binary files under ``path``; identity is the SHA-256 of the bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("doc_name"), F.sha2("content", 256).alias("doc_hash"), "content")


def read_buffers(spark: SparkSession, buffers: list[tuple[str | None, bytes | bytearray | memoryview]]) -> DataFrame:
    """(doc_name, doc_hash, content) of documents held in memory; one without a name is called ``DEFAULT_NAME``."""
    rows = [(name or DEFAULT_NAME, bytearray(content)) for name, content in buffers]
    files = spark.createDataFrame(rows, "doc_name string, content binary")
    return files.select("doc_name", F.sha2("content", 256).alias("doc_hash"), "content")


def page_records(chunks: DataFrame) -> DataFrame:
    """The seven columns of a page that extraction from buffers works on."""
    image = F.col("image_bytes") if "image_bytes" in chunks.columns else F.lit(None).cast("binary")
    return chunks.select("clean_text", F.col("doc_name").alias("source_doc_name"), "page_number", "doc_hash", "has_images", image.alias("image_bytes"), "provenance_modality")


def first_pages(pages: DataFrame, most: int) -> DataFrame:
    """Pages up to number ``most``."""
    return pages.where(F.col("page_number") <= most)


def text_pages(files: DataFrame, page_break: str = "\f") -> DataFrame:
    """(doc_name, doc_hash, page_number, raw_text): pages of text files, parted by form feeds."""
    pages = files.select("doc_name", "doc_hash", F.posexplode(F.split(F.decode("content", "UTF-8"), page_break)).alias("p", "raw_text"))
    return pages.select("doc_name", "doc_hash", (F.col("p") + 1).alias("page_number"), "raw_text")


def pdf_pages(files: DataFrame) -> DataFrame:
    """(doc_name, doc_hash, page_number, raw_text, has_tables, has_images, image_bytes) of PDF files.

    Pages with pictures are rendered as JPEG at ``RENDER_DPI``. Needs the optional package ``pymupdf`` on the workers; without it the
    query fails with a clear message.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import pymupdf
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the package pymupdf on the workers") from e
        for batch in batches:
            for name, digest, content in zip(batch["doc_name"], batch["doc_hash"], batch["content"]):
                rows = []
                with pymupdf.open(stream=content, filetype="pdf") as doc:
                    for n, page in enumerate(doc, 1):
                        drawn = len(page.get_drawings())
                        visual = bool(page.get_images()) or drawn > 4
                        image = page.get_pixmap(dpi=RENDER_DPI).tobytes("jpeg") if visual else None
                        rows.append((name, digest, n, page.get_text(), bool(page.find_tables().tables) or drawn > 4, visual, image))
                yield pd.DataFrame(rows, columns=["doc_name", "doc_hash", "page_number", "raw_text", "has_tables", "has_images", "image_bytes"])

    return files.mapInPandas(parse, "doc_name string, doc_hash string, page_number int, raw_text string, has_tables boolean, has_images boolean, image_bytes binary")


def html_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, clean_text, has_tables, has_images) of HTML pages, by their tags."""
    bare = F.regexp_replace(F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return pages.select(
        key, clean_page_text(bare).alias("clean_text"),
        F.regexp_like(html, F.lit(r"(?i)<table")).alias("has_tables"), F.regexp_like(html, F.lit(r"(?i)<(?:img|svg)")).alias("has_images"),
    )


def modality(has_images):
    """VISUAL_CHART where a page has pictures, else TEXT."""
    return F.when(F.coalesce(has_images, F.lit(False)), F.lit("VISUAL_CHART")).otherwise(F.lit("TEXT"))


def chunk_pages(pages: DataFrame, max_tokens: int = MAX_TOKENS, separator: str = "\n\n") -> DataFrame:
    """Page chunks of raw pages: cleaned, pages over the limit packed by paragraphs.

    ``pages`` has doc_name, doc_hash, page_number, raw_text and, optionally,
    has_tables and has_images. A page without text or pictures gives nothing; a
    page with pictures only has a fixed text and estimate.
    """
    for flag in ("has_tables", "has_images"):
        if flag not in pages.columns:
            pages = pages.withColumn(flag, F.lit(False))
    clean = pages.withColumn("clean", clean_page_text(F.coalesce("raw_text", F.lit("")))).where((F.col("clean") != "") | F.col("has_images"))
    shown = F.when(F.col("clean") == "", F.array(F.lit(VISUAL_TEXT))).otherwise(pack_paragraphs(F.col("clean"), max_tokens, separator))
    kept = ["image_bytes"] if "image_bytes" in pages.columns else []
    parts = clean.select("doc_name", "doc_hash", "page_number", "has_tables", "has_images", *kept, F.col("clean"), F.posexplode(shown).alias("chunk_index", "clean_text"))
    tokens = F.when(F.col("clean") == "", F.lit(VISUAL_TOKENS)).otherwise(estimate_tokens(F.col("clean_text")))
    return parts.withColumn("token_estimate", tokens).withColumn("provenance_modality", modality(F.col("has_images"))).drop("clean")
