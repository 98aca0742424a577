"""Queries of this package's operators; their SQL twins are in ``sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import BLANK
from quern.llm import encoding, groups, names, packing, splitting, tokens
from quern.llm.sql import SQL  # noqa: F401
from quern.session import checkpointed, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.corroborated_groups(table(spark, sf_dir, "relationships", "fact_id_a", "fact_id_b", "case_type"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "page_chunks", "chunk_id", "clean_text")
    return splitting.over_limit(chunks, "chunk_id", "clean_text").selectExpr("key AS chunk_id")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "page_chunks", "chunk_id", "clean_text")
    return splitting.split_texts(chunks, "chunk_id", "clean_text")


def p3_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every text cut into pieces: what the pieces without their overlaps give, and whether all are within the limit and overlap as asked."""
    pieces = p3_pieces(spark, sf_dir)
    before = F.lag("word_end").over(Window.partitionBy("chunk_id").orderBy("piece"))
    shared = pieces.withColumn("shared", F.coalesce(before - F.col("word_start"), F.lit(0)))
    blank, tokens = f"[{BLANK}]", lambda n: F.floor(n * 13 / 10)
    own = F.regexp_replace("text", F.concat(F.lit(f"^(?:[^{BLANK}]+{blank}+){{"), F.col("shared").cast("string"), F.lit("}")), F.lit(""))
    last = F.max("piece").over(Window.partitionBy("chunk_id")) == F.col("piece")
    # the last piece may not need as much as the overlap; slightly fewer is one word at most
    full = (F.col("piece") == 0) | last | tokens(F.col("shared")).between(splitting.OVERLAP - 2, splitting.OVERLAP)
    checked = shared.select("chunk_id", "piece", own.alias("own"), (tokens(F.col("word_end") - F.col("word_start")) <= splitting.LIMIT).alias("within"), full.alias("full"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "own"))), lambda x: x["own"]), "")
    return checked.groupBy("chunk_id").agg(F.sha2(whole, 256).alias("digest"), F.bool_and("within").alias("within_limit"), F.bool_and("full").alias("overlaps"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "facts", "entity_canonical", "entity_raw")
    return names.linked_pairs(facts, table(spark, sf_dir, "name_forms"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counted once: the histogram and the assignment both need the sizes
    sizes = checkpointed(tokens.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text"))
    return packing.pack(sizes, "doc_id", "n_tokens")


def p9_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about the containers of ``p9_pack``: documents in them, containers that are too full or whose texts overlap, and whether they are within 1 % of the fewest possible."""
    placed = checkpointed(p9_pack(spark, sf_dir))
    sized = placed.where("size > 0")
    after = F.lead("container_offset", 1).over(Window.partitionBy("container_id").orderBy("container_offset"))
    ends = sized.select("container_id", "size", (F.col("container_offset") + F.col("size")).alias("end"), after.alias("next"))
    used = ends.groupBy("container_id").agg(F.sum("size").alias("used"), F.max("end").alias("end"), F.max((F.col("end") > F.col("next")).cast("int")).alias("overlaps"))
    filled = used.agg(
        F.count_if((F.col("used") > packing.CAPACITY) | (F.col("end") > packing.CAPACITY)).alias("overfull"), F.coalesce(F.sum("overlaps"), F.lit(0)).cast("bigint").alias("overlapping"),
        (F.count("*") <= 1 + 1.01 * F.sum("used") / packing.CAPACITY).alias("within_bound"),
    )
    return filled.join(placed.agg(F.count_distinct("doc_id").alias("documents")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restored_hashes(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_pieces, p3_whole, p4_found, p8_ids, p9_pack, p9_whole, p10_found)}
