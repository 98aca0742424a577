"""The fact store: an append-only log of deliveries, with incremental reconciliation.

Two parquet tables under one folder, ``facts`` and ``relationships``, each with a
partition per batch. The current state of a fact is its last delivery
(``reconcile.latest``). A batch replaces its own partitions, relationships first
and facts last, and its relationships are seen only with its facts: a batch that
failed half-way shows nothing, and one that is replayed adds nothing twice.

Within a batch, facts lie in buckets of their attribute, so that a later batch is
compared with the buckets of its own attributes only. They are written once, to
``staged``, and moved from there when the batch is whole.

Relationships grow with the square of a thing's facts; they are kept in slices
(``tally``), a byte for each pair, and spelt out when they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.periods import stated_period
from quern.functions.text import attribute_key, entity_key, fact_id, strip
from quern.functions.values import value_and_unit
from quern.operators import tally
from quern.operators.reconcile import latest, new_slices, slice_cases, slice_relationships
from quern.session import checkpointed, collect_bounded
from quern.sources.schemas import FACTS, RELATIONSHIPS, conform

#: Buckets of attributes that a batch's facts are laid out in.
BUCKETS = 32
_PLACE = [T.StructField("batch", T.StringType()), T.StructField("bucket", T.IntegerType())]


def attribute_bucket(attribute: Column) -> Column:
    return F.pmod(F.xxhash64(attribute), F.lit(BUCKETS)).cast("int")


def canonicalize(facts: DataFrame) -> DataFrame:
    """Facts with canonical keys, value, unit and period, as they enter the store.

    Keys and unit are always set anew; the value only where it is missing; the
    period only where its text isn't blank, replacing bounds and granularity.
    A missing fact id is computed.
    """
    c = F.col
    parsed = facts.withColumn("_v", value_and_unit(c("raw_value"), c("canonical_unit"))).withColumn("_t", stated_period(c("temporal_raw")))
    has = F.coalesce(strip(c("temporal_raw")) != "", F.lit(False))
    pick = lambda n: F.when(has, c(f"_t.{n}")).otherwise(c(n))
    return parsed.withColumns({
        "entity_canonical": entity_key(c("entity_raw")), "attribute_canonical": attribute_key(c("attribute_raw")),
        "canonical_value_num": F.coalesce("canonical_value_num", c("_v.value")), "canonical_unit": c("_v.unit"),
        "start_date": pick("start_date"), "end_date": pick("end_date"), "granularity": F.coalesce(pick("granularity"), F.lit("UNKNOWN")),
        "temporal_raw": F.when(has, c("_t.raw")).otherwise(c("temporal_raw")),
        "fact_id": F.coalesce(F.nullif("fact_id", F.lit("")), fact_id(c("entity_raw"), c("attribute_raw"), c("doc_hash"), c("page_number"), c("raw_value"))),
    }).drop("_v", "_t")


def unseen_documents(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The facts of a batch whose document isn't in the store yet."""
    return batch.join(stored.select("doc_hash").distinct(), "doc_hash", "left_anti")


class FactStore:
    """Facts and relationships under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> tuple:
        """The file system and the path of ``name``."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _exists(self, name: str) -> bool:
        files, path = self._at(name)
        return files.exists(path)

    def _delete(self, name: str) -> None:
        files, path = self._at(name)
        files.delete(path, True)

    def _move(self, name: str, to: str) -> None:
        """Puts ``name`` in the place of ``to``."""
        (files, path), (_, target) = self._at(name), self._at(to)
        files.delete(target, True)
        files.mkdirs(target.getParent())
        if not files.rename(path, target):
            raise OSError(f"{path} can't be moved to {target}")

    def _read(self, name: str) -> DataFrame:
        placed = T.StructType([*FACTS.fields, *_PLACE])
        return self.spark.read.schema(placed).parquet(f"{self.path}/{name}") if self._exists(name) else self.spark.createDataFrame([], placed)

    def _slices(self) -> DataFrame:
        """The slices of the batches whose facts are stored."""
        placed = f"{tally.SLICE}, batch string"
        if not self._exists("relationships"):
            return self.spark.createDataFrame([], placed)
        return self.spark.read.schema(placed).parquet(f"{self.path}/relationships").join(self._placed().select("batch").distinct(), "batch", "left_semi")

    def _placed(self) -> DataFrame:
        return self._read("facts")

    def deliveries(self) -> DataFrame:
        """Every delivery."""
        return self._placed().select(*FACTS.names)

    def facts(self) -> DataFrame:
        """The current facts."""
        return latest(self.deliveries())

    def quarantined(self) -> DataFrame:
        return self.facts().where("is_quarantined")

    def relationships(self) -> DataFrame:
        """The relationships of the batches whose facts are stored."""
        return slice_relationships(self._slices().drop("batch"))

    def cases(self) -> DataFrame:
        """(case_type, pairs): ``relationships`` counted, without spelling them out."""
        return slice_cases(self._slices())

    def has_document(self, doc_hash: str) -> bool:
        return not self.deliveries().where(F.col("doc_hash") == doc_hash).isEmpty()

    def reset(self) -> None:
        for name in ("facts", "relationships", "staged"):
            self._delete(name)

    def _current(self, stored: DataFrame, buckets: list[int]) -> DataFrame:
        """The current facts in ``buckets``: whole rows are read of those only, of the others just ids and numbers."""
        last = stored.groupBy("fact_id").agg(F.max("ingest_seq").alias("ingest_seq"))
        return stored.where(F.col("bucket").isin(*buckets)).join(last, ["fact_id", "ingest_seq"], "left_semi").select(*FACTS.names)

    def ingest(self, batch: DataFrame, fuzzy: bool = True, batch_id: str | None = None) -> DataFrame:
        """Adds a batch and returns the new relationships.

        Facts of documents that are already stored are dropped. The rest is
        canonicalised and compared with what was there and within the batch
        (different documents only, by ``ingest_seq``); pairs of old facts are
        never looked at again.

        ``batch_id`` names the batch's partitions; without it they are named by
        the batch's content. A batch that comes again under its name replaces
        what it wrote before, and is compared as if it hadn't been there.
        """
        given = conform(batch, FACTS)
        if batch_id is None:
            given = checkpointed(given)
            sums = given.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*FACTS.names).cast("decimal(38,0)")).alias("h")).first()
            batch_id = f"c{sums['n']}_{abs(sums['h'] or 0)}"
        stored = self._placed().where(F.col("batch") != batch_id)
        fresh = conform(canonicalize(unseen_documents(given, stored)), FACTS).withColumn("bucket", attribute_bucket(F.col("attribute_canonical")))
        # written out, as plans over the store's own files must not be read after those are replaced
        staged = f"staged/batch={batch_id}"
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{staged}")
        new = self._read(staged)
        buckets = [r[0] for r in collect_bounded(new.select("bucket").distinct(), BUCKETS, "buckets")]
        if not buckets:
            self._delete(staged)
            return self.spark.createDataFrame([], RELATIONSHIPS)
        found = new_slices(self._current(stored, buckets), new.select(*FACTS.names), fuzzy)
        kept = f"{self.path}/relationships/batch={batch_id}"
        found.write.mode("overwrite").option("compression", "zstd").parquet(kept)
        self._move(staged, f"facts/batch={batch_id}")
        return slice_relationships(self.spark.read.schema(tally.SLICE).parquet(kept))


def ingest_totals(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """(source_doc_name, facts, relations): extracted facts of each document and the relationships that its facts added as the newer side."""
    by_doc = facts.groupBy("source_doc_name").agg(F.count("*").alias("facts"))
    newer = relations.select(F.col("fact_id_b").alias("fact_id")).join(latest(facts).select("fact_id", "source_doc_name"), "fact_id")
    return by_doc.join(newer.groupBy("source_doc_name").agg(F.count("*").alias("relations")), "source_doc_name", "left").select(
        "source_doc_name", "facts", F.coalesce("relations", F.lit(0)).alias("relations")
    )
