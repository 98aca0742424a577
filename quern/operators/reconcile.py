"""Pairs of facts about one thing in different documents, classified by how they agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.periods import DISJOINT, EQUAL, PERPETUAL, SUBSET, SUPERSET, interval_relation
from quern.functions.similarity import (
    JACCARD_SHARE, RATIO_SHARE, SAME_NAME, compared_text, letter_marks, match_ratio, name_stems,
)
from quern.functions.text import strip
from quern.functions.values import values_match
from quern.operators import tally
from quern.session import checkpointed

# The case names, dimension labels and rationales (four more labels in ``classify``).
CORROBORATION, CONTRADICTION, RECONCILED = "CASE_1_CORROBORATION", "CASE_2_GENUINE_CONTRADICTION", "CASE_3_CONTEXT_RECONCILED"
CONFLICT = "Value Conflict"
AGGREGATION = "Aggregation Scope (Quarterly sub-period vs Full Fiscal Year)"
WHY = {
    CORROBORATION: "Corroborated across documents: Identical values asserted under the same temporal interval and scope despite differing phrasing.",
    CONTRADICTION: "Genuine contradiction: Mutually exclusive figures reported for the exact same reporting period and corporate scope.",
    RECONCILED: "Apparent contradiction reconciled by context: Figures differ due to ",
}
FACT_COLUMNS = (
    "fact_id", "entity_canonical", "attribute_canonical", "entity_raw", "canonical_value_num", "canonical_value_str", "start_date", "end_date",
    "granularity", "temporal_raw", "scope", "canonical_unit", "doc_hash", "page_number", "is_quarantined", "ingest_seq",
)


def latest(facts: DataFrame, key: str = "fact_id", order: str = "ingest_seq") -> DataFrame:
    """The last delivery of each fact; ``max_by`` combines on the map side, so no window sorts a hot key."""
    row = F.struct(*facts.columns)
    return facts.groupBy(key).agg(F.max_by(row, F.col(order)).alias("r")).select("r.*")


def _side(facts: DataFrame, prefix: str) -> DataFrame:
    kept = [c for c in FACT_COLUMNS if c in facts.columns]
    return facts.where(~F.coalesce(F.col("is_quarantined"), F.lit(False))).select(*(F.col(c).alias(f"{prefix}_{c}") for c in kept))


def candidates(facts: DataFrame, newer: DataFrame | None = None) -> DataFrame:
    """Pairs (a_*, b_*) of the same attribute and entity key from different documents, older first.

    With ``newer``, only pairs whose second fact is one of those. Equal keys
    are the join's own keys, so a hot entity is spread over its attributes and
    AQE splits what is still skewed; quarantined facts take no part.
    """
    a, b = _side(facts, "a"), _side(facts if newer is None else newer, "b")
    same = (F.col("a_attribute_canonical") == F.col("b_attribute_canonical")) & (F.col("a_entity_canonical") == F.col("b_entity_canonical"))
    return a.join(b, same & (F.col("a_doc_hash") != F.col("b_doc_hash")) & (F.col("a_ingest_seq") < F.col("b_ingest_seq")))


def _names(side: DataFrame, prefix: str) -> DataFrame:
    """What a side's names, each with its key, are compared by: texts, stems, bits of both, and the attributes they occur with."""
    name, key = f"{prefix}_name", f"{prefix}_entity_canonical"
    seen = side.where(F.col(name) != "").groupBy(name, key).agg(F.collect_set(F.xxhash64(f"{prefix}_attribute_canonical")).alias("attributes"))
    read = seen.select("*", F.length(name).alias("n"), name_stems(F.col(name)).alias("stems"), letter_marks(F.col(name)).alias("m"))
    bits = F.expr("aggregate(stems, 0L, (x, s) -> x | shiftleft(1L, int(pmod(xxhash64(s), 64))))")
    marked = read.select("*", F.size("stems").alias("k"), bits.alias("bits"), *(F.col("m")[i].alias(f"m{i}") for i in range(4))).drop("m")
    # letters and stems that share a bit with another
    hidden = F.col("n") - sum((F.bit_count(f"m{i}") for i in range(1, 4)), F.bit_count("m0"))
    own = marked.select("*", hidden.alias("n_hidden"), (F.col("k") - F.bit_count("bits")).alias("k_hidden"))
    own = own.withColumnsRenamed({c: f"{prefix}_{c}" for c in own.columns if c not in (name, key)})
    # a name without words meets only itself
    stems = F.col(f"{prefix}_stems")
    return own.withColumn("stem", F.explode(F.when(F.size(stems) > 0, stems).otherwise(F.array(name))))


def _near_names(a: DataFrame, b: DataFrame, least: float = SAME_NAME) -> DataFrame:
    """(a_name, a_entity_canonical, b_name, b_entity_canonical, attribute) of unequal keys whose names reach ``least``, a's the first.

    ``attribute`` is the hash of one that both occur with, a row for each.

    Names share a word beginning, or the blend can't reach 0.7, and are joined
    on each of those. What bounds the blend from above goes from cheap to dear:
    bits and lengths, attributes in common, the word overlap itself; the
    characters of the rest are matched in Python.
    """
    c = F.col
    both = lambda *names: [F.bit_count(c(f"a_{n}").bitwiseAND(c(f"b_{n}"))) for n in names]
    letters = sum(both("m1", "m2", "m3"), both("m0")[0]) + F.least("a_n_hidden", "b_n_hidden")
    shared = both("bits")[0] + F.least("a_k_hidden", "b_k_hidden")
    ratio = 2 * F.least(letters, "a_n", "b_n") / (c("a_n") + c("b_n"))
    overlap = lambda x: F.coalesce(F.try_divide(x, c("a_k") + c("b_k") - x), F.lit(0.0))
    blend = lambda x, y: F.lit(JACCARD_SHARE) * x + F.lit(RATIO_SHARE) * y
    equal = c("a_name") == c("b_name")
    differ = ~F.coalesce(c("a_entity_canonical") == c("b_entity_canonical"), F.lit(False))
    met = a.join(b, "stem").where(differ & (equal | (blend(overlap(shared), ratio) >= least - 1e-9))).where(F.arrays_overlap("a_attributes", "b_attributes"))
    common = F.array_intersect("a_stems", "b_stems")
    once = met.where(F.coalesce(F.try_element_at(common, F.lit(1)), c("a_name")) == c("stem"))
    likely = once.withColumn("jaccard", overlap(F.size(common))).where(equal | (blend(c("jaccard"), ratio) >= least - 1e-9))
    pair = ("a_name", "a_entity_canonical", "b_name", "b_entity_canonical")
    matched = likely.select(*pair, "jaccard", F.array_intersect("a_attributes", "b_attributes").alias("attributes"), match_ratio(c("a_name"), c("b_name")).alias("ratio"))
    return matched.where(equal | (blend(c("jaccard"), c("ratio")) >= least)).select(*pair, F.explode("attributes").alias("attribute"))


def similar_names(facts: DataFrame, least: float = SAME_NAME) -> DataFrame:
    """(name_a, name_b, similarity) of different entity spellings that reach ``least``, both ways round.

    Only the texts that are compared count, and many spellings share one: each
    pair of those is bounded and matched once (``tally.near_texts``), then spelt out.
    """
    names = facts.select(F.col("entity_raw").alias("raw")).where(F.col("raw").isNotNull()).distinct()
    texts = checkpointed(names.select("raw", compared_text(F.col("raw")).alias("name")))
    read = _stemmed(texts.select("name").where("name <> ''").distinct())
    scored = tally.near_texts(read, least)
    # spellings of one text: its words and letters are the same
    same = read.where("stems <> ''").select(F.col("name").alias("a_name"), F.col("name").alias("b_name"), F.lit(JACCARD_SHARE + RATIO_SHARE).alias("similarity")).distinct()
    side = lambda p: texts.select(F.col("raw").alias(f"name_{p}"), F.col("name").alias(f"{p}_name"))
    return scored.unionByName(same).join(side("a"), "a_name").join(side("b"), "b_name").where(f"name_a <> name_b AND similarity >= {least}").select("name_a", "name_b", "similarity")


def fuzzy_candidates(facts: DataFrame, newer: DataFrame | None = None) -> DataFrame:
    """``candidates`` plus the pairs whose entity spellings differ in key but are similar enough.

    ``similarity`` depends on the compared texts alone, so each spelling is
    read once and only those texts are matched that occur with one attribute.
    A key that is null equals none.
    """
    sides = {"a": _side(facts, "a"), "b": _side(facts if newer is None else newer, "b")}
    raw = [x.select(F.col(f"{p}_entity_raw").alias("raw")) for p, x in sides.items() if p == "a" or newer is not None]
    spellings = reduce(DataFrame.union, raw).where("raw IS NOT NULL").distinct()
    texts = checkpointed(spellings.select("raw", compared_text(F.col("raw")).alias("name")))
    a, b = (x.join(texts.select(F.col("raw").alias(f"{p}_entity_raw"), F.col("name").alias(f"{p}_name")), f"{p}_entity_raw") for p, x in sides.items())
    names = checkpointed(_names(a, "a"))
    newer_names = checkpointed(_names(b, "b")) if newer is not None else names.withColumnsRenamed({c: f"b_{c[2:]}" for c in names.columns if c != "stem"})
    near = _near_names(names, newer_names)
    near = near.withColumnsRenamed({c: f"_{c}" for c in near.columns})
    same = lambda p: (F.col(f"_{p}_name") == F.col(f"{p}_name")) & F.col(f"_{p}_entity_canonical").eqNullSafe(F.col(f"{p}_entity_canonical"))
    # by attribute too, so that a fact meets only names that have a fact to pair it with
    fuzzy = a.join(near, same("a") & (F.xxhash64("a_attribute_canonical") == F.col("_attribute"))).join(b, same("b") & (F.col("a_attribute_canonical") == F.col("b_attribute_canonical"))).where(
        "a_doc_hash <> b_doc_hash AND a_ingest_seq < b_ingest_seq"
    )
    found = candidates(facts, newer)
    return found.unionByName(fuzzy.select(*found.columns))


def _tests() -> dict[str, Column]:
    c = F.col
    return {
        "relation": interval_relation(c("a_start_date"), c("a_end_date"), c("a_granularity"), c("b_start_date"), c("b_end_date"), c("b_granularity")),
        "same_scope": F.lower(strip(c("a_scope"))) == F.lower(strip(c("b_scope"))),
        "same_unit": c("a_canonical_unit") == c("b_canonical_unit"),
        "same_value": values_match(c("a_canonical_value_num"), c("a_canonical_value_str"), c("b_canonical_value_num"), c("b_canonical_value_str")),
    }


def classify(pairs: DataFrame) -> DataFrame:
    """Pairs with ``relation``, ``case_type``, ``differing_dimensions`` and ``rationale``.

    Same interval (or an open one), scope and unit make a corroboration or a
    contradiction, by the values; otherwise the dimensions that differ
    reconcile the pair. A scope or unit that is null differs from everything.
    Pairs of one document and page, or with a quarantined fact, are dropped.
    """
    c = F.col
    apart = ~((c("a_doc_hash") == c("b_doc_hash")) & (c("a_page_number") == c("b_page_number")))
    free = ~F.coalesce(c("a_is_quarantined"), F.lit(False)) & ~F.coalesce(c("b_is_quarantined"), F.lit(False))
    t = _tests()
    tested = pairs.where(apart & free).select("*", *(F.coalesce(x, F.lit(False)).alias(n) if n != "relation" else x.alias(n) for n, x in t.items()))
    settled = c("relation").isin(EQUAL, PERPETUAL) & c("same_scope") & c("same_unit")
    case = F.when(settled & c("same_value"), F.lit(CORROBORATION)).when(settled, F.lit(CONTRADICTION)).otherwise(F.lit(RECONCILED))
    return _explained(tested.withColumn("case_type", case))


def _explained(cases: DataFrame) -> DataFrame:
    """Pairs with ``differing_dimensions`` and ``rationale``, from ``relation``, ``same_scope``, ``same_unit`` and ``case_type``."""
    c = F.col
    aligned = c("relation").isin(EQUAL, PERPETUAL)
    # The labels of the dimensions, and None for a missing value.
    text = lambda x: F.coalesce(x, F.lit("None"))
    versus = lambda label, x: F.concat(F.lit(label + " ("), text(c(f"a_{x}")), F.lit(" vs "), text(c(f"b_{x}")), F.lit(")"))
    time = (
        F.when(aligned, F.lit(None))
        .when(c("relation") == DISJOINT, versus("Temporal Progression/Evolution", "temporal_raw"))
        .when(c("relation").isin(SUBSET, SUPERSET), F.lit(AGGREGATION))
        .otherwise(versus("Different Time Windows", "temporal_raw"))
    )
    scope = F.when(~c("same_scope"), versus("Organizational Scope", "scope"))
    unit = F.when(~c("same_unit"), versus("Unit/Measurement Scale", "canonical_unit"))
    dims = F.when(c("case_type") == CORROBORATION, F.array().cast("array<string>")).when(
        c("case_type") == CONTRADICTION, F.array(F.lit(CONFLICT))
    ).otherwise(F.filter(F.array(time, scope, unit), lambda x: x.isNotNull()))
    named = cases.withColumn("differing_dimensions", dims)
    why = F.when(c("case_type") == RECONCILED, F.concat(F.lit(WHY[RECONCILED]), F.array_join("differing_dimensions", ", "), F.lit(".")))
    return named.withColumn("rationale", why.when(c("case_type") == CORROBORATION, F.lit(WHY[CORROBORATION])).otherwise(F.lit(WHY[CONTRADICTION])))


def _part(facts: DataFrame, older: bool, newer: bool, *keys: Column) -> DataFrame:
    """The facts that take part in pairs, as ``tally`` compares them, with ``keys`` of them and the sides that they may take."""
    return _side(facts, "f").select(*keys, *tally.compared("f_"), F.lit(older).alias("older"), F.lit(newer).alias("newer"))


def _meeting(facts: DataFrame, newer: DataFrame | None, *keys: Column) -> DataFrame:
    return _part(facts, True, True, *keys) if newer is None else _part(facts, True, False, *keys).unionByName(_part(newer, False, True, *keys))


def _case() -> Column:
    cases = {tally.CORROBORATION: CORROBORATION, tally.CONTRADICTION: CONTRADICTION, tally.RECONCILED: RECONCILED}
    return F.create_map(*(F.lit(x) for pair in cases.items() for x in pair))[F.col("case")].alias("case_type")


def _as_cases(counts: DataFrame) -> DataFrame:
    return counts.select(F.col("label").alias("attribute"), _case(), "relation", "pairs")


def _thing() -> tuple[Column, ...]:
    return F.col("f_attribute_canonical").alias("attribute"), F.col("f_entity_canonical").alias("entity")


def candidate_cases(facts: DataFrame, newer: DataFrame | None = None) -> DataFrame:
    """(attribute, case_type, relation, pairs): ``candidates``, classified and counted."""
    return _as_cases(tally.counted(_meeting(facts, newer, *_thing()), "attribute", "entity"))


def _stemmed(names: DataFrame) -> DataFrame:
    """``names`` with the word beginnings of ``name``, a row for each; a name without words meets only itself."""
    stems = F.col("_s")
    each = F.explode(F.when(F.size(stems) > 0, stems).otherwise(F.array("name"))).alias("stem")
    return names.withColumn("_s", name_stems(F.col("name"))).withColumn("stems", F.array_join("_s", " ")).select("*", each).drop("_s")


def fuzzy_candidate_cases(facts: DataFrame, newer: DataFrame | None = None) -> DataFrame:
    """(attribute, case_type, relation, pairs): ``fuzzy_candidates``, classified and counted."""
    # read for each fact: more CPU time than to join facts and spellings, but less disk
    meeting = _stemmed(_meeting(facts, newer, *_thing(), compared_text(F.col("f_entity_raw")).alias("name")))
    near = _as_cases(tally.counted_near(meeting, SAME_NAME))
    return candidate_cases(facts, newer).unionByName(near).groupBy("attribute", "case_type", "relation").agg(F.sum("pairs").alias("pairs"))


def new_slices(stored: DataFrame, new: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``tally.SLICE`` rows of the pairs whose newer side is one of ``new``, by equal keys and, if ``fuzzy``, by similar spellings too."""
    met = lambda *keys: _part(stored, True, False, *keys).unionByName(_part(new, True, True, *keys))
    told = (*_thing(), *tally.shown("f_"))
    found = tally.listed(met(*told), "attribute", "entity")
    if fuzzy:
        found = found.unionByName(tally.listed_near(_stemmed(met(*told, compared_text(F.col("f_entity_raw")).alias("name"))), SAME_NAME))
    return found


def slice_cases(slices: DataFrame) -> DataFrame:
    """(case_type, pairs) of slices."""
    return tally.slice_counts(slices).groupBy(_case()).agg(F.sum("pairs").alias("pairs"))


def slice_relationships(slices: DataFrame) -> DataFrame:
    """The pairs of slices as relationship rows."""
    same = {n: F.coalesce(x, F.lit(False)) for n, x in _tests().items() if n in ("same_scope", "same_unit")}
    return _rows(_explained(tally.slice_pairs(slices).withColumns(same | {"case_type": _case()})))


def relationships(pairs: DataFrame) -> DataFrame:
    """Classified pairs as relationship rows."""
    return _rows(classify(pairs))


def _rows(classified: DataFrame) -> DataFrame:
    return classified.select(
        F.col("a_fact_id").alias("fact_id_a"), F.col("b_fact_id").alias("fact_id_b"), "case_type", "rationale", "differing_dimensions"
    )


def recorded_pairs(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """Recorded relationships with both facts (a_*, b_*); rows with an unknown or null id are dropped."""
    side = lambda p: facts.select(*(F.col(x).alias(f"{p}_{x}") for x in facts.columns))
    rows = relations.select("id", F.col("fact_id_a").alias("a_fact_id"), F.col("fact_id_b").alias("b_fact_id"), F.col("case_type").alias("recorded_case"))
    return rows.join(side("a"), "a_fact_id").join(side("b"), "b_fact_id")
