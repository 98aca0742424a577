import random

from pyspark.sql import functions as F

from quern.llm import names

FORMS = [("William", "Will", "given_name"), ("Technologies", "Techs", "word"), ("Pharmaceuticals", "Pharm.", "word"), ("Engineering", "Engrg", "word")]
# one line an entity: its spellings
SAME = [
    ["Havigakita Logistics Corp.", "Havigakita Logist. Corporation", "M/s. HAVIGAKITA LOGISTICS CORP", "The Havigakita Logisitcs Corp.", "Hávigakita Logistics Corp.", "Havigakta Logistics Corp."],
    ["Havigakita Research and Design Ltd.", "Havigakita Res. & Design Limited", "Havigakita Research and Desing Limited"],
    ["Gomopahiba United Pharmaceuticals Ltd", "Gomopahiba United Pharm. Ltd", "Gomopahiba Pharmaceuticals Limited", "Gomo pahiba United Pharmaceuticals Ltd"],
    ["William M. Gahijazeto", "Gahijazeto, Will M.", "Bill Gahijazeto", "Dr. William Gahijazeto", "W. Gahijazeto", "Gahijazeto, Wiliam M."],
    ["Katherine Gahijazeto", "Kate Gahijazeto"],
    ["Department of Ports, Kaneniloba", "Dept. of Ports, Kaneniloba", "Department of Ports Kaneniloba", "Department of Ports, Kanenilboa"],
    ["Tokesekaze Engineering LLP", "Tokesekaze Engrg LLP", "Tokesekaze Engineeering Llp", "T0kesekaze Engineering LLP"],
    ["Tokesekaze Engineers Power LLP"],
    ["Elizabeth Zinonesoko", "Beth Zinonesoko", "Elisabeth Zinonesoko"], ["Edward Zinonesoko"], ["E. Zinonesoko"],  # fits both, so neither
    ["Bogado Foods Inc"], ["Bogodo Foods LLP"],  # one edit apart, but different legal forms
    ["Arjun S. Levakipo Jr"], ["Ritagajo Cement Limited"],
]


WORDS = "logistics research design united pharmaceuticals department ports engineering power foods cement engineers".split()
NICKNAMES = {"william": "bill", "katherine": "kate", "elizabeth": "beth", "edward": "ted", "arjun": "arj"}


def two_edits(a, b):
    """Whether any edit of ``a`` leaves at most one more to ``b``."""
    at = range(len(a) + 1)
    edited = {a[:i] + a[i + 1 :] for i in at} | {a[:i] + a[i : i + 2][::-1] + a[i + 2 :] for i in at}
    edited |= {a[:i] + c + a[i + k :] for i in at for c in set(b) for k in (0, 1)}
    return abs(len(a) - len(b)) < 3 and any(names.one_edit(x, b) for x in edited)


def syllables(n):
    """Made-up roots that no two edits make alike."""
    out = []
    rnd = random.Random(11)
    while len(out) < n:
        root = "".join(rnd.choice("bdgklmnprstvz") + rnd.choice("aeiou") for _ in range(5))
        if not any(two_edits(root, x) for x in out):
            out.append(root)
    return out


def corpus():
    """Names that the words, given names and nicknames can be learnt from; one line an entity."""
    roots = iter(syllables(200))
    out = [[f"{next(roots)} {w} limited"] for w in WORDS for _ in range(9)]
    for given, nickname in NICKNAMES.items():
        for i in range(9):
            root = next(roots)
            out.append([f"{given} {root}", f"{nickname} {root}"] if i < 3 else [f"{given} {root}"])
    return out


def key_of(raw):
    return "_".join(sorted(set(names.re.findall(r"[^\W_]+", raw.lower())) - set("limited ltd inc corp corporation llp pvt private".split())))


def table(spark, entities):
    rows = []
    for group in [*entities, *corpus()]:
        for raw in group:
            key = key_of(raw)
            rows += [(key, raw), (key, raw.upper())]
    rows += [(None, "x y"), ("nameless", None), ("blank", ""), ("marks", "!!"), ("long", "a" * 100_000)]
    return spark.createDataFrame(rows, "entity_canonical string, entity_raw string").withColumn("root", F.lit("clash")).withColumn("name", F.lit("clash"))


def test_variants(spark):
    facts = table(spark, SAME)
    forms = spark.createDataFrame(FORMS + [(None, "x", "word")], "full_form string, short_form string, kind string")
    got = {tuple(r) for r in names.linked_pairs(facts, forms).collect()}
    expected = set()
    for group in [*SAME, *corpus()]:
        keys = sorted({key_of(raw) for raw in group})
        expected |= {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]}
    assert got == expected


def test_no_names(spark):
    forms = spark.createDataFrame([], "full_form string, short_form string, kind string")
    assert names.linked_pairs(spark.createDataFrame([], "entity_canonical string, entity_raw string"), forms).isEmpty()


def test_metric_join_against_brute_force(spark):
    rnd = random.Random(3)
    roots = {"".join(rnd.choice("ab") for _ in range(rnd.randint(4, 7))) for _ in range(150)}
    points = sorted({(r, rnd.choice(["foods", "power", "cement works"])) for r in roots for _ in range(2)})
    got = {tuple(r) for r in names.near_pairs(spark.createDataFrame(points, "root string, sig string"), pivots=7).select("sig", "root_a", "root_b").collect()}
    assert got == {(s, a, b) for a, s in points for b, t in points if s == t and a < b and names.one_edit(a, b)}


def test_one_edit_and_distances():
    assert [names.one_edit("abcd", x) for x in ("abcd", "abc", "abdc", "xbcd", "abcde", "badc", "ab", "bcd")] == [True, True, True, True, True, False, False, True]
    assert list(names.levenshtein_all("kitten", ["sitting", "kitten", "", "mitten"])) == [3, 0, 6, 1]
    assert names.abbreviates("mgmt", "management") and names.abbreviates("fin", "finance") and names.abbreviates("prods", "products")
    assert not names.abbreviates("toni", "telecommunications") and not names.abbreviates("foods", "finance")


SHORT_AND_OTHER = [
    ["LG Foods Ltd", "L.G. Foods"], ["BP Foods Ltd"], ["LK Foods Ltd"], ["3M Power Ltd", "3M POWER LIMITED"], ["3N Power Ltd"], ["O2 Power"], ["X Power Inc"],
    ["ICI Paints Ltd"], ["AKZ Paints Ltd"], ["SBI Life"], ["HDF Life"],
    ["हिंदुस्तान Power Limited", "हिंदुस्तन Power Limited"], ["भारतीय Power Limited"], ["東京電力", "東京電力 LTD"], ["Ñandúñez Foods", "Nandunez Foods"],
]


def test_short_names_and_other_scripts(spark):
    facts = table(spark, SHORT_AND_OTHER)
    rows = [(f"k{i}_{j}", raw) for i, group in enumerate(SHORT_AND_OTHER) for j, raw in enumerate(group)] + [(key_of(raw), raw) for g in corpus() for raw in g]
    facts = spark.createDataFrame(rows, "entity_canonical string, entity_raw string")
    got = {tuple(r) for r in names.linked_pairs(facts, spark.createDataFrame(FORMS, "full_form string, short_form string, kind string")).collect() if r[0].startswith("k") and "_" in r[0] and r[0][1].isdigit()}
    assert got == {(f"k{i}_0", f"k{i}_1") for i, g in enumerate(SHORT_AND_OTHER) if len(g) > 1 and i != 0}


def test_learnt_words(spark):
    rows = [(key_of(raw), names.tokens_of(raw), raw.endswith("limited")) for g in corpus() for raw in g]
    words, given, short = names.learn_words(spark.createDataFrame(rows, "name string, tokens array<string>, legal boolean"), [])
    assert set(words) == set(WORDS) and set(given) == set(NICKNAMES)
    assert set(short) == {(full, nick, "given_name") for full, nick in NICKNAMES.items()}


def test_two_edits_and_long_texts_against_brute_force(spark):
    rnd = random.Random(4)
    roots = {"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 9))) for _ in range(120)}
    for size in (28, 31, 33, 36, 60, 200):
        base = "".join(rnd.choice("abcdefgh") for _ in range(size))
        for _ in range(12):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                i = rnd.randrange(len(t) - 1)
                t[i : i + 2] = rnd.choice([[t[i + 1], t[i]], [t[i]], [t[i], "x", t[i + 1]], ["y", t[i + 1]]])
            roots.add("".join(t))
    points = sorted((r, rnd.choice(["foods", "power"])) for r in roots)
    df = spark.createDataFrame([(r, s, True) for r, s in points], "root string, sig string, deep boolean")
    got = {tuple(r) for r in names.near_pairs(df, pivots=5).collect()}
    expected = {(s, a, b, 1 if names.one_edit(a, b) else 2) for a, s in points for b, t in points if s == t and a < b and two_edits(a, b)}
    assert got == expected


def test_readings_are_bounded():
    known = [(f"a{i}", f"b{i}", f"c{i}") for i in range(3)]
    assert len(names._readings(known)) == 27 and names._readings(known * 2) == names._readings(known)
    assert names._readings([(f"a{i}", f"b{i}") for i in range(40)]) == {frozenset(f"a{i}/b{i}" for i in range(40))}
