"""Variant spellings of names typed by people, linked by a metric-space join.

A name is taken apart into its *root* (the surname or brand that tells families
apart) and its *signature* (the words around it that many names share, with short
forms, nicknames and misspelt words replaced). What is a word, which of them are
given names and what is short for what is learnt from the names themselves
(``learn_words``) and from the known short forms, never from a list in this code.

Spelling differences are then a matter of one metric over the points (text,
signature): the Levenshtein distance of the texts plus that of the signatures,
weighted so that points within the radius have one signature. Every name is a
point by its root and another by how that sounds; names that leave a word out are
points of what they would have said. All links come from one radius join:

* every point goes to the cell of its nearest pivot and, by the triangle
  inequality, also to each pivot that is at most twice the radius farther away, so
  that every pair within the radius meets in a home cell;
* inside its cell a point is looked up by what its text is after up to two
  deletions (long texts by their fifths), so that neither a crowded cell nor a
  common signature ends in one task or in all of its pairs;
* a pair that meets is kept if its distances from the pivot allow it and its
  edits (insertion, deletion, substitution, exchange of neighbours) do.

Names of one point are at distance 0 and form a class; links between near classes
form groups. Names that say less (a dropped word, initials for the given name)
join a group only if just one fits, misspellings by two edits only then too.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.groups import linked_groups
from quern.session import checkpointed, collect_bounded, slices

#: Pivots, the sample of points that they are chosen from, and the letters that a pivot has at most.
PIVOTS, PIVOT_SAMPLE, PIVOT_LETTERS = 24, 1500, 64
#: One edit is at most two in the metric, so two are four; the weight of signatures sets points of different ones further apart.
RADIUS, SIG_WEIGHT = 2, 32
#: Letters that a text has at least for one and for two edits to be a misspelling rather than another name.
ONE_EDIT_FROM, TWO_EDITS_FROM = 4, 8
#: Letters from which texts are looked up by their fifths: deletions and fifths find the same pairs.
LONG_TEXT = 32
#: A token is a word from this share of all names on, next to so many other tokens (alike ones, by their beginnings, count once).
WORD_SHARE, WORD_BESIDE, BEGINNING = 0.002, 5, 3
#: A token is short for a word from this share of all names on, and from so many names.
SHORT_SHARE, SHORT_NAMES = 0.00005, 2
#: How often the long form must stand where a short form does.
SHORT_FOR = 0.5
#: Most readings of a name; the ambiguous words of a name with more stand for themselves.
READINGS = 1024
# Words that say nothing about who is meant, and legal forms with those that exclude each other.
TITLES = "mr mrs ms miss dr shri sri smt prof sir messrs the of and".split()
LEGAL = "limited ltd inc incorporated corp corporation llp pvt private plc gmbh ag sa".split()
_FORMS = (("llp", 1), ("inc|incorporated", 2), ("corp|corporation", 4), ("pvt|private", 8))
# Digits typed for letters, and letters that sound or look alike.
_DIGITS = str.maketrans("015689", "olsbbg")
_SPOKEN = (("rn", "m"), ("ee", "i"), ("ai", "e"), ("vv", "w"), ("oo", "u"), ("ph", "f"), ("th", "t"), ("ck", "k"))
# European accents; the marks of other scripts are letters of their own
_ACCENT = re.compile("[̀-ͯ]")


def fold(token: str) -> str:
    """A token without accents and with digits typed for letters undone."""
    t = unicodedata.normalize("NFC", _ACCENT.sub("", unicodedata.normalize("NFKD", token)))
    return t.translate(_DIGITS) if re.search(r"[^\W\d_]", t) else t


def spoken(root: str) -> str:
    """A root with letters that sound alike written one way and doubled letters once."""
    for a, b in _SPOKEN:
        root = root.replace(a, b)
    return re.sub(r"(.)\1", r"\1", root)


def sound_of(root: Column) -> Column:
    """``spoken`` as an expression."""
    for a, b in _SPOKEN:
        root = F.replace(root, F.lit(a), F.lit(b))
    return F.regexp_replace(root, r"(.)\1", "$1")


def plain_name(raw: Column) -> Column:
    """A name in lower case with its words parted by single spaces; marks of all scripts stay with their letters."""
    t = F.regexp_replace(F.lower(raw), r"\bm/s\b\.?", " ")
    t = F.replace(F.regexp_replace(t, "['’`]", ""), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}]+", " "))


def tokens_of(plain: str) -> list[str]:
    """Folded tokens of a plain name, in order, without legal forms."""
    return [x for w in plain.split(" ") if w and (x := fold(w)) not in LEGAL]


def _deletions(word: str) -> Iterable[str]:
    yield word
    for i in range(len(word)):
        yield word[:i] + word[i + 1 :]


def one_edit(a: str, b: str) -> bool:
    """Whether at most one insertion, deletion, substitution or exchange of neighbours parts ``a`` and ``b``."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _edits_towards(a: str, b: str) -> Iterable[str]:
    """What one edit makes of ``a`` at the first place where it differs from ``b``."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    yield a[:i] + a[i + 1 :]
    if i < len(b):
        yield a[:i] + b[i] + a[i:]
        yield a[:i] + b[i] + a[i + 1 :]
    yield a[:i] + a[i : i + 2][::-1] + a[i + 2 :]


def edits_between(a: Column, b: Column) -> Column:
    """0, 1 or 2 edits between two texts, null if there are more."""
    swaps = lambda t: F.transform(
        F.when(F.length(t) > 1, F.sequence(F.lit(1), F.length(t) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.lit(1)), F.substring(t, i, F.lit(1)), F.substring(t, i + 2, F.length(t))),
    )
    d = F.levenshtein(a, b, 2 * RADIUS)
    swapped = (d == 2) & (F.length(a) == F.length(b)) & F.array_contains(swaps(a), b)
    after = lambda x, y: F.exists(swaps(x), lambda s: F.levenshtein(s, y).between(0, 1))
    twice = F.exists(swaps(a), lambda s: (F.levenshtein(s, b) == 2) & F.array_contains(swaps(s), b))
    return F.when(d.between(0, 1), d).when(swapped, 1).when(d == 2, 2).when((d > 2) & (after(a, b) | after(b, a) | ((F.length(a) == F.length(b)) & twice)), 2)


def abbreviates(short: str, word: str) -> bool:
    """Whether ``short`` is a usual way of shortening ``word``: its beginning, or its first and some later letters in order."""
    if not 2 <= len(short) <= len(word) - 2 or short[0] != word[0]:
        return False
    if word.startswith(short) or (len(short) > 2 and word.startswith(short[:-1]) and short[-1] in "st"):
        return True
    if not 3 <= len(short) <= 6 or sum(c in "aeiou" for c in short) > 1:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


class Lexicon:
    """Words, given names and short forms; takes names apart."""

    def __init__(self, words: Iterable[str], given: Iterable[str], forms: Iterable[tuple[str, str, str]]):
        self.given, self.words, self.short = set(given), set(words), {}
        for full, short, kind in forms:
            full, short = fold(full.lower()), re.sub(r"[\W_]", "", fold(short.lower()))
            if short and full:
                (self.given if kind == "given_name" else self.words).add(full)
                self.short.setdefault(short, []).append(full)
        # what is short for a short form is short for its word
        whole = lambda w: [x for x in self.short.get(w, ()) if x not in self.short] or [w]
        self.short = {s: sorted({x for w in fulls for x in whole(w) if x != s}) for s, fulls in self.short.items()}
        # a frequent short form isn't a word of its own
        self.words = {w for w in self.words if not any(abbreviates(w, v) for v in self.words | self.given)} - self.given - set(self.short) - set(TITLES) - set(LEGAL)
        self.given -= set(self.short)
        self.near: dict[str, list[str]] = {}
        for w in sorted(self.words | self.given | {s for s in self.short if len(s) > 5}):
            if len(w) > 4:
                for d in _deletions(w) if len(w) < 8 else {y for x in _deletions(w) for y in _deletions(x)}:
                    self.near.setdefault(d, []).append(w)
        self.longest = max(map(len, self.words | self.given), default=0)
        self.meanings = lru_cache(maxsize=100_000)(self._meanings)

    def _meanings(self, token: str) -> tuple[bool, tuple[str, ...]]:
        """(sure, words that a token may stand for); none for a part of the root. What only may abbreviate a word isn't sure."""
        if token in self.words or token in self.given:
            return True, (token,)
        found = list(self.short.get(token, ()))
        # a token longer than any word by more than two letters is near to none
        if not found and 4 < len(token) <= self.longest + 2:
            alike = spoken(token)
            near = dict.fromkeys(w for d in (*_deletions(token), *_deletions(alike)) for w in self.near.get(d, ()))
            near = [w for w in near if one_edit(w, token) or one_edit(spoken(w), alike)]
            if not near and len(token) > 6:
                twice = dict.fromkeys(w for x in _deletions(token) for d in _deletions(x) for w in self.near.get(d, ()) if len(w) > 7)
                near = [w for w in twice if any(one_edit(x, w) for x in _edits_towards(token, w))]
            found = [x for w in near for x in self.short.get(w, (w,))]
        sure = bool(found)
        if 1 < len(token) <= 8:
            found += [w for w in sorted(self.words) if len(w) > 4 and abbreviates(token, w)]
        return sure, tuple(dict.fromkeys(found))

    def take_apart(self, plain: str) -> tuple[str, list[str], list[str], str, list[str]]:
        """(root, signatures, shorter signatures, given name, initials) of a plain name."""
        tokens = [t for t in tokens_of(plain) if t not in TITLES]
        initials = [t for t in tokens if len(t) == 1]
        meant = [(t, *self.meanings(t)) for t in tokens if len(t) > 1]
        if all(words for _, _, words in meant):
            # something must be left that tells the name apart, and a guess is the first to go
            meant = [(t, sure, words if sure else ()) for t, sure, words in meant]
        known = [words for _, _, words in meant if words]
        unknown = [t for t, _, words in meant if not words]
        given = [m for m in known if any(x in self.given for x in m)]
        if not unknown and known:
            # a name of known words only is told apart by all of them
            unknown, known, given = ["_".join(m[0] for m in known)], [], []
        if not unknown:
            unknown, initials = initials, []
        root = "".join(unknown)
        letters = sorted(set(initials))
        if given and len(known) == len(given):
            names = [x for x in given[0] if x in self.given]
            return root, [f"p:{x}" for x in names], sorted({f"i:{x[0]}" for x in names}), names[0], letters
        if not known and initials:
            return root, [f"j:{''.join(letters)}"], [], "", letters
        full = _readings(known)
        shorter = {c - {w} for c in full for w in c if len(c) > 1}
        text = lambda c: "o:" + " ".join(sorted(c))
        return root, sorted({text(c) for c in full}), sorted({text(c) for c in shorter}), "", []


def _readings(known: list[tuple[str, ...]]) -> set[frozenset[str]]:
    """The sets of words that a name's tokens may stand for, a choice for each different one."""
    known = list(dict.fromkeys(known))
    if np.prod([float(len(m)) for m in known]) > READINGS:
        known = [m if len(m) == 1 else ("/".join(m),) for m in known]
    out: set[frozenset[str]] = {frozenset()}
    for meanings in known:
        out = {c | {m} for c in out for m in meanings}
    return out


def choose_pivots(sample: list[tuple[str, str]], count: int) -> list[tuple[str, str]]:
    """Farthest-first choice of ``count`` points (text, signature); deterministic."""
    if not sample:
        return []
    roots, sigs = [list(x) for x in zip(*sample)]
    far = lambda p: levenshtein_all(p[0], roots) + SIG_WEIGHT * levenshtein_all(p[1], sigs)
    pivots, best = [sample[0]], far(sample[0])
    while len(pivots) < min(count, len(sample)) and best.max() > 0:
        pivots.append(sample[int(best.argmax())])
        best = np.minimum(best, far(pivots[-1]))
    return pivots


def levenshtein_all(a: str, words: list[str]) -> np.ndarray:
    """Levenshtein distance of ``a`` to each of ``words``, one row of all tables at a time."""
    width = max(map(len, words))
    codes = np.zeros((len(words), width), dtype=np.int64)
    for i, w in enumerate(words):
        codes[i, : len(w)] = [ord(c) for c in w]
    across = np.arange(width + 1)
    row = np.tile(across, (len(words), 1))
    for i, c in enumerate(a, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (codes != ord(c)))
        row = np.minimum.accumulate(new - across, axis=1) + across
    return row[np.arange(len(words)), [len(w) for w in words]]


def _lookups(text: Column, deep: Column) -> Column:
    """Keys that two texts share whenever one edit parts them or, if both are deep, two."""
    size = F.length(text)
    cut = lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.concat(F.substring(r, F.lit(1), i - 1), F.substring(r, i + 1, F.length(r))))
    less = cut(text)
    short = F.concat(F.array(text), F.when(deep, F.concat(less, F.flatten(F.transform(less, cut)))).otherwise(less))
    # two edits leave one of five parts as it was, moved by two letters at most
    fifths = F.flatten(F.transform(F.sequence(size - 2, size + 2), lambda n: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda p: F.transform(
        F.sequence(F.lit(-2), F.lit(2)),
        lambda s: F.concat_ws(":", n, p, F.sha2(F.substring(text, F.greatest(F.lit(1), F.floor(n * p / 5).cast("int") + 1 + s), F.floor(n / 5).cast("int")), 256)),
    )))))
    none = F.array().cast("array<string>")
    keys = F.concat(F.when(size <= LONG_TEXT + 2, short).otherwise(none), F.when(size > LONG_TEXT - 2, fifths).otherwise(none))
    return F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k)))


def near_pairs(elements: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """(sig, root_a, root_b, edits) of all distinct elements (root, sig) of equal signature that are 1 edit apart.

    With a column ``deep`` that is true for both elements, also of those 2
    edits apart. Each pair once, ``root_a`` < ``root_b``. The pivots are chosen
    from a bounded sample; every element is assigned and joined. An empty input
    has no pairs, nor has an empty root.
    """
    if "deep" not in elements.columns:
        elements = elements.withColumn("deep", F.lit(False))
    # few bytes, much to compute: a fixed number of tasks, not one
    spark = elements.sparkSession
    points = elements.where("root <> ''").repartition(slices(spark), "root", "sig").groupBy("root", "sig").agg(F.bool_or("deep").alias("deep"))
    points = checkpointed(points.select("root", "sig", "deep", F.xxhash64("root", "sig").alias("id")))
    picked = collect_bounded(points.orderBy("id").limit(PIVOT_SAMPLE), PIVOT_SAMPLE, "pivot sample")
    # a pivot may be any point, so those of overlong names are their beginnings
    centres = choose_pivots(sorted({(r["root"][:PIVOT_LETTERS], r["sig"][:PIVOT_LETTERS]) for r in picked}), pivots)
    if not centres:
        return elements.select("sig", F.col("root").alias("root_a"), F.col("root").alias("root_b"), F.lit(1).alias("edits")).where(F.lit(False))
    distances = F.array(*(F.levenshtein("root", F.lit(r)) + F.levenshtein("sig", F.lit(s)) * SIG_WEIGHT for r, s in centres))
    far = points.select("*", distances.alias("d")).select("*", F.array_min("d").alias("least"))
    # y within r of x meets it in x's home cell: d(y, home of x) <= d(y, home of y) + 2r
    reach = F.when(F.col("deep"), 4 * RADIUS).otherwise(2 * RADIUS)
    cells = F.filter(F.transform("d", lambda d, i: F.struct(i.alias("cell"), d.alias("d"))), lambda c: c["d"] <= F.col("least") + reach)
    placed = far.select("root", "sig", "deep", "id", F.explode(cells).alias("c"), (F.array_position("d", F.col("least")) - 1).alias("home"))
    keyed = placed.select(
        "id", F.col("c.d").cast("int").alias("d"), "deep", (F.col("c.cell") == F.col("home")).alias("home"), F.xxhash64("sig", "c.cell").alias("cell"),
        F.explode(_lookups(F.col("root"), F.col("deep"))).alias("v"),
    )
    hood = keyed.select("id", "d", "deep", "home", F.xxhash64("cell", "v").alias("v"))
    a, b = (hood.select("v", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "d", "deep", "home"))) for side in "ab")
    # what the triangle inequality lets pass; the pairs themselves are checked below
    reach = F.when(F.col("deep_a") & F.col("deep_b"), 2 * RADIUS).otherwise(RADIUS)
    met = a.join(b, "v").where((F.col("id_a") < F.col("id_b")) & (F.col("home_a") | F.col("home_b")) & (F.abs(F.col("d_a") - F.col("d_b")) <= reach))
    ids = met.select("id_a", "id_b").distinct()
    left, right = (points.select(F.col("id").alias(f"id_{s}"), F.col("root").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("deep").alias(f"deep_{s}")) for s in "ab")
    pairs = ids.join(left, "id_a").join(right, "id_b").where("sig_a = sig_b").withColumn("edits", edits_between(F.col("a"), F.col("b")))
    near = pairs.where("edits = 1 OR (edits = 2 AND deep_a AND deep_b)")
    return near.select(F.col("sig_a").alias("sig"), F.least("a", "b").alias("root_a"), F.greatest("a", "b").alias("root_b"), "edits")


def _rests(words: frozenset[str]):
    def rests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kept in batch["kept"]:
                for t in kept:
                    rest = sorted(set(kept) - {t})
                    # a rest of words alone says nothing about who is meant
                    if any(x not in words for x in rest):
                        rows.append((" ".join(rest), t, t in words))
            yield pd.DataFrame(rows, columns=["rest", "token", "word"])

    return rests


def learn_words(names: DataFrame, forms: list[tuple[str, str, str]]) -> tuple[list[str], list[str], list[tuple[str, str, str]]]:
    """(words, given names, short forms) of the names (``name``, ``tokens``, ``legal``).

    * A token in ``WORD_SHARE`` of all names is a word, if it stands next to
      different tokens; those of one name's variants begin alike.
    * A word is a given name if most of its names are it and one token more,
      without a legal form.
    * A token is short for a word that stands in its place, next to the same
      rest, in at least ``SHORT_FOR`` of the names that it occurs in.

    A name has few tokens, so what reaches the driver is bounded by tokens per
    name over the shares, whatever the number of names.
    """
    kept = F.array_sort(F.array_distinct(F.filter("tokens", lambda t: (F.length(t) > 1) & ~t.isin(*TITLES))))
    # the spellings of a key differ in order, not in tokens
    once = checkpointed(names.groupBy("name").agg(F.min(F.struct(kept.alias("kept"), "legal")).alias("n")).select("n.kept", "n.legal"))
    total = once.count()
    personal = (F.size("kept") == 2) & ~F.col("legal")
    others = F.transform(F.filter("kept", lambda x: x != F.col("t")), lambda x: F.left(x, F.lit(BEGINNING)))
    each = once.select("kept", F.explode("kept").alias("t"), personal.alias("personal")).select("t", "personal", F.posexplode_outer(others).alias("i", "beside"))
    first = F.coalesce(F.col("i") == 0, F.lit(True))
    tokens = each.groupBy("t").agg(F.count_if(first).alias("n"), F.count_if(first & F.col("personal")).alias("personal"), F.approx_count_distinct("beside").alias("beside"))
    frequent = collect_bounded(tokens.where((F.col("n") >= total * WORD_SHARE) & (F.col("beside") >= WORD_BESIDE)), 1_000_000, "words")
    words = {r["t"] for r in frequent}
    given = {r["t"] for r in frequent if 2 * r["personal"] > r["n"]}
    fulls = {fold(f.lower()) for f, _, _ in forms}
    given_fulls = {fold(f.lower()) for f, _, kind in forms if kind == "given_name"}
    rows = checkpointed(once.where(F.size("kept") > 1).mapInPandas(_rests(frozenset(words | fulls)), "rest string, token string, word boolean").distinct())
    beside = rows.groupBy("rest").agg(F.collect_set("token").alias("token"), F.collect_set(F.when(F.col("word"), F.col("token"))).alias("full"))
    both = beside.where("size(full) > 0 AND size(token) > 1").select("full", F.explode("token").alias("token")).select("token", F.explode("full").alias("full")).where("token <> full")
    support = both.groupBy("token", "full").agg(F.count("*").alias("both"))
    short = support.join(rows.groupBy("token").agg(F.count("*").alias("n")), "token").where(
        (F.col("both") >= max(SHORT_NAMES, total * SHORT_SHARE)) & (F.col("both") >= F.col("n") * SHORT_FOR)
    )
    learnt = collect_bounded(short.select("token", "full"), 1_000_000, "short forms")
    # of two forms that stand for each other the longer one is the word
    pairs = {(r["full"], r["token"]) for r in learnt if r["token"] not in fulls}
    pairs = {(full, token) for full, token in pairs if (token, full) not in pairs or (len(full), full) > (len(token), token)}
    return sorted(words - given), sorted(given), sorted((full, token, "given_name" if full in given | given_fulls else "word") for full, token in pairs)


def _allowed(edits: Column, a: Column, b: Column) -> Column:
    """Whether texts are long enough for so many edits to be misspellings."""
    return F.least(F.length(a), F.length(b)) >= F.when(edits == 1, ONE_EDIT_FROM).otherwise(TWO_EDITS_FROM)


def linked_names(facts: DataFrame, name_forms: DataFrame) -> DataFrame:
    """(name, group): every entity key that is linked to another, with the group it belongs to.

    Keys whose raw spelling is null or has no letters or digits stay alone.
    Companies of different legal form and persons with different middle
    initials are not linked, nor are names that fit several groups.
    """
    raw = F.lower(F.trim("entity_raw"))
    forms = sum((F.when(raw.rlike(rf"\b({p})\b"), F.lit(bit)).otherwise(F.lit(0)) for p, bit in _FORMS[1:]), F.when(raw.rlike(r"\b(llp)\b"), F.lit(1)).otherwise(F.lit(0)))
    legal = raw.rlike(rf"\b({'|'.join(LEGAL)})\b")
    keys = facts.where("entity_canonical IS NOT NULL AND entity_raw IS NOT NULL").select(F.col("entity_canonical").alias("name"), plain_name(F.col("entity_raw")).alias("plain"), forms.alias("form"), legal.alias("legal"))
    spelt = keys.groupBy("name", "plain").agg(F.bit_or("form").alias("form"), F.bool_or("legal").alias("legal"), F.count("*").alias("rows"))
    tokens = F.pandas_udf(lambda s: s.map(tokens_of), "array<string>")
    names = checkpointed(spelt.repartition(slices(facts.sparkSession), "name").withColumn("tokens", tokens("plain")))
    known = [tuple(r) for r in collect_bounded(name_forms.select("full_form", "short_form", "kind").where("full_form IS NOT NULL AND short_form IS NOT NULL").distinct(), 100_000, "name_forms")]
    words, given, short = learn_words(names, known)
    lexicon = facts.sparkSession.sparkContext.broadcast((words, given, known + short))
    parse = F.pandas_udf(_parser(lexicon), "root string, full array<string>, less array<string>, given string, initials array<string>")
    own = names.groupBy("name").agg(F.bit_or("form").alias("form"), F.sum("rows").alias("rows"))
    parsed = checkpointed(names.select("name", parse("plain").alias("p")).select("name", "p.*").where("root <> ''").join(own, "name"))

    # what tells namesakes apart: the legal form of companies, the middle initials of persons
    mark = F.when(F.col("given") != "", F.array_join("initials", "")).otherwise(F.when(F.col("form") > 0, F.col("form").cast("string")).otherwise(""))
    texts = F.array(F.struct(F.col("root").alias("text"), F.col("sig")), F.struct(sound_of(F.col("root")).alias("text"), F.concat(F.lit("s"), "sig").alias("sig")))
    points = lambda rows, *kept: rows.select(*kept, F.explode(texts).alias("p")).select(*kept, "p.text", "p.sig").distinct()
    full = checkpointed(points(parsed.select("name", "root", F.explode("full").alias("sig"), mark.alias("mark"), "form", "initials", "rows"), "name", "mark", "form", "initials", "rows"))
    less = points(parsed.select("name", "root", F.explode("less").alias("sig")), "name")
    # names that give initials only are near to the elements that offer such an initial
    lone = full.where(F.col("sig").rlike("^s?j:")).select("name", "text", F.explode("initials").alias("i"), F.regexp_extract("sig", "^s?", 0).alias("s"))
    lone = lone.select("name", "text", F.concat("s", F.lit("i:"), "i").alias("sig"))
    deep = ~F.col("sig").startswith("s") & (F.length("text") >= TWO_EDITS_FROM)
    elements = full.select(F.col("text").alias("root"), "sig", deep.alias("deep"))
    for more in (less, lone):
        elements = elements.unionByName(more.select(F.col("text").alias("root"), "sig", F.lit(False).alias("deep")))
    found = near_pairs(elements).where(_allowed(F.col("edits"), F.col("root_a"), F.col("root_b")))
    near = checkpointed(found.select("sig", F.col("root_a").alias("a"), F.col("root_b").alias("b"), "edits"))
    mirrored = near.unionByName(near.select("sig", F.col("b").alias("a"), F.col("a").alias("b"), "edits"))

    # a class: names of one point that nothing tells apart
    marks = full.groupBy("text", "sig").agg(F.max("mark").alias("top"), (F.min(F.nullif("mark", F.lit(""))) != F.max("mark")).alias("several"))
    marked = full.join(marks, ["text", "sig"])
    several = F.coalesce("several", F.lit(False))
    classed = checkpointed(marked.select(
        F.concat(F.lit("n:"), "name").alias("node"), "text", "sig", several.alias("several"), F.when(several, F.col("mark")).otherwise(F.col("top")).alias("mark"),
    ).withColumn("class", F.concat(F.lit("c:"), F.substring(F.sha2(F.concat_ws("\u0001", "text", "sig", F.when(F.col("several"), F.col("mark"))), 256), 1, 32))))
    classes = classed.select("text", "sig", "several", "mark", "class").distinct()
    left, right = (classes.select("sig", F.col("text").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("several", "mark", "class"))) for s in "ab")
    both = near.where("edits = 1").join(left, ["sig", "a"]).join(right, ["sig", "b"])
    agree = "(mark_a = mark_b AND mark_a <> '') OR (NOT several_a AND NOT several_b AND (mark_a = '' OR mark_b = ''))"
    links = classed.select(F.col("node").alias("a"), F.col("class").alias("b")).unionByName(both.where(agree).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    group = lambda g: g.where("node LIKE 'n:%'").select(F.substring("node", 3, 1_000_000).alias("name"), F.col("root").alias("group"))
    first = checkpointed(group(linked_groups(links, "a", "b")))

    # names that say less: linked if all they fit is one group
    offers = less.join(first, "name").join(parsed.select("name", "form", "initials").distinct(), "name")
    offers = offers.groupBy("text", "sig", "group").agg(F.bit_or("form").alias("form"), F.array_distinct(F.flatten(F.collect_set("initials"))).alias("held"))
    asking = full.where(F.col("sig").rlike("^s?o:")).select("name", "text", "sig").unionByName(lone).join(full.select("name", F.col("form").alias("own"), F.col("initials").alias("given")).distinct(), "name")
    exact = asking.select("*", F.when(F.col("sig").startswith("s"), 1).otherwise(0).alias("far"))
    misspelt = asking.withColumnRenamed("text", "a").join(mirrored.where("edits = 1"), ["sig", "a"]).select("name", F.col("b").alias("text"), "sig", "own", "given", F.lit(1).alias("far"))
    by_form = F.col("sig").rlike("^s?o:") & ((F.col("own") == F.col("form")) | (F.col("own") == 0) | (F.col("form") == 0))
    # J. K. Smith fits John K. Smith and John Smith, not John L. Smith
    by_initials = F.col("sig").rlike("^s?i:") & F.forall("held", lambda h: F.array_contains("given", h) | (F.size("given") == 1))
    fits = exact.unionByName(misspelt).join(offers, ["text", "sig"]).where(by_form | by_initials)
    # the exact root goes before a near one; a group may not be asked for by several that exclude each other
    nearest = fits.groupBy("name", "far").agg(F.collect_set("group").alias("groups")).groupBy("name").agg(F.min_by("groups", "far").alias("groups"))
    mine = nearest.join(first.withColumnRenamed("group", "mine"), "name").select("mine", F.explode("groups").alias("group")).distinct()
    one = mine.groupBy("mine").agg(F.count("*").alias("n"), F.min("group").alias("group")).where("n = 1 AND mine <> group")
    second = checkpointed(_merged(first, one.select(F.col("mine").alias("a"), F.col("group").alias("b"))))
    return _merged(second, _twice_misspelt(second, full, mirrored))


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (name, group) with those that ``links`` (a, b) name as one."""
    into = linked_groups(links, "a", "b").select(F.col("node").alias("group"), F.col("root").alias("into"))
    return groups.join(into, "group", "left").select("name", F.coalesce("into", "group").alias("group"))


def _twice_misspelt(groups: DataFrame, full: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b): groups of one name, with the one group that two edits part them from.

    Two edits also part names that only happen to be alike, so the group must be
    the only one in reach, agree in what tells namesakes apart, and be written
    at least twice as often as the name that is taken for its misspelling.
    """
    sizes = full.select("name", "rows").distinct().join(groups, "name").groupBy("group").agg(F.count("*").alias("names"), F.sum("rows").alias("rows"))
    named = checkpointed(full.where(~F.col("sig").rlike("^(s|j:)")).select("name", "text", "sig", "mark").join(groups, "name").join(sizes, "group"))
    asks = named.where("names = 1").select(F.col("text").alias("a"), "sig", F.col("group").alias("mine"), F.col("mark").alias("mark_a"), F.col("rows").alias("rows_a"))
    has = named.select(F.col("text").alias("b"), "sig", "mark", "group", F.col("rows").alias("rows_b")).distinct()
    met = asks.join(near.where("edits = 2"), ["sig", "a"]).join(has, ["sig", "b"]).where("mine <> group AND (mark_a = mark OR mark_a = '' OR mark = '')")
    once = met.groupBy("mine").agg(F.min("group").alias("least"), F.max("group").alias("most"), F.max("rows_a").alias("rows_a"), F.max("rows_b").alias("rows_b"))
    return once.where("least = most AND 2 * rows_a <= rows_b").select(F.col("mine").alias("a"), F.col("least").alias("b"))


def _parser(lexicon):
    made: dict[int, Lexicon] = {}

    def parse(plain: pd.Series) -> pd.DataFrame:
        if 0 not in made:
            made[0] = Lexicon(*lexicon.value)
        return pd.DataFrame([made[0].take_apart(x) for x in plain], columns=["root", "full", "less", "given", "initials"])

    return parse


def linked_pairs(facts: DataFrame, name_forms: DataFrame) -> DataFrame:
    """(entity_canonical_a, entity_canonical_b): all pairs of keys of one group, smaller first."""
    groups = checkpointed(linked_names(facts, name_forms))
    left = groups.select("group", F.col("name").alias("entity_canonical_a"))
    right = groups.select("group", F.col("name").alias("entity_canonical_b"))
    pairs = left.join(right, "group").where("entity_canonical_a < entity_canonical_b")
    return pairs.select("entity_canonical_a", "entity_canonical_b")
