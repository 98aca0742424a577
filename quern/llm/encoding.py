"""Texts that were decoded with the wrong code page, found and restored.

The garbled characters of a source are a substitution cipher: each *unit* stands
for a letter that is unknown as long as the code page is. A unit is either what a
code page shows for the UTF-8 bytes of one letter, or one character, where the
bytes were of another code page (a swap). Which letters come into question
follows from all single-byte code pages that Python knows; which one it is, or
whether the characters are genuine, is learnt by expectation-maximisation per
source against the bigrams of the undamaged texts of the whole corpus:

1. the characters in use are collected (the corpus's alphabet),
2. bigrams around non-ASCII characters are counted over texts that are mostly
   free of suspicious units (the language model), and contexts of all units,
3. per source, EM alternates between the posterior of each reading of a unit in
   its contexts and the source's mapping from unit to letter,
4. texts whose characters are improbable under the model are counted once more,
   as bigrams of symbols; per source and script shown, EM over those learns the
   mapping of a swap, from the likeliest pair of code pages on,
5. each text is rewritten: its units become cipher symbols, ``translate()`` turns
   the symbols into letters, until nothing changes; a swap is applied with
   ``translate()`` alone, to texts that it makes far likelier.

Steps 1, 2 and 4 only shuffle counts that are summed per task before. What reaches
the driver are the alphabet and those bigrams that a unit can be part of, bounded
by the characters in use.
"""

from __future__ import annotations

import encodings
import math
import operator
import pkgutil
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import checkpointed, collect_bounded, spread

# The code pages that come first where several explain a text equally well.
USUAL_PAGES = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859-15", "koi8-r", "cp866")
LOST = "�"
#: Prior of a suspicious unit being damage, EM rounds, prior of a unit's letter being that of its text's likeliest page.
DAMAGED, ROUNDS, HINT = 0.05, 12, 0.995
#: Weight of what an unusual page explains.
UNUSUAL = 0.9
#: Nats by which a letter of an unusual page is less likely in a text that a usual page explains.
FAR = 12.0
#: A text may be a swap if its characters are so many nats (a bigram) less likely than the corpus's; it is one if the swap wins so many, a bigram and in all.
ODD, GAIN, WHOLE_GAIN = 1.0, 1.0, 15.0
#: How many nats a bigram a text restored from a swap may be less likely than the texts of its script.
ALIKE = 1.0
_RUN = re.compile(r"[^\x00-\x7f]{2,}")
# the character after a run may be the one before the next
_AROUND = re.compile(r"([\x00-\x7f]?[^\x00-\x7f]+)(?=([\x00-\x7f]?))")
_BETWEEN = "\x00"
#: Characters that are turned into arrays at once.
_SLICE = 1 << 20
_SUSPECT = r"[^\x00-\x7F]{2}"


def _page(name: str) -> dict[int, str]:
    """Byte -> character of a code page; bytes that it leaves open show as controls."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


def code_pages() -> dict[str, dict[int, str]]:
    """All single-byte code pages that keep ASCII, the usual ones first; of equal ones the first."""
    low, out = bytes(range(128)), {}
    pairs = [bytes([b, t]) for b in range(128, 256) for t in (0x40, 0xA1)]
    for name in [*USUAL_PAGES, *sorted(m.name for m in pkgutil.iter_modules(encodings.__path__))]:
        try:
            single = not name.endswith("escape") and low.decode(name) == low.decode("ascii") and all(len(p.decode(name, "replace")) == 2 for p in pairs)
        except (LookupError, ValueError, AssertionError):
            continue
        if single and (page := _page(name)) not in out.values():
            out[name] = page
    return out


def _shapes(page: dict[int, str]) -> tuple[re.Pattern, dict[str, int]]:
    """Pattern of the UTF-8 shapes as the page shows them, and its characters' bytes."""
    cls = lambda a, b: "[" + "".join(re.escape(page[i]) for i in range(a, b + 1)) + "]"
    tail = cls(0x80, 0xBF)
    pattern = re.compile(f"{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}}")
    return pattern, {c: b for b, c in page.items()}


CODE_PAGES = code_pages()
_PAGES = [_shapes(page) for page in CODE_PAGES.values()]
#: The characters that any code page shows.
SHOWN = frozenset(c for page in CODE_PAGES.values() for c in page.values())
#: Bounds of what the driver collects, proven by the characters that there are: the alphabet, and pairs of shown characters or with ASCII.
MAX_ALPHABET = 0x110000
MAX_BIGRAMS = len(SHOWN) ** 2 + 2 * 128 * MAX_ALPHABET
_ANY = lambda first, last: "[" + "".join(re.escape(c) for c in sorted({page[i] for page in CODE_PAGES.values() for i in range(first, last)})) + "]"
#: Two characters that some pages show for a lead and a continuation byte; a text without them has no units.
_BEGINS = re.compile(_ANY(0xC2, 0xF5) + _ANY(0x80, 0xC0))


def block(letter: str) -> int:
    """Rough Unicode block of a letter."""
    n = ord(letter)
    return n >> 7 if n < 0x3000 else 0x10000 + (n >> 12)


def units_of(run: str, pages: int | None = None) -> tuple[tuple[int, str, tuple[str, ...]], ...]:
    """(offset, unit, letters) of every unit that some code page (one of the first ``pages``) sees in a run of non-ASCII characters."""
    # a run with a character that no code page shows isn't all units; short runs recur
    if not SHOWN.issuperset(run):
        return ()
    return _short_units(run, pages) if len(run) <= 32 else _units(run, pages)


@lru_cache(maxsize=50_000)
def _short_units(run: str, pages: int | None) -> tuple[tuple[int, str, tuple[str, ...]], ...]:
    return _units(run, pages)


def _units(run: str, pages: int | None) -> tuple[tuple[int, str, tuple[str, ...]], ...]:
    found: dict[tuple[int, str], dict[str, None]] = {}
    for pattern, bytes_of in _PAGES[:pages]:
        for m in pattern.finditer(run):
            try:
                letter = bytes(bytes_of[c] for c in m[0]).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if unicodedata.category(letter) not in ("Cn", "Co", "Cs"):
                found.setdefault((m.start(), m[0]), {})[letter] = None
    return tuple((at, unit, tuple(letters)) for (at, unit), letters in sorted(found.items()))


def suspicious(text: str, blocks: frozenset[int], pages: int | None = None) -> list[tuple[int, str, tuple[str, ...]]]:
    """Units of a text, with the letters whose block the corpus uses.

    Damage leaves no letter of a run of non-ASCII characters whole, so a run
    counts only if units cover it entirely.
    """
    out = []
    for run in _RUN.finditer(text) if _BEGINS.search(text) else ():
        units = [(run.start() + at, u, kept) for at, u, letters in units_of(run[0], pages) if (kept := tuple(x for x in letters if block(x) in blocks))]
        if units and not any(outside(run[0], [(at - run.start(), u, k) for at, u, k in units])):
            out += units
    return out


def explaining_page(text: str) -> int:
    """Number of the code page that explains most of a text's runs; the first of several, an unusual one only if it explains much more."""
    runs = "\0".join(_RUN.findall(text))
    cover = [sum(len(m[0]) for m in pattern.finditer(runs)) for pattern, _ in _PAGES]
    return max(range(len(cover)), key=lambda i: cover[i] * (1.0 if i < len(USUAL_PAGES) else UNUSUAL))


def letter_by(page: int, unit: str) -> str:
    """The letter that a unit shows on a code page, or an empty text."""
    try:
        letter = bytes(_PAGES[page][1][c] for c in unit).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return ""
    return letter if len(letter) == 1 else ""


def peeled(text: str, page: int | None = None) -> str:
    """``text`` with the units of the code page that explains most of it decoded, as a look at the damage below."""
    page = explaining_page(text) if page is None else page
    return _PAGES[page][0].sub(lambda m: letter_by(page, m[0]) or m[0], text)


def outside(text: str, units: list[tuple[int, str, tuple[str, ...]]]) -> list[str]:
    """The stretches of ``text`` that no unit touches."""
    parts, at = [], 0
    for start, unit, _ in units:
        if start > at:
            parts.append(text[at:start])
        at = max(at, start + len(unit))
    return [*parts, text[at:]]


class Bigrams:
    """Smoothed bigram model of undamaged text; an unknown neighbour is an empty string."""

    def __init__(self, pairs: dict[tuple[str, str], int], singles: dict[str, int]):
        self.pairs, self.singles = pairs, singles
        self.total = sum(singles.values()) + 1.0
        # the same by code point, for whole texts at once; as joint frequencies, as a swap's bigrams follow each other as usual
        keys = sorted((ord(a) << 21 | ord(b), n) for (a, b), n in pairs.items() if _swappable(a + b))
        self.keys, self.seen = np.array([k for k, _ in keys], dtype=np.int64), np.array([n for _, n in keys], dtype=float)
        self.all = max(1.0, float(self.seen.sum()))
        a, b = self.keys >> 21, self.keys & 0x1FFFFF
        likely, blocks = self.seen * self.joint(a, b), np.maximum(a, b) >> 7
        self.usual = float(likely.sum() / self.all)
        # what the bigrams of a script are like
        self.script_usual = {int(k): float(likely[blocks == k].sum() / self.seen[blocks == k].sum()) for k in np.unique(blocks)}

    def single(self, c: str) -> float:
        return (self.singles.get(c, 0) + 1e-3) / self.total

    def follows(self, a: str, b: str) -> float:
        """log P(b | a), backing off to P(b)."""
        if not b:
            return 0.0
        if not a:
            return math.log(self.single(b))
        return math.log((self.pairs.get((a, b), 0) + self.single(b)) / (self.singles.get(a, 0) + 1.0))

    def chain(self, text: list[str]) -> float:
        return sum(self.follows(a, b) for a, b in zip(text, text[1:]))

    def joint(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """log P(a, b) of many pairs of code points."""
        if not len(self.keys):
            return np.zeros(len(a))
        wanted = a << 21 | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.log((np.where(self.keys[at] == wanted, self.seen[at], 0.0) + 0.05) / self.all)

    def score(self, codes: np.ndarray) -> tuple[float, int]:
        """(log likelihood, number) of the bigrams of a text that a non-ASCII character is part of; runs of characters that no page shows are left out."""
        a, b = codes[:-1], codes[1:]
        high = ((a > 127) | (b > 127)) & (_IS_SHOWN[a] | (a < 128)) & (_IS_SHOWN[b] | (b < 128))
        return (float(self.joint(a[high], b[high]).sum()), int(high.sum())) if high.any() else (0.0, 0)


_IS_SHOWN = np.zeros(0x110000, dtype=bool)
_IS_SHOWN[[ord(c) for c in SHOWN]] = True


def codes_of(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def _slices_of(parts: list[str]) -> Iterator[str]:
    """The parts' characters in slices of bounded size."""
    waiting, size = [], 0
    for part in parts:
        for at in range(0, len(part), _SLICE):
            waiting.append(part[at : at + _SLICE])
            size += len(waiting[-1])
            if size >= _SLICE:
                yield "".join(waiting)
                waiting, size = [], 0
    yield "".join(waiting)


def judged(text: str, model: Bigrams) -> tuple[float, int, int]:
    """(log likelihood, bigrams, script) of a text's shown non-ASCII characters, slice by slice; the script is the block of most of them."""
    likely, n, blocks = 0.0, 0, np.zeros(0x110000 >> 7, dtype=np.int64)
    for at in range(0, max(1, len(text)), _SLICE):
        codes = codes_of(text[max(0, at - 1) : at + _SLICE])
        part, m = model.score(codes)
        likely, n = likely + part, n + m
        own = codes[(codes > 127) & _IS_SHOWN[codes]] >> 7
        blocks += np.bincount(own, minlength=len(blocks))
    return likely, n, int(blocks.argmax())


def learn_swap(pairs: list[tuple[str, str, int]], model: Bigrams, rounds: int = ROUNDS) -> dict[str, str]:
    """Symbol -> letter of the swapped texts of one source and script, by EM over their bigrams ``pairs`` (a, b, count).

    The hidden variable is the letter behind each symbol. It starts from the
    pair of code pages (the bytes' own and the one that they were read by) that
    makes the bigrams likeliest; then, in turn, the letters of the neighbours
    are taken as they stand and each symbol's letter is chosen anew among all
    that code pages have for it. Empty if nothing is likelier than the symbols.
    """
    n = np.array([k for _, _, k in pairs], dtype=float)
    codes, at = np.unique([ord(c) for x, y, _ in pairs for c in (x, y)], return_inverse=True)
    a, b = at[::2], at[1::2]
    mass = np.bincount(a, n, len(codes)) + np.bincount(b, n, len(codes))
    symbols = [i for i, c in enumerate(codes) if c > 127 and chr(c) in SHOWN]
    usual = lambda to: float((n * model.joint(to[a], to[b])).sum())
    best, likely = codes, usual(codes)
    letters = {i: {int(codes[i])} for i in symbols}
    for shown in CODE_PAGES.values():
        byte_of = {ord(c): k for k, c in shown.items()}
        inside = [i for i in symbols if int(codes[i]) in byte_of]
        if not symbols or mass[inside].sum() < 0.9 * mass[symbols].sum():
            continue
        for own in CODE_PAGES.values():
            to = codes.copy()
            for i in inside:
                to[i] = ord(own[byte_of[int(codes[i])]])
                letters[i].add(int(to[i]))
            if (now := usual(to)) > likely:
                best, likely = to, now
    if best is codes:
        return {}
    for _ in range(rounds):
        changed = False
        for i, choices in letters.items():
            near = (a == i) | (b == i)
            total = {}
            # a cipher has one symbol for each letter
            for c in choices - {int(best[j]) for j in letters if j != i} | {int(best[i])}:
                to = best.copy()
                to[i] = c
                total[c] = float((n[near] * model.joint(to[a[near]], to[b[near]])).sum())
            top = max(sorted(total), key=total.__getitem__)
            # another letter must be likelier by some evidence, not by a tie
            if total[top] > total[int(best[i])] + 1.0:
                best[i], changed = top, True
        if not changed:
            break
    return {chr(codes[i]): chr(best[i]) for i in symbols if best[i] != codes[i]}


def learn_mapping(contexts: list[tuple[str, str, str, str, int]], letters_of: dict[str, tuple[str, ...]], model: Bigrams, usual: dict[str, tuple[str, ...]] | None = None, rounds: int = ROUNDS) -> dict[str, str]:
    """Unit -> letter of one source by EM; units that are rather genuine are left out.

    ``contexts`` are (unit, previous, next, hint, count). The hidden variable
    of an occurrence is its reading: one of the unit's letters, or the unit
    itself. The hint is the letter on the code page that explains most of the
    text; it is right with probability ``HINT``, and where it is one of the
    ``usual`` letters, an unusual page's letter needs ``FAR`` more evidence.
    """
    likely: dict[str, list[tuple[int, list[float]]]] = {}
    for unit, before, after, hint, n in contexts:
        right, wrong = (math.log(HINT), math.log(1 - HINT)) if hint else (0.0, 0.0)
        far = FAR if hint and usual and hint in usual.get(unit, ()) else 0.0
        readings = [model.chain([before, x, after]) + (right if x == hint else wrong - (far if usual and x not in usual.get(unit, ()) else 0.0)) for x in letters_of[unit]]
        genuine = model.chain([before, *unit, after]) + (math.log(0.5) if hint else 0.0)
        likely.setdefault(unit, []).append((n, [genuine, *readings]))
    theta = {u: [1 - DAMAGED] + [DAMAGED / len(letters_of[u])] * len(letters_of[u]) for u in likely}
    for _ in range(rounds):
        for unit, rows in likely.items():
            sums = [0.0] * len(theta[unit])
            for n, logs in rows:
                weights = [x + math.log(max(t, 1e-300)) for x, t in zip(logs, theta[unit])]
                top = max(weights)
                parts = [math.exp(w - top) for w in weights]
                scale = n / sum(parts)
                for i, p in enumerate(parts):
                    sums[i] += p * scale
            prior = [1 - DAMAGED] + [DAMAGED / len(letters_of[unit])] * len(letters_of[unit])
            whole = sum(sums) + 0.1
            theta[unit] = [(s + 0.1 * p) / whole for s, p in zip(sums, prior)]
    mapping = {}
    for unit, t in theta.items():
        best = max(range(1, len(t)), key=t.__getitem__)
        if t[best] > t[0]:
            mapping[unit] = letters_of[unit][best - 1]
    return mapping


class Cipher:
    """A source's mapping, ready to be applied with ``translate()``."""

    def __init__(self, mapping: dict[str, str]):
        units = sorted(mapping, key=lambda u: (-len(u), u))
        # supplementary private-use characters are the cipher's alphabet
        self.symbol = {u: chr(0xF0000 + i) for i, u in enumerate(units)}
        self.table = {0xF0000 + i: mapping[u] for i, u in enumerate(units)}
        self.pattern = re.compile("|".join(map(re.escape, units))) if units else None

    def restore(self, text: str) -> str:
        # every round that changes the text makes it shorter
        while self.pattern:
            coded = self.pattern.sub(lambda m: self.symbol[m[0]], text)
            if coded == text:
                break
            text = coded.translate(self.table)
        return text


def _sum_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n").alias("n"))


def alphabet(docs: DataFrame, text: str) -> DataFrame:
    """(c): the characters in use."""
    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: set[str] = set()
        for batch in batches:
            used.update(*batch[text])
        yield pd.DataFrame({"c": sorted(used)})

    return docs.where(F.col(text).isNotNull()).select(text).mapInPandas(collect, "c string").distinct()


def _swappable(pair: str) -> bool:
    """Whether a bigram has a non-ASCII character that code pages show, next to ASCII or another."""
    return not pair.isascii() and all(c < "\x80" or c in SHOWN for c in pair)


def _kept(pair: str) -> bool:
    """Whether a bigram can be part of a unit's reading: with ASCII, or of characters that code pages show."""
    return pair[0] < "\x80" or pair[1] < "\x80" or (pair[0] in SHOWN and pair[1] in SHOWN)


def _count_texts(docs: DataFrame, source: str, text: str, blocks: frozenset[int]) -> DataFrame:
    """Counts for the model and of the units' contexts: (kind, source, a, b, c, d, n), summed per task."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        singles = np.zeros(0x110000, dtype=np.int64)
        pairs: Counter = Counter()
        units_at: Counter = Counter()
        for batch in batches:
            around: list[str] = []
            plain_parts: list[str] = []
            for s, t in zip(batch[source], batch[text]):
                if t.isascii():
                    plain_parts.append(t)
                    continue
                units = suspicious(t, blocks)
                # what only an unusual page explains is mostly genuine and teaches the model, so that damage by it must be likelier
                plain = suspicious(t, blocks, len(USUAL_PAGES)) if units else units
                # chance units of genuine text are few among its letters; then the text may teach the model
                if LOST not in t and 2 * sum(len(u) for _, u, _ in plain) < 1 + len(t) - len(t.encode("ascii", "ignore")):
                    for part in outside(t, plain) if plain else (t,):
                        around += map("".join, _AROUND.findall(part))
                        plain_parts.append(part)
                while units:
                    page = explaining_page(t)
                    for at, unit, _ in units:
                        before, after = t[at - 1 : at] if at else "", t[at + len(unit) : at + len(unit) + 1]
                        # a neighbour that is itself damaged tells nothing
                        units_at[s, unit, before if before < "\x80" else "", after if after < "\x80" else "", letter_by(page, unit)] += 1
                    # each look below shortens the text
                    t, above = peeled(t, page), t
                    units = suspicious(t, blocks) if t != above else []
            for part in _slices_of(plain_parts):
                n = np.bincount(codes_of(part))
                singles[: len(n)] += n
            # all runs of a batch at once; what joins them is left out when the counts are written
            joined = _BETWEEN.join(around)
            pairs.update(map(operator.add, joined, joined[1:]))
            if len(pairs) + len(units_at) > 500_000:
                yield _frame(singles, pairs, units_at)
                singles, pairs, units_at = np.zeros_like(singles), Counter(), Counter()
        yield _frame(singles, pairs, units_at)

    schema = "kind string, source string, a string, b string, c string, d string, n long"
    return _sum_counts(docs.select(F.col(source).alias(source), text).mapInPandas(count, schema), "kind", "source", "a", "b", "c", "d")


def _frame(singles: np.ndarray, pairs: Counter, units_at: Counter) -> pd.DataFrame:
    rows = [("single", None, chr(c), None, None, None, int(singles[c])) for c in np.flatnonzero(singles).tolist()]
    rows += [("pair", None, p[0], p[1], None, None, n) for p, n in pairs.items() if _BETWEEN not in p and _kept(p)]
    rows += [("unit", *key, n) for key, n in units_at.items()]
    return pd.DataFrame(rows, columns=["kind", "source", "a", "b", "c", "d", "n"])


def learn(docs: DataFrame, source: str, text: str):
    """(ciphers, model): (source, units, letters) of every source with damage, and the broadcast language model."""
    used = collect_bounded(alphabet(docs, text), MAX_ALPHABET, "alphabet")
    blocks = frozenset(block(r["c"]) for r in used)
    counts = checkpointed(_count_texts(docs, source, text, blocks))
    pairs = collect_bounded(counts.where("kind = 'pair'").select("a", "b", "n"), MAX_BIGRAMS, "bigrams")
    singles = collect_bounded(counts.where("kind = 'single'").select("a", "n"), MAX_ALPHABET, "alphabet")
    model = docs.sparkSession.sparkContext.broadcast(Bigrams({(r[0], r[1]): r[2] for r in pairs}, {r[0]: r[1] for r in singles}))

    def em(pdf: pd.DataFrame) -> pd.DataFrame:
        letters = {u: tuple(dict.fromkeys(x for at, unit, xs in units_of(u) if unit == u for x in xs if block(x) in blocks)) for u in set(pdf["a"])}
        usual = {u: tuple(x for at, unit, xs in units_of(u, len(USUAL_PAGES)) if unit == u for x in xs) for u in letters}
        mapping = learn_mapping(list(zip(pdf["a"], pdf["b"], pdf["c"], pdf["d"], pdf["n"])), letters, model.value, usual)
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "units": [list(mapping)], "letters": [list(mapping.values())]})

    # of one source there are as many rows as units and neighbours, however many texts it has
    units = counts.where("kind = 'unit'").select("source", "a", "b", "c", "d", "n")
    return units.groupBy("source").applyInPandas(em, "source string, units array<string>, letters array<string>"), model


def odd_texts(docs: DataFrame, model, key: str) -> DataFrame:
    """(key, source, script, text): the texts whose characters are far less likely than the corpus's."""
    kind = dict(docs.dtypes)[key]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            least, rows = model.value.usual - ODD, []
            for k, s, t in zip(batch[key], batch["source"], batch["text"]):
                likely, n, script = judged(t, model.value)
                if n and likely < least * n:
                    rows.append((k, s, script, t))
            yield pd.DataFrame(rows, columns=[key, "source", "script", "text"])

    return docs.mapInPandas(look, f"{key} {kind}, source string, script int, text string")


def learn_swaps(odd: DataFrame, model) -> DataFrame:
    """(source, script, symbols, letters) of the swaps in ``odd_texts``."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs: Counter = Counter()
        for batch in batches:
            for s, b, t in zip(batch["source"], batch["script"], batch["text"]):
                pairs.update((s, b, x, y) for x, y in zip(t, t[1:]) if _swappable(x + y))
        yield pd.DataFrame([(*k, n) for k, n in pairs.items()], columns=["source", "script", "a", "b", "n"])

    def em(pdf: pd.DataFrame) -> pd.DataFrame:
        mapping = learn_swap(list(zip(pdf["a"], pdf["b"], pdf["n"])), model.value)
        return pd.DataFrame({"source": pdf["source"].iloc[:1], "script": pdf["script"].iloc[:1], "symbols": ["".join(mapping)], "to": ["".join(mapping.values())]})

    counts = _sum_counts(odd.mapInPandas(count, "source string, script int, a string, b string, n long"), "source", "script", "a", "b")
    # of one source and script there are at most as many rows as bigrams of shown characters
    return counts.groupBy("source", "script").applyInPandas(em, "source string, script int, symbols string, to string").where("symbols <> ''")


def swapped_back(odd: DataFrame, swaps: DataFrame, model, key: str) -> DataFrame:
    """(key, restored) of the odd texts that their source's swap makes far likelier."""
    kind = dict(odd.dtypes)[key]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t, symbols, to in zip(batch[key], batch["text"], batch["symbols"], batch["to"]):
                restored = t.translate(str.maketrans(symbols, to))
                (before, n, _), (after, m, script) = judged(t, model.value), judged(restored, model.value)
                gain = after / max(1, m) - before / n
                # the result must be like the texts of its script, not only better than what it was
                if gain >= GAIN and gain * n >= WHOLE_GAIN and after >= (model.value.script_usual.get(script, 0.0) - ALIKE) * m:
                    rows.append((k, restored))
            yield pd.DataFrame(rows, columns=[key, "restored"])

    return odd.join(swaps, ["source", "script"]).select(key, "text", "symbols", "to").mapInPandas(apply, f"{key} {kind}, restored string")


def restore(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, restored, lost) of the damaged texts.

    ``restored`` is the whole text with all damage undone; it is null, and
    ``lost`` true, where characters were replaced and can't be had back. Texts
    without damage, null, empty and ASCII texts give no row. Texts of a null
    source are a source of their own.
    """
    rows = spread(docs.select(key, F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text")).where("text IS NOT NULL"))
    ciphers, model = learn(rows, "source", "text")
    lost = F.contains(F.col("text"), F.lit(LOST))
    doubtful = rows.where(F.col("text").rlike(_SUSPECT) & ~lost)
    # one row per source against the texts: a join on a skewed key, which AQE splits
    joined = doubtful.join(ciphers, "source").select(key, "text", "units", "letters")
    kind = dict(docs.dtypes)[key]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[tuple, Cipher] = {}
        for batch in batches:
            out = []
            for t, units, letters in zip(batch["text"], batch["units"], batch["letters"]):
                mapping = (tuple(units), tuple(letters))
                if mapping not in made:
                    made[mapping] = Cipher(dict(zip(units, letters)))
                out.append(made[mapping].restore(t))
            changed = [a != b for a, b in zip(out, batch["text"])]
            yield pd.DataFrame({key: batch[key], "restored": out})[changed]

    fixed = checkpointed(joined.mapInPandas(apply, f"{key} {kind}, restored string"))
    # what no unit explains may be a swap
    odd = checkpointed(odd_texts(rows.where(F.col("text").rlike(r"[^\x00-\x7F]") & ~lost), model, key).join(fixed.select(key), key, "left_anti"))
    swapped = swapped_back(odd, checkpointed(learn_swaps(odd, model)), model, key)
    gone = rows.where(lost).select(key, F.lit(None).cast("string").alias("restored"), F.lit(True).alias("lost"))
    return fixed.unionByName(swapped).withColumn("lost", F.lit(False)).unionByName(gone)


def restored_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, restored_sha256): hash of each damaged document's restored text, empty where it is lost."""
    out = restore(docs, "doc_id", "text", "source")
    return out.select("doc_id", F.when(F.col("lost"), F.lit("")).otherwise(F.sha2(F.col("restored"), 256)).alias("restored_sha256"))
