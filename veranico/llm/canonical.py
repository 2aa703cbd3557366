"""Freely entered names mapped to the entries of a reference list.

A symmetric-delete dictionary of the list is broadcast: every name, and every
word of the names, is stored under the hashes of what is left after deleting
up to two letters. A value that shares such a rest with a name may be within
the bounded edit distance of it; a value whose every word is near, or a
shortening of, the word at its place in a name may be an abbreviation of it.
As the cheapest edit costs 0.7 and the bound is 2, two deletes miss nothing.
Candidates are ranked by a weighted Damerau-Levenshtein distance, in which
abbreviated words cost little, then by the agreement of the state and the
frequency of the name in the list; values beyond the bound are reported as
misses. Each distinct value is mapped once; the answers of frequent values are
broadcast (their number is bounded), the others are joined.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veranico.session import cut, parallel, ship

# Words before or behind a name that aren't part of it.
FILLERS = {"estado", "est", "municipio", "mun", "munic", "pref", "prefeitura", "municipal", "bioma", "brasil", "cidade"}
# Small words that names may lose.
SMALL = {"de", "do", "da", "dos", "das"}
# Names in use beside the listed ones (the default of a parameter).
ALIASES = {"atlantic forest": "mata atlantica", "amazon": "amazonia", "amz": "amazonia", "amazon forest": "amazonia", "rainforest": "amazonia", "wetland": "pantanal", "savanna": "cerrado", "distrito fed": "distrito federal"}
VOWELS = frozenset("aeiouy")


def plain(text: str) -> str:
    """Lower case without accents, repaired encodings, entities read, odd spaces made one space."""
    text = html.unescape(text)
    if "Ã" in text or "Â" in text:
        for code in ("latin-1", "cp1252"):
            try:
                text = text.encode(code).decode("utf-8")
                break
            except UnicodeError:
                pass
    text = unicodedata.normalize("NFKD", text.replace("’", "'").replace("`", "'"))
    text = "".join(c for c in text if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", text).strip()


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text)


def deletes(word: str, most: int = 2) -> set[str]:
    """The word and what is left after deleting up to ``most`` (at most two) letters."""
    out, n = {word}, len(word)
    if most >= 1 and n > 1:
        out.update([word[:i] + word[i + 1 :] for i in range(n)])
    if most >= 2 and n > 2:
        out.update([word[:i] + word[i + 1 : j] + word[j + 1 :] for i in range(n) for j in range(i + 1, n)])
    return out


def distance(a: str, b: str, bound: float = 4.0) -> float:
    """Weighted Damerau-Levenshtein: neighbours swapped 0.8, a letter doubled or undoubled 0.7, a vowel for a vowel 0.9, other edits 1.

    Texts without a common letter are beyond any bound.
    """
    if a == b:
        return 0.0
    # An edit changes the length by one and the set of letters by two at most, and costs 0.7 at least.
    if abs(len(a) - len(b)) * 0.7 > bound or len(set(a) ^ set(b)) * 0.35 > bound or set(a).isdisjoint(b):
        return bound + 1
    before: list[float] = []
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [float(i)]
        for j, y in enumerate(b, 1):
            if x == y:
                best = row[j - 1]
            else:
                best = row[j - 1] + (0.9 if x in VOWELS and y in VOWELS else 1.0)
            drop = row[j] + (0.7 if i > 1 and a[i - 2] == x else 1.0)
            add = new[j - 1] + (0.7 if j > 1 and b[j - 2] == y else 1.0)
            best = min(best, drop, add)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, before[j - 2] + 0.8)
            new.append(best)
        if min(new) > bound:
            return bound + 1
        before, row = row, new
    return row[-1]


def shortened(short: str, word: str) -> bool:
    """Whether ``short`` can stand for ``word``: same first letter, its letters in the word's order."""
    if len(short) >= len(word) or not short or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def by_words(value: list[str], name: list[str], bound: float = 4.0) -> float:
    """Distance word by word, where a shortened word costs 0.3 and a small word may be missing."""
    v, n = [w for w in value if w not in SMALL], [w for w in name if w not in SMALL]
    if len(v) != len(n):
        return 9.0
    total = 0.0
    for x, y in zip(v, n):
        if x != y:
            total += 0.3 if shortened(x, y) and (len(x) <= 4 or y.startswith(x)) else distance(x, y, bound)
            if total > bound:
                return bound + 1
    return total


class Deletes:
    """A symmetric-delete dictionary: sorted hashes of the rests, and the term that each belongs to.

    12 bytes a rest. A clash of hashes only adds a candidate, which the distance rejects.
    """

    def __init__(self, terms: Iterable[str], most: int = 2):
        self.terms, self.most = list(terms), most
        pairs = [(xxhash.xxh3_64_intdigest(rest), i) for i, t in enumerate(self.terms) for rest in deletes(t, most)]
        rests = np.array([h for h, _ in pairs], dtype=np.uint64)
        order = np.argsort(rests, kind="stable")
        self.rests, self.at = rests[order], np.array([i for _, i in pairs], dtype=np.int32)[order]
        self.longest = max(map(len, self.terms), default=0)

    def near(self, word: str) -> set[str]:
        """Terms that share a rest with ``word``: all within ``most`` edits of it, and some beyond."""
        # What is longer than every term by more than the deletes allow is near none.
        if len(word) > self.longest + self.most:
            return set()
        asked = np.array([xxhash.xxh3_64_intdigest(rest) for rest in deletes(word, self.most)], dtype=np.uint64)
        lo, hi = np.searchsorted(self.rests, asked, "left"), np.searchsorted(self.rests, asked, "right")
        return {self.terms[i] for a, b in zip(lo[lo < hi], hi[lo < hi]) for i in self.at[a:b]}


class Names:
    """The list of one kind, with its symmetric-delete dictionaries of names and of their words."""

    def __init__(self, entries: list[tuple[int, str, str | None]]):
        self.by_key: dict[str, list[tuple[int, str | None]]] = defaultdict(list)
        self.split: dict[str, list[str]] = {}
        for entry_id, name, state in entries:
            w = words(plain(name))
            if w:
                self.by_key["".join(w)].append((entry_id, state))
                self.split["".join(w)] = w
        self.whole = Deletes(self.split)
        # Names by their number of words, without small ones, and the word at each place.
        self.having: dict[tuple[int, int, str], list[str]] = defaultdict(list)
        self.bare: dict[str, list[str]] = {}
        for key, w in self.split.items():
            self.bare[key] = kept = [x for x in w if x not in SMALL]
            for place, x in enumerate(kept):
                self.having[len(kept), place, x].append(key)
        every = {x for kept in self.bare.values() for x in kept}
        self.words = Deletes(every)
        self.by_first: dict[str, list[str]] = defaultdict(list)
        for x in every:
            self.by_first[x[0]].append(x)
        self.matching: dict[str, frozenset[str]] = {}

    def matches(self, word: str) -> frozenset[str]:
        """Words of the list that ``word`` may stand for: near ones and those it shortens."""
        if (found := self.matching.get(word)) is None:
            if len(self.matching) > 200_000:  # memory only
                self.matching.clear()
            short = {y for y in self.by_first.get(word[:1], ()) if shortened(word, y) and (len(word) <= 4 or y.startswith(word))}
            found = self.matching[word] = frozenset(self.words.near(word) | short)
        return found

    def candidates(self, w: list[str]) -> set[str]:
        """Every name within two edits of the value, or within two word by word, and some beyond."""
        found = self.whole.near("".join(w))
        kept = [x for x in w if x not in SMALL]
        if kept and all(sets := [self.matches(x) for x in kept]):
            # Start at the place with the fewest names, then ask for the other places' words.
            lists = [[name for y in ys for name in self.having.get((len(kept), place, y), ())] for place, ys in enumerate(sets)]
            for name in min(lists, key=len):
                if all(y in ys for y, ys in zip(self.bare[name], sets)):
                    found.add(name)
        return found

    def ranked(self, w: list[str], bound: float) -> list[tuple[float, str]]:
        """(distance, name key) of the names within the bound (at most two), nearest first."""
        key = "".join(w)
        if key in self.by_key:
            return [(0.0, key)]
        return sorted((d, k) for k in self.candidates(w) if (d := min(by_words(w, self.split[k], bound), distance(key, k, bound))) <= bound)


class PlaceMapper:
    """Entries of states, biomes and municipalities for freely entered values."""

    def __init__(self, entries: list[tuple[int, str, str, str | None]], aliases: Mapping[str, str] = ALIASES):
        kinds: dict[str, list[tuple[int, str, str | None]]] = {"state": [], "biome": [], "municipality": []}
        for entry_id, kind, name, state in entries:
            if kind in kinds and name:
                kinds[kind].append((entry_id, name, state))
        self.lists = {k: Names(v) for k, v in kinds.items()}
        self.aliases = aliases
        self.states: dict[tuple[str, float], int] = {}  # answers by text
        self.codes = {s.lower(): (i, s) for i, _, s in kinds["state"] if s}
        self.code_of = {i: s for i, _, s in kinds["state"]}

    def short_name(self, value: str, kind: str, bound: float = 2.0) -> int:
        """The entry of a short list (states, biomes), 0 if none."""
        text = plain(value)
        names = self.lists[kind]
        inside = re.findall(r"\(([^()]*)\)", text)
        outside = re.sub(r"\([^()]*\)", " ", text)
        for piece in [outside, *re.split(r"[/,;:|]| - ", outside), *inside]:
            w = [x for x in words(piece) if x not in FILLERS]
            while w and w[0] in SMALL:
                w = w[1:]
            if not w:
                continue
            joined = "".join(w)
            if kind == "state" and joined in self.codes and (len(w) == 1 or all(len(x) == 1 for x in w)):
                return self.codes[joined][0]
            if (alias := self.aliases.get(" ".join(w))) and (k := alias.replace(" ", "")) in names.by_key:
                return names.by_key[k][0][0]
            if joined.isdigit() or len(joined) < 3:
                continue
            best = names.ranked(w, min(bound, 1.0 if len(joined) < 5 else 2.0))
            if best and (best[0][0] == 0 or len(best) == 1 or best[0][0] < best[1][0]):
                return names.by_key[best[0][1]][0][0]
            short = {k for k, full in names.split.items() if by_words(w, full) < 1} or {
                k for k, full in names.split.items() if k.startswith(joined) and len(joined) >= 4
            } or {k for k, full in names.split.items() if len(w) == 1 and joined == "".join(x[0] for x in full if x not in SMALL) and len(joined) > 2}
            if len(short) == 1:
                return names.by_key[short.pop()][0][0]
            held = {k for x in w for d, k in names.ranked([x], 1.0) if len(x) >= 5 and len(names.split[k]) == 1}
            if len(held) == 1:
                return names.by_key[held.pop()][0][0]
        return 0

    def state_of(self, text: str | None, bound: float = 1.0) -> str | None:
        """The code of the state that a text names."""
        if not text or not text.strip():
            return None
        if (text, bound) not in self.states:
            if len(self.states) > 200_000:  # memory only
                self.states.clear()
            self.states[text, bound] = self.short_name(text, "state", bound)
        return self.code_of.get(self.states[text, bound])

    def municipality(self, value: str, state: str | None, bound: float = 2.0) -> int:
        """The municipality's entry, told apart by the state within the value, else by ``state``; 0 if none."""
        text = plain(value)
        own, name = None, text
        if (m := re.match(r"^([a-z]{2})\s*[-/]\s*(\S.{3,})$", text)) and m.group(1) in self.codes:
            own, name = self.codes[m.group(1)][1], m.group(2)
        for pattern in (r"^(.*?)\s*\(([^()]*)\)\s*$", r"^(.*\S)\s*[/]\s*([a-z .]+)$", r"^(.*\S)\s+-\s+([a-z .]+)$", r"^(.*\S)\s*,\s*([a-z .]+)$", r"^(.*\S)\s*-\s*([a-z]{2})$"):
            if own is None and (m := re.match(pattern, text)) and (s := self.state_of(m.group(2))):
                own, name = s, m.group(1)
                break
        if "," in name:  # the first word of a name was put behind it
            head, tail = name.split(",", 1)
            name = tail + " " + head
        w = words(name)
        while w and (w[0] in FILLERS or (w[0] in SMALL and len(w) > 1)):
            w = w[1:]
        if not w:
            return 0
        names = self.lists["municipality"]
        ranked = names.ranked(w, bound)
        best: tuple[float, float, int, int] | None = None
        for d, k in ranked:
            entries = names.by_key[k]
            fit = [i for i, s in entries if own and s == own] or [i for i, s in entries if state and s == state]
            if fit:
                cost, entry = d, fit[0]
            elif len(entries) == 1 and d == 0:
                cost, entry = 0.0, entries[0][0]
            elif len(entries) == 1:
                cost, entry = d + (0.6 if (own or state) else 0.1), entries[0][0]
            else:
                continue  # namesakes that no state tells apart
            rank = (cost, d, -len(entries), entry)
            if best is None or rank < best:
                best = rank
        if best is None or best[0] > bound:
            return 0
        return best[3]


_MAPPERS: dict[str, PlaceMapper] = {}


def mapper_of(digest: str, shared) -> PlaceMapper:
    """The worker's mapper of the list with this digest (of all its rows and aliases), read from its broadcast once.

    A module's function, so that workers keep it between tasks.
    """
    if (found := _MAPPERS.get(digest)) is None:
        if len(_MAPPERS) >= 4:  # memory only
            _MAPPERS.clear()
        found = _MAPPERS[digest] = shared.value
    return found


def map_places(
    df: DataFrame, entries: DataFrame, *, key: str, municipality: str, state: str, biome: str, aliases: Mapping[str, str] = ALIASES, most_entries: int = 50_000, frequent: int = 1000
) -> DataFrame:
    """(key, field_name, entry_id): one row per value that isn't NULL; entry_id is 0 where no entry fits.

    ``entries`` has entry_id, list_name, canonical_name and state_acronym; it is
    a reference list, compiled on the driver and broadcast after a check that it
    has at most ``most_entries`` rows. Empty and blank values give 0. Of names
    at the same distance the one with the agreeing state wins, then the more
    frequent name, then the smaller id; namesakes that no state tells apart give
    0. Repeated rows give a row each; with an empty list every value gives 0.
    Values that make up over one in ``frequent`` of all values (so fewer than
    that) are joined by broadcast, so none of them is a hot group.
    """
    spark = df.sparkSession
    ship(spark)
    rows = entries.select("entry_id", "list_name", "canonical_name", "state_acronym").orderBy("entry_id", "list_name", "canonical_name", "state_acronym").limit(most_entries + 1).collect()
    if len(rows) > most_entries:
        raise ValueError(f"the reference list has over {most_entries} entries")
    listed = [tuple(r) for r in rows]
    digest = hashlib.sha256(repr((listed, sorted(aliases.items()))).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(PlaceMapper(listed, aliases))
    text = lambda c: F.col(f"`{c}`").cast("string")
    none = F.lit(None).cast("string")
    asked = F.array(
        *[F.struct(F.lit(i).alias("kind"), text(c).alias("v"), beside.alias("s")) for i, (c, beside) in enumerate(((municipality, text(state)), (state, none), (biome, none)))]
    )
    long = df.select(F.col(f"`{key}`").alias("key"), F.explode(asked).alias("a")).select("key", "a.*").filter("v is not null")
    counted = long.groupBy("kind", "v", "s").agg(F.count(F.lit(1)).alias("n")).repartition(parallel(df), "v", "s")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mapper = mapper_of(digest, shared)
        for f in frames:
            ids = [mapper.municipality(v, mapper.state_of(s, 2.0)) if kind == 0 else mapper.short_name(v, ("", "state", "biome")[kind]) for kind, v, s in zip(f["kind"], f["v"], f["s"])]
            yield f.assign(entry_id=pd.Series(ids, dtype="int64", index=f.index))

    answers = cut(counted.mapInPandas(run, "kind int, v string, s string, n bigint, entry_id bigint"))
    total = answers.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    usual = F.col("n") * frequent > total
    same = lambda a: long["kind"].eqNullSafe(a["kind"]) & long["v"].eqNullSafe(a["v"]) & long["s"].eqNullSafe(a["s"])
    often, rest = F.broadcast(answers.filter(usual)), answers.filter(~usual)
    found = long.join(often, same(often), "left").select("key", long["kind"], long["v"], long["s"], "entry_id")
    told = found.filter("entry_id is not null").select("key", "kind", "entry_id")
    left = found.filter("entry_id is null").select("key", F.col("kind").alias("lk"), F.col("v").alias("lv"), F.col("s").alias("ls"))
    others = left.join(rest, F.col("lk").eqNullSafe(F.col("kind")) & F.col("lv").eqNullSafe(F.col("v")) & F.col("ls").eqNullSafe(F.col("s"))).select("key", "kind", "entry_id")
    name = F.get(F.array(*[F.lit(c) for c in (municipality, state, biome)]), F.col("kind"))
    return told.unionByName(others).select(F.col("key").alias(key), name.alias("field_name"), "entry_id")
