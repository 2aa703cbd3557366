"""Subject areas of documents by label propagation over a document-similarity graph.

The words that labelled documents tell to be one subject's are the terms. A
term of a document is verified when it comes in at least two of its sentences
and claims. All documents that share a verified term are neighbours, the edge
between two weighs the cosine of their verified terms. The edges grow with the
square of the documents, so they aren't listed: as the cosine is a sum over the
shared terms, labels move from documents to terms and on to documents, which
gives the same sums exactly, and a step grows in proportion to the documents'
terms. Labels start at trusted seed documents, which stay clamped, and move
along the edges by DataFrame joins; a document can hold several. Labelled
documents then tell the subject of each term, clear terms tell the subjects of
sentences, a term between two subjects goes to the one that the document was
labelled with, and a document has every subject that a given share of its
sentences with any subject treats.
"""

from __future__ import annotations

import html
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veranico.session import cut, parallel, ship, spread

#: The end of a sentence or claim, in the stream of words.
END = "\n"

# Abbreviations whose point ends no sentence.
ABBREVIATED = {"fig.", "figs.", "cf.", "vgl.", "nr.", "no.", "bzw.", "ca.", "z.b.", "d.h.", "e.g.", "i.e.", "p.ex.", "abb.", "ref.", "sr.", "dr.", "(cf.", "(vgl."}

_TAG = regex.compile(r"<[^<>\n]{1,40}>")
_BROKEN = regex.compile(r"(?<=\p{L})-\r?\n\s*(?=\p{Ll})")
_WORD = regex.compile(r"[a-zß]{2,}")
_MARKS = regex.compile(r"[\u0300-\u036f]+")
# A letter of two UTF-8 bytes that was read as two characters.
_PAIR = regex.compile(r"[ÂÃ][\u0080-\u00bf\u0152-\u0192\u02c6-\u02dc\u2013-\u203a\u20ac\u2122]")
# Digits that scanning put for letters inside a word.
_ONE = regex.compile(r"(?<=[a-z])1(?=[a-z])|\b1(?=[a-z]{3})|(?<=[a-z]{3})1\b")
_ZERO = regex.compile(r"(?<=[a-z])0(?=[a-z])|\b0(?=[a-z]{3})|(?<=[a-z]{3})0\b")


def _repaired(m) -> str:
    for code in ("latin-1", "cp1252"):
        try:
            return m.group().encode(code).decode("utf-8")
        except UnicodeError:
            pass
    return m.group()


class _Reader(dict):
    """Lower-case words without accents of each piece of text between spaces, with END behind a sentence's last."""

    def __missing__(self, piece: str) -> tuple[str, ...]:
        if len(self) > 400_000:  # memory only: entries are made again when needed
            self.clear()
        text = _PAIR.sub(_repaired, piece).lower() if "Ã" in piece or "Â" in piece else piece.lower()
        ends = text.rstrip("\"')]}»”")[-1:] in (".", "!", "?", ";") and text not in ABBREVIATED and not text[0].isdigit()
        if not text.isascii():
            text = _MARKS.sub("", unicodedata.normalize("NFD", text))
        if "1" in text or "0" in text:
            text = _ZERO.sub("o", _ONE.sub("l", text))
        found = tuple(_WORD.findall(text)) + ((END,) if ends else ())
        if len(piece) < 100:
            self[piece] = found
        return found


def pieces(text: str) -> list[str]:
    """The text between spaces, without markup, with words joined that a line's end broke."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" . ", text)
    if "-\n" in text or "-\r" in text:
        text = _BROKEN.sub("", text)
    return text.split()


def label_spread(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(word, label, n): in how many of a label's seed documents each word comes."""
    labelled = docs.join(marks.groupBy("doc").agg(F.collect_set("label").alias("labels")), "doc")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int]] = Counter()
        words = _Reader()

        def drained() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in seen], pa.string()), pa.array([i for _, i in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["word", "label", "n"])

        for batch in batches:
            for text, labels in zip(batch.column("text").to_pylist(), batch.column("labels").to_pylist()):
                own = set(chain.from_iterable(map(words.__getitem__, set(pieces(text)))))
                for label in labels:
                    seen.update((w, label) for w in own)
            if len(seen) > 500_000:
                yield drained()
                seen.clear()
        yield drained()

    parts = labelled.select("text", "labels").mapInArrow(count, "word string, label int, n bigint")
    return parts.filter(F.col("word") != END).groupBy("word", "label").agg(F.sum("n").alias("n"))


def telling_words(docs: DataFrame, marks: DataFrame, lift: float, least: int = 2) -> DataFrame:
    """(word, n): words in at least ``least`` seed documents of the label where they are clear.

    Each label's count is taken by its own number of seed documents, so a label
    of a third of the corpus keeps its words. Clear is ``lift`` of the sum over
    the labels, and at least half above the mean of the other labels; a single
    label tells no word.
    """
    sizes = docs.select("doc").join(marks, "doc").groupBy("label").agg(F.count(F.lit(1)).alias("all"))  # one row per subject
    k = sizes.agg(F.count(F.lit(1)).alias("k"))
    rates = label_spread(docs, marks).join(F.broadcast(sizes), "label").withColumn("v", F.col("n") / F.col("all"))
    best = rates.groupBy("word").agg(F.max(F.struct("v", "n")).alias("top"), F.sum("v").alias("sum")).crossJoin(F.broadcast(k))
    return best.filter((F.col("top.n") >= least) & (F.col("top.v") >= F.greatest(F.lit(lift), 1.5 / (F.col("k") + 0.5)) * F.col("sum")) & (F.col("k") > 1)).select("word", F.col("top.n").alias("n"))


def read_terms(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(row, doc, us, ps, ts, terms, counts, m): the number of sentence, the place in the text and the id of each term in order; in how many sentences each term comes; the number of sentences with terms.

    ``docs`` has row, doc and text. Rows without terms are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, codes = shared.value, _Reader(), {}

        def coded(piece: str) -> tuple[int, ...]:
            """-1 the end of a sentence, else the term's id or 0, of the words of a piece; nothing where it has no word."""
            if (found := codes.get(piece)) is None:
                if len(codes) > 400_000:  # memory only
                    codes.clear()
                found = codes[piece] = tuple(-1 if w == END else ids.get(w, 0) for w in words[piece]) or (0,)
            return found

        def hits(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            c = np.fromiter(chain.from_iterable(map(coded, pieces(text))), dtype=np.int32)
            at = np.flatnonzero(c > 0)
            return np.cumsum(c < 0)[at].astype(np.int32), at.astype(np.int32), c[at]

        def counts(us: np.ndarray, ts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            terms, n = np.unique(np.unique(us.astype(np.int64) << 32 | ts) & 0xFFFFFFFF, return_counts=True)
            return terms.astype(np.int32), n.astype(np.int32)

        lists = pa.list_(pa.int32())
        for batch in batches:
            found = [hits(text) for text in batch.column("text").to_pylist()]
            kept = [i for i, f in enumerate(found) if len(f[2])]
            columns = [pa.array([found[i][k] for i in kept], lists) for k in range(3)]
            counted = [counts(found[i][0], found[i][2]) for i in kept]
            columns += [pa.array([c[k] for c in counted], lists) for k in range(2)]
            m = pa.array([len(np.unique(found[i][0])) for i in kept], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(kept, pa.int64())), batch.column("doc").take(pa.array(kept, pa.int64())), *columns, m], names=["row", "doc", "us", "ps", "ts", "terms", "counts", "m"])

    return docs.select("row", "doc", "text").mapInArrow(read, f"row bigint, doc {kind}, us array<int>, ps array<int>, ts array<int>, terms array<int>, counts array<int>, m int")


def read_all_terms(docs: DataFrame, words: DataFrame, most_terms: int) -> DataFrame:
    """``read_terms`` of the vocabulary ``words`` (word, n), in which a rarer word has a larger id.

    Of a vocabulary over ``most_terms`` words, one stretch at a time is sent to
    the tasks, the texts are read once for each, and a row's hits are put together.
    """
    parts: list[DataFrame] = []
    chunk: dict[str, int] = {}
    ordered = cut(words.orderBy(F.desc("n"), "word").select("word"))
    for i, r in enumerate(ordered.toLocalIterator()):
        chunk[r["word"]] = i + 1
        if len(chunk) == most_terms:
            parts.append(read_terms(docs, chunk))
            chunk = {}
    if chunk or not parts:
        parts.append(read_terms(docs, chunk))
    if len(parts) == 1:
        return cut(parts[0])
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # A term is in one stretch, so only its hits need order and the sentences need counting anew.
    hits = F.arrays_zip(F.col("ps").alias("p"), F.col("us").alias("u"), F.col("ts").alias("t"))
    grouped = every.groupBy("row", "doc").agg(F.sort_array(F.flatten(F.collect_list(hits))).alias("h"), F.flatten(F.collect_list("terms")).alias("terms"), F.flatten(F.collect_list("counts")).alias("counts"))
    h = F.col("h")
    return cut(grouped.select("row", "doc", h["u"].alias("us"), h["p"].alias("ps"), h["t"].alias("ts"), "terms", "counts", F.size(F.array_distinct(h["u"])).alias("m")))


def similar_documents(verified: DataFrame, *, posts: int = 3, neighbours: int = 2, least: float = 0.3) -> DataFrame:
    """(a, b, w): edges, in both directions, between rows whose verified terms have a cosine of at least ``least``.

    ``verified`` has row and terms (distinct ids, a rarer term has a larger
    one). Each row stands under its ``posts`` rarest terms, and is compared with
    the next ``neighbours`` rows that follow it there. Pairs under several terms repeat.
    These are few edges of many, to look at; ``propagate_all`` leaves none out.
    """
    rare = verified.select("row", "terms", F.explode(F.sequence(F.lit(1), F.least(F.lit(posts), F.size("terms")))).alias("i"))
    placed = rare.select("row", "terms", F.get("terms", F.col("i") - 1).alias("term"), F.when(F.col("i") > 1, F.get("terms", F.lit(0))).otherwise(F.get("terms", F.lit(1))).alias("next"), F.xxhash64("row", "i").alias("tie"))
    placed = placed.repartitionByRange(parallel(verified), "term", "next", "tie").sortWithinPartitions("term", "next", "tie").select("row", "term", "terms")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[tuple[int, int, frozenset[int]]] = []
        for batch in batches:
            a, b, w = [], [], []
            for row, term, terms in zip(batch.column("row").to_pylist(), batch.column("term").to_pylist(), batch.column("terms").to_pylist()):
                mine = frozenset(terms)
                for other, under, theirs in before:
                    if under == term and other != row:
                        near = len(mine & theirs) / (len(mine) * len(theirs)) ** 0.5
                        if near >= least:
                            a += (row, other)
                            b += (other, row)
                            w += (near, near)
                before = [*before[-(neighbours - 1) :], (row, term, mine)] if neighbours > 1 else [(row, term, mine)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.float64())], names=["a", "b", "w"])

    return placed.mapInArrow(compare, "a bigint, b bigint, w double")


def propagate(edges: DataFrame, seeds: DataFrame, *, rounds: int, least: float = 0.15, sharp: float = 1.0) -> DataFrame:
    """(row, label, y): labels of rows after ``rounds`` steps over the edges (a, b, w).

    ``seeds`` (row, label, y) stay as they are. Other rows take the weighted mean
    of their neighbours' labels, raised to ``sharp`` and made shares again;
    shares under ``least`` are dropped as noise.
    """
    labels = seeds
    for _ in range(rounds):
        sent = edges.join(labels.withColumnRenamed("row", "b"), "b").groupBy(F.col("a").alias("row"), "label").agg(F.sum(F.col("w") * F.col("y")).alias("v"))
        labels = _means(sent, seeds, least, sharp)
    return labels


def _means(sent: DataFrame, seeds: DataFrame, least: float, sharp: float) -> DataFrame:
    """(row, label, y): the shares of what was sent (row, label, v), sharpened, and the seeds as they are."""
    row = Window.partitionBy("row")
    sent = sent.withColumn("v", F.pow(F.col("v") / F.max("v").over(row), F.lit(sharp)))
    mean = sent.withColumn("y", F.col("v") / F.sum("v").over(row)).filter(F.col("y") >= least).select("row", "label", "y")
    return cut(mean.join(seeds.select("row").distinct(), "row", "left_anti").unionByName(seeds))


def propagate_all(verified: DataFrame, seeds: DataFrame, *, rounds: int, least: float = 0.15, sharp: float = 2.0, most_sent: int = 1_000_000) -> DataFrame:
    """``propagate`` over the edges between all rows of ``verified`` (row, terms) that share a term, weighted by the cosine of their terms.

    No edge is left out and none is listed: the cosine is a sum over the shared
    terms of 1 / sqrt(terms of a) / sqrt(terms of b), so each term gathers its
    rows' labels once, and a row's neighbours together are the sum over its own
    terms, less the row itself. Steps grow with the terms of the rows, not with
    pairs. Repeated rows weigh as often as they come, and aren't their own
    neighbours. As all neighbours, near and far, have a voice, the means are
    blurred; a row's shares are raised to ``sharp`` after each step.
    """
    folded = verified.groupBy("row").agg(F.first("terms").alias("terms"), F.count(F.lit(1)).alias("times"))
    folded = cut(folded.withColumn("c", 1 / F.sqrt(F.size("terms"))))
    links = folded.select("row", "c", F.explode("terms").alias("term"))
    few = links.select("term").distinct().count() * seeds.select("label").distinct().count() <= most_sent
    labels = seeds
    for _ in range(rounds):
        told = folded.join(labels, "row").select("row", "label", "terms", (F.col("times") * F.col("y")).alias("y"), "c")
        held = told.select("label", (F.col("c") * F.col("y")).alias("s"), F.explode("terms").alias("term")).groupBy("term", "label").agg(F.sum("s").alias("s"))
        sent = links.join(F.broadcast(held) if few else held, "term").select("row", "label", (F.col("c") * F.col("s")).alias("v"))
        sent = sent.unionByName(told.select("row", "label", (-F.col("y")).alias("v"))).groupBy("row", "label").agg(F.sum("v").alias("v"))
        # What is left of a row without neighbours is rounding.
        labels = _means(sent.filter("v > 1e-9"), seeds, least, sharp)
    return labels


def term_scores(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, label, share): where a term's links (row, term, w) lead, each label counted by its own total weight."""
    votes = links.join(labels, "row").groupBy("term", "label").agg(F.sum(F.col("w") * F.col("y")).alias("v"))
    total = votes.groupBy("label").agg(F.sum("v").alias("all"))  # one row per subject
    lifted = votes.join(F.broadcast(total), "label").withColumn("v", F.col("v") / F.col("all"))
    whole = lifted.groupBy("term").agg(F.sum("v").alias("sum"))
    return lifted.join(whole, "term").select("term", "label", (F.col("v") / F.col("sum")).alias("share"))


def _one_per_term(scores: DataFrame, clear: float) -> DataFrame:
    """(term, label, share, second, other): a term's first label, and its second where it lies between two subjects."""
    two = scores.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("share", "label")), asc=False).alias("s"))  # a row per subject at most
    first, second = F.get("s", 0), F.get("s", 1)
    between = (first["share"] < clear) & (second["share"] >= clear / 2) & (first["share"] + second["share"] >= 0.8)
    return two.filter((first["share"] >= clear) | between).select("term", first["label"].alias("label"), first["share"].alias("share"), F.when(between, second["label"]).alias("other"))


def label_subjects(
    docs: DataFrame,
    seeds: DataFrame,
    subjects: list[str],
    *,
    key: str = "doc_id",
    text: str = "text",
    seed_subject: str = "subject",
    part: float = 0.25,
    clear: float = 0.6,
    rounds: int = 3,
    most_terms: int = 1_000_000,
) -> DataFrame:
    """(key, subject, share): each subject that at least ``part`` of a document's sentences with any subject treats.

    ``seeds`` holds labelled documents, with mistakes and gaps; a seed document
    is trusted, and clamped to its labels, if its own terms bear out all of
    them. Terms are the words in two or more seed documents that these tell to
    be one subject's, whatever their spread; they are sent to tasks at most
    ``most_terms`` at a time. A term is clear when ``clear`` of its weight lies
    in one subject. What one sentence tells, in a document with a subject of
    several, is a mention. NULL, empty and contentless documents give no rows,
    repeated rows weigh as often as they come, and repeated keys have one
    row per subject; without seeds, or with seeds of one subject only, there are
    no rows.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text")).filter(F.length("text") > 0)
    number = F.create_map(*[F.lit(x) for i, s in enumerate(subjects) for x in (s, i + 1)])
    marks = seeds.select(F.col(f"`{key}`").alias("doc"), F.try_element_at(number, F.col(f"`{seed_subject}`")).alias("label")).filter("label is not null and doc is not null").distinct()
    marks = cut(marks)
    words = telling_words(base, marks, clear * 0.7)
    read = read_all_terms(spread(base).withColumn("row", F.xxhash64("doc", "text")), words, most_terms)
    # A term is verified by two sentences; its weight is bounded, so a long document has no more voice.
    pairs = read.select("row", "m", F.explode(F.arrays_zip("terms", "counts")).alias("p")).filter("p.counts >= 2")
    links = cut(pairs.select("row", F.col("p.terms").alias("term"), F.least(F.lit(1.0), F.col("p.counts") / F.col("m") * 2).alias("w")))
    marked = cut(read.select("row", "doc").join(marks, "doc").select("row", "label").distinct())
    # Trusted are seeds whose own terms, as all seeds tell them, hold each of their labels.
    scores = term_scores(links, marked.withColumn("y", F.lit(1.0)))
    own = links.join(marked.select("row").distinct(), "row").join(scores, "term").groupBy("row", "label").agg(F.sum(F.col("w") * F.col("share")).alias("v"))
    own = own.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("row")))
    held = marked.join(own, ["row", "label"], "left").withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("row"))).withColumn("least", F.min(F.coalesce("v", F.lit(0.0))).over(Window.partitionBy("row")))
    trusted = cut(held.filter(F.col("least") >= part / 2).select("row", "label", (1.0 / F.col("all")).alias("y")))
    verified = F.sort_array(F.transform(F.filter(F.arrays_zip("terms", "counts"), lambda p: p["counts"] >= 2), lambda p: p["terms"]), asc=False)
    labels = propagate_all(read.select("row", verified.alias("terms")).filter(F.size("terms") > 0), trusted, rounds=rounds, most_sent=most_terms)
    lookup = cut(_one_per_term(term_scores(links, labels), clear))
    hits = read.select("row", "doc", F.explode(F.arrays_zip("us", "ps", "ts")).alias("h")).select("row", "doc", F.col("h.us").alias("u"), F.col("h.ps").alias("p"), F.col("h.ts").alias("term"))
    hits = hits.join(F.broadcast(lookup) if lookup.count() <= most_terms else lookup, "term")
    # A term between two subjects goes to the one that the document holds more of.
    if not lookup.filter("other is not null").isEmpty():
        y = lambda side: labels.select(F.col("row"), F.col("label").alias(side), F.col("y").alias(f"y_{side}"))
        between = hits.filter("other is not null").join(y("label"), ["row", "label"], "left").join(y("other"), ["row", "other"], "left")
        first, second = F.coalesce("y_label", F.lit(0.0)), F.coalesce("y_other", F.lit(0.0))
        between = between.filter(first != second).withColumn("label", F.when(first > second, F.col("label")).otherwise(F.col("other"))).select(hits.columns)
        hits = hits.filter("other is null").unionByName(between)
    # Of neighbours in one expression the clearer word tells the subject.
    w = Window.partitionBy("row", "u").orderBy("p")
    beside = [F.coalesce(F.max("share").over(w.rangeBetween(k, k)), F.lit(0.0)) for k in (-1, 1)]
    clearest = hits.withColumn("before", beside[0]).withColumn("behind", beside[1]).filter("share >= before and share >= behind")
    # Everything below stays in the partitions of the rows.
    units = clearest.groupBy("row", "doc", "u").agg(F.collect_set("label").alias("labels"))
    per_row = units.groupBy("row", "doc").agg(F.collect_list("labels").alias("u"))
    each = per_row.select("row", "doc", "u", F.explode(F.array_distinct(F.flatten("u"))).alias("label")).withColumn("n", F.size(F.filter("u", lambda x: F.array_contains(x, F.col("label")))))
    told = each.groupBy("row", "doc").agg(F.first("u").alias("u"), F.max("n").alias("most"), F.collect_list(F.struct("label", "n")).alias("each"))
    told = told.withColumn("each", F.filter("each", lambda e: (e["n"] > 1) | (F.col("most") == 1)))
    told = told.withColumn("m", F.size(F.filter("u", lambda x: F.arrays_overlap(x, F.transform(F.col("each"), lambda e: e["label"])))))
    out = told.select("doc", "m", F.explode("each").alias("e")).filter(F.col("e.n") >= F.col("m") * part)
    name = F.get(F.array(*[F.lit(s) for s in subjects]), F.col("e.label") - 1)
    return out.groupBy(F.col("doc").alias(key), name.alias("subject")).agg(F.max(F.col("e.n") / F.col("m")).alias("share"))
