"""Byte-pair encoding of a corpus through a tokenization automaton.

In the token automaton the arcs are labelled with tokens and the states are
the tokens read last; a sequence of arcs is a path exactly if it is what the
merges make of its text. It is built by merge gadgets in merge order. The
gadget of a merge (u, v) -> t forbids the arc v behind u, and adds arcs
labelled t: they start where u could be read, and behind them may follow what
could follow v. As t inherits both from u and v at that moment, a gadget is
stored as one forbidden pair, the two tokens that t inherits from, and its time.

Reading bytes, the automaton is made deterministic: a state is the longest
suffix of what was read that begins a token, with the token that ends the
path to each position inside it. Every text has one path, so the next state is
a function of state and byte; the transition table is filled when a pair of
them is first met. A pre-split word is read through the table once, without
stepping back, and its path is followed from the end. The text of a path is
the labels of its arcs.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from veranico.session import ship, spread

#: The pattern of the public byte-level tokenizers that splits text before merging (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of byte-level BPE."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary(NamedTuple):
    """A vocabulary file: its digest, labels by id, and merges as (left id, right id, id) in order."""

    digest: str
    labels: list[bytes]
    merges: list[tuple[int, int, int]]


def load_merges(path: str) -> Vocabulary:
    """The vocabulary of a tokenizers JSON file of byte-level BPE.

    Files that split, normalise or merge in another way than the GPT-2 pattern
    and plain BPE would get other ids, so they raise ValueError.
    """
    with open(path, "rb") as f:
        content = f.read()
    whole = json.loads(content)
    model, before = whole["model"], whole.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    other = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or not plain or whole.get("normalizer") or other:
        raise ValueError(f"{path} isn't byte-level BPE with the pattern built in here: pre-tokenizer {before or None}, normaliser {whole.get('normalizer')}, settings {other}")
    vocab, letters = model["vocab"], byte_letters()
    labels = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        labels[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    merges = []
    for m in model["merges"]:
        u, v = m if isinstance(m, list) else m.split(" ")
        merges.append((vocab[u], vocab[v], vocab[u + v]))
    return Vocabulary(hashlib.sha256(content).hexdigest(), labels, merges)


#: What the path to the beginning of a word ends with.
_START = -1


class Automaton:
    """Deterministic tokenization automaton, compiled from merges by successive gadgets."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.head = list(range(len(labels)))  # the token whose incoming arcs t took over
        self.last = list(range(len(labels)))  # the token whose outgoing arcs t took over
        self.time = [-1] * len(labels)
        self.forbidden: dict[int, int] = {}
        self.arcs: dict[bytes, int] = {}
        self.step: dict[int, bool] = {}
        for b, label in enumerate(labels):
            if len(label) == 1:
                self.arcs[label] = b
        for now, (u, v, t) in enumerate(merges):
            self._gadget(u, v, t, now)
        # A token that is never made from its own text has no arc (there is none in vocabularies built by merging).
        self.arcs = {label: t for label, t in self.arcs.items() if not self._split_inside(t)}
        self.begins = {label[:i] for label in self.arcs for i in range(len(label) + 1)}
        self._restart()

    def _restart(self) -> None:
        """An empty transition table; states are made again when met."""
        self.states: dict[tuple[bytes, tuple[int, ...]], int] = {(b"", (_START,)): 0}
        self.held: list[tuple[bytes, tuple[int, ...]]] = [(b"", (_START,))]
        self.table: list[dict[int, int]] = [{}]
        self.arc: list[int] = [_START]  # the token that ends the path in a state

    def _gadget(self, u: int, v: int, t: int, now: int) -> None:
        self.forbidden.setdefault(u << 32 | v, now)
        if self.time[t] < 0 and len(self.labels[t]) > 1:
            self.head[t], self.last[t], self.time[t] = u, v, now
            self.arcs[self.labels[t]] = t

    def _move(self, state: int, byte: int) -> int:
        """The state behind ``state`` and a byte, entered in the table."""
        suffix, ends = self.held[state]
        text = suffix + bytes((byte,))
        for i in range(len(text)):
            t = self.arcs.get(text[i:])
            if t is not None and (ends[i] == _START or self.follows(ends[i], t)):
                break
        else:
            raise ValueError("a byte of the text has no token")
        ends = (*ends, t)
        drop = 0
        while text[drop:] not in self.begins:
            drop += 1
        key = (text[drop:], ends[drop:])
        new = self.states.get(key)
        if new is None:
            new = self.states[key] = len(self.held)
            self.held.append(key)
            self.table.append({})
            self.arc.append(t)
        self.table[state][byte] = new
        return new

    def follows(self, x: int, y: int) -> bool:
        """Whether the arc y leaves the state behind x."""
        key = x << 32 | y
        known = self.step.get(key)
        if known is None:
            known = self.step[key] = self._follows(x, y)
        return known

    def _follows(self, x: int, y: int) -> bool:
        time, forbidden = self.time, self.forbidden
        before = 1 << 60  # what x inherited, it inherited before this time
        while True:
            b, until = y, 1 << 60
            while True:
                m = forbidden.get(x << 32 | b)
                if m is not None and m < before and m <= until:
                    return False
                if time[b] < 0:
                    break
                until, b = time[b], self.head[b]
            if time[x] < 0:
                return True
            before, x = time[x], self.last[x]

    def encode(self, word: bytes) -> tuple[int, ...]:
        """Ids of the one path that spells ``word``."""
        if len(self.held) > 2_000_000:  # memory only
            self._restart()
        table, arc, state = self.table, self.arc, 0
        ends = []
        for byte in word:
            state = nxt if (nxt := table[state].get(byte)) is not None else self._move(state, byte)
            ends.append(arc[state])
        ids, at, labels = [], len(word), self.labels
        while at:
            ids.append(ends[at - 1])
            at -= len(labels[ends[at - 1]])
        return tuple(reversed(ids))

    def _split_inside(self, t: int) -> bool:
        """Whether a token is never made from its own text (none in vocabularies built by merging)."""
        return self.time[t] >= 0 and not self.follows_before(self.head[t], self.last[t], self.time[t])

    def follows_before(self, u: int, v: int, now: int) -> bool:
        """Whether v could follow u just before the merge at time ``now``."""
        time, forbidden = self.time, self.forbidden
        before, x = now, u
        while True:
            b, until = v, now - 1
            while True:
                m = forbidden.get(x << 32 | b)
                if m is not None and m < before and m <= until:
                    return False
                if time[b] < 0:
                    break
                until, b = min(until, time[b]), self.head[b]
            if time[x] < 0:
                return True
            before, x = min(before, time[x]), self.last[x]

    def decode(self, ids: list[int]) -> str:
        """The text of a path: the labels of its arcs."""
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


class _Chunks(dict):
    """Ids of each chunk of text between spaces, by the chunk; a chunk stands for a space and itself."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.words, self.split = automaton, {}, regex.compile(SPLIT).findall

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) > 400_000:  # memory only: entries are made again when needed
            self.clear()
        ids = self.text(" " + chunk)
        if len(chunk) < 200:
            self[chunk] = ids
        return ids

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) > 400_000:
                self.words.clear()
            ids = self.words[word] = self.automaton.encode(word.encode("utf-8", "surrogatepass"))
        return ids

    def text(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.word, self.split(text))))

    def parts(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ids piece by piece. A single space always begins a word, so text can be cut before it."""
        if "  " in text:
            return map(self.word, self.split(text))
        first, *rest = text.split(" ")
        return chain((self.text(first),), map(self.__getitem__, rest))


_COMPILED: dict[str, _Chunks] = {}


def compiled(digest: str, tables) -> _Chunks:
    """The worker's automaton of the vocabulary with this digest, compiled once; ``tables`` is its broadcast.

    A module's function, so that workers keep it between tasks; the digest is of the whole file, so no two vocabularies share one.
    """
    if (found := _COMPILED.get(digest)) is None:
        if len(_COMPILED) >= 4:  # memory only
            _COMPILED.clear()
        found = _COMPILED[digest] = _Chunks(Automaton(tables.value.labels, tables.value.merges))
    return found


def encode_texts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens.

    NULL and empty texts both give an empty list. Rows are kept one for one,
    repeated ones too; texts of any length are encoded whole; strings that look
    like special tokens are ordinary text. ``path`` is a vocabulary file of a
    byte-level BPE in the JSON layout of the tokenizers library, read on the
    driver and broadcast (its size doesn't depend on the corpus).
    """
    spark = df.sparkSession
    ship(spark)
    vocabulary = load_merges(path)
    digest, tables = vocabulary.digest, spark.sparkContext.broadcast(vocabulary)
    rows = spread(df.select(df[f"`{key}`"].alias("key"), df[f"`{text}`"].alias("text")))
    kind = rows.schema["key"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = compiled(digest, tables)
        for batch in batches:
            ids, ends = array("i"), [0]
            for t in batch.column(1).to_pylist():
                if t:
                    ids.extend(chain.from_iterable(chunks.parts(t)))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.asarray(ends, dtype=np.int32)), pa.array(np.frombuffer(ids, dtype=np.int32) if ids else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    return rows.mapInArrow(encode, f"key {kind.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, n_tokens): the number of token ids of each text, 0 for NULL and empty ones."""
    spark = df.sparkSession
    ship(spark)
    vocabulary = load_merges(path)
    digest, tables = vocabulary.digest, spark.sparkContext.broadcast(vocabulary)
    rows = spread(df.select(df[f"`{key}`"].alias("key"), df[f"`{text}`"].alias("text")))
    kind = rows.schema["key"].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = compiled(digest, tables)
        for batch in batches:
            n = [sum(map(len, chunks.parts(t))) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["key", "n_tokens"])

    return rows.mapInArrow(count, f"key {kind.simpleString()}, n_tokens bigint").withColumnRenamed("key", key)
