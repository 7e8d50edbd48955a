"""Corpus encoding with a public byte-level BPE vocabulary, by a tokenization automaton.

The merges are compiled, one merge gadget after the other, into a deterministic
automaton over tokens whose accepted sequences are exactly the tokenizations BPE
can produce. It starts with one state that loops on every byte. The gadget of
``u v -> w`` gives the state after ``u`` a copy without its ``v`` arc, and every
state with a ``u`` arc a new ``w`` arc to the state after ``v``. A state is thus
named by the last token, and starts as a copy of the state after that token's
right half. The full table would have |V|^2 cells, so the gadgets' effects (when
a token was born, from which halves, and when an arc was cut) are what is
stored, and an arc is derived from them on first use and kept in the table.

A word is read by a byte trie of the vocabulary with suffix links, which gives
all tokens that end at a byte, longest first. Each prefix of a word has exactly
one tokenization, so of these tokens exactly one follows, by an arc, from the
last token of the prefix before it: encoding is linear in the word, without
back-tracking. Decoding emits the byte labels of the arcs.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every entry point.
TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: the public pre-split pattern of this vocabulary.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker keeps; beyond that it starts anew. Only a speed matter.
KEPT_WORDS = 300_000
NEVER = 1 << 60


@functools.cache
def byte_letters() -> dict[str, int]:
    """The printable letter by which the vocabulary file writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    """Deterministic automaton over the tokens of a byte-level BPE vocabulary."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        """labels: bytes by token id (b"" for ids that are no plain token); merges: (left, right, whole) in order."""
        self.labels = labels
        n = len(labels)
        self.left, self.right, self.born = [-1] * n, [-1] * n, [0] * n
        self.cut: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        self.shift = max(1, n.bit_length())
        live = {x for x in range(n) if len(labels[x]) == 1}
        for k, (u, v, w) in enumerate(merges, 1):
            # A gadget whose halves cannot meet any more adds no arc: its token is never emitted.
            if u in live and v in live and w not in live and self._arc(u, v, k - 1):
                self.left[w], self.right[w], self.born[w] = u, v, k
                self.cut.setdefault((u << self.shift) | v, k)
                live.add(w)
            else:
                self.cut.setdefault((u << self.shift) | v, k)
        self.arcs.clear()
        self._trie(sorted(live))

    def _arc(self, x: int, y: int, now: int) -> bool:
        """Whether, after ``now`` gadgets, the state after token x has an arc y."""
        while True:
            bx, by = self.born[x], self.born[y]
            birth = max(bx, by)
            if now < birth:
                return False
            if birth < self.cut.get((x << self.shift) | y, NEVER) <= now:
                return False
            if birth == 0:
                return True
            if by >= bx:
                # The arc y came with y's gadget to all states with an arc to its left half;
                # in a run of one token the first two merge, so that y cannot follow that token.
                u = self.left[y]
                if x == u == self.right[y]:
                    return False
                y, now = u, birth - 1
                if bx == by:
                    x = self.right[x]
            else:
                # The state after x began as a copy of the state after x's right half.
                x, now = self.right[x], birth - 1

    def follows(self, x: int, y: int) -> bool:
        key = (x << self.shift) | y
        got = self.arcs.get(key)
        if got is None:
            got = self._arc(x, y, NEVER - 1)
            if len(self.arcs) < 4_000_000:
                self.arcs[key] = got
        return got

    def _trie(self, live: list[int]) -> None:
        """Byte trie with suffix links; of each node the longest token that ends there and the next shorter one."""
        step: list[dict[int, int]] = [{}]
        token = [-1]
        for t in live:
            node = 0
            for b in self.labels[t]:
                to = step[node].get(b)
                if to is None:
                    to = step[node][b] = len(step)
                    step.append({})
                    token.append(-1)
                node = to
            token[node] = t
        fail, ends = [0] * len(step), [-1] * len(step)
        shorter = [-1] * len(self.labels)
        queue = [0]
        for node in queue:
            for b, to in step[node].items():
                if node:
                    f = fail[node]
                    while f and b not in step[f]:
                        f = fail[f]
                    fail[to] = step[f].get(b, 0)
                below = ends[fail[to]] if node else -1
                if token[to] >= 0:
                    shorter[token[to]] = below
                    ends[to] = token[to]
                else:
                    ends[to] = below
                queue.append(to)
        self.step, self.fail, self.ends, self.shorter = step, fail, ends, shorter
        self.size = [len(x) for x in self.labels]

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word."""
        step, fail, ends, shorter, size, arcs, shift = self.step, self.fail, self.ends, self.shorter, self.size, self.arcs, self.shift
        last: list[int] = []
        node = 0
        for i, b in enumerate(word):
            to = step[node].get(b)
            while to is None and node:
                node = fail[node]
                to = step[node].get(b)
            node = to or 0
            t = ends[node]
            while True:
                start = i + 1 - size[t]
                if start == 0:
                    # Its halves could meet when it was born, so BPE makes a token of its own bytes.
                    break
                ok = arcs.get((last[start - 1] << shift) | t)
                if ok is None:
                    ok = self.follows(last[start - 1], t)
                if ok:
                    break
                t = shorter[t]
            last.append(t)
        out = []
        i = len(word)
        while i > 0:
            t = last[i - 1]
            out.append(t)
            i -= size[t]
        out.reverse()
        return out

    def decode(self, ids) -> bytes:
        return b"".join(self.labels[i] for i in ids)


def parse_vocabulary(text: str) -> TokenAutomaton:
    """The automaton of a vocabulary file (JSON with ``model.vocab`` and ``model.merges``)."""
    model = json.loads(text)["model"]
    vocab, letter = model["vocab"], byte_letters()
    labels = [b""] * (max(vocab.values()) + 1)
    for name, i in vocab.items():
        if all(ch in letter for ch in name):
            labels[i] = bytes(letter[ch] for ch in name)
    merges = []
    for m in model["merges"]:
        a, b = m if isinstance(m, list) else m.split(" ", 1)
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    return TokenAutomaton(labels, merges)


class _Words(dict):
    """Ids of words, made when first met."""

    def __init__(self, automaton: TokenAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.automaton.encode_word(word.encode("utf-8", "replace")))
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class _Chunks(dict):
    """Ids of what stands between two lone spaces, with the space before it, made when first met."""

    def __init__(self, words: _Words):
        super().__init__()
        self.words, self.split = words, regex.compile(WORDS).findall

    def ids(self, text: str) -> tuple[int, ...]:
        return tuple(itertools.chain.from_iterable(map(self.words.__getitem__, self.split(text))))

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        got = self.ids(" " + chunk)
        if len(chunk) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[chunk] = got
        return got


class Encoder:
    """Texts to ids, with the ids of frequent words and chunks kept.

    A word of the pre-split pattern never runs over a space that stands alone, as
    such a space begins a word; so texts are cut there, and what repeats is split once.
    """

    def __init__(self, automaton: TokenAutomaton):
        self.automaton = automaton
        self.kept = _Words(automaton)
        self.chunks = _Chunks(self.kept)
        self.runs = regex.compile(r"(\s{2,})").split

    def _spaced(self, text: str, begins: bool) -> Iterator[tuple[int, ...]]:
        """Ids of a text without two spaces in a row; ``begins``: no space stands before it."""
        parts = iter(text.split(" "))
        if begins:
            yield self.chunks.ids(next(parts))
        yield from map(self.chunks.__getitem__, parts)

    def encode(self, text: str | None) -> list[int]:
        """Null and empty texts have no ids. Special tokens' strings are ordinary text; lone surrogates become U+FFFD."""
        if not text:
            return []
        parts = self.runs(text)
        found = [self._spaced(parts[0], True)] if parts[0] else []
        for run, after in zip(parts[1::2], parts[2::2], strict=True):
            # The last of several spaces belongs to what follows: to its word, or by itself.
            if not after:
                found.append(iter((self.kept[run],)))
            elif run[-1] == " ":
                found += [iter((self.kept[run[:-1]],)), self._spaced(after, False)]
            else:
                found += [iter((self.kept[run[:-1]], self.kept[run[-1]])), self._spaced(after, True)]
        return list(itertools.chain.from_iterable(itertools.chain.from_iterable(found)))


@functools.lru_cache(maxsize=2)
def encoder(text: str) -> Encoder:
    """The compiled encoder of a vocabulary file."""
    return Encoder(parse_vocabulary(text))


_shared: dict[str, Encoder] = {}


def _worker_encoder(name: str, compiled) -> Encoder:
    """A worker's encoder of the automaton that the driver compiled; kept between tasks."""
    if name not in _shared:
        _shared.clear()
        _shared[name] = Encoder(compiled.value)
    return _shared[name]


def vocabulary_text(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    with open(f"{folder}/{name}.json", encoding="utf-8") as f:
        return f.read()


def _broadcast(df: DataFrame, vocabulary: str):
    return hashlib.md5(vocabulary.encode(), usedforsecurity=False).hexdigest(), df.sparkSession.sparkContext.broadcast(encoder(vocabulary).automaton)


def encode_corpus(df: DataFrame, *, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """Rows ``(id_col, ids)`` for every row of ``df``, ids by the vocabulary, without special tokens.

    Null and empty texts get an empty list; null ids stay null. Whole texts are
    encoded, of any length. No shuffle. The automaton is compiled once and broadcast
    (about 3 MB, of a fixed size), so executors need no tokenizer files.
    """
    name, shared = _broadcast(df, vocabulary)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        enc = _worker_encoder(name, shared)
        for b in batches:
            lists = [enc.encode(t) for t in b.column(1).to_pylist()]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "ids"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, ids array<int>").withColumnRenamed("id", id_col)


def decode_corpus(df: DataFrame, *, id_col: str, ids_col: str, vocabulary: str) -> DataFrame:
    """Rows ``(id_col, text)`` of encoded documents; null lists give null, empty ones the empty text."""
    name, shared = _broadcast(df, vocabulary)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        a = _worker_encoder(name, shared).automaton
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else a.decode(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, text string").withColumnRenamed("id", id_col)
