"""Evaluation texts leaking into training text.

Items are cut into windows: with ``run_words`` of so many words, one starting at
each word (an item with fewer words is one window of its own size), else one
window as long as the item. Each window gets a 64-bit SimHash over its five-word
shingles. Documents are slid over by windows of the same sizes. The fingerprints
of the item windows are indexed by ``radius + 1`` blocks: two fingerprints within
the Hamming radius agree in at least one block, so no candidate within the radius
is missed. Candidates are verified by the exact weighted similarity of their
shingles (weight: how often a shingle occurs) and, on request, by the order of
all their words.

The pass over the documents is map-only. Items are hashed on the executors; the
driver indexes and broadcasts them in blocks of at most ``block_windows`` words,
one at a time, so that its memory does not grow with the items; more items mean
more passes.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.visible_form import adopt, transducer, visible

SHINGLE = 5
#: Item windows in one broadcast block: about 200 MB at most.
BLOCK_WINDOWS = 1_000_000
#: Words that are fingerprinted at a time; longer texts are slid over in pieces.
PIECE = 1 << 15
KEPT_WORDS = 300_000
WORD = re.compile(r"[^\W_]+")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _Hashes(dict):
    """Hashes of the words of what stands between white space, made when first met: no word runs over white space."""

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        h = tuple(map(xxhash.xxh3_64_intdigest, WORD.findall(chunk)))
        if len(chunk) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[chunk] = h
        return h


@functools.cache
def _hashes() -> _Hashes:
    return _Hashes()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in the visible form, without case. Null and empty texts have none."""
    return WORD.findall(visible(text).casefold()) if text else []


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each of ``words(text)``, in order."""
    if not text:
        return np.empty(0, np.uint64)
    return np.fromiter(itertools.chain.from_iterable(map(_hashes().__getitem__, visible(text).casefold().split())), np.uint64)


def shingles(w: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words, in order."""
    n = len(w) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = (h ^ w[k : k + n]) * _MIX[0]
            h ^= h >> np.uint64(29)
        h *= _MIX[1]
        h ^= h >> np.uint64(32)
        h *= _MIX[2]
        h ^= h >> np.uint64(31)
    return h


class WindowVotes:
    """SimHashes of all windows over a list of shingles; sizes share their partial sums.

    The votes of the 64 bits are counted side by side in lanes of 64-bit words, in
    sums over 1, 2, 4, ... shingles of which each window is put together.
    """

    def __init__(self, s: np.ndarray):
        self.s, self.sums = s, {}

    def _sum(self, lane: int, shift: int, per: int) -> np.ndarray:
        """Lane sums of every ``shift``-th bit over windows of ``per``."""
        powers = self.sums.get((lane, shift))
        if powers is None:
            every = np.uint64(sum(1 << i for i in range(0, 64, lane)))
            powers = self.sums[lane, shift] = [(self.s >> np.uint64(shift)) & every]
        while 1 << len(powers) <= per:
            p, half = powers[-1], 1 << (len(powers) - 1)
            powers.append(p[:-half] + p[half:])
        n, out, at = len(self.s) - per + 1, None, 0
        for k, p in enumerate(powers):
            if per >> k & 1:
                part = p[at : at + n]
                out = part.copy() if out is None else np.add(out, part, out=out)
                at += 1 << k
        return out

    def of(self, per: int) -> np.ndarray:
        if len(self.s) < per:
            return np.empty(0, np.uint64)
        lane = next(x for x in (4, 8, 16, 32) if per < 1 << x)
        top = np.uint64(lane - 1)
        every = sum(1 << i for i in range(0, 64, lane))
        bias, highest = np.uint64(every * ((1 << (lane - 1)) - 1 - per // 2)), np.uint64(every)
        out = np.zeros(len(self.s) - per + 1, np.uint64)
        for k in range(lane):
            # A lane's highest bit is set if more than half of the window's shingles vote for the bit.
            out |= (((self._sum(lane, k, per) + bias) >> top) & highest) << np.uint64(k)
        return out


def simhashes(s: np.ndarray, per: int) -> np.ndarray:
    """SimHash of all windows of ``per`` consecutive shingles."""
    return WindowVotes(s).of(per)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: shared weight over joint weight of two lists of shingles, each shingle weighing its count."""
    if a.shape[1] > 16:
        shared = np.array([sum((Counter(x) & Counter(y)).values()) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
        return shared / (a.shape[1] + b.shape[1] - shared)

    def nth(x: np.ndarray) -> np.ndarray:
        same = x[:, :, None] == x[:, None, :]
        return np.tril(same, -1).sum(2)

    match = (a[:, :, None] == b[:, None, :]) & (nth(a)[:, :, None] == nth(b)[:, None, :])
    shared = match.any(2).sum(1)
    return shared / (a.shape[1] + b.shape[1] - shared)


class ItemIndex:
    """Windows of items by size, their fingerprints, and a table for each block of fingerprint bits."""

    def __init__(self, items: list[tuple[int, np.ndarray]], run_words: int | None, radius: int):
        self.radius = radius
        self.sizes: dict[int, dict] = {}
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, w in items:
            if len(w):
                by_size.setdefault(min(run_words or len(w), len(w)), []).append((item, w))
        bounds = np.linspace(0, 64, radius + 2).astype(int)
        for size, own in by_size.items():
            k = min(SHINGLE, size)
            per = size - k + 1
            grams = [shingles(w, k) for _, w in own]
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(g, per) for g in grams])
            seq = np.concatenate([np.lib.stride_tricks.sliding_window_view(w, size) for _, w in own])
            prints = np.concatenate([simhashes(g, per) for g in grams])
            owner = np.concatenate([np.full(len(w) - size + 1, item, np.int64) for item, w in own])
            tables = []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                key = self._block(prints, lo, hi)
                order = np.argsort(key, kind="stable")
                starts = np.searchsorted(key[order], np.arange((1 << min(hi - lo, 22)) + 1))
                tables.append((lo, hi, order, starts, np.diff(starts).astype(np.int32)))
            self.sizes[size] = {"k": k, "per": per, "rows": rows, "seq": seq, "prints": prints, "owner": owner, "tables": tables}

    @staticmethod
    def _block(prints: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """The bits lo..hi; of blocks wider than 22 bits the lowest 22, which only adds candidates."""
        return ((prints >> np.uint64(lo)) & np.uint64((1 << min(hi - lo, 22)) - 1)).astype(np.int64)

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item window) within the radius, each perhaps more than once."""
        own = self.sizes[size]
        left, right = [], []
        for lo, hi, order, starts, counts in own["tables"]:
            key = self._block(prints, lo, hi)
            n = counts[key]
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            n, first = n[hit], starts[key[hit]]
            at = np.repeat(hit, n)
            item = order[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
            near = np.flatnonzero(np.bitwise_count(prints[at] ^ own["prints"][item]) <= self.radius)
            left.append(at[near])
            right.append(item[near])
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(left), np.concatenate(right)

    def leaks(self, w: np.ndarray, doc: np.ndarray, similarity: float, in_order: bool) -> set[tuple[int, int]]:
        """(document row, item) of all windows that verify. w: words of several documents, doc: the row of each word."""
        found: set[tuple[int, int]] = set()
        grams: dict[int, tuple[np.ndarray, WindowVotes]] = {}
        for size, own in self.sizes.items():
            if len(w) < size:
                continue
            if own["k"] not in grams:
                s = shingles(w, own["k"])
                grams[own["k"]] = s, WindowVotes(s)
            s, votes = grams[own["k"]]
            whole = np.flatnonzero(doc[: len(w) - size + 1] == doc[size - 1 :])
            i, j = self.candidates(size, votes.of(own["per"])[whole])
            step = max(1, (1 << 21) // own["per"] ** 2)
            for lo in range(0, len(i), step):
                ii, jj = whole[i[lo : lo + step]], j[lo : lo + step]
                ok = weighted_similarity(s[ii[:, None] + np.arange(own["per"])], own["rows"][jj]) >= similarity
                if in_order:
                    ok &= (w[ii[:, None] + np.arange(size)] == own["seq"][jj]).all(1)
                found.update(zip(doc[ii[ok]].tolist(), own["owner"][jj[ok]].tolist(), strict=True))
        return found


def _scan(batches: Iterator, index: ItemIndex, similarity: float, in_order: bool) -> Iterator:
    import pyarrow as pa

    overlap = max(index.sizes, default=1) - 1
    for b in batches:
        ids = b.column(0).to_pylist()
        found: set[tuple[int, int]] = set()
        held, rows, n = [], [], 0

        def flush(held=held, rows=rows, found=found) -> None:
            if held:
                found |= index.leaks(np.concatenate(held), np.concatenate(rows), similarity, in_order)
                held.clear()
                rows.clear()

        for row, text in enumerate(b.column(1).to_pylist()):
            w = word_hashes(text)
            for lo in range(0, len(w), PIECE):
                part = w[lo : lo + PIECE + overlap]  # pieces overlap by a window
                held.append(part)
                rows.append(np.full(len(part), row, np.int32))
                n += len(part)
                if n >= PIECE:
                    flush()
                    n = 0
        flush()
        pairs = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r, _ in pairs], pa.int64()), pa.array([i for _, i in pairs], pa.int64())], ["doc_id", "item_id"])


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str,
    doc_text: str,
    item_id: str,
    item_text: str,
    run_words: int | None = 12,
    radius: int = 3,
    similarity: float = 1.0,
    in_order: bool = True,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Rows ``(doc_id, item_id)``, once for each document and item that leaked into it.

    With the defaults a document matches if it holds ``run_words`` consecutive
    words of the item consecutively, or all its words if the item has fewer.
    With ``run_words=None`` the windows are as long as the items; with
    ``similarity`` below 1 and ``in_order=False`` windows match whose fingerprints
    lie within ``radius`` and whose five-word shingles are that similar
    (``altered_leaks`` chooses these). Words are those of the visible form, without
    case. Null and empty texts, texts without words and null ids match nothing;
    ids are unique.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    form = sc.broadcast(transducer())

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        adopt(form.value)
        for b in batches:
            w = [word_hashes(t).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w, pa.list_(pa.int64()))], ["id", "w"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")).where("doc_id is not null and text <> ''")
    i = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null and text <> ''").mapInArrow(hashed, "id bigint, w array<bigint>")
    n = math.ceil((i.agg(F.sum(F.size("w"))).first()[0] or 0) / block_windows) or 1
    out = None
    for block in range(n):
        # The words of one block only; an item's windows are no more than its words.
        own = [(r["id"], np.array(r["w"], np.int64).view(np.uint64)) for r in i.where(F.pmod(F.xxhash64("id"), F.lit(n)) == block).collect()]
        shared = sc.broadcast(ItemIndex(own, run_words, radius))
        del own

        def scan(batches: Iterator, shared=shared) -> Iterator:
            adopt(form.value)
            yield from _scan(batches, shared.value, similarity, in_order)

        one = d.mapInArrow(scan, "doc_id bigint, item_id bigint")
        out = one if out is None else out.unionAll(one)
    return out


def altered_leaks(docs: DataFrame, items: DataFrame, *, similarity: float = 0.8, radius: int = 16, **names: str) -> DataFrame:
    """Rows ``(doc_id, item_id)`` of whole items that were copied with changes: item-sized windows of at least that similarity.

    At a similarity of 0.8 two fingerprints differ in 9 or 10 of 64 bits, and in
    more than 16 of them in one case of a hundred.
    """
    return find_leaks(docs, items, run_words=None, radius=radius, similarity=similarity, in_order=False, **names)
