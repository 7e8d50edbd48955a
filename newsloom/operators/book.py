"""Order books from session messages: one ordered fold per book, top of book on change."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceReader

from newsloom.operators.ordered import fold_sorted
from newsloom.sources.market_files import SessionSource, _SessionReader, book_blocks, last_stocks

TOP = "session string, locate int, seq bigint, ts_ns bigint, bid_e4 bigint, bid_size bigint, ask_e4 bigint, ask_size bigint"
LEVELS = "session string, locate int, side string, px_e4 bigint, shares bigint"
USED = "type in ('A', 'F', 'E', 'C', 'X', 'D', 'U')"


class _Side:
    """Standing shares by price of one side, and its best price with its shares."""

    __slots__ = ("name", "sign", "levels", "heap", "px", "size")

    def __init__(self, name: str):
        self.name, self.sign = name, -1 if name == "B" else 1
        self.levels: dict[int, int] = {}
        #: Prices by goodness (bids negated); a price whose level is gone is dropped when it comes to the top, or when such prices are the most.
        self.heap: list[int] = []
        self.px = self.size = None

    def add(self, px: int, shares: int) -> bool:
        """Whether the best price or its shares were set; so for ``drop``."""
        have = self.levels.get(px)
        if have is None:
            if len(self.heap) > 2 * len(self.levels) + 64:
                self.heap = [x * self.sign for x in self.levels]
                heapq.heapify(self.heap)
            heapq.heappush(self.heap, px * self.sign)
            self.levels[px] = shares
            if self.px is None or px * self.sign < self.px * self.sign:
                self.px, self.size = px, shares
                return True
            return False
        self.levels[px] = have + shares
        if px != self.px:
            return False
        self.size = have + shares
        return True

    def drop(self, px: int, shares: int) -> bool:
        left = self.levels.get(px, 0) - shares
        if left > 0:
            self.levels[px] = left
            if px != self.px:
                return False
            self.size = left
            return True
        self.levels.pop(px, None)
        if px != self.px:
            return False
        heap, levels, sign = self.heap, self.levels, self.sign
        while heap and heap[0] * sign not in levels:
            heapq.heappop(heap)
        self.px = heap[0] * sign if heap else None
        self.size = levels.get(self.px)
        return True


class _Book:
    """Live orders by reference and the two sides they stand on."""

    __slots__ = ("orders", "bids", "asks", "top")

    def __init__(self):
        self.orders: dict[int, tuple[_Side, int, int]] = {}
        self.bids, self.asks = _Side("B"), _Side("S")
        self.top = (None, None, None, None)

    def apply(self, kind: str, ref: int, new_ref: int | None, side: str | None, shares: int | None, px: int | None) -> bool:
        """One message, and whether the top may have changed; unknown references change nothing, nor do orders without side."""
        orders = self.orders
        if kind in "AF":
            if side not in ("B", "S"):
                return False
            to = self.bids if side == "B" else self.asks
            orders[ref] = (to, px, shares)
            return to.add(px, shares)
        order = orders.get(ref)
        if order is None:
            return False
        at, price, have = order
        if kind in "DU" or shares is None or shares >= have:
            del orders[ref]
            changed = at.drop(price, have)
            if kind == "U":
                orders[new_ref] = (at, px, shares)
                changed |= at.add(px, shares)
            return changed
        orders[ref] = (at, price, have - shares)
        return at.drop(price, shares)

    def moved(self) -> tuple | None:
        """The top, if it is another than at the last call."""
        bids, asks = self.bids, self.asks
        top = (bids.px, bids.size, asks.px, asks.size)
        if top == self.top:
            return None
        self.top = top
        return top


def tops_of_book(messages: DataFrame) -> DataFrame:
    """Rows (session, locate, seq, ts_ns, bid, bid size, ask, ask size), one per message that changes the top.

    Books are independent, so a session's books are folded in parallel; one book
    is inherently sequential, in memory bounded by its live orders. Executions,
    cancels and replacements of unknown orders change nothing; an empty side is
    null. Orders without side are left out.
    """
    cols = ["session", "locate", "seq", "ts_ns", "type", "ref", "new_ref", "side", "shares", "px_e4"]

    def step(book: _Book, row):
        top = book.moved() if book.apply(*row[4:]) else None
        return book, top and (*row[:4], *top)

    return fold_sorted(messages.where(USED).select(*cols), keys=["session", "locate"], order=["seq"], step=step, start=_Book, out=TOP)


class TopsSource(SessionSource):
    """``spark.read.format("exchange_tops").load(paths)``: the rows of ``tops_of_book`` of session files, with the ``stock`` of the session's last directory or trading-action message for the locate; null without one.

    A file has its messages in order already: its books are folded side by side as they
    are read, so that no message leaves the reader. One task per file, in memory bounded by
    the session's live orders; a file is read twice, first for its stocks.
    """

    @classmethod
    def name(cls) -> str:
        return "exchange_tops"

    def schema(self) -> str:
        return f"{TOP}, stock string"

    def reader(self, schema) -> DataSourceReader:
        return _TopsReader(self.options)


class _TopsReader(_SessionReader):
    def read(self, partition):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        session = self.session(partition)
        with self.opened(partition) as f:
            stocks = last_stocks(f)
        stock_of, books = np.full(1 << 16, len(stocks)), defaultdict(_Book)
        stock_of[np.array([*stocks], np.int64)] = range(len(stocks))
        stocks = pa.array([*stocks.values(), None], pa.string())
        with self.opened(partition) as f:
            for m in book_blocks(f):
                rows, tops = [], []
                for i, locate, kind, ref, new_ref, side, shares, px in zip(range(len(m["seq"])), *(m[c].tolist() for c in ("locate", "type", "ref", "new_ref", "side", "shares", "px_e4")), strict=True):
                    book = books[locate]
                    if book.apply(kind, ref, new_ref, side, shares, px) and (top := book.moved()):
                        rows.append(i)
                        tops.append(top)
                if rows:
                    locate = m["locate"][rows]
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(session, len(rows)), pa.array(locate.astype(np.int32)), pa.array(m["seq"][rows]), pa.array(m["ts_ns"][rows]), *(pa.array(c, pa.int64()) for c in zip(*tops, strict=True)), pc.take(stocks, pa.array(stock_of[locate]))],
                        ["session", "locate", "seq", "ts_ns", "bid_e4", "bid_size", "ask_e4", "ask_size", "stock"],
                    )


def depth_after(messages: DataFrame) -> DataFrame:
    """Standing shares per (session, locate, side, price) after all messages.

    An order may be replaced any number of times, so the books are folded in
    message order as in ``tops_of_book``; the levels that then stand are the result.
    """
    cols = ["session", "locate", "seq", "type", "ref", "new_ref", "side", "shares", "px_e4"]

    def step(book: _Book, row):
        book.apply(*row[3:])
        return book, None

    def standing(key: tuple, book: _Book) -> list[tuple]:
        return [(*key, side.name, px, shares) for side in (book.bids, book.asks) for px, shares in side.levels.items() if px is not None and shares > 0]

    return fold_sorted(messages.where(USED).select(*cols), keys=["session", "locate"], order=["seq"], step=step, start=_Book, out=LEVELS, finish=standing)
