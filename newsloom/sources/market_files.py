"""Market data files: binary exchange sessions, bridge lines and tapes."""

from __future__ import annotations

import fnmatch
import gzip
import io
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from newsloom.functions.names import normalize_symbol

# Message types and their lengths.
LENGTHS = {"S": 12, "R": 39, "H": 25, "Y": 20, "L": 26, "V": 35, "W": 12, "K": 28, "J": 35, "h": 21, "A": 36, "F": 40, "E": 31, "C": 36, "X": 23, "D": 19, "U": 35, "P": 44, "Q": 40, "B": 19, "I": 50, "N": 20, "O": 48}

# Fields of the messages that are used, as (column, offset, width or kind).
FIELDS = {
    "S": [("code", 11, "c")],
    "R": [("stock", 11, "s8"), ("category", 19, "c"), ("status", 20, "c"), ("shares", 21, 4)],
    "H": [("stock", 11, "s8"), ("state", 19, "c"), ("reason", 21, "s4")],
    "Y": [("state", 19, "c")],
    "A": [("ref", 11, 8), ("side", 19, "c"), ("shares", 20, 4), ("px_e4", 32, 4)],
    "F": [("ref", 11, 8), ("side", 19, "c"), ("shares", 20, 4), ("px_e4", 32, 4)],
    "E": [("ref", 11, 8), ("shares", 19, 4)],
    "C": [("ref", 11, 8), ("shares", 19, 4), ("printable", 31, "c"), ("px_e4", 32, 4)],
    "X": [("ref", 11, 8), ("shares", 19, 4)],
    "D": [("ref", 11, 8)],
    "U": [("ref", 11, 8), ("new_ref", 19, 8), ("shares", 27, 4), ("px_e4", 31, 4)],
    "P": [("side", 19, "c"), ("shares", 20, 4), ("stock", 24, "s8"), ("px_e4", 32, 4)],
    "Q": [("shares", 11, 8), ("stock", 19, "s8"), ("px_e4", 27, 4), ("code", 39, "c")],
    "B": [("ref", 11, 8)],
}
#: Types of messages that change books.
BOOK = "AFECXDU"
SCHEMA = "session string, seq bigint, type string, locate int, ts_ns bigint, stock string, ref bigint, new_ref bigint, side string, shares bigint, px_e4 bigint, printable string, state string, reason string, code string, category string, status string"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
BLOCK, STEP = 8 << 20, 1 << 20
_LETTERS = [chr(i).rstrip(" \0") for i in range(256)]


def _offsets(buf: np.ndarray) -> tuple[np.ndarray, int]:
    """Starts of the whole messages in a block of length-prefixed messages, and how far they reach."""
    out, at, n, raw = [], 2, len(buf), buf.tobytes()
    while at <= n:
        end = at + ((raw[at - 2] << 8) | raw[at - 1])
        if end > n:
            break
        out.append(at)
        at = end + 2
    starts = np.array(out, np.int64)
    sizes = (buf[starts - 2].astype(np.int64) << 8) | buf[starts - 1]
    return np.stack([starts, sizes], 1), at - 2


def _number(rows: np.ndarray, at: int, width: int) -> np.ndarray:
    v = np.zeros(len(rows), np.uint64)
    for k in range(width):
        v = (v << np.uint64(8)) | rows[:, at + k].astype(np.uint64)
    return v.astype(np.int64)


def decode_block(buf: np.ndarray, session: str, first: int):
    """(record batch, bytes used, messages seen): all used messages of a block, decoded by type, in order."""
    import pyarrow as pa

    spans, used = _offsets(buf)
    parts = []
    if len(spans):
        kinds = buf[spans[:, 0]]
        for kind, fields in FIELDS.items():
            which = np.flatnonzero((kinds == ord(kind)) & (spans[:, 1] >= LENGTHS[kind]))
            if not len(which):
                continue
            rows = buf[spans[which, 0][:, None] + np.arange(LENGTHS[kind])]
            cols = {"session": pa.repeat(session, len(which)), "seq": pa.array(which + first), "type": pa.repeat(kind, len(which)), "locate": pa.array(_number(rows, 1, 2).astype(np.int32)), "ts_ns": pa.array(_number(rows, 5, 6))}
            for name, at, width in fields:
                if isinstance(width, int):
                    cols[name] = pa.array(_number(rows, at, width))
                elif width == "c":
                    cols[name] = pa.array(_LETTERS).take(pa.array(rows[:, at]))
                else:
                    w = int(width[1:])
                    distinct, which_one = np.unique(np.ascontiguousarray(rows[:, at : at + w]).view(f"S{w}").ravel(), return_inverse=True)
                    cols[name] = pa.array([x.decode("latin-1").rstrip() for x in distinct.tolist()], pa.string()).take(pa.array(which_one))
            parts.append(pa.table(cols))
    types = {"locate": pa.int32(), "seq": pa.int64(), "ts_ns": pa.int64(), "ref": pa.int64(), "new_ref": pa.int64(), "shares": pa.int64(), "px_e4": pa.int64()}
    schema = pa.schema([(c, types.get(c, pa.string())) for c in _COLUMNS])
    full = [pa.table({c: t[c] if c in t.column_names else pa.nulls(len(t), schema.field(c).type) for c in _COLUMNS}, schema=schema) for t in parts]
    table = pa.concat_tables(full).sort_by("seq").combine_chunks() if full else schema.empty_table()
    return table, used, len(spans)


def _book_columns(buf: np.ndarray, first: int) -> tuple[dict[str, np.ndarray], int, int]:
    """(columns, bytes used, messages seen): the messages of a block that change books, in order. A field that a type of message lacks is 0 or empty."""
    spans, used = _offsets(buf)
    kinds, whole = buf[spans[:, 0]], np.zeros(len(spans), bool)
    for kind in BOOK:
        whole |= (kinds == ord(kind)) & (spans[:, 1] >= LENGTHS[kind])
    seen = np.flatnonzero(whole)
    starts, kinds = spans[seen, 0], kinds[seen]
    letters = np.array(_LETTERS, object)
    out = {"seq": seen + first, "type": letters[kinds], "side": np.full(len(seen), "", object)} | {c: np.zeros(len(seen), np.int64) for c in ("locate", "ts_ns", "ref", "new_ref", "shares", "px_e4")}
    for kind in BOOK:
        which = np.flatnonzero(kinds == ord(kind))
        rows = buf[starts[which][:, None] + np.arange(LENGTHS[kind])]
        for name, offset, width in [("locate", 1, 2), ("ts_ns", 5, 6), *FIELDS[kind]]:
            if name in out:
                out[name][which] = letters[rows[:, offset]] if width == "c" else _number(rows, offset, width)
    return out, used, len(spans)


def _last_stocks(buf: np.ndarray, first: int) -> tuple[dict[int, str], int, int]:
    """(stock by locate, bytes used, messages seen): of a block's last directory or trading-action messages that name one."""
    spans, used = _offsets(buf)
    kinds, out = buf[spans[:, 0]], {}
    for start in spans[(kinds == ord("R")) & (spans[:, 1] >= LENGTHS["R"]) | (kinds == ord("H")) & (spans[:, 1] >= LENGTHS["H"]), 0].tolist():
        if stock := buf[start + 11 : start + 19].tobytes().rstrip(b"\0").decode("latin-1").rstrip():
            out[int(buf[start + 1]) << 8 | int(buf[start + 2])] = stock
    return out, used, len(spans)


def _inflated(stream: io.BufferedIOBase) -> tuple[bytes, bool]:
    """A block of bytes, and whether more may follow.

    A compressed stream that ends too early gives all that came out before its end;
    every other failure to read is an error.
    """
    parts, size = [], 0
    try:
        # read1 gives what one step inflates, so an early end takes nothing along that came before it.
        while size < BLOCK:
            more = stream.read1(min(STEP, BLOCK - size))
            if not more:
                break
            parts.append(more)
            size += len(more)
    except EOFError:
        return b"".join(parts), False
    return b"".join(parts), size == BLOCK


def _blocks(stream: io.BufferedIOBase, decode: Callable) -> Iterator:
    """What ``decode(block, number of its first message)`` makes of each block; it also gives the bytes used and the messages seen. Stops cleanly at a message or gzip stream that ends too early."""
    rest, seq, goes_on = b"", 0, True
    while goes_on:
        more, goes_on = _inflated(stream)
        if not more:
            return
        buf = np.frombuffer(rest + more, np.uint8)
        got, used, n = decode(buf, seq)
        rest, seq = buf[used:].tobytes(), seq + n
        yield got


def book_blocks(stream: io.BufferedIOBase) -> Iterator[dict[str, np.ndarray]]:
    """The messages of a session that change books, as numpy columns of a block each."""
    return _blocks(stream, _book_columns)


def last_stocks(stream: io.BufferedIOBase) -> dict[int, str]:
    """The stock of the session's last directory or trading-action message for each locate."""
    out: dict[int, str] = {}
    for got in _blocks(stream, _last_stocks):
        out |= got
    return out


def read_messages(stream: io.BufferedIOBase, session: str, directory_only: bool = False) -> Iterator:
    """Record batches of a session; stops cleanly at a message or gzip stream that ends too early. Short and unknown messages are passed over."""
    for table in _blocks(stream, lambda buf, first: decode_block(buf, session, first)):
        if directory_only:
            traded = np.isin(table["type"].to_numpy(zero_copy_only=False), ["A", "F", "P"])
            if traded.any():
                yield from table.slice(0, int(traded.argmax())).to_batches()
                return
        yield from table.to_batches()


def _opened(path: str):
    """(file system, path) of a URI of any file system that Arrow knows, or of a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def session_files(paths: str) -> list[str]:
    """The files of a list of paths, parted by commas: files, folders (all files in them) or patterns (``*`` and ``?`` in the last part)."""
    from pyarrow import fs

    out: list[str] = []
    for path in filter(None, paths.split(",")):
        system, at = _opened(path)
        head = path[: len(path) - len(at)] if path.endswith(at) else ""
        folder, _, name = at.rpartition("/")
        if any(c in name for c in "*?"):
            out += sorted(head + f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, name))
        elif system.get_file_info(at).type == fs.FileType.Directory:
            out += sorted(head + f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.base_name[0] not in "._")
        else:
            out.append(path)
    return out


class SessionSource(DataSource):
    """``spark.read.format("exchange_session").load(paths)``: files, folders or patterns on any file system; one task per file, as gzip cannot be split.

    With the option ``directoryOnly`` a file is read up to its first order or trade, before which the directory stands.
    """

    @classmethod
    def name(cls) -> str:
        return "exchange_session"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _SessionReader(self.options)


class _SessionReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options.get("path", "")
        self.directory_only = options.get("directoryOnly", "false").lower() == "true"

    def partitions(self):
        return [InputPartition(p) for p in session_files(self.paths)]

    @contextmanager
    def opened(self, partition):
        path = partition.value
        system, at = _opened(path)
        with system.open_input_stream(at, compression=None) as raw:
            # Every stream offers read1, which an Arrow file alone does not.
            yield gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(_Raw(raw), STEP)

    def session(self, partition) -> str:
        return partition.value.rsplit("/", 1)[-1].split(".")[0]

    def read(self, partition):
        with self.opened(partition) as f:
            yield from read_messages(f, self.session(partition), self.directory_only)


class _Raw(io.RawIOBase):
    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.stream.read(len(into))
        into[: len(got)] = got
        return len(got)


def encode_message(kind: str, locate: int, ts_ns: int, **values) -> bytes:
    """One length-prefixed message, for fixtures."""
    m = bytearray(LENGTHS[kind])
    m[0] = ord(kind)
    m[1:3] = locate.to_bytes(2, "big")
    m[5:11] = ts_ns.to_bytes(6, "big")
    for name, at, width in FIELDS[kind]:
        v = values.get(name)
        if isinstance(width, int):
            m[at : at + width] = int(v or 0).to_bytes(width, "big")
        else:
            w = 1 if width == "c" else int(width[1:])
            m[at : at + w] = str(v or "").ljust(w)[:w].encode("latin-1")
    return len(m).to_bytes(2, "big") + bytes(m)


def encode_block(batch):
    """The messages of a record batch with columns of the session source, with their length, as one binary array: ``encode_message`` of all rows at once."""
    import pyarrow as pa
    import pyarrow.compute as pc

    cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    kinds = cols["type"].dictionary_encode()
    names, kind_at = kinds.dictionary.to_pylist(), kinds.indices.to_numpy(zero_copy_only=False)
    sizes = np.array([LENGTHS[k] + 2 for k in names], np.int64)[kind_at] if names else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(offsets[-1], np.uint8)
    for i, kind in enumerate(names):
        which = np.flatnonzero(kind_at == i)
        at_rows, m = pa.array(which), np.zeros((len(which), LENGTHS[kind] + 2), np.uint8)
        m[:, 0], m[:, 1], m[:, 2] = LENGTHS[kind] >> 8, LENGTHS[kind] & 255, ord(kind)
        for name, at, width in [("locate", 1, 2), ("ts_ns", 5, 6), *FIELDS[kind]]:
            of = cols[name].take(at_rows) if name in cols else None
            if isinstance(width, int):
                if of is None:
                    continue
                v = pc.fill_null(of.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                if len(v) and (v.min() < 0 or width < 8 and v.max() >= 1 << 8 * width):
                    raise OverflowError(f"{name} of a message {kind} does not fit {width} bytes")
                m[:, at + 2 : at + 2 + width] = v.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]
            else:
                w = 1 if width == "c" else int(width[1:])
                if of is None:
                    m[:, at + 2 : at + 2 + w] = ord(" ")
                    continue
                d = pc.fill_null(of, "").dictionary_encode()
                texts = b"".join(x.ljust(w)[:w].encode("latin-1") for x in d.dictionary.to_pylist())
                m[:, at + 2 : at + 2 + w] = np.frombuffer(texts, np.uint8).reshape(-1, w)[d.indices.to_numpy(zero_copy_only=False)]
        out[offsets[which][:, None] + np.arange(LENGTHS[kind] + 2)] = m
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def session_prints(messages: DataFrame) -> DataFrame:
    """Prints ``(session, seq, locate, ts_ns, px_e4, shares, kind)`` of a session.

    An execution without price takes that of its resting order; a replacement
    carries its order's place on. References live in one session, so the join is
    by (session, ref); executions of unknown references drop out. Crosses and
    hidden trades carry their own price; non-printable executions drop out.
    """
    orders = messages.where("type in ('A', 'F')").select("session", "ref", "px_e4").unionByName(messages.where("type = 'U'").select("session", F.col("new_ref").alias("ref"), "px_e4"))
    base = ["session", "seq", "locate", "ts_ns", "px_e4", "shares"]
    at_order = messages.where("type = 'E'").drop("px_e4").join(orders, ["session", "ref"]).select(*base, F.lit("execution").alias("kind"))
    priced = messages.where("type = 'C' and printable = 'Y'").select(*base, F.lit("execution").alias("kind"))
    trades = messages.where("type = 'P'").select(*base, F.lit("trade").alias("kind"))
    crosses = messages.where("type = 'Q' and shares > 0").select(*base, F.concat(F.lit("cross "), F.col("code")).alias("kind"))
    return at_order.unionByName(priced).unionByName(trades).unionByName(crosses)


def missing_symbols(messages: DataFrame, master: DataFrame) -> DataFrame:
    """Directory symbols that the master lacks."""
    return messages.where("type = 'R'").select(F.col("stock").alias("ticker"), "category", "status").distinct().join(master.select("ticker").distinct(), "ticker", "left_anti")


def bridge_lines(lines: DataFrame, *, stamped: bool = False) -> DataFrame:
    """Typed rows of text lines ``T SYM PX SZ [NS]``, ``Q SYM BID BSZ ASK ASZ [NS]``, ``H SYM STATE [REASON]``.

    ``stamped`` lines start with their epoch ns. Prices round half up to 1e-4
    dollars. Lines that do not read so have kind null and keep their text.
    """
    v = F.trim(F.col("value"))
    ns = F.regexp_extract(v, r"^([0-9]+)\s+", 1).try_cast("bigint") if stamped else F.lit(None).cast("bigint")
    f = F.split(F.regexp_replace(v, r"^[0-9]+\s+", "") if stamped else v, r"\s+")
    n = F.size(f)
    px = lambda i: F.floor(F.get(f, F.lit(i)).try_cast("double") * 10000 + 0.5).cast("bigint")
    num = lambda i: F.get(f, F.lit(i)).try_cast("bigint")
    kind = F.get(f, F.lit(0))
    good = (
        F.when(kind == "T", (n >= 4) & (px(2) > 0) & (num(3) > 0))
        .when(kind == "Q", (n >= 6) & (px(2) >= 0) & (px(4) >= 0) & num(3).isNotNull() & num(5).isNotNull())
        .when(kind == "H", n >= 3)
        .otherwise(False)
    )
    ok = lambda k, c: F.when(good & (kind == k), c)
    return lines.select(
        F.when(good, kind).alias("kind"), F.when(good, F.get(f, F.lit(1))).alias("ticker"), F.coalesce(ns, ok("T", num(4)), ok("Q", num(6))).alias("ts_ns"),
        ok("T", px(2)).alias("px_e4"), ok("T", num(3)).alias("shares"), ok("Q", px(2)).alias("bid_e4"), ok("Q", num(3)).alias("bid_size"), ok("Q", px(4)).alias("ask_e4"), ok("Q", num(5)).alias("ask_size"),
        ok("H", F.get(f, F.lit(2))).alias("state"), ok("H", F.get(f, F.lit(3))).alias("reason"), v.alias("line"),
    )


def read_tape(spark: SparkSession, path: str) -> DataFrame:
    return bridge_lines(spark.read.text(path), stamped=True)


def with_symbols(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """``rows`` (session, locate, ...) with ``ticker``: of the session's last directory or trading-action message for that locate; null without one.

    Locates are numbers of one session: at most 65,536 to a session, joined by (session, locate).
    """
    known = messages.where("type in ('R', 'H') and stock <> ''").groupBy("session", "locate").agg(F.max_by("stock", "seq").alias("_stock"))
    return rows.join(known, ["session", "locate"], "left").withColumn("ticker", normalize_symbol(F.col("_stock"))).drop("_stock")


def session_counters(messages: DataFrame) -> DataFrame:
    """(session, messages, orders, unknown_refs, hidden): messages that name an order which no earlier kind of message of the session brought in count as unknown."""
    # One pass; one row per reference and task is moved, as a reference's messages stand near each other. Nothing brings in a null reference.
    kind, yes = F.col("type"), lambda c: F.coalesce(c, F.lit(False)).cast("int")
    counts = {"messages": F.lit(1), "orders": yes(kind.isin("A", "F")), "hidden": yes((kind == "C") & (F.col("printable") != "Y")), "named": yes(kind.isin("E", "C", "X", "D", "U")), "born": yes(kind.isin("A", "F"))}
    own = F.struct(F.when(kind.isin(*"AFECXDU"), F.col("ref")).alias("ref"), *(c.alias(k) for k, c in counts.items()))
    new = F.struct(F.col("new_ref").alias("ref"), *(F.lit(int(k == "born")).alias(k) for k in counts))
    r = messages.select("session", F.explode(F.when(kind == "U", F.array(own, new)).otherwise(F.array(own))).alias("r")).select("session", "r.*").groupBy("session", "ref").agg(*(F.sum(k).alias(k) for k in counts))
    unknown = F.when((F.col("born") == 0) | F.col("ref").isNull(), F.col("named")).otherwise(0)
    return r.groupBy("session").agg(*(F.sum(k).alias(k) for k in ("messages", "orders", "hidden")), F.sum(unknown).alias("unknown_refs"))


def tape_lines(rows: DataFrame) -> DataFrame:
    """(ts_ns, value): rows of ``bridge_lines`` as stamped lines again; rows without kind or time are left out."""
    px = lambda c: F.format_string("%d.%04d", F.floor(F.col(c) / 10000), F.col(c) % 10000)
    text = lambda *c: F.concat_ws(" ", "kind", "ticker", *c)
    line = F.when(F.col("kind") == "T", text(px("px_e4"), F.col("shares").cast("string"))).when(F.col("kind") == "Q", text(px("bid_e4"), F.col("bid_size").cast("string"), px("ask_e4"), F.col("ask_size").cast("string"))).when(F.col("kind") == "H", text("state", "reason"))
    return rows.withColumn("_l", line).where("_l is not null and ts_ns is not null").select("ts_ns", F.concat_ws(" ", F.col("ts_ns").cast("string"), "_l").alias("value"))
