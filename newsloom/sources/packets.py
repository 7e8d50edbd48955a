"""Numbered packets of exchange messages: a header of session, number and count, then length-prefixed messages.

However packets were repeated, overlapped or came out of order, the messages are
those of the session's numbers, each once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.sources.market_files import FIELDS, SCHEMA, _number, decode_block, encode_block

#: Bytes of the header's fields; the count that ends a session.
SESSION_BYTES, HEADER, END = 10, 20, 0xFFFF


def encode_packet(session: str, seq: int, messages: list[bytes]) -> bytes:
    """A packet of messages that carry their length, for fixtures."""
    return _packet(session, seq, len(messages), b"".join(messages))


def _packet(session: str, seq: int, count: int, body: bytes) -> bytes:
    return session.ljust(SESSION_BYTES).encode("latin-1") + seq.to_bytes(8, "big") + count.to_bytes(2, "big") + body


def split_packet(packet: bytes | None) -> tuple[str, int, list[bytes]] | None:
    """(session, number of the first message, messages); None for a short header. Heartbeats and ends of sessions have no messages; a truncated packet has those that are whole."""
    if packet is None or len(packet) < HEADER:
        return None
    session, seq, count = packet[:SESSION_BYTES].decode("latin-1").strip(), int.from_bytes(packet[10:18], "big"), int.from_bytes(packet[18:20], "big")
    out, at = [], HEADER
    for _ in range(0 if count == END else count):
        size = int.from_bytes(packet[at : at + 2], "big")
        if at + 2 + size > len(packet):
            break
        out.append(packet[at + 2 : at + 2 + size])
        at += 2 + size
    return session, seq, out


def _buffers(a) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a binary Arrow array without nulls."""
    _, offsets, data = a.buffers()
    return np.frombuffer(offsets, np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64), np.frombuffer(data or b"", np.uint8)


def split_packets(packets):
    """``split_packet`` of a binary Arrow array: a record batch (session, seq, message) of all messages of all packets, in order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = packets.filter(pc.greater_equal(pc.binary_length(packets), HEADER))
    ends, data = _buffers(held) if len(held) else (np.zeros(1, np.int64), np.zeros(0, np.uint8))
    head = data[ends[:-1, None] + np.arange(HEADER)]
    at, end, count = ends[:-1] + HEADER, ends[1:], _number(head, SESSION_BYTES + 8, 2)
    live, k, parts = np.flatnonzero((count > 0) & (count != END)), 0, []
    while len(live):  # the next message of every packet that has one
        live = live[at[live] + 2 <= end[live]]
        size = data[at[live]].astype(np.int64) << 8 | data[at[live] + 1]
        whole = at[live] + 2 + size <= end[live]
        live, size = live[whole], size[whole]
        parts.append((live, np.full(len(live), k), at[live] + 2, size))
        at[live] += 2 + size
        k += 1
        live = live[count[live] > k]
    of, number, start, size = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
    order = np.argsort(of, kind="stable")
    of, number, start, size = of[order], number[order], start[order], size[order]
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]
    names = pa.Array.from_buffers(pa.binary(SESSION_BYTES), len(head), [None, pa.py_buffer(np.ascontiguousarray(head[:, :SESSION_BYTES]))]).dictionary_encode()
    session = pa.array([x.decode("latin-1").strip() for x in names.dictionary.to_pylist()], pa.string()).take(names.indices.take(pa.array(of)))
    message = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
    return pa.RecordBatch.from_arrays([session, pa.array(_number(head, SESSION_BYTES, 8)[of] + number), message], ["session", "seq", "message"])


def packet_messages(packets: DataFrame, *, packet: str) -> DataFrame:
    """(session, seq, message): every message of every packet, repeated ones too. Null and short packets give none."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            yield split_packets(b.column(0))

    return packets.select(packet).mapInArrow(run, "session string, seq bigint, message binary")


def recovered(packets: DataFrame, *, packet: str) -> DataFrame:
    """Messages with the columns of the session source, ``seq`` being the session's own numbers, each number once.

    Repeats of a number are the same message by contract; one of them is taken, by an
    aggregation with map-side partial results. What no packet holds is missing: ``market.sequence_gaps`` tells it.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            offsets, data = _buffers(b.column(2))
            size = np.diff(offsets)
            raw, at = np.zeros(int(offsets[-1] - offsets[0]) + 2 * len(size), np.uint8), offsets[:-1] - offsets[0] + 2 * np.arange(len(size))
            raw[at], raw[at + 1] = size >> 8, size & 255
            raw[np.arange(offsets[-1] - offsets[0]) + 2 * np.repeat(np.arange(1, len(size) + 1), size)] = data[offsets[0] : offsets[-1]]
            table, _, _ = decode_block(raw, "", 0)
            at = table["seq"]
            table = table.set_column(0, "session", b.column(0).take(at.combine_chunks())).set_column(1, "seq", b.column(1).take(at.combine_chunks()))
            yield from table.to_batches()

    one = packet_messages(packets, packet=packet).groupBy("session", "seq").agg(F.first("message").alias("message"))
    return one.mapInArrow(run, SCHEMA)


def values_of(messages: DataFrame) -> list[str]:
    """The columns that hold fields of some type of message."""
    return sorted({name for fields in FIELDS.values() for name, _, _ in fields} & set(messages.columns))


def encoded(messages: DataFrame) -> DataFrame:
    """(session, seq, message) of rows with the columns of the session source; messages carry their length. For fixtures and recorders."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), encode_block(b)], ["session", "seq", "message"])

    return messages.select("session", "seq", "type", "locate", "ts_ns", *values_of(messages)).mapInArrow(run, "session string, seq bigint, message binary")


def packed(messages: DataFrame, *, packet_of: str) -> DataFrame:
    """(session, packet) of ``encoded`` messages, those of one ``packet_of`` together; for fixtures, whose packets are small."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            seq, message = b.column(1).flatten().flatten()
            ends, (offsets, data) = b.column(1).offsets.to_numpy(), _buffers(message)
            ends, raw, first = (ends - ends[0]).tolist(), data.tobytes(), seq.to_pylist()
            at = offsets[ends].tolist()
            out = [_packet(s, first[f], e - f, raw[x:y]) for s, f, e, x, y in zip(b.column(0).to_pylist(), ends, ends[1:], at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["session", "packet"])

    g = messages.groupBy("session", packet_of).agg(F.array_sort(F.collect_list(F.struct("seq", "message"))).alias("ms")).select("session", "ms")
    return g.mapInArrow(run, "session string, packet binary")
