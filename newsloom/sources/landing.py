"""Files that others left or are to read: lines, tables and exchange sessions, written by the executors."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.sources.market_files import _opened, encode_block
from newsloom.sources.packets import _buffers, encoded, values_of


def land_lines(lines: DataFrame, path: str, compression: str = "none") -> str:
    """One text column to text files."""
    lines.write.mode("overwrite").option("compression", compression).text(path)
    return path


def land_documents(items: DataFrame, path: str, head: str, tail: str) -> str:
    """One text column to documents of many items: each file begins with ``head`` and ends with ``tail``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([tail])], ["value"])

    return land_lines(items.mapInArrow(run, "value string"), path)


def land_table(df: DataFrame, path: str, sep: str, header: bool = True) -> str:
    """Columns as they are, without quotes; null is empty."""
    df.write.mode("overwrite").options(sep=sep, header=header, quote="\u0000", escape="\u0000", emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def land_sessions(messages: DataFrame, folder: str, in_order: bool = False, made: Callable | None = None) -> DataFrame:
    """Record messages to ``folder/SESSION.gz``, one file per session, in the order of ``seq``; rows (session, messages).

    With ``in_order`` they are parted by session and stand in order already; then nothing is moved or sorted here, and
    they need no ``seq``; ``made`` may make them of other rows here, a record batch of one, so that no
    message is passed on singly. A file takes its name when it is whole, so that a task that is run again, or
    twice at once, leaves one whole file. Messages have the columns of the session source.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        system, at = _opened(folder)
        system.create_dir(at, recursive=True)
        now, out, part, n, done = None, None, "", 0, []

        def close() -> None:
            if out is not None:
                out[1].close()
                out[0].close()
                system.move(part, f"{at}/{now}.gz")
                done.append((now, n))

        for b in map(made, batches) if made else batches:
            offsets, data = _buffers(encode_block(b) if in_order else b.column(2))
            runs = b.column(0).dictionary_encode()
            which = runs.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(which, prepend=-1)).tolist()
            for start, end in zip(starts, [*starts[1:], len(which)], strict=True):
                session = runs.dictionary[int(which[start])].as_py()
                if session != now:
                    close()
                    now, n, part = session, 0, f"{at}/.{uuid.uuid4().hex}"
                    raw = system.open_output_stream(part, compression=None)
                    out = raw, gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=6)
                out[1].write(data[offsets[start] : offsets[end]])
                n += end - start
        close()
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["session", "messages"])

    rows = messages if made else messages.select("session", "type", "locate", "ts_ns", *values_of(messages)) if in_order else encoded(messages).repartition("session").sortWithinPartitions("session", "seq")
    return rows.mapInArrow(run, "session string, messages bigint")


MARK = "_newsloom"


def claim_folder(folder: str) -> str:
    """A folder for results: made, or taken if it is empty or was claimed before; anything else in it is an error, so that nobody's files are replaced."""
    from pyarrow import fs

    system, at = _opened(folder)
    system.create_dir(at, recursive=True)
    names = {f.base_name for f in system.get_file_info(fs.FileSelector(at))}
    if names and MARK not in names:
        raise FileExistsError(f"{folder} holds other files")
    with system.open_output_stream(f"{at}/{MARK}") as f:
        f.write(b"")
    return folder


def counted(df: DataFrame, name: str, **counts: Column):
    """(df, observation): counters that fill as the plan runs, at no cost of another pass; read ``observation.get`` after an action."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items())), seen
