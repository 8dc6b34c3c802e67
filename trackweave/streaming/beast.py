"""Beast byte streams as a streaming source, and positions from their frames.

A frame is 0x1A, a type and a body of fixed size, in which 0x1A is doubled.  So
a frame begins at the last of an odd run of 0x1A before a type: where frames
begin shows in their neighbourhood, whatever was read before.  A batch takes
the frames whose last byte lies in its range of bytes; it looks back a little
for their beginnings, which is how unfinished frames are carried over.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.timeunits import micros
from ..sources import modes

# Bytes of a frame by type, type and escape counted once.
SIZES = {0x31: 11, 0x32: 16, 0x33: 23, 0x34: 23}
#: A frame takes so many bytes at most, every byte of its body doubled.
LONGEST = 2 * 23
SCHEMA = "file string, at long, kind string, received long, signal int, rawmsg string"


def frames(data: bytes, since: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(first byte, past the last byte, frame) of the whole frames of ``data`` that end after ``since``.

    A frame that another one interrupts is damaged and left out.
    """
    at = 0
    while True:
        at = data.find(b"\x1a", at)
        if at < 0:
            return
        run = at
        while run < len(data) and data[run] == 0x1A:
            run += 1
        need = SIZES.get(data[run]) if run < len(data) and (run - at) % 2 else None
        if need is None:
            at = run
            continue
        body, i = bytearray(data[run - 1 : run + 1]), run + 1
        while len(body) < need and i < len(data):
            if data[i] == 0x1A:
                if data[i + 1 : i + 2] != b"\x1a":
                    break
                i += 1
            body.append(data[i])
            i += 1
        if len(body) == need and i > since:
            yield run - 1, i, bytes(body)
        at = i if len(body) == need else run


def frames_of(chunks) -> Iterator[bytes]:
    """Frames of chunks of any size, as they come; no more than a chunk and a frame is held."""
    rest = b""
    for chunk in chunks:
        rest += chunk
        end = 0
        for _, end, frame in frames(rest):
            yield frame
        keep = max(end, len(rest) - LONGEST)
        while 0 < keep and rest[keep - 1 : keep] == b"\x1a" and keep > end:
            keep -= 1  # a run of escapes stays whole
        rest = rest[keep:]


class Range(InputPartition):
    """Bytes of a file: the frames that end after ``start`` and not after ``end``."""

    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _sizes(path: str) -> dict[str, int]:
    """Bytes of each file of a folder (or of a file), by path."""
    from pyarrow import fs

    system, root = _system(path)
    info = system.get_file_info(root)
    infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return {i.path: i.size for i in infos if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))}


def _rows(path: str, r: Range) -> Iterator[tuple]:
    system, _ = _system(path)
    with system.open_input_file(r.file) as f:
        back = LONGEST
        while True:  # as far back as a frame may begin, and to the beginning of a run of escapes
            low = max(0, r.start - back)
            f.seek(low)
            data = f.read(r.end - low)
            if low == 0 or data[:1] != b"\x1a":
                break
            back *= 2
    for first, _, frame in frames(data, r.start - low):
        body = frame[2:]
        yield r.file, low + first, chr(frame[1]), int.from_bytes(body[:6], "big"), body[6], body[7:].hex()


def _cut(file: str, start: int, end: int, size: int) -> list[Range]:
    return [Range(file, a, min(a + size, end)) for a in range(start, end, size)]


class BeastSource(DataSource):
    """Format "beast": options path (a folder or file that pyarrow reaches from every executor) and range_bytes.

    Rows: the file, the frame's first byte in it, type, 48-bit time, signal
    level and the message in hex.
    """

    @classmethod
    def name(cls) -> str:
        return "beast"

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("range_bytes", 16 << 20))

    def reader(self, schema) -> DataSourceReader:
        return BeastReader(*self._given())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return BeastStreamReader(*self._given())


class BeastReader(DataSourceReader):
    """All frames that are whole, in ranges of bytes."""

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        return [r for file, n in sorted(_sizes(self.path).items()) for r in _cut(file, 0, n, self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _rows(self.path, partition)


class BeastStreamReader(DataSourceStreamReader):
    """Frames as their last bytes arrive; the offset is the number of bytes of each file."""

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": json.dumps(_sizes(self.path), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        return [r for file, n in sorted(new.items()) for r in _cut(file, old.get(file, 0), n, self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _rows(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    """Makes format "beast" known to the session."""
    spark.dataSource.register(BeastSource)


_PACKED = T.StructType().add("t", T.LongType()).add("y", T.DoubleType()).add("x", T.DoubleType())
_STATE = T.StructType([T.StructField(f"{p}{c}", k) for p in "eo" for c, k in (("t", T.LongType()), ("y", T.DoubleType()), ("x", T.DoubleType()))]).add("held", T.BinaryType())


def _pair(rows: pd.DataFrame, time: str, tie: list[str], last: list) -> pd.DataFrame:
    """Adds to each row, in order, the last even and the last odd position before it; ``last`` is carried on."""
    rows = rows.sort_values([time, *tie], kind="stable")
    t = rows[time].to_numpy("datetime64[us]").astype("int64")
    even, odd = [], []
    for at, parity, y, x in zip(t.tolist(), rows["_odd"].tolist(), rows["_y"].tolist(), rows["_x"].tolist(), strict=True):
        even.append(last[0])
        odd.append(last[1])
        if parity == 0:
            last[0] = {"t": at, "y": y, "x": x}
        elif parity == 1:
            last[1] = {"t": at, "y": y, "x": x}
    return rows.assign(_e=pd.Series(even, rows.index, object), _o=pd.Series(odd, rows.index, object))


def decode_stream(stream: DataFrame, message: str = "rawmsg", time: str = "timestamp", within="10 s", late: str = "10 seconds", tie: tuple[str, ...] = ()) -> DataFrame:
    """modes.decode() of a stream: the same rows, once the watermark has passed them.

    A row waits in its aircraft's state until nothing earlier can come, so
    rows out of order pair as they do in a batch; later rows than ``late`` are
    dropped.  The state is the rows that wait and two packed positions; it goes
    ``within`` after the aircraft's last row.  ``tie`` orders rows of one time.
    """
    f = modes.fields(stream, message).withWatermark(time, late)
    schema = T.StructType(f.schema.fields + [T.StructField("_e", _PACKED), T.StructField("_o", _PACKED)])
    span = micros(within)

    def step(key, frames_: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last: list = [None, None]
        held = []
        if state.exists:
            s = state.get
            last = [None if s[k] is None else {"t": s[k], "y": s[k + 1], "x": s[k + 2]} for k in (0, 3)]
            if s[6]:
                held.append(pa.ipc.open_stream(io.BytesIO(s[6])).read_pandas())
        rows = pd.concat([*held, *frames_]) if held or not state.hasTimedOut else None
        mark = state.getCurrentWatermarkMs() * 1000
        out = rest = None
        if rows is not None and len(rows):
            t = rows[time].to_numpy("datetime64[us]").astype("int64")
            out, rest = rows[t < mark], rows[t >= mark]
            if len(out):
                yield _pair(out, time, list(tie), last)[schema.names]
        known = [v["t"] for v in last if v]
        if rest is not None and len(rest):
            sink = io.BytesIO()
            table = pa.Table.from_pandas(rest, preserve_index=False)
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            wait = int(rest[time].to_numpy("datetime64[us]").astype("int64").min())
        elif known and max(known) + span >= mark:
            sink, wait = None, max(known) + span
        else:
            if state.exists:
                state.remove()
            return
        packed = [v for p in last for v in ((p["t"], p["y"], p["x"]) if p else (None, None, None))]
        state.update((*packed, sink.getvalue() if sink else None))
        state.setTimeoutTimestamp(max(wait, mark) // 1000 + 1)

    paired = f.groupBy("icao24").applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return modes.positions(paired, time, within)
