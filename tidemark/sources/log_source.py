"""A data source for access logs: ``spark.read.format("accesslog")`` and ``readStream``.

It reads CSV with a header, JSON lines, ORC and Parquet with the schema of logs. Files
are planned into pieces (row groups, stripes, ranges of bytes that end at a line), so one
large file is read by many tasks. Filters on plain columns can be taken over: they choose
pieces by what Parquet knows of each row group, and rows before they leave Python. As a
stream it hands out files in the order of their time and name; the offset is the last
file handed out, so nothing but the checkpoint remembers what was read.
"""

from __future__ import annotations

import io
import json
import posixpath
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
import pyarrow.orc
import pyarrow.parquet
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

NAME = "accesslog"
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
ARROW = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
ENDINGS = {"csv": ".csv", "json": ".json", "orc": ".orc", "parquet": ".parquet"}
#: Bytes of a piece of text.
PIECE_BYTES = 64 << 20
COMPARED = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


@dataclass
class Piece(InputPartition):
    """A part of a file: a row group or stripe by number, or lines that begin in a range of bytes."""

    path: str
    first: int
    last: int

    def __post_init__(self):
        super().__init__(None)


@dataclass
class Kept:
    """Filters taken over, as (kind, column, value)."""

    tests: list[tuple[type, str, object]] = field(default_factory=list)

    def mask(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        for kind, name, value in self.tests:
            column = batch.column(batch.schema.get_field_index(name))
            if kind is IsNotNull or kind is IsNull:
                keep = pc.is_valid(column) if kind is IsNotNull else pc.is_null(column)
            elif kind is In:
                keep = pc.and_(pc.is_in(column, value_set=pa.array(value, column.type)), pc.is_valid(column))
            else:
                keep = COMPARED[kind](column, pa.scalar(value, column.type))
            batch = batch.filter(keep)  # an unknown comparison drops the row, as in SQL
        return batch

    def may_match(self, low: dict, high: dict) -> bool:
        """Whether rows between these bounds of columns can pass; a column without bounds can."""
        for kind, name, value in self.tests:
            if low.get(name) is None or high.get(name) is None or kind in (IsNotNull, IsNull):
                continue
            values = value if kind is In else [value]
            if kind in (EqualTo, In) and not any(low[name] <= v <= high[name] for v in values):
                return False
            if kind is GreaterThan and high[name] <= value or kind is GreaterThanOrEqual and high[name] < value:
                return False
            if kind is LessThan and low[name] >= value or kind is LessThanOrEqual and low[name] > value:
                return False
        return True


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def files(path: str, kind: str) -> list[tuple[int, str]]:
    """(time in microseconds, path) of a log's files, oldest first; hidden ones are none of it."""
    fs, at = _store(path)
    info = fs.get_file_info(at)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in posixpath.relpath(p, at).split("/") if x != ".")
    return sorted((f.mtime_ns // 1000, f.path) for f in found if f.is_file and f.size and (info.is_file or f.path.endswith(ENDINGS[kind]) and not hidden(f.path)))


class LogReader:
    """Plans and reads pieces; shared by batch and stream."""

    def __init__(self, options: dict):
        self.path, self.kind = options.get("path"), options.get("kind", "parquet")
        self.piece_bytes = int(options.get("piecebytes", PIECE_BYTES))
        if self.kind not in ENDINGS:
            raise ValueError(f"{self.kind}: one of {', '.join(ENDINGS)}")
        if not self.path:
            raise ValueError("a log needs a path")
        self.kept = Kept()

    def pieces(self, paths: Iterable[str]) -> list[Piece]:
        fs, _ = _store(self.path)
        out = []
        for path in paths:
            if self.kind == "parquet":
                told = pa.parquet.read_metadata(path, filesystem=fs)
                out += [Piece(path, g, g + 1) for g in range(told.num_row_groups) if self.kept.may_match(*_bounds(told.row_group(g)))]
            elif self.kind == "orc":
                with fs.open_input_file(path) as f:
                    out += [Piece(path, s, s + 1) for s in range(pa.orc.ORCFile(f).nstripes)]
            else:
                size = fs.get_file_info(path).size
                out += [Piece(path, a, min(a + self.piece_bytes, size)) for a in range(0, size, self.piece_bytes)]
        return out

    def rows(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        fs, _ = _store(self.path)
        with fs.open_input_file(piece.path) as f:
            if self.kind == "parquet":
                batches = pa.parquet.ParquetFile(f).iter_batches(row_groups=range(piece.first, piece.last))
            elif self.kind == "orc":
                told = pa.orc.ORCFile(f)
                batches = (told.read_stripe(s) for s in range(piece.first, piece.last))
            else:
                batches = self._lines(f, piece)
            for batch in batches:
                yield self.kept.mask(_as_log(batch))

    def _lines(self, f, piece: Piece) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the range. The first line of a CSV file names its columns."""
        header = b""
        if self.kind == "csv":
            header = _line_at(f, 0)
        begin = piece.first
        if begin:
            begin += len(_line_at(f, begin - 1)) - 1  # the next line's beginning, or this place if a line begins here
        elif header:
            begin = len(header)
        end = piece.last if piece.last >= f.size() else piece.last - 1 + len(_line_at(f, piece.last - 1))
        if begin >= end:
            return
        f.seek(begin)
        data = f.read(end - begin)
        if self.kind == "csv":
            names = next(iter(pa.csv.read_csv(io.BytesIO(header + b"\n")).schema.names for _ in (0,)))
            convert = pa.csv.ConvertOptions(column_types={n: ARROW.field(n).type for n in names if n in ARROW.names}, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=False)
            yield from pa.csv.read_csv(io.BytesIO(data), read_options=pa.csv.ReadOptions(column_names=names), parse_options=pa.csv.ParseOptions(escape_char="\\"), convert_options=convert).to_batches()
        else:
            rows = [json.loads(x) for x in data.splitlines() if x.strip()]
            yield pa.RecordBatch.from_arrays([pa.array([_plain(r.get(n)) for r in rows], pa.string() if pa.types.is_timestamp(t) else t) for n, t in zip(ARROW.names, ARROW.types, strict=True)], names=ARROW.names)


def _plain(value):
    """Nested JSON stays text."""
    return json.dumps(value) if isinstance(value, dict | list) else value


def _line_at(f, place: int) -> bytes:
    """The bytes from a place to the end of its line."""
    f.seek(place)
    parts = []
    while chunk := f.read(1 << 16):
        at = chunk.find(b"\n")
        if at >= 0:
            parts.append(chunk[: at + 1])
            break
        parts.append(chunk)
    return b"".join(parts)


def _bounds(group) -> tuple[dict, dict]:
    low, high = {}, {}
    for i in range(group.num_columns):
        column = group.column(i)
        if column.path_in_schema in ARROW.names and column.is_stats_set and column.statistics.has_min_max:
            low[column.path_in_schema], high[column.path_in_schema] = column.statistics.min, column.statistics.max
    return low, high


def _as_log(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The log's columns and kinds; what a file lacks is null."""
    out = []
    for name, kind in zip(ARROW.names, ARROW.types, strict=True):
        i = batch.schema.get_field_index(name)
        column = pa.nulls(batch.num_rows, kind) if i < 0 else batch.column(i)
        if pa.types.is_timestamp(kind) and pa.types.is_integer(column.type):
            column = column.cast(pa.int64())  # as ORC files hold a time without a zone
        elif pa.types.is_timestamp(kind) and not pa.types.is_timestamp(column.type):
            column = pc.cast(pc.replace_substring(pc.cast(column, pa.string()), "Z", ""), kind)
        elif pa.types.is_timestamp(column.type) and column.type.tz is not None:
            column = column.cast(pa.timestamp("us", "UTC")).cast(pa.int64())
        out.append(column.cast(kind))
    return pa.RecordBatch.from_arrays(out, schema=ARROW)


class BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.log = LogReader(options)

    def partitions(self) -> Sequence[InputPartition]:
        return self.log.pieces(p for _, p in files(self.log.path, self.log.kind))

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        return self.log.rows(partition) if partition is not None else iter(())


class FilteringReader(BatchReader):
    """Takes over comparisons of one plain column; the rest is left to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in (*COMPARED, In, IsNotNull, IsNull) and len(f.attribute) == 1 and f.attribute[0] in ARROW.names:
                self.log.kept.tests.append((type(f), f.attribute[0], getattr(f, "value", None)))
            else:
                yield f


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.log = LogReader(options)

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(files(self.log.path, self.log.kind), default=(-1, ""))
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return self.log.pieces(p for t, p in files(self.log.path, self.log.kind) if after < (t, p) <= upto)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.log.rows(partition)

    def commit(self, end: dict) -> None:
        """The checkpoint knows; nothing is kept here."""


class AccessLog(DataSource):
    """Options: path, kind (csv, json, orc, parquet), pieceBytes, and pushFilters (true): for
    frames that are read once only, as Spark 4.1 keeps what was pushed with the frame, and
    two filters of one frame would both read what the last of them left."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (FilteringReader if options.get("pushfilters", "false").lower() == "true" else BatchReader)(options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(AccessLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # readers that take over filters need it
