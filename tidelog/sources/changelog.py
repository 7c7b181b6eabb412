"""The change log as a Spark data source: format("tidelog"), batch with pushed-down filters and streaming by files as they land."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

#: Bytes of a file read by one task.
SPLIT_BYTES = 128 << 20


@dataclass
class Piece(InputPartition):
    """The row groups of a file whose middle lies in part ``k`` of ``n`` of it."""

    path: str
    k: int = 0
    n: int = 1

    def __post_init__(self):
        super().__init__((self.path, self.k, self.n))


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of the parquet files of a folder, at any depth, or of those a pattern names. Only names are listed: no file is opened."""
    fs, p = file_system(path)
    plain = p.split("*")[0].split("?")[0]
    info = fs.get_file_info(p) if plain == p else None
    if info is not None and info.type == pafs.FileType.File:
        return [(p, info.size)]
    root = p if plain == p else plain.rsplit("/", 1)[0]
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
    shown = (f for f in found if f.type == pafs.FileType.File and not any(x.startswith(("_", ".")) for x in f.path[len(root) :].split("/")))
    return sorted((f.path, f.size) for f in shown if (fnmatch(f.path, p) if plain != p else f.path.endswith(".parquet")))


def pieces(files: list[tuple[str, int]]) -> list[Piece]:
    return [Piece(f, k, n) for f, size in files for n in (max(1, -(-size // SPLIT_BYTES)),) for k in range(n)]


_TESTS = {GreaterThan: lambda c, v: c > v, GreaterThanOrEqual: lambda c, v: c >= v, LessThan: lambda c, v: c < v, LessThanOrEqual: lambda c, v: c <= v, EqualTo: lambda c, v: c == v}


class LogReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.position, self.schema = options["path"], options.get("position", "log_offset"), schema
        start, end = options.get("startingoffset"), options.get("endingoffset")
        self.low, self.high = int(start) if start else None, int(end) if end else None
        self.filters: list = []

    def pushFilters(self, filters):  # noqa: N802
        """Comparisons of a plain column are evaluated at the scan; ranges of the position also pass over whole row groups."""
        for f in filters:
            if len(f.attribute) == 1 and (type(f) in _TESTS or isinstance(f, In)) and f.attribute[0] in self.schema.fieldNames():
                self.filters.append(f)
                if f.attribute[0] == self.position and type(f) in _TESTS:
                    if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                        self.low = max(f.value, self.low) if self.low is not None else f.value
                    if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                        self.high = min(f.value, self.high) if self.high is not None else f.value
            else:
                yield f

    def partitions(self):
        return pieces(files_of(self.path)) or [Piece("")]

    def groups(self, meta: pq.FileMetaData, piece: Piece) -> list[int]:
        """The row groups of a piece that may hold positions asked for, by the file's footer, which only the task reads."""
        names = [meta.schema.column(i).path for i in range(meta.num_columns)]
        at = names.index(self.position) if self.position in names else None
        sizes = [meta.row_group(g).total_byte_size for g in range(meta.num_row_groups)]
        total, begin, out = max(1, sum(sizes)), 0, []
        for g, size in enumerate(sizes):
            mine = min(piece.n - 1, (begin + size // 2) * piece.n // total) == piece.k
            begin += size
            stats = meta.row_group(g).column(at).statistics if at is not None else None
            known = stats is not None and stats.has_min_max
            if mine and not (known and ((self.low is not None and stats.max < self.low) or (self.high is not None and stats.min > self.high))):
                out.append(g)
        return out

    def _filter(self):
        column = pc.field(self.position)
        tests = ([column >= self.low] if self.low is not None else []) + ([column <= self.high] if self.high is not None else [])
        for f in self.filters:
            own = pc.field(f.attribute[0])
            tests.append(own.isin(list(f.value)) if isinstance(f, In) else _TESTS[type(f)](own, f.value))
        out = None
        for t in tests:
            out = t if out is None else out & t
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = file_system(self.path)
        with fs.open_input_file(partition.path) as f:
            groups = self.groups(pq.read_metadata(f), partition)
        if not groups:
            return
        fragment = ds.ParquetFileFormat().make_fragment(partition.path, fs).subset(row_group_ids=groups)
        wanted = to_arrow_schema(self.schema)
        for batch in fragment.scanner(columns=wanted.names, filter=self._filter()).to_batches():
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(n).cast(wanted.field(n).type) for n in wanted.names], schema=wanted)


class LogStream(DataSourceStreamReader):
    """Follows a growing log by the files that land: each batch is the files not seen before, so a message that lands late, below positions already
    read, is read like any other. Files never change once they have landed. The offset names the files seen."""

    def __init__(self, options, schema):
        self.options, self.schema, self.path = options, schema, options["path"]

    def initialOffset(self):  # noqa: N802
        return {"files": []}

    def latestOffset(self):  # noqa: N802
        return {"files": [f for f, _ in files_of(self.path)]}

    def partitions(self, start, end):
        seen, wanted = set(start["files"]), set(end["files"])
        return pieces([(f, size) for f, size in files_of(self.path) if f in wanted and f not in seen])

    def read(self, partition: Piece):
        yield from LogReader(self.options, self.schema).read(partition)

    def commit(self, end):
        """Nothing to release: files stay."""


class ChangeLog(DataSource):
    """Options: path (a parquet file, folder or pattern, or a URI of one, that all workers see), position (the ordering column), startingOffset and endingOffset (inclusive)."""

    @classmethod
    def name(cls) -> str:
        return "tidelog"

    def schema(self):
        files = files_of(self.options["path"])
        if not files:
            raise FileNotFoundError(self.options["path"])
        with file_system(self.options["path"])[0].open_input_file(files[0][0]) as f:
            return from_arrow_schema(pq.read_schema(f))

    def reader(self, schema):
        return LogReader(self.options, schema)

    def streamReader(self, schema):  # noqa: N802
        return LogStream(self.options, schema)


#: Other sources by name; each is a DataSource class.
PLUGINS: dict[str, type[DataSource]] = {"tidelog": ChangeLog}


def register(spark: SparkSession, *more: type[DataSource]) -> None:
    """Make the sources known to a session: those here and any given."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (*PLUGINS.values(), *more):
        spark.dataSource.register(source)


