"""Files of folders: scans with paths told from their root, and a sink that writes one file per row.

Reading lists folders by jobs, a level of the tree each, and keeps what was found as a table of names in shared storage; its parts, so many files each, are
the splits of a scan.  The driver holds no names, however many files there are.  Contents are a column that is read where it is used, so scans of names alone read none.
Writing is a data source of two steps.  A task writes its files under temporary names beside their places and gives them their
names when all are whole, so a task that fails or is lost leaves no partial file and may run again; a file of the same name is replaced.  A marker
with the numbers of files and bytes ends a job.  Any store that Arrow's file systems reach can be written and read so; of others Spark's own file source
reads, which lists names in the driver.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .tables import FILES

MARKER = "_SUCCESS"
#: Folders that a task lists, and bytes of files that it reads, about; bytes of contents that are held at once, but for a single file.
FOLDERS, BYTES, HELD = 500, 128 << 20, 8 << 20
LISTED = "path string, folder boolean, length long, time long"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, as the file source tells it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def below(path: Column, root: str) -> Column:
    """The part of a path below a qualified root; null for one that isn't."""
    return F.when(F.startswith(path, F.lit(root + "/")), F.substring(path, len(root) + 2, 1 << 30))


def scan_files(spark: SparkSession, root: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """``path`` (below the root), ``length``, ``modificationTime`` and ``content`` of the files under a root as it is now; hidden and empty ones are
    passed over, as Spark's source does.

    ``pattern``: a glob on names.
    """
    top = qualified(spark, root)
    made = scratch(spark)
    try:
        for place in (top, made):
            _system(place)
    except (pa.ArrowInvalid, OSError):
        return _spark_files(spark, top, pattern, recursive)
    found = listed(spark, top, made, recursive).where("NOT folder AND length > 0")
    if pattern:
        glob = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
        found = found.where(F.substring_index("path", "/", -1).rlike(rf"\A(?:{glob})\z"))
    n, size = found.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(min(n, spark.sparkContext.defaultParallelism), -(-n // FILES), -(-size // BYTES), 1)
    found.select("path", "length", "time").repartition(tasks).write.parquet(f"{made}/files")
    spark.dataSource.register(FileNames)
    names = spark.read.format("quill_names").option("table", f"{made}/files").load()
    return names.select("path", "length", F.timestamp_micros("time").alias("modificationTime"), _contents(top)("path").alias("content"))


def _spark_files(spark: SparkSession, top: str, pattern: str | None, recursive: bool) -> DataFrame:
    """The same by Spark's file source."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    # a root is no pattern: its own special characters are taken as they are
    files = reader.load("".join("\\" + c if c in "*?[]{}\\," else c for c in top))
    return files.select(below(F.col("path"), top).alias("path"), "length", "modificationTime", "content").where("path IS NOT NULL")


def listed(spark: SparkSession, top: str, made: str, recursive: bool) -> DataFrame:
    """``path, folder, length, time`` (in microseconds) of all that lies under a root, a job for each level of its tree, written below ``made``."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(top)
        rows: list[tuple] = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for row in _entries(system, base, folder):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    level, levels, n = spark.createDataFrame([("",)], "path string"), [], 1
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while n and (recursive or not levels):
        levels.append(f"{made}/level{len(levels)}")
        level.repartition(max(1, min(most, -(-n // FOLDERS))), "path").mapInArrow(look, LISTED).write.parquet(levels[-1])
        level = spark.read.schema(LISTED).parquet(levels[-1]).where("folder").select("path")
        n = level.count()
    return spark.read.schema(LISTED).parquet(*levels)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "folder", "length", "time"])


def _hidden(name: str, folder: bool) -> bool:
    """As Spark's file source has it."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not (folder and name.startswith(("_metadata", "_common_metadata"))))


def _entries(system, base: str, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """Path below ``base``, whether a folder, length and time of what lies in a folder of it."""
    from pyarrow import fs

    place, head = (f"{base}/{folder}", f"{folder}/") if folder else (base, "")
    if isinstance(system, fs.LocalFileSystem):  # one by one, however many there are
        with os.scandir(place) as entries:
            for e in entries:
                try:
                    told = None if _hidden(e.name, e.is_dir()) else e.stat()
                except FileNotFoundError:  # gone meanwhile, or a link to nothing
                    continue
                if told is not None:
                    yield head + e.name, e.is_dir(), told.st_size, told.st_mtime_ns // 1000
        return
    for e in system.get_file_info(fs.FileSelector(place)):
        deep = e.type == fs.FileType.Directory
        if not _hidden(e.base_name, deep):
            yield head + e.base_name, deep, e.size or 0, (e.mtime_ns or 0) // 1000


def _contents(top: str):
    """A column of the contents of files by their paths below a root, in batches bounded by bytes."""

    @F.arrow_udf("binary")
    def contents(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        system, base = _system(top)
        for batch in batches:
            held, size = [], 0
            for path in batch.to_pylist():
                with system.open_input_file(f"{base}/{path}") as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= HELD:
                    yield pa.array(held, pa.binary())
                    held, size = [], 0
            if held:
                yield pa.array(held, pa.binary())

    return contents


class NamesReader(DataSourceReader):
    def __init__(self, table: str) -> None:
        self.table = table

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, base = _system(self.table)
        return [InputPartition(f.path) for f in system.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(".parquet")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        with _system(self.table)[0].open_input_file(partition.value) as f:
            yield from parquet.ParquetFile(f).iter_batches(columns=["path", "length", "time"])


class FileNames(DataSource):
    """A table of names, a split for each of its parts.  Unlike a Parquet scan it claims no small size, from which contents beside it would be taken as small and broadcast."""

    @classmethod
    def name(cls) -> str:
        return "quill_names"

    def schema(self) -> str:
        return "path string, length long, time long"

    def reader(self, schema) -> NamesReader:
        return NamesReader(self.options["table"])


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, removed when the session's JVM ends: in ``spark.checkpoint.dir``, or for a local master a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="quillspark-files-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/quill-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def _system(root: str):
    from pyarrow import fs

    if "://" not in root:
        root = "file://" + root.removeprefix("file:")
    scheme, _, rest = root.partition("://")
    if scheme == "file":  # a path is no URI: its own special characters are taken as they are
        return fs.LocalFileSystem(), rest
    return fs.FileSystem.from_uri(root)


def checked(path: str) -> str:
    parts = path.split("/")
    if not path or path.endswith("/") or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a path below a folder: {path!r}")
    return path


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class FileWriter(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, rows: Iterator) -> Written:
        system, root = _system(self.root)
        waiting: list[tuple[str, str]] = []
        size, made = 0, set()
        try:
            for row in rows:
                if row["data"] is None:
                    continue
                place = f"{root}/{checked(row['path'])}"
                folder, _, name = place.rpartition("/")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                held = f"{folder}/.{name[:80]}.{uuid.uuid4().hex}"
                waiting.append((held, place))
                with system.open_output_stream(held) as out:
                    out.write(bytes(row["data"]))
                size += len(row["data"])
            n = len(waiting)
            while waiting:
                held, place = waiting[-1]
                try:
                    system.move(held, place)
                except OSError:  # stores that don't replace
                    system.delete_file(place)
                    system.move(held, place)
                waiting.pop()
        except BaseException:
            for held, _ in waiting:
                try:
                    system.delete_file(held)
                except OSError:
                    pass
            raise
        return Written(n, size)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.root)
        system.create_dir(root, recursive=True)
        told = [m for m in messages if m is not None]
        with system.open_output_stream(f"{root}/{MARKER}") as out:
            out.write(json.dumps({"files": sum(m.files for m in told), "bytes": sum(m.bytes for m in told)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Tasks have removed what they hadn't finished; whole files stay for the next run to replace."""


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quill_files"

    def schema(self) -> str:
        return "path string, data binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["root"])


def write_files(files: DataFrame, root: str) -> None:
    """Write ``files(path, data)`` below a root; of rows with one path one is written, null data is none."""
    spark = files.sparkSession
    spark.dataSource.register(FileSink)
    one = files.select("path", F.col("data").cast("binary").alias("data")).dropDuplicates(["path"])
    one.write.format("quill_files").option("root", qualified(spark, root)).mode("append").save()
