"""Files and members of ZIP archives as a data source, in batch and in streams.

``document_files`` lists a folder and deals what it finds over tasks: plain files and small archives by
whole files of about ``partition_bytes``, an archive above that by ranges of its members, which its
directory tells without reading them. A task opens an archive where it lies and reads one member after
the other, so no row and no task ever holds an archive. A stream takes files as they come, by their time
of change, and does not read a file again.

Rows: path, archive (null for a plain file), name, extension, size, modified, content and error. Members
of a directory's kind, hidden ones and those of ``__MACOSX`` are left out, as are endings that are not in
``extensions`` (given as "md,txt"; "*" takes all). A file that cannot be opened, a broken archive or member and a file above
``max_bytes`` give a row with its error and without content.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

# Endings that are taken as documents.
SUPPORTED = "pdf docx doc html htm txt csv json png jpg jpeg md".split()
_DDL = "path string, archive string, name string, extension string, size long, modified timestamp, content binary, error string"
_SCHEMA = pa.schema([("path", pa.string()), ("archive", pa.string()), ("name", pa.string()), ("extension", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", tz="UTC")), ("content", pa.binary()), ("error", pa.string())])
_BATCH = 8 << 20


def file_system(folder: str):
    """Arrow's file system and the path in it, of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


@dataclass
class _File:
    path: str
    size: int
    modified: int  # nanoseconds
    members: tuple[int, int] | None = None  # a range of an archive's members


class _Part(InputPartition):
    def __init__(self, files: list[_File]) -> None:
        self.files = files


def _listed(folder: str) -> list[_File]:
    """Visible files below a folder, or the file itself, in the order of their paths."""
    from pyarrow import fs

    files, root = file_system(folder)
    info = files.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
    below = len(root.rstrip("/"))
    visible = lambda p: not any(s.startswith((".", "_")) for s in p[below:].split("/"))
    return sorted((_File(i.path, i.size, i.mtime_ns or 0) for i in found if i.type == fs.FileType.File and (i is info or visible(i.path))), key=lambda f: f.path)


def _parts(folder: str, found: list[_File], most: int) -> list[InputPartition]:
    """Files of up to ``most`` bytes together; larger archives by ranges of members."""
    files, _ = file_system(folder)
    parts: list[InputPartition] = []
    held, size = [], 0
    for f in found:
        if f.size > most and f.path.lower().endswith(".zip"):
            try:
                with files.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:
                    sizes = [m.compress_size for m in z.infolist()]
            except (zipfile.BadZipFile, OSError, ValueError):
                parts.append(_Part([f]))  # the task tells what is wrong with it
                continue
            at = total = 0
            for i, s in enumerate(sizes):
                if total and total + s > most:
                    parts.append(_Part([_File(f.path, f.size, f.modified, (at, i))]))
                    at, total = i, 0
                total += s
            parts.append(_Part([_File(f.path, f.size, f.modified, (at, len(sizes)))]))
            continue
        if held and size + f.size > most:
            parts.append(_Part(held))
            held, size = [], 0
        held.append(f)
        size += f.size
    return [*parts, _Part(held)] if held else parts


def _ending(path: str) -> str:
    name = path.rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def _rows(folder: str, part: _Part, extensions: frozenset[str] | None, most: int) -> Iterator[tuple]:
    files, _ = file_system(folder)
    taken = lambda p: extensions is None or _ending(p) in extensions
    row = lambda path, archive, f, size, content, error: (path, archive, path.rpartition("/")[2].rpartition("!")[2], _ending(path), size, f.modified // 1000, content, error)
    for f in part.files:
        if not f.path.lower().endswith(".zip"):
            if not taken(f.path):
                continue
            if f.size > most:
                yield row(f.path, None, f, f.size, None, f"more than {most} bytes")
                continue
            try:
                with files.open_input_stream(f.path) as raw:
                    yield row(f.path, None, f, f.size, raw.read(), None)
            except OSError as e:
                yield row(f.path, None, f, f.size, None, str(e)[:200])
            continue
        try:
            with files.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:
                members = z.infolist()
                a, b = f.members or (0, len(members))
                for m in members[a:b]:
                    n = m.filename
                    if m.is_dir() or "__MACOSX" in n or n.startswith(".") or "/." in n or not taken(n):
                        continue
                    if m.file_size > most:
                        yield row(f"{f.path}!{n}", f.path, f, m.file_size, None, f"more than {most} bytes")
                        continue
                    try:
                        yield row(f"{f.path}!{n}", f.path, f, m.file_size, z.read(m), None)
                    except (zipfile.BadZipFile, OSError, ValueError, RuntimeError, NotImplementedError, EOFError) as e:  # broken, locked, or of an unknown kind
                        yield row(f"{f.path}!{n}", f.path, f, m.file_size, None, str(e)[:200])
        except (zipfile.BadZipFile, OSError, ValueError) as e:
            yield row(f.path, f.path, f, f.size, None, str(e)[:200])


class _Options:
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        given = options.get("extensions", ",".join(SUPPORTED))
        self.extensions = None if given == "*" else frozenset(x.strip().lower() for x in given.split(",") if x.strip())
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.max_bytes = int(options.get("max_bytes", 256 << 20))

    def batches(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, _Part):
            return
        held, size = [], 0
        for r in _rows(self.folder, part, self.extensions, self.max_bytes):
            held.append(r)
            size += 1024 + len(r[6] or b"")
            if size >= _BATCH:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = _Options(options)

    def partitions(self) -> list[InputPartition]:
        return _parts(self.options.folder, _listed(self.options.folder), self.options.partition_bytes)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.options.batches(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are a time of change and the files of that very time that were seen."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = _Options(options)
        self.files_per_batch = int(options.get("files_per_batch", 1000))
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        return {"time": -1, "seen": []}

    @staticmethod
    def _after(f: _File, offset: dict) -> bool:
        return f.modified > offset["time"] or (f.modified == offset["time"] and f.path not in offset["seen"])

    def latestOffset(self) -> dict:
        start = self.last or self.initialOffset()
        new = sorted((f for f in _listed(self.options.folder) if self._after(f, start)), key=lambda f: (f.modified, f.path))[: self.files_per_batch]
        if new:
            time = new[-1].modified
            seen = [f.path for f in new if f.modified == time]
            self.last = {"time": time, "seen": sorted(seen + (start["seen"] if start["time"] == time else []))}
        return self.last or start

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = end  # after a restart the search goes on from here
        found = [f for f in _listed(self.options.folder) if self._after(f, start) and not self._after(f, end)]
        return _parts(self.options.folder, found, self.options.partition_bytes)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.options.batches(partition)

    def commit(self, end: dict) -> None:
        pass


class DocumentFiles(DataSource):
    """The data source ``document_files``."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return _DDL

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def read_documents(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """Files and archive members below ``folder``; options: extensions, partition_bytes, max_bytes."""
    spark.dataSource.register(DocumentFiles)
    return spark.read.format("document_files").options(**{k: str(v) for k, v in options.items()}).load(folder)


def stream_documents(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """The same as a stream of new files; also files_per_batch."""
    spark.dataSource.register(DocumentFiles)
    return spark.readStream.format("document_files").options(**{k: str(v) for k, v in options.items()}).load(folder)
