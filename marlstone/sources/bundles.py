"""Bundles: rows of (path, text) written as ZIP archives with a manifest, and checked against it.

Every task writes one archive of its own name, hashes each file on the way, and lists path, size and
SHA-256 in a part of the manifest beside it. What reaches the driver is one message a task: the commit
writes ``.okf/manifest.json`` with the parts, their totals and the hash of each list, and appends to the log. The manifest is put in place
by one rename, so a reader sees the old bundle or the new. After that the files of the bundle before go. A job
that fails leaves the folder's manifest as it was, or none.

Layout of a folder: ``part-<n>-<attempt>.zip``, ``.okf/files-<n>-<attempt>.jsonl``, ``.okf/manifest.json``,
``.okf/log.jsonl``. A null text is an empty file; rows without a path are left out; of rows of one path all are
written, and ``repeated_paths`` tells of them, as a bundle has each path once.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from marlstone.session import bound_batches
from marlstone.sources.archives import file_system, read_documents

FORMAT, VERSION = "Open Knowledge Format", "0.2.0"
_FILES = "path string, size long, sha256 string, archive string"


class _Written(WriterCommitMessage):
    def __init__(self, part: int, name: str, files: int, size: int, sha256: str) -> None:
        self.part, self.name, self.files, self.size, self.sha256 = part, name, files, size, sha256


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.root, self.level = options["path"], options.get("root", "bundle"), int(options.get("level", 6))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        files, folder = file_system(self.folder)
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        n = total = 0
        lines = hashlib.sha256()
        archive = listing = raw = None
        for b in iterator:
            for path, text in zip(b.column(0), b.column(1), strict=True):
                if archive is None:  # a task without rows leaves no file
                    raw = files.open_output_stream(f"{folder}/part-{name}.zip")
                    archive = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED, compresslevel=self.level)
                    listing = files.open_output_stream(f"{folder}/.okf/files-{name}.jsonl")
                content = (text.as_py() or "").encode()
                # A fixed time, so that the same rows give the same archive.
                archive.writestr(zipfile.ZipInfo(f"{self.root}/{path.as_py()}"), content, zipfile.ZIP_DEFLATED, self.level)
                line = json.dumps({"path": path.as_py(), "size": len(content), "sha256": hashlib.sha256(content).hexdigest(), "archive": f"part-{name}.zip"}) + "\n"
                listing.write(line.encode())
                lines.update(line.encode())
                n, total = n + 1, total + len(content)
        if archive is None:
            return _Written(part, "", 0, 0, "")
        archive.close()
        raw.close()
        listing.close()
        return _Written(part, name, n, total, lines.hexdigest())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = file_system(self.folder)
        before = _manifest(self.folder)
        parts = sorted((m for m in messages if m is not None and m.files), key=lambda m: m.part)
        now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        manifest = {
            "format": FORMAT, "version": VERSION, "root": self.root, "generated_at": now, "files": sum(m.files for m in parts), "bytes": sum(m.size for m in parts),
            "parts": [{"name": m.name, "files": m.files, "bytes": m.size, "listing_sha256": m.sha256} for m in parts],
        }
        with files.open_output_stream(f"{folder}/.okf/manifest.json.new") as f:
            f.write(json.dumps(manifest, indent=2).encode())
        log = _text(files, f"{folder}/.okf/log.jsonl")
        with files.open_output_stream(f"{folder}/.okf/log.jsonl") as f:
            f.write((log + json.dumps({"at": now, "event": "replaced" if before else "created", "files": manifest["files"], "bytes": manifest["bytes"], "parts": len(parts)}) + "\n").encode())
        files.move(f"{folder}/.okf/manifest.json.new", f"{folder}/.okf/manifest.json")
        _remove(self.folder, [p["name"] for p in (before or {"parts": []})["parts"]])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _remove(self.folder, [m.name for m in messages if m is not None and m.name])


def _text(files, path: str) -> str:
    try:
        with files.open_input_stream(path) as f:
            return f.read().decode()
    except FileNotFoundError:
        return ""


def _manifest(folder: str) -> dict | None:
    files, root = file_system(folder)
    text = _text(files, f"{root}/.okf/manifest.json")
    return json.loads(text) if text else None


def _remove(folder: str, names: list[str]) -> None:
    files, root = file_system(folder)
    for n in names:
        for path in (f"{root}/part-{n}.zip", f"{root}/.okf/files-{n}.jsonl"):
            try:
                files.delete_file(path)
            except FileNotFoundError:
                pass


class Bundle(DataSource):
    """The data source ``okf_bundle``, for writing."""

    @classmethod
    def name(cls) -> str:
        return "okf_bundle"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def write_bundle_files(rows: DataFrame, folder: str, path_col: str = "path", text_col: str = "text", root: str = "bundle") -> dict:
    """Write a bundle, in place of one that the folder holds; its manifest."""
    spark = rows.sparkSession
    bound_batches(spark)
    spark.dataSource.register(Bundle)
    files, place = file_system(folder)
    files.create_dir(f"{place}/.okf", recursive=True)
    base = rows.where(F.col(path_col).isNotNull()).select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    base.write.format("okf_bundle").option("root", root).mode("append").save(folder)
    return read_manifest(folder)


def read_manifest(folder: str) -> dict:
    """The committed manifest; an error where there is none."""
    found = _manifest(folder)
    if found is None:
        raise FileNotFoundError(f"{folder} holds no bundle")
    return found


def bundle_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256, archive) of every file that the manifest names."""
    parts = [f"{folder.rstrip('/')}/.okf/files-{p['name']}.jsonl" for p in read_manifest(folder)["parts"]]
    return spark.read.schema(_FILES).json(parts) if parts else spark.createDataFrame([], _FILES)


def bundle_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, archive, content, error) of every file of the committed bundle, from its archives."""
    found = read_manifest(folder)
    names = [f"part-{p['name']}.zip" for p in found["parts"]]
    read = read_documents(spark, folder, extensions="*").withColumn("archive", F.element_at(F.split("archive", "/"), -1))
    inside = F.expr(f"substring(path, instr(path, '!') + {len(found['root']) + 2})")
    return read.where(F.col("archive").isin(names)).select(inside.alias("path"), "archive", "content", "error")


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """(path, archive, state) of every file: ok, changed, missing from its archive, or unlisted."""
    want = bundle_listing(spark, folder).withColumn("copy", F.lit(1))
    got = bundle_files(spark, folder).select("path", "archive", F.sha2("content", 256).alias("found"))
    state = F.when(F.col("copy").isNull(), "unlisted").when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed").otherwise("ok")
    return want.join(got, ["path", "archive"], "full_outer").select("path", "archive", state.alias("state"))


def repeated_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(path, n) of paths that a bundle holds more than once."""
    return bundle_listing(spark, folder).groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
