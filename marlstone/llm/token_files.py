"""Token ids of documents in compressed files that give single documents back.

A folder holds one dictionary, the files, and a manifest. The zstandard dictionary is trained on
serialized id arrays of a bounded sample and shared by all files; every document is compressed by
itself with it, so that short ones, which alone have nothing to refer to, stay small and can be read
without their neighbours.

    dictionary-<sha256>.zdict     the trained dictionary
    ids-<part>-<attempt>.tok      frames, then the index, then the footer
    manifest.json                 what was committed: dictionary, files in order, ids before each

A frame is one document's ids, little-endian, 16 bits wide where the vocabulary allows it, else 32.
The index (compressed) has three arrays of 64-bit numbers: document ids, lengths of the frames, which
add up to their offsets, and numbers of tokens. The footer has a fixed length: the format's mark,
width, number of documents, number of leading ones without id, place of the index, tokens of the
file, and the dictionary's hash, which readers compare with the manifest's before they decode.

Writing is a data source's job with a commit: every task writes a file of its own name, and the
driver, which gets one message from each, lists the files of the attempts that ended in the
manifest, with the ids before each. A file of a lost attempt is in no manifest. Reading deals the
files over tasks. Files are opened through Arrow's file systems by the folder's URI, so all
executors see them.

Order: ascending id, rows without id first; rows of one id go by a hash of their text. Ranges are
dealt by these and by a running number behind them, so that one id may hold any number of rows.

Nulls: a null text is an empty document, which has the end id alone. Repeated ids are documents of
their own. An empty table gives a folder without documents. Other columns are ignored. One task
holds one document's ids at a time, and the index of its file.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from marlstone.llm.packing import Tokenizer
from marlstone.session import bound_batches, shared_dir

_FOOTER = struct.Struct("<8sIIQQQQ32s")
_MARK = b"TOKIDS01"
_ROW = "doc_id long, start long, n_tokens long, ids_crc32 long"


def file_system(folder: str):
    """Arrow's file system and the path in it of a folder's URI or plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _tokenizer_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    return path


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: Tokenizer) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, token ids) of each row of (id, text) batches, about half a megabyte of text at a time."""
    for b in batches:
        ids = b.column(0).to_pylist()
        at, texts, size = 0, [], 0
        for i, x in enumerate(b.column(1)):
            texts.append(x.as_py() or "")
            size += len(texts[-1])
            if size >= 1 << 19 or i == b.num_rows - 1:
                yield from zip(ids[at : i + 1], tokenizer.encode(texts), strict=True)
                at, texts, size = i + 1, [], 0


class _Committed(WriterCommitMessage):
    def __init__(self, part: int, name: str, docs: int, tokens: int, size: int) -> None:
        self.part, self.name, self.docs, self.tokens, self.size = part, name, docs, tokens, size


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import zstandard
        from pyspark import TaskContext

        files, folder = file_system(self.options["path"])
        with files.open_input_stream(f"{folder}/dictionary-{self.options['dictionary']}.zdict") as f:
            shared = zstandard.ZstdCompressionDict(f.read())
        level = int(self.options["level"])
        shared.precompute_compress(level=level)
        press = zstandard.ZstdCompressor(level=level, dict_data=shared, write_dict_id=False)  # the footer has its hash
        tokenizer = Tokenizer(_tokenizer_path(self.options.get("tokenizer")), int(self.options["end_id"]))
        width = 2 if max(tokenizer.whole.get_vocab_size() - 1, tokenizer.end_id) < 1 << 16 else 4
        part = TaskContext.get().partitionId()
        name = f"ids-{part:08d}-{uuid.uuid4().hex}.tok"
        known, sizes, counts, at, nulls = [], [], [], 0, 0
        out = None
        for doc, ids in _encoded(iterator, tokenizer):
            if out is None:  # a task without rows leaves no file
                out = files.open_output_stream(f"{folder}/{name}")
            frame = press.compress(ids.astype(f"<u{width}").tobytes())
            out.write(frame)
            nulls += doc is None
            known.append(0 if doc is None else doc)
            sizes.append(len(frame))
            counts.append(len(ids))
            at += len(frame)
        if out is None:
            return _Committed(part, "", 0, 0, 0)
        index = zstandard.ZstdCompressor().compress(b"".join(np.array(x, "<i8").tobytes() for x in (known, sizes, counts)))
        out.write(index)
        out.write(_FOOTER.pack(_MARK, width, nulls, len(known), at, len(index), sum(counts), bytes.fromhex(self.options["dictionary"])))
        out.close()
        return _Committed(part, name, len(known), sum(counts), at + len(index) + _FOOTER.size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        listed, docs, tokens = [], 0, 0
        for m in sorted((m for m in messages if m is not None and m.docs), key=lambda m: m.part):
            listed.append({"file": m.name, "docs": m.docs, "tokens": m.tokens, "bytes": m.size, "docs_before": docs, "tokens_before": tokens})
            docs, tokens = docs + m.docs, tokens + m.tokens
        files, folder = file_system(self.options["path"])
        with files.open_output_stream(f"{folder}/manifest.json") as f:
            f.write(json.dumps({"dictionary": self.options["dictionary"], "docs": docs, "tokens": tokens, "files": listed}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = file_system(self.options["path"])
        for m in messages:
            if m is not None and m.name:
                files.delete_file(f"{folder}/{m.name}")


class _Part(InputPartition):
    def __init__(self, name: str, size: int, tokens_before: int, dictionary: str) -> None:
        self.name, self.size, self.tokens_before, self.dictionary = name, size, tokens_before, dictionary


class TokenFile:
    """One opened file: its footer and index are read at once, frames when they are asked for."""

    def __init__(self, folder: str, name: str, dictionary: str, size: int) -> None:
        import zstandard

        files, root = file_system(folder)
        self.file = files.open_input_file(f"{root}/{name}")
        mark, width, self.nulls, docs, at, length, self.tokens, digest = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if mark != _MARK or digest.hex() != dictionary:
            raise ValueError(f"{name}: not a token file of the dictionary {dictionary}")
        with files.open_input_stream(f"{root}/dictionary-{dictionary}.zdict") as f:
            raw = f.read()
        if hashlib.sha256(raw).hexdigest() != dictionary:
            raise ValueError(f"the dictionary {dictionary} has other content")
        self.type = f"<u{width}"
        self.unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        index = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file.read_at(length, at)), "<i8")
        self.ids, sizes, self.counts = index.reshape(3, docs)
        self.places = np.concatenate(([0], np.cumsum(sizes)))

    def document(self, n: int) -> np.ndarray:
        """The token ids of the n-th document."""
        at, to = int(self.places[n]), int(self.places[n + 1])
        return np.frombuffer(self.unpress.decompress(self.file.read_at(to - at, at)), self.type)

    def find(self, doc_id: int) -> list[int]:
        """The numbers of the documents of an id."""
        a, b = np.searchsorted(self.ids[self.nulls :], (doc_id, doc_id + 1)) + self.nulls
        return list(range(int(a), int(b)))

    def documents(self, most: int = 1 << 22) -> Iterator[np.ndarray]:
        """The token ids of all documents in their order, read some megabytes at a time."""
        n = 0
        while n < len(self.ids):
            to = max(n + 1, int(np.searchsorted(self.places, self.places[n] + most, "right")) - 1)
            base = int(self.places[n])
            raw = self.file.read_at(int(self.places[to]) - base, base)
            for i in range(n, to):
                yield np.frombuffer(self.unpress.decompress(raw[int(self.places[i]) - base : int(self.places[i + 1]) - base]), self.type)
            n = to


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.options, self.with_ids = options, "ids" in schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        dictionary, listed = _manifest(self.options["path"])
        return [_Part(f["file"], f["bytes"], f["tokens_before"], dictionary) for f in listed]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _Part):
            return
        opened = TokenFile(self.options["path"], partition.name, partition.dictionary, partition.size)
        starts = partition.tokens_before + np.cumsum(opened.counts) - opened.counts
        held: list[tuple] = []
        size = 0

        def out(n: int) -> pa.RecordBatch:
            rows = slice(n - len(held), n)
            valid = np.arange(rows.start, rows.stop) < opened.nulls
            columns = [pa.array(opened.ids[rows], pa.int64(), mask=valid), pa.array(starts[rows]), pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if self.with_ids:
                columns.append(pa.array([h[2] for h in held], pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        for n, ids in enumerate(opened.documents()):
            held.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int64) if self.with_ids else None))
            size += 1 + self.with_ids * len(ids)
            if size >= 1 << 16:
                yield out(n + 1)
                held.clear()
                size = 0
        if held:
            yield out(len(opened.ids))


class TokenIds(DataSource):
    """The data source ``token_ids``; options: path, and for writing dictionary, level, end_id, tokenizer."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return _ROW

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def _manifest(folder: str) -> tuple[str, list[dict]]:
    files, root = file_system(folder)
    with files.open_input_stream(f"{root}/manifest.json") as f:
        found = json.loads(f.read())
    return found["dictionary"], found["files"]


def train_dictionary(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 2000, sample_ids: int = 2048, dictionary_bytes: int = 64 << 10, end_id: int = 2) -> bytes:
    """A zstandard dictionary for id arrays, fitted on at most about ``sample_docs`` documents drawn by a hash of
    their text, of each of which a stretch of ``sample_ids`` ids at a drawn place is taken. Empty bytes, which
    compress without a dictionary, where the sample is too small to train on. It decides sizes, never content.
    """
    n = docs.count()
    drawn = F.pmod(F.xxhash64(text_col), F.lit(max(1, n // sample_docs))) == 0
    base = docs.where(F.col(text_col).isNotNull() & drawn).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).dropDuplicates(["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(_tokenizer_path(tokenizer_path), end_id)
        width = 2 if max(tokenizer.whole.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        taken = []
        for _, ids in _encoded(batches, tokenizer):
            at = zlib.crc32(ids.tobytes()) % max(1, len(ids) - sample_ids + 1)
            taken.append(ids[at : at + sample_ids].astype(f"<u{width}").tobytes())
            if len(taken) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(taken, pa.binary())], ["ids"])
                taken = []
        yield pa.RecordBatch.from_arrays([pa.array(taken, pa.binary())], ["ids"])

    # The draw is of texts, so its size is bounded in the mean only: the limit bounds what reaches the driver.
    samples = sorted(bytes(r[0]) for r in base.mapInArrow(run, "ids binary").limit(2 * sample_docs).toLocalIterator())
    import zstandard

    try:
        return zstandard.train_dictionary(dictionary_bytes, samples, k=200, d=8, level=3).as_bytes()
    except zstandard.ZstdError:  # too few samples for a dictionary
        return b""


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, level: int = 3, dictionary: bytes | None = None) -> None:
    """Write the ids of every document, each with ``end_id`` behind it, in ascending id order to a new folder."""
    spark = docs.sparkSession
    bound_batches(spark)
    spark.dataSource.register(TokenIds)
    if dictionary is None:
        dictionary = train_dictionary(docs, tokenizer_path, id_col, text_col, end_id=end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    files, root = file_system(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/dictionary-{digest}.zdict") as f:
        f.write(dictionary)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    ranged = base.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    options = {"dictionary": digest, "end_id": str(end_id), "level": str(level)} | ({"tokenizer": tokenizer_path} if tokenizer_path else {})
    ranged.write.format("token_ids").options(**options).mode("append").save(folder)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files; with
    ``with_ids`` also the ids."""
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").schema(_ROW + (", ids array<long>" if with_ids else "")).load(folder)


def lookup(folder: str, doc_id: int) -> list[np.ndarray]:
    """The token ids of one document (of each that has this id), read by footer, index and one frame a file."""
    dictionary, listed = _manifest(folder)
    found = []
    for f in listed:
        opened = TokenFile(folder, f["file"], dictionary, f["bytes"])
        found += [opened.document(n) for n in opened.find(doc_id)]
    return found


def new_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
