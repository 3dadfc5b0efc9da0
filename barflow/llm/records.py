"""Token ids as files of length-delimited binary records, with an index of offsets beside each file.

A file is ``HEAD`` (a mark, and the bytes of an id: 2 where the vocabulary allows, else 4) and records. A record is
the length of its payload (8 bytes), the masked crc32 of that length (4), the payload, and the masked crc32 of the
payload (4), all little-endian. A payload is one document: whether it has an id (1 byte), doc_id (8), the token
ids. The checksum of the length is looked at before the length is believed. Masking (rotate by 15 bits, add a constant) keeps a
checksum of data that holds checksums sound. The index file has, for each record, its offset in the file and the
ids before it (8 bytes each), then a closing entry with the file's end and all its ids, and the masked crc32 of all that.

Documents are written in ascending doc_id (NULL last, equal ones by a hash of the text, then the text): a range
partitioning, whose tasks each write one file after the other, none of much more than ``FILE_BYTES``. A file's name is new in each
attempt of a task, and files count only through the manifest, which Spark commits; what a lost executor left behind is
never read. The manifest has one row per file; the ids before a file are a running sum over it.

``read`` gives the documents in the order of the files, ``read_shuffled`` in an order drawn from a seed, for
which tasks look up offsets in the index and read single records. Both raise ``ValueError`` where a checksum fails.

Encoding is that of the tokenizers library without special tokens: their strings in a text are ordinary text. A blank between two
printable ASCII or Latin characters always begins a pre-token, so texts are cut there and a part that came before is looked
up; anything else stays in one part, up to the whole text. An end id closes each document.

NULL and empty texts are the end id alone. Texts are taken whole. Repeated rows are records of their own. An empty
table gives files of no records, or none. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.llm.common import shared_dir, slices, stage, table
from barflow.llm.registry import query

END = 2
#: Bytes after which a task begins another file.
FILE_BYTES = 64 << 20
#: Parts that a task remembers at most.
REMEMBERED = 900_000
# Fixed values of the format.
MARK = b"BFSEQ\x01\r\n"
HEAD = struct.Struct("<8sI")
LENGTH = struct.Struct("<Q")
CHECK = struct.Struct("<I")
OWNER = struct.Struct("<Bq")
ENTRY = np.dtype("<u8")
MASK = 0xA282EAD8

_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
_SAFE = frozenset(map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x250)]))
#: A blank that is not between two of them.
_UNSAFE = re.compile(r" (?:(?<![!-~À-ɏ] )|(?![!-~À-ɏ]))")



def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


class Encoder:
    """Ids of whole texts by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Letters behind a blank are one pre-token, so their bytes, as the library writes them, can go to the model at once.
        self.model = Tokenizer(self.tokenizer.model)
        self.written = {b: c for x in map(chr, range(0x250)) for b, c in zip(x.encode(), "".join(w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(x)))}
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.parts: dict[str, bytes] = {}

    def _raw(self, texts: list[str], tokenizer=None) -> list[bytes]:
        found = [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]
        return [struct.pack(f"<{len(ids)}{self.code}", *ids) for ids in found]

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The text cut before each blank that stands between two safe characters; pieces after the first lack that blank."""
        parts = text.split(" ")
        if not _UNSAFE.search(text):
            return parts
        out = parts[:1]
        for p in parts[1:]:
            if p and p[0] in _SAFE and out[-1] and out[-1][-1] in _SAFE:
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian numbers of ``width`` bytes."""
        cut = [self.pieces(t) for t in texts]
        new = list(set().union(*[parts[1:] for parts in cut]).difference(self.parts))
        letters = [p for p in new if _LATIN.fullmatch(p)]
        self.parts.update(zip(letters, self._raw([f" {p}".encode().decode("latin-1").translate(self.written) for p in letters], self.model)))
        others = [p for p in new if p not in self.parts]
        self.parts.update(zip(others, self._raw([" " + p for p in others])))
        first = self._raw([parts[0] for parts in cut])
        out = [b"".join([head, *map(self.parts.__getitem__, parts[1:])]) for head, parts in zip(first, cut)]
        if len(self.parts) > REMEMBERED:  # full: what came first, the common ones among it, stays
            for part in new:
                del self.parts[part]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def frame(payload: bytes) -> bytes:
    length = LENGTH.pack(len(payload))
    return b"".join((length, CHECK.pack(masked(length)), payload, CHECK.pack(masked(payload))))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at ``at`` and where the next one begins."""
    body = at + LENGTH.size + CHECK.size
    if body > len(data) or masked(bytes(data[at : at + LENGTH.size])) != CHECK.unpack_from(data, at + LENGTH.size)[0]:
        raise ValueError(f"broken length of the record at {at}")
    (size,) = LENGTH.unpack_from(data, at)
    if body + size + CHECK.size > len(data) or masked(data[body : body + size]) != CHECK.unpack_from(data, body + size)[0]:
        raise ValueError(f"broken record at {at}")
    return data[body : body + size], body + size + CHECK.size


class _Writer:
    """One record file and its index."""

    def __init__(self, folder: str, width: int):
        self.path = f"{folder}/{uuid.uuid4().hex}.rec"
        self.fs, self.name = _files(self.path)
        self.out = self.fs.open_output_stream(self.name)
        self.at, self.ids, self.width, self.entries = 0, 0, width, []
        self._put(HEAD.pack(MARK, width))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.entries += (self.at, self.ids)
        self._put(frame(OWNER.pack(doc_id is not None, doc_id or 0) + ids))
        self.ids += len(ids) // self.width

    def close(self) -> dict:
        self.out.close()
        index = np.array([*self.entries, self.at, self.ids], ENTRY).tobytes()
        with self.fs.open_output_stream(self.name + ".idx") as out:
            out.write(index + CHECK.pack(masked(index)))
        return {"path": self.path, "n_docs": len(self.entries) // 2, "n_ids": self.ids, "n_bytes": self.at}


MANIFEST = "part long, file long, path string, n_docs long, n_ids long, n_bytes long"


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, end: int = END, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all documents in ascending doc_id; the manifest: part, file, path, n_docs, n_ids, n_bytes and start (ids in earlier files)."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    folder = folder or f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = folder.removeprefix("file:")
    fs, name = _files(folder)
    fs.create_dir(name, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, rows = encoder(path), None, []
        closing = struct.pack(f"<{encode.code}", end)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi in slices(batch.column(1)):
                texts = [t or "" for t in batch.column(1)[lo:hi].to_pylist()]
                for doc_id, tokens in zip(ids[lo:hi], encode.encode(texts)):
                    writer = writer or _Writer(folder, encode.width)
                    writer.add(doc_id, tokens + closing)
                    if writer.at >= file_bytes:
                        rows.append(writer.close())
                        writer = None
        if writer:
            rows.append(writer.close())
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([{"part": part, "file": i, **r} for i, r in enumerate(rows)], schema=_schema())

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("mark").asc()]
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    files = stage(dealt.select("doc_id", "text").mapInArrow(run, MANIFEST))
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return stage(files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")))


def _schema() -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def read_index(path: str) -> np.ndarray:
    """Rows (offset, ids before) of a file's records, and the closing one."""
    fs, name = _files(path + ".idx")
    with fs.open_input_stream(name) as f:
        data = f.read()
    if len(data) < CHECK.size or masked(data[: -CHECK.size]) != CHECK.unpack(data[-CHECK.size :])[0]:
        raise ValueError(f"broken index of {path}")
    return np.frombuffer(data[: -CHECK.size], ENTRY).astype(np.int64).reshape(-1, 2)


def _width(head: bytes) -> int:
    mark, width = HEAD.unpack(head)
    if mark != MARK:
        raise ValueError("no file of records")
    return width


def _open(path: str) -> tuple[pa.NativeFile, int]:
    fs, name = _files(path)
    f = fs.open_input_file(name)
    return f, _width(f.read_at(HEAD.size, 0))


def _document(payload: memoryview, width: int) -> tuple[int | None, np.ndarray]:
    has, doc_id = OWNER.unpack_from(payload)
    return (doc_id if has else None), np.frombuffer(payload[OWNER.size :], f"<u{width}").astype("<u4")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_ids, starts, ids = zip(*rows) if rows else ((), (), ())
    offsets = np.cumsum([0, *map(len, ids)])
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)))
    crcs = [zlib.crc32(x.tobytes()) for x in ids]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(crcs, pa.int64()), lists.cast(pa.list_(pa.int32()))],
        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"
#: Documents and ids in a batch read back.
_ROWS, _IDS = 4096, 1 << 20


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if len(held) >= _ROWS or size >= _IDS:
            yield _batch(held)
            held, size = [], 0
    yield _batch(held)


def _read_file(path: str, start: int) -> Iterator[tuple]:
    index = read_index(path)
    fs, name = _files(path)
    with fs.open_input_stream(name) as f:
        width = _width(f.read(HEAD.size))
        for (at, before), (to, _) in zip(index[:-1], index[1:]):
            payload, after = unframe(memoryview(f.read(to - at)), 0)
            if after != to - at:
                raise ValueError(f"{path}: the record at {at} does not end where the index says")
            doc_id, ids = _document(payload, width)
            yield doc_id, start + int(before), ids


def read(manifest: DataFrame) -> DataFrame:
    """All documents of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _batches(_read_file(path, start))

    files = max(1, manifest.count())
    return manifest.select("path", "start").repartition(files).mapInArrow(run, SCHEMA)


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """As ``read``, in an order that ``seed`` draws: single records by their offsets, ordered by ``turn`` within and across tasks."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                index = read_index(path)
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * (len(index) - 1), pa.string()), pa.array(index[:-1, 0]), pa.array(np.diff(index[:, 0])), pa.array(start + index[:-1, 1])],
                    names=["path", "at", "size", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, tuple] = {}

        def record(path: str, at: int, size: int, start: int) -> tuple:
            if path not in opened:
                if len(opened) >= 64:
                    opened.pop(next(iter(opened)))[0].close()
                opened[path] = _open(path)
            f, width = opened[path]
            doc_id, ids = _document(unframe(memoryview(f.read_at(size, at)), 0)[0], width)
            return doc_id, start, ids

        for batch in batches:
            turns = batch.column(4).to_pylist()
            done = 0
            for out in _batches(record(*r) for r in zip(*[batch.column(i).to_pylist() for i in range(4)])):
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(turns[done : done + len(out)], pa.int64())], names=[*out.schema.names, "turn"])
                done += len(out)

    files = max(1, manifest.count())
    index = manifest.select("path", "start").repartition(files).mapInArrow(entries, "path string, at long, size long, start long")
    turned = index.withColumn("turn", F.xxhash64(F.lit(seed), F.col("start")))
    return turned.repartitionByRange("turn", "start").sortWithinPartitions("turn", "start").mapInArrow(run, SCHEMA + ", turn long")


@query("op13_records")
def op13_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the files."""
    return read(write(table(spark, sf_dir))).select("doc_id", "start", "n_tokens", "ids_crc32")
