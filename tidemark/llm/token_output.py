"""Binary token-id output: one zstandard frame per document under a shared dictionary.

A dataset folder holds

* ``dictionary/``: the shared dictionary, trained on the serialised id arrays of
  a bounded sample (``DICT_DOCS`` documents of at most ``DICT_DOC_CHARS``
  characters, ``DICT_BYTES`` bytes of dictionary);
* ``shards/``: one file per shard. A shard is ``MAGIC``, the SHA-256 of the
  dictionary, the header numbers, the index (doc_id, validity, first token,
  token count, frame offset) and the frames, one for each document.

Shards are cut at ``shard_bytes`` of frames and follow ascending doc_id, which
their headers tell: :func:`read_document` searches the headers by halves and
reads one shard's index and the document's frame, by ranges of bytes. Ids that
do not fit in ``id_width`` bytes are refused.

Null texts count as empty and hold the end id alone; null doc_ids come first
and stay null; repeated doc_ids keep all their rows, ordered by text; an empty
table gives a dataset without shards. Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, remove, staged, work_path
from .tokens import encoder

MAGIC = b"TMTOK02\n"
HEAD = struct.Struct("<8s32sIIqqqqqq")  # magic, dictionary hash, id width, documents, partition, number in it, tokens, frame bytes, rows without an id, last id
SHARD_BYTES = 8 << 20
DICT_DOCS = 800
DICT_DOC_CHARS = 65_536
DICT_BYTES = 64 << 10
LEVEL = 1


def id_dtype(width: int) -> str:
    return {2: "<u2", 4: "<u4"}[width]


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, width: int) -> bytes:
    """Dictionary from a hash-chosen sample; empty where the sample is too small to train on."""
    import zstandard

    n = docs.count()
    if not n:
        return b""
    share = min(1.0, DICT_DOCS / n)
    sample = (
        docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("dictionary")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
        .filter(F.length("text") <= DICT_DOC_CHARS)
        .select("text")
        .limit(2 * DICT_DOCS)
        .collect()
    )
    enc = encoder(tokenizer_path, "byte")
    arrays = [np.append(np.frombuffer(enc.encode(r.text), "<u4"), end_id).astype(id_dtype(width)).tobytes() for r in sample]
    if sum(map(len, arrays)) < 8 * DICT_BYTES or len(arrays) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def _shard(part: int, number: int, width: int, digest: bytes, rows: list[tuple]) -> bytes:
    ids = np.array([r[0] or 0 for r in rows], "<i8")
    valid = np.array([r[0] is not None for r in rows], "u1")
    count = np.array([r[1] for r in rows], "<i8")
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype("<i8")
    offset = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype("<i8")
    head = HEAD.pack(MAGIC, digest, width, len(rows), part, number, int(count.sum()), int(offset[-1]), int((valid == 0).sum()), int(ids[-1]))
    return b"".join([head, ids.tobytes(), valid.tobytes(), first.tobytes(), count.tobytes(), offset.tobytes(), *(r[2] for r in rows)])


class Shard:
    """A shard's bytes: its index at once, its documents one by one."""

    def __init__(self, blob: bytes):
        magic, self.digest, self.width, n, self.part, self.number, self.tokens, self.frame_bytes, _, _ = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size
        take = lambda kind, k, at: (np.frombuffer(blob, kind, k, at), at + np.dtype(kind).itemsize * k)
        self.doc_id, at = take("<i8", n, at)
        self.valid, at = take("u1", n, at)
        self.first, at = take("<i8", n, at)
        self.count, at = take("<i8", n, at)
        self.offset, at = take("<i8", n + 1, at)
        self.frames = memoryview(blob)[at : at + self.frame_bytes]

    def __len__(self) -> int:
        return len(self.doc_id)

    def frame(self, i: int) -> bytes:
        return bytes(self.frames[self.offset[i] : self.offset[i + 1]])


def decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_width: int = 2, shard_bytes: int = SHARD_BYTES
) -> None:
    """Encode ``docs(doc_id, text)`` and write the dataset folder ``path``."""
    import zstandard

    spark = docs.sparkSession
    arrow_rows(spark)
    ids = max(encoder(tokenizer_path, "byte").size, end_id + 1)
    if ids > 1 << 8 * id_width:
        raise ValueError(f"ids up to {ids - 1} do not fit in {id_width} bytes")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dictionary = train_dictionary(docs, tokenizer_path, end_id, id_width)
    digest = hashlib.sha256(dictionary).digest()
    kind = id_dtype(id_width)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, rows = TaskContext.get().partitionId(), 0, 0, []
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=True)
        enc = encoder(tokenizer_path, "byte")

        def out():
            return pa.RecordBatch.from_arrays([pa.array([_shard(part, number, id_width, digest, rows)], pa.binary())], ["value"])

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1).to_pylist())):
                ids = np.append(found, end_id).astype(kind)
                frame = press.compress(ids.tobytes())
                rows.append((doc_id, len(ids), frame))
                held += len(frame)
                if held >= shard_bytes:
                    yield out()
                    number, held, rows = number + 1, 0, []
        if rows:
            yield out()

    shards = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, "value binary")
    write_blobs(shards, f"{path}/shards")
    write_blobs(spark.createDataFrame([(bytearray(dictionary),)], "value binary").coalesce(1), f"{path}/dictionary")


def write_blobs(blobs: DataFrame, path: str) -> None:
    """One file for each binary ``value``. The text writer copies a string's bytes as they are, to every store that Spark
    reaches; compression and line end are stated, so no setting of the session alters the files."""
    rows = blobs.select(F.col("value").cast("string"))
    rows.write.option("maxRecordsPerFile", 1).option("compression", "none").option("lineSep", "\n").text(path)


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    files = spark.read.format("binaryFile").load(f"{path}/dictionary/part-*").select("content").collect()
    return b"".join(bytes(r.content) for r in files)[:-1]  # less the line end that the text writer adds


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a dataset: doc_id, part, number, first (in the shard), n_tokens, ids_crc32 (and ``ids``)."""
    dictionary = read_dictionary(spark, path)
    digest = hashlib.sha256(dictionary).digest()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = decompressor(dictionary)
        for batch in batches:
            for blob in batch.column(0):
                shard = Shard(blob.as_py())
                if shard.digest != digest:
                    raise ValueError("the shard was written with another dictionary")
                ids = [np.frombuffer(opened.decompress(shard.frame(i)), id_dtype(shard.width)).astype("<u4") for i in range(len(shard))]
                for i, x in enumerate(ids):
                    if len(x) != shard.count[i]:
                        raise ValueError("a frame and the index disagree")
                n = len(shard)
                columns = [
                    pa.array(shard.doc_id, pa.int64(), mask=shard.valid == 0),
                    pa.array(np.full(n, shard.part), pa.int64()),
                    pa.array(np.full(n, shard.number), pa.int64()),
                    pa.array(shard.first, pa.int64()),
                    pa.array(shard.count, pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                ]
                names = ["doc_id", "part", "number", "first", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, part long, number long, first long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    return files.select("content").mapInArrow(decode, schema)


class Ranges:
    """Byte ranges of files in any store that Spark reaches, read by the driver."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def files(self, path: str) -> list[str]:
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return sorted(str(f.getPath()) for f in at.getFileSystem(self.conf).listStatus(at) if f.getPath().getName().startswith("part-"))

    def read(self, file: str, start: int, length: int) -> bytes:
        at = self.jvm.org.apache.hadoop.fs.Path(file)
        stream = at.getFileSystem(self.conf).open(at)
        try:
            stream.seek(start)
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
        finally:
            stream.close()


def _order(file: str) -> tuple[int, int]:
    """Partition and number of a shard, from its file's name."""
    name = file.rsplit("/", 1)[-1]
    return int(name.split("-")[1]), int(name.split("-c")[-1].split(".")[0])


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (of each row with this id): a search of headers, one index and the frames asked for are read."""
    ranges = Ranges(spark)
    dictionary = read_dictionary(spark, path)
    opened, digest = decompressor(dictionary), hashlib.sha256(dictionary).digest()
    files = sorted(ranges.files(f"{path}/shards"), key=_order)
    head = lambda k: HEAD.unpack(ranges.read(files[k], 0, HEAD.size))

    def ends_before(k: int) -> bool:  # a shard of rows without an id alone comes before all others
        h = head(k)
        return h[8] == h[3] or h[9] < doc_id

    low, high = 0, len(files)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if ends_before(middle) else (low, middle)
    found: list[list[int]] = []
    for k in range(low, len(files)):
        _, own, width, n, *_ = head(k)
        if own != digest:
            raise ValueError("the shard was written with another dictionary")
        index = ranges.read(files[k], HEAD.size, 33 * n + 8)
        ids, valid = np.frombuffer(index, "<i8", n), np.frombuffer(index, "u1", n, 8 * n)
        offset = np.frombuffer(index, "<i8", n + 1, 25 * n)
        if not (valid[-1] and ids[-1] >= doc_id):
            break
        for i in np.flatnonzero((ids == doc_id) & (valid == 1)):
            frame = ranges.read(files[k], HEAD.size + 33 * n + 8 + int(offset[i]), int(offset[i + 1] - offset[i]))
            found.append(np.frombuffer(opened.decompress(frame), id_dtype(width)).tolist())
        if ids[-1] > doc_id:
            break
    return found


def with_starts(tokens: DataFrame) -> DataFrame:
    """Add ``start``: ids of all documents before, from shard totals summed within and over partitions.

    Only one total per writing partition reaches the driver.
    """
    spark = tokens.sparkSession
    shards = tokens.groupBy("part", "number").agg(F.sum("n_tokens").alias("shard_tokens"))
    order = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    within = shards.withColumn("within", F.coalesce(F.sum("shard_tokens").over(order), F.lit(0)))
    bases, total = [], 0
    for part, n in sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("shard_tokens").alias("n")).collect()):
        bases.append((part, total))
        total += n
    base = spark.createDataFrame(bases, "part long, base long")
    place = within.join(F.broadcast(base), "part").select("part", "number", (F.col("base") + F.col("within")).alias("shard_start"))
    return tokens.join(place, ["part", "number"]).withColumn("start", F.col("shard_start") + F.col("first"))


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` in the file format, read the files back and describe each document."""
    spark = docs.sparkSession
    path = work_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    back = staged(read_tokens(spark, path), "token-index")
    remove(spark, path)
    return with_starts(back).select("doc_id", "start", "n_tokens", "ids_crc32")
