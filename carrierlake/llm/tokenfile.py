"""Token ids in binary files: one shared zstandard dictionary, one frame per document, and an offset index.

A file set under ``path`` has two Spark-written tables. ``dictionary``: (dict_hash, dictionary), one row. ``blocks``: one row per block of
consecutive documents in ascending doc_id: part and block (their order), dict_hash, width (bytes per id), first_id and last_id (Parquet's
statistics skip blocks by them), doc_ids, n_tokens, offsets (the index into the payload) and payload (the frames one after the other). A frame is the little-endian id array of one document, so a
single short document is read with one block row, one offset and one small decompression. Blocks are rows, so Spark's committer makes
a lost executor's work safe to repeat, and column pruning reads the index without the payload.
"""

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from carrierlake.session import cut_lineage, delete_at_exit, discard, scratch_folder

from .common import documents, hashed_sample, query
from .tokens import default_vocabulary, encoder, slices

END_ID = 1
#: Documents that train the dictionary (those of the smallest text hash), its bytes, and the zstandard level.
SAMPLE = 500
DICTIONARY_BYTES = 65_536
LEVEL = 3
#: A block closes at so many payload bytes or documents.
BLOCK_BYTES = 4 << 20
BLOCK_DOCS = 8192


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary over the serialized id arrays of a bounded sample; empty where zstandard cannot train one (too little data)."""
    texts = hashed_sample(docs.where(F.length("text") > 0).select("text"), sample)
    arrays = []
    for batch in encoded(texts.withColumn("doc_id", F.lit(0).cast("bigint")), vocabulary, end_id, b"", plain=True).select("frame").toArrow().to_batches():
        for frame in batch.column(0).to_pylist():
            arrays += [frame[i : i + 4096] for i in range(0, len(frame), 4096)]
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes() if arrays else b""
    except zstandard.ZstdError:
        return b""


def encoded(docs: DataFrame, vocabulary: str, end_id: int, dictionary: bytes, plain: bool = False) -> DataFrame:
    """(doc_id, n_tokens, width, frame): each document's ids with the end id, compressed apart (or as they are)."""

    def frames(batches):
        tokens = encoder(vocabulary)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = (lambda x: x) if plain else zstandard.ZstdCompressor(level=LEVEL, dict_data=shared).compress
        for batch in batches:
            for part in slices(batch):
                ends, ids = tokens.encode(part.column("text"), end_id)
                begins = np.concatenate([[0], ends[:-1]])
                packed = [compress(ids[a:b].tobytes()) for a, b in zip(begins, ends)]
                n = len(ends)
                columns = [part.column("doc_id"), pa.array(ends - begins), pa.array(np.full(n, ids.itemsize, np.int32)), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "width", "frame"])

    return docs.select("doc_id", "text").mapInArrow(frames, "doc_id bigint, n_tokens bigint, width int, frame binary")


BLOCK_TYPE = (
    "part int, block int, dict_hash string, width int, first_id bigint, last_id bigint, doc_ids array<bigint>, n_tokens array<bigint>, offsets array<bigint>, payload binary"
)


def blocks(rows: DataFrame, dict_hash: str) -> DataFrame:
    """Rows in order, gathered into blocks; a task holds one block at a time."""

    def gather(batches):
        part, block, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            offsets = np.concatenate([[0], np.cumsum([len(r[3]) for r in held])]).tolist()
            known = [r[0] for r in held if r[0] is not None]
            values = [part, block, dict_hash, held[0][2], min(known, default=None), max(known, default=None), [r[0] for r in held], [r[1] for r in held], offsets, b"".join(r[3] for r in held)]
            types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            names = [c.split()[0] for c in BLOCK_TYPE.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                held.append(row)
                size += len(row[3])
                if size >= BLOCK_BYTES or len(held) >= BLOCK_DOCS:
                    yield close()
                    block, held, size = block + 1, [], 0
        if held:
            yield close()

    return rows.select("doc_id", "n_tokens", "width", "frame").mapInArrow(gather, BLOCK_TYPE)


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, sample: int = SAMPLE) -> str:
    """Encode ``docs`` (doc_id, text) into a file set at ``path``; returns the dictionary's SHA-256.

    Null text counts as empty (the end id alone). Rows with equal doc_id stay apart, in the order of their frames; null doc_id comes
    first. An empty table gives a file set without blocks. The encoded frames are written once, then put in order by ranges of doc_id.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    dictionary = train_dictionary(docs, vocabulary, end_id, sample)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, dictionary)], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    rows = cut_lineage(encoded(docs, vocabulary, end_id, dictionary))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "frame")
    blocks(ordered, dict_hash).write.parquet(f"{path}/blocks")
    discard(rows)
    return dict_hash


def block_starts(table: DataFrame) -> DataFrame:
    """(part, block, block_start): ids before each block; windows over blocks of a part, and over the parts' totals."""
    tokens = F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    sums = table.select("part", "block", tokens.alias("tokens"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("tokens")
    parts = sums.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = parts.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
    return sums.select("part", "block", inside.alias("inside")).join(before, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("block_start"))


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files, or ids_crc32 (of the ids as unsigned 32-bit) in place of ids."""
    dictionary = spark.read.parquet(f"{path}/dictionary").first()
    table = spark.read.schema(BLOCK_TYPE).parquet(f"{path}/blocks")
    data, name = dictionary.dictionary, dictionary.dict_hash

    def frames(batches):
        shared = zstandard.ZstdCompressionDict(bytes(data)) if data else None
        decompress = zstandard.ZstdDecompressor(dict_data=shared).decompress
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_hash"] != name:
                    raise ValueError("a block was written with another dictionary")
                offsets, payload = row["offsets"], memoryview(row["payload"])
                kind = np.uint16 if row["width"] == 2 else np.uint32
                ids = [np.frombuffer(decompress(payload[a:b]), kind).astype("<u4").tobytes() for a, b in zip(offsets, offsets[1:])]
                n, counts = len(ids), np.array([len(x) // 4 for x in ids], np.int64)
                last = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if digest else pa.array(ids, pa.binary())
                columns = [pa.array(np.full(n, row[k], np.int32)) for k in ("part", "block")]
                columns += [pa.array(row["doc_ids"], pa.int64()), pa.array(np.cumsum(counts) - counts), pa.array(counts), last]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32" if digest else "ids"])

    kind = "ids_crc32 bigint" if digest else "ids binary"
    rows = table.mapInArrow(frames, f"part int, block int, doc_id bigint, inside bigint, n_tokens bigint, {kind}")
    placed = rows.join(block_starts(table), ["part", "block"])
    return placed.select("doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32" if digest else "ids")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of one document (one list per row that has this id): its block's index finds the frame, nothing else is decompressed."""
    dictionary = spark.read.parquet(f"{path}/dictionary").first().dictionary
    table = spark.read.schema(BLOCK_TYPE).parquet(f"{path}/blocks")
    at: Column = F.explode(F.filter(F.sequence(F.lit(1), F.size("doc_ids")), lambda i: F.get("doc_ids", i - 1) == doc_id))
    near = table.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    found = near.where(F.array_contains("doc_ids", F.lit(doc_id).cast("bigint"))).withColumn("at", at)
    begin, end = F.get("offsets", F.col("at") - 1), F.get("offsets", F.col("at"))
    frame = F.substring("payload", (begin + 1).cast("int"), (end - begin).cast("int"))
    shared = zstandard.ZstdCompressionDict(bytes(dictionary)) if dictionary else None
    reader = zstandard.ZstdDecompressor(dict_data=shared)
    rows = found.select("width", frame.alias("frame")).collect()  # the rows of one id
    return [np.frombuffer(reader.decompress(bytes(r.frame)), np.uint16 if r.width == 2 else np.uint32).tolist() for r in rows]


@query("op7_tokenfile")
def op7(spark, folder):
    path = f"{scratch_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_token_files(documents(spark, folder), path)
    delete_at_exit(spark, path)
    return read_token_files(spark, path, digest=True)
