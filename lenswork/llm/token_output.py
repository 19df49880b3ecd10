"""Token-id output in patched frame-of-reference blocks.

File format (`.pfor`): blocks of up to BLOCK ids, one after the other. A block is a header
(count u32, minimum u32, width u8, exceptions u32), the differences to the minimum packed at
`width` bits (little-endian bit order), then the positions (u32) and whole differences (u32)
of the exceptions, i.e. of those that need more bits. The width is that of the PERCENTILE-th
percentile of the differences. The sidecar (`.idx`, an Arrow file) has the blocks' byte offsets
and first ids in its schema's metadata, and a row (doc_id, start, n_tokens) for each document.

Rows: null texts count as empty; each row is a document of its own, null ids come first and
equal ids stand in the order of their texts. An empty table gives no files and no rows. Very long texts span blocks.
Only doc_id and text are read; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, fresh_path, load, shuffle_partitions, stored
from .tokens import encoder, in_groups

BLOCK, PERCENTILE = 8192, 95
HEADER = np.dtype([("count", "<u4"), ("minimum", "<u4"), ("width", "u1"), ("exceptions", "<u4")])


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min()) if len(ids) else 0
    diff = (ids.astype(np.int64) - low).astype(np.uint32)
    rank = min(len(diff) - 1, int(np.ceil(len(diff) * percentile / 100)) - 1) if len(diff) else 0
    width = int(np.partition(diff, rank)[rank]).bit_length() if len(diff) else 0
    odd = np.flatnonzero(diff >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    kept = diff & np.uint32((1 << width) - 1)
    bits = ((kept[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    head = np.array([(len(ids), low, width, len(odd))], HEADER)
    return head.tobytes() + np.packbits(bits, bitorder="little").tobytes() + odd.astype("<u4").tobytes() + diff[odd].astype("<u4").tobytes()


def block_bytes(head: np.void) -> int:
    return HEADER.itemsize + (int(head["count"]) * int(head["width"]) + 7) // 8 + 8 * int(head["exceptions"])


def unpack_block(data: bytes) -> np.ndarray:
    head = np.frombuffer(data, HEADER, 1)[0]
    n, width, odd = int(head["count"]), int(head["width"]), int(head["exceptions"])
    at = HEADER.itemsize
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    diff = np.zeros(n, np.uint32)
    for b in range(width):
        diff |= bits[:, b].astype(np.uint32) << np.uint32(b)
    where = np.frombuffer(data, "<u4", odd, at + size)
    diff[where] = np.frombuffer(data, "<u4", odd, at + size + 4 * odd)
    return (diff.astype(np.int64) + int(head["minimum"])).astype("<u4")


class BlockWriter:
    def __init__(self, out):
        self.out, self.ids, self.held, self.at, self.offsets, self.written = out, [], 0, 0, [], 0

    def add(self, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, stop, BLOCK):
            block = pack_block(ids[i : i + BLOCK])
            self.offsets.append((self.at, self.written))
            self.out.write(block)
            self.at += len(block)
            self.written += len(ids[i : i + BLOCK])
        self.ids, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        self.out.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, leading_space: bool = True, partitions: int | None = None) -> DataFrame:
    """Write docs' ids in ascending doc_id order; one row (part, path, n_ids) for each file written.

    Spark deals the texts out by ranges of doc_id (it samples the ids), each task streams one
    range into one file. A repeated task writes a file of its own; the returned manifest, kept in
    the shared folder, names only the files of the tasks that counted.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")

    def write(batches):
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer_path, leading_space).encode
        end = np.array([end_id], np.uint32)
        writer, ids, starts, counts, at = None, [], [], [], 0
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if texts and writer is None:
                fs.create_dir(root, recursive=True)
                writer = BlockWriter(fs.open_output_stream(f"{root}/{name}.pfor"))
            ids += batch.column(0).to_pylist()
            for lo, hi in in_groups(texts):
                for raw in encode(texts[lo:hi]):
                    n = len(raw) // 4 + 1
                    writer.add(np.frombuffer(raw, "<u4"))
                    writer.add(end)
                    starts.append(at)
                    counts.append(n)
                    at += n
        if writer is not None:
            writer.close()
            table = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
            table = table.replace_schema_metadata({"blocks": json.dumps(writer.offsets)})
            with fs.open_output_stream(f"{root}/{name}.idx") as out, pa.ipc.new_file(out, table.schema) as sink:
                sink.write_table(table)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": pa.array([f"{folder}/{name}"]), "n_ids": pa.array([at], pa.int64())})

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = dealt.repartitionByRange(partitions or shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(dealt.mapInArrow(write, "part int, path string, n_ids long"), "token-manifest")


def read_blocks(fs, path: str):
    """The ids of a file, block by block, each found by the index."""
    with fs.open_input_file(path + ".idx") as f:
        index = pa.ipc.open_file(f).read_all()
    blocks = json.loads(index.schema.metadata[b"blocks"])

    def ids():
        with fs.open_input_file(path + ".pfor") as f:
            for at, _ in blocks:
                f.seek(at)
                head = f.read(HEADER.itemsize)
                yield unpack_block(head + f.read(block_bytes(np.frombuffer(head, HEADER, 1)[0]) - len(head)))

    return index, ids()


def read_range(path: str, start: int, count: int) -> np.ndarray:
    """Ids start to start+count of one file, by seeking to the blocks that hold them."""
    fs, p = filesystem(path)
    with fs.open_input_file(p + ".idx") as f:
        blocks = json.loads(pa.ipc.open_file(f).schema.metadata[b"blocks"])
    found = []
    with fs.open_input_file(p + ".pfor") as f:
        for k, (at, first) in enumerate(blocks):
            if first < start + count and (k + 1 == len(blocks) or blocks[k + 1][1] > start):
                f.seek(at)
                head = f.read(HEADER.itemsize)
                ids = unpack_block(head + f.read(block_bytes(np.frombuffer(head, HEADER, 1)[0]) - len(head)))
                found.append(ids[max(0, start - first) : start + count - first])
    return np.concatenate(found) if found else np.zeros(0, "<u4")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    The manifest has a row per write partition, so its running sum is one small task.
    """
    spark = manifest.sparkSession
    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches):
        for batch in batches:
            for part, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, p = filesystem(path)
                index, blocks = read_blocks(fs, p)
                held, crcs = np.zeros(0, "<u4"), []
                for n in index.column("n_tokens").to_numpy():
                    crc, need = 0, int(n)
                    while need:
                        if not len(held):
                            held = next(blocks)
                        crc = zlib.crc32(held[:need].tobytes(), crc)
                        need, held = need - min(need, len(held)), held[need:]
                    crcs.append(crc)
                out = pa.table({"part": pa.array([part] * len(index), pa.int32()), "doc_id": index["doc_id"], "start": index["start"], "n_tokens": index["n_tokens"], "ids_crc32": pa.array(crcs, pa.int64())})
                yield from out.to_batches()

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per write partition
    bases = manifest.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    docs = manifest.select("part", "path").repartition(shuffle_partitions(spark)).mapInArrow(read, schema)
    return docs.join(F.broadcast(bases), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_token_files(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(manifest)
