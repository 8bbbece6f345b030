"""Training-order materialisation of token ids as fixed-stride binary shards.

Texts become one stream of ids in each partition, cut into sequences of equal length. A keyed Feistel permutation over the least power
of four that holds all sequences, walked along its cycle until it falls inside, gives each sequence its global slot: any task computes it
by itself, and reading slots one after the other is reading in random order. Every shard, a range of slots, is then one partition, and
is written as one file of records of the same size, so slot s begins at byte (s mod shard) * stride of file s div shard and
reading may resume anywhere. Files are written under another name and renamed: a task that runs twice leaves the same file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import shared_dir, stage, tidy
from .sets import STEP, mix
from .tokens import chunk_ids, each_encoded

ROUNDS = 6


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 .. n - 1 for each key, at the given places."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, out, todo = np.uint64((1 << half) - 1), index.astype(np.uint64), np.arange(len(index))
    with np.errstate(over="ignore"):
        keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * STEP + np.uint64(key % (1 << 64)))
        while len(todo):
            left, right = out[todo] >> np.uint64(half), out[todo] & mask
            for k in keys:
                left, right = right, left ^ (mix(right + k) & mask)
            out[todo] = left << np.uint64(half) | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer: str, length: int, end_id: int, pad_id: int) -> DataFrame:
    """(part, seq, n_tokens, n_docs, first_doc_id, ids): each partition's ids, texts ended by end_id, cut at `length`; the last is filled with pad_id.

    ids: 16-bit little-endian, compressed. n_docs: texts that have ids here; first_doc_id: of the first one.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        ids_of, pack, part, seq = chunk_ids(tokenizer), zstandard.ZstdCompressor(3), TaskContext.get().partitionId(), 0
        if ids_of.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this tokenizer don't fit into 16 bits")
        parts: list[np.ndarray] = []
        begins: list[np.ndarray] = []  # of the texts in the ids held
        owners: list[int | None] = []
        held, out = 0, []
        names = ["part", "seq", "n_tokens", "n_docs", "first_doc_id", "ids"]

        def cut(last: bool):
            nonlocal parts, begins, owners, held, seq
            ids, n = np.concatenate(parts), -(-held // length) if last else held // length
            used = min(held, n * length)
            full = np.full(n * length, pad_id, "<u2")
            full[:used] = ids[:used]
            at, text_at = np.arange(n) * length, np.concatenate(begins)
            first = np.searchsorted(text_at, at, side="right") - 1
            n_docs = np.searchsorted(text_at, np.minimum(at + length, used), side="left") - first
            for i, row in enumerate(full.reshape(n, length)):
                out.append((part, seq + i, min(length, used - i * length), int(n_docs[i]), owners[first[i]], pack.compress(row.tobytes())))
            keep = max(0, int(np.searchsorted(text_at, used, side="right")) - 1)
            parts, begins, owners = [ids[used:]], [text_at[keep:] - used], owners[keep:]
            seq, held = seq + n, held - used

        def batch_of():
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.binary()], strict=True)], names)
            out.clear()
            return got

        for ids, at, rows in each_encoded(batches, ids_of, end_id):
            begins.append(held + at[:-1])
            owners += rows.column("doc_id").to_pylist()
            parts.append(ids)
            held += len(ids)
            if held >= 64 * length:
                cut(False)
                yield batch_of()
        if held:
            cut(True)
        if out:
            yield batch_of()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "part long, seq long, n_tokens long, n_docs long, first_doc_id long, ids binary")


def materialise(docs: DataFrame, tokenizer: str, out_dir: str | None = None, key: int = 20240229, length: int = 2048, shard: int = 2048, end_id: int = 49407, pad_id: int = 49407) -> DataFrame:
    """Write the shards and return slot, shard, byte_offset, n_tokens, n_docs, first_doc_id, ids_crc32 of every sequence; they are written as the result is read.

    Null and empty texts are end_id alone; equal rows are each in the stream; a null doc_id is carried along. An empty table writes nothing.
    docs must come in the same partitions if they are read twice only as far as a lost task needs it: the cut sequences are staged.
    """
    spark = docs.sparkSession
    rows = stage(sequences(docs, tokenizer, length, end_id, pad_id), "sequences")
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = stage(counts.select("part", "n", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")), "offsets")  # a row for each input partition
    total = before.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    target = out_dir or f"{shared_dir(spark)}/loomtide/shards-{uuid.uuid4().hex}"
    slot_of = F.pandas_udf(lambda i: __import__("pandas").Series(permuted(i.to_numpy(), total, key)), "long")
    placed = rows.join(F.broadcast(before), "part").withColumn("slot", slot_of(F.col("before") + F.col("seq"))).withColumn("shard", F.floor(F.col("slot") / shard))
    n_shards = max(1, -(-total // shard))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyarrow import fs

        unpack, file, now, name = zstandard.ZstdDecompressor(), None, None, ""
        system, root = fs.FileSystem.from_uri(target)
        system.create_dir(root, recursive=True)

        def done():
            file.close()
            system.move(f"{name}.{tag}", name)

        tag = uuid.uuid4().hex
        for b in batches:
            crc = []
            for s, data in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if s != now:
                    if file:
                        done()
                    now, name = s, shard_file(root, s)
                    file = system.open_output_stream(f"{name}.{tag}")
                raw = unpack.decompress(data)
                crc.append(zlib.crc32(raw))
                file.write(raw)
            names = ["slot", "shard", "n_tokens", "n_docs", "first_doc_id"]
            at = pa.array((b.column("slot").to_numpy() - b.column("shard").to_numpy() * shard) * length * 2, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), at, pa.array(crc, pa.int64())], [*names, "byte_offset", "ids_crc32"])
        if file:
            done()

    dealt = placed.select("slot", "shard", "n_tokens", "n_docs", "first_doc_id", "ids").repartitionById(n_shards, F.pmod("shard", F.lit(n_shards)).cast("int")).sortWithinPartitions("slot")
    return dealt.mapInArrow(tidy(run), "slot long, shard long, n_tokens long, n_docs long, first_doc_id long, byte_offset long, ids_crc32 long")


def shard_file(root: str, shard: int) -> str:
    return os.path.join(root, f"shard-{shard:08d}.bin")


def read_slots(target: str, first: int, n: int, length: int = 2048, shard: int = 2048) -> np.ndarray:
    """n sequences from slot `first` on, as far as there are any."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(target if "://" in target else f"file://{target}")
    out, stride = [], 2 * length
    while n > 0:
        s, i = divmod(first, shard)
        if system.get_file_info(shard_file(root, s)).type == fs.FileType.NotFound:
            break
        with system.open_input_file(shard_file(root, s)) as f:
            f.seek(i * stride)
            got = np.frombuffer(f.read(min(n, shard - i) * stride), "<u2").reshape(-1, length)
        if not len(got):
            break
        out.append(got)
        first, n = first + len(got), n - len(got)
    return np.concatenate(out) if out else np.zeros((0, length), "<u2")
