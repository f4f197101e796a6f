"""Token ids in ORC files: run-length coded integers, row indexes and Bloom filters on document ids.

Files hold documents in ascending order of doc_id: parts by ranges, each sorted. A null doc_id comes
first; rows of one doc_id stand by a hash of their text; null and empty texts are the end id alone;
texts of any length are one row. Readers take stripes in any order and in parallel, as each row
holds its place within its part. An empty table gives no rows. Only doc_id and text are
read, so further columns cannot clash.
"""
import os
import uuid
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from .bpe import loaded
from .common import shared_dir, sums_before
from .packing import Words

SCHEMA = "part long, at long, doc_id long, n_tokens long, ids array<int>"
_ARROW = pa.schema([("part", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32())))])
#: Ids of one batch on its way to a file.
BATCH = 1 << 21


def token_rows(docs, path, end):
    """Rows of SCHEMA from sorted parts of docs(doc_id, text): `at` counts the ids of the part before."""
    def batch(part, at, rows):
        sizes = np.array([len(r) // 4 for _, r in rows], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(r for _, r in rows), "<i4"))).cast(_ARROW.field("ids").type)
        columns = [pa.array(np.full(len(rows), part)), pa.array(at + np.cumsum(sizes) - sizes), pa.array([d for d, _ in rows], pa.int64()), pa.array(sizes), ids]
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW), at + int(sizes.sum())

    def run(batches):
        words, part, at, held, size = loaded(Words, path), TaskContext.get().partitionId(), 0, [], 0
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                held.append((d, words.encode(t.as_py() or "") + tail))
                size += len(held[-1][1]) // 4
                if size > BATCH:
                    out, at = batch(part, at, held)
                    held, size = [], 0
                    yield out
        if held:
            yield batch(part, at, held)[0]

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write(docs, target, path=None, end=2, stripe=64 << 20, stride=10_000, wrong=0.01):
    """Token ids of docs(doc_id, text) as ORC files in `target`; one pass, texts are shuffled once.

    `stripe` bytes make a stripe, `stride` rows an index entry with the range and the Bloom filter
    (false positives: `wrong`) of its doc_ids. Copies of an id are dealt out by text and row.
    """
    by = ["doc_id", "tie", "nth"]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("nth"))
    rows = token_rows(d.repartitionByRange(*by).sortWithinPartitions(*by), path or P.path("word_bpe_49k.json"), end)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": wrong, "orc.stripe.size": stripe, "orc.row.index.stride": stride, "orc.create.index": "true"}
    rows.write.options(**options).orc(target)
    return target


def table(spark, target):
    return spark.read.schema(SCHEMA).orc(target)


def lookup(spark, target, doc_ids):
    """The rows of some documents: the filter reaches the files, whose footers, indexes and Bloom filters rule out
    stripes and row groups unread."""
    return table(spark, target).where(F.col("doc_id").isin(*doc_ids))


def starts(spark, target):
    """part, before: the ids in all parts before; reads two narrow columns of the files."""
    totals = table(spark, target).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums_before(totals, "part", "n").select("part", "before")


def digests(spark, target):
    """doc_id, start, n_tokens, ids_crc32 of each row of the files, `start` over all documents."""
    schema = pa.schema([("part", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            ids = b.column(3)
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            at = ids.offsets.to_numpy().astype(np.int64) * 4
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(at) // 4), pa.array(crc, pa.int64())], schema=schema)

    rows = table(spark, target).select("part", "at", "doc_id", "ids").mapInArrow(run, "part long, at long, doc_id long, n_tokens long, ids_crc32 long")
    return rows.join(starts(spark, target), "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(docs, path=None, end=2):
    """Writes the files into the shared folder and reads them back."""
    spark = docs.sparkSession
    return digests(spark, write(docs, os.path.join(shared_dir(spark), f"drydock-ids-{uuid.uuid4().hex}"), path, end))
