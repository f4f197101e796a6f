"""Shared helpers: shared-folder tables, safe column names, Arrow batches."""
import gc
import os
import re
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Window as W, functions as F

#: White_Space of Unicode, which the tokenizer libraries use for \s (fixed values).
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def shared_dir(spark):
    """The cluster's checkpoint folder; a folder of our own only in local mode, where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (path or "file:///tmp/checkpoints").rstrip("/")


def written(df, name):
    """Cut lineage: write df as a table in the shared folder and read it again."""
    path = os.path.join(shared_dir(df.sparkSession), f"drydock-{name}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.parquet(path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()  # shuffle files of what is no longer referred to can go
    return df.sparkSession.read.schema(schema).parquet(path)


def free_name(name, df):
    """name, lengthened until no column of df bears it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def mapped(df, func, schema):
    """mapInArrow where func turns one batch's column lists into a dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        for b in batches:
            out = func(*(b.column(i).to_pylist() for i in range(b.num_columns)))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def sums_before(totals, at, value, by=(), block=1024):
    """totals with `before`: the sum of `value` over rows of the same `by` whose `at` (long, from 0) is smaller.

    Two levels: sums within blocks of `block` places, then over the blocks. No window sorts more than
    `block` rows of a key, or one row for each of its blocks, and nothing is broadcast.
    """
    t = totals.withColumn("_block", F.floor(F.col(at) / block))
    ahead = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    blocks = t.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    blocks = blocks.select(*[F.col(c).alias(f"_{c}") for c in (*by, "_block")], ahead(W.partitionBy(*by).orderBy("_block"), "_sum").alias("_ahead"))
    within = t.withColumn("_within", ahead(W.partitionBy(*by, "_block").orderBy(at), value))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "_block")])
    return within.join(blocks.hint("shuffle_hash"), same).select(*totals.columns, (F.col("_within") + F.col("_ahead")).alias("before"))


#: Names of the files that Spark writes: the number of the task, and of the file where a task writes several.
PART = re.compile(r"^part-(\d+)-[^.]*-c(\d+)\..*parquet$")


def numbered(df, name):
    """df with a row number that no later reading changes: (number, row of the file) in one long, exact.

    Of files that Spark wrote the number is in their names and the place in a file is known to its reader, so
    nothing moves when executors come and go; any other table is written once with a number.
    """
    plain = df._jdf.queryExecution().analyzed().children().isEmpty()  # a reading of files and nothing else
    names = [os.path.basename(f) for f in df.inputFiles()] if plain else []
    keys = {(int(m[1]), int(m[2])) for m in map(PART.match, names) if m}
    if names and len(keys) == len(names) and max(keys)[0] < 2**20 and max(c for _, c in keys) < 2**7:
        got = lambda k: F.regexp_extract("_metadata.file_name", PART.pattern, k).cast("long")
        return df.select("*", (F.shiftleft(got(1), 43) + F.shiftleft(got(2), 36) + F.col("_metadata.row_index")).alias(name))
    return written(df.withColumn(name, F.monotonically_increasing_id()), "rows")
