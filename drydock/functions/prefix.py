"""Running sums in one order over a whole table, groups of any size included."""
from pyspark.sql import functions as F, Window as W

from .storage import cut


def running_sums(df, by, order, value):
    """df with `before`: the sum of `value` (a long) over the earlier rows of the same `by`, by `order`.

    Rows are dealt by ranges of (by, order), so a group may lie over many partitions; each sums along
    its rows, and what a group has in partitions before is a sum over partitions, not over rows. Nulls come
    first and are equal to each other. df should be narrow: it is shuffled and written once.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType([*df.schema.fields]).add("_part", "long").add("_lo", "long").add("_first", "boolean")
    arrow = to_arrow_schema(kind)

    def run(batches):
        part, key, total, ordinal = TaskContext.get().partitionId(), None, 0, -1
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            groups = [b.column(c) for c in by]
            for c in groups:
                code = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            new[0] = key != [c[0].as_py() for c in groups]
            w = b.column(value).fill_null(0).to_numpy(zero_copy_only=False)
            done, seg = np.cumsum(w) - w, np.cumsum(new)
            lo = done - np.concatenate([[-total], done[new]])[seg]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(w), part)), pa.array(lo), pa.array(ordinal + seg == 0)], schema=arrow)
            key, total, ordinal = [c[-1].as_py() for c in groups], int(lo[-1] + w[-1]), ordinal + int(seg[-1])

    sorting = [*by, *order]
    t = cut(df.repartitionByRange(*sorting).sortWithinPartitions(*sorting).mapInArrow(run, kind))
    each = t.groupBy("_part", *by).agg(F.sum(value).alias("_n"), F.bool_or("_first").alias("_is"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ahead = each.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_is").select(F.col("_part").alias("_p"), "_ahead")
    with_first = t.join(ahead, (F.col("_part") == F.col("_p")) & F.col("_first"), "left")
    return with_first.select(*df.columns, (F.col("_lo") + F.coalesce("_ahead", F.lit(0))).cast("long").alias("before"))
