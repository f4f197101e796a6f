"""Grouped ranking with ties: multiplicity compression, weighted prefix sums over ranges, sequences.

Equal tuples (group and order columns) become one tuple with a count, first in each batch before the
shuffle. Tuples are dealt by ranges of (group, order), so that a group of any size lies over as many
partitions as its tuples need, and each partition sums counts along its order. What a group has in
earlier partitions is a prefix sum over partitions. Nulls are values like any other, placed as the
order says and equal to each other; repeated rows are ranked one by one; an empty table gives
no rows; columns that are neither group nor order are not read, so they cannot clash.
"""
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import free_name, sums_before, written

#: A sequence that restores duplicates holds so many places at most; longer ones are dealt out in pieces.
CHUNK = 65_536
ROW, RUN, TOTAL = 0, 1, 2


def compressed(rows):
    """Equal rows of each batch as one, with their number `n`: what a hot tuple sends is a row for each batch."""
    kind = StructType([*rows.schema.fields]).add("n", "long")
    arrow = to_arrow_schema(kind)

    def run(batches):
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b]).group_by(b.schema.names, use_threads=False).aggregate([([], "count_all")])
                yield from t.select([*b.schema.names, "count_all"]).rename_columns(arrow.names).cast(arrow).to_batches()

    return rows.mapInArrow(run, kind)


def _codes(columns):
    """Numbers that are equal where rows of a batch are, nulls included, for each column."""
    return [pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in columns]


def _changes(columns, last):
    """Where a row differs from the one before it; the first row is held against the values `last`."""
    out = np.zeros(len(columns[0]), bool)
    for code in _codes(columns):
        out[1:] |= code[1:] != code[:-1]
    out[0] = last != [c[0].as_py() for c in columns]
    return out


def ranked_ranges(tuples, n_group, n_tie, at_most):
    """tuples(g0.., o0.., n) in ranges and sorted -> rows of three kinds, from one pass over each partition.

    ROW: a tuple with `lo`, the lines of its group before it in this partition (below `at_most`);
    RUN: lines of one tie, for the first `at_most` ties of a group in each partition (in parts);
    TOTAL: lines of the first and of the last group of a partition, the only ones that others share.
    `first` says that a row belongs to the first group of its partition.
    """
    kind = StructType().add("kind", "integer").add("pid", "long")
    for f in tuples.schema.fields:
        kind = kind.add(f.name, f.dataType)
    kind = kind.add("lo", "long").add("first", "boolean")
    arrow = to_arrow_schema(kind)

    def run(batches):
        pid = TaskContext.get().partitionId()
        group = tie = first = last = None
        total, first_total, ties, ordinal = 0, 0, 0, -1

        def made(kind_, b, at, n, lo, is_first):
            cols = [pa.array(np.full(len(at), v), t) for v, t in ((kind_, pa.int32()), (pid, pa.int64()))]
            cols += [b.column(i).take(pa.array(at)) for i in range(b.num_columns - 1)]
            return pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(is_first, pa.bool_())], schema=arrow)

        for b in batches:
            if not b.num_rows:
                continue
            cols, w = b.columns, b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            new = _changes(cols[:n_group], group)
            turn = new | _changes(cols[n_group:n_group + n_tie], tie)
            seg, done, turned = np.cumsum(new), np.cumsum(w) - w, np.cumsum(turn)
            starts = np.flatnonzero(new)
            at_start = lambda x, carried: np.concatenate([[carried], x[starts]])[seg]
            lo = done - at_start(done, -total)
            nth = turned - at_start(turned, -ties)
            is_first = ordinal + seg == 0
            keep = np.flatnonzero(lo < at_most) if at_most is not None else np.arange(len(w))
            yield made(ROW, b, keep, w[keep], lo[keep], is_first[keep])
            heads = np.flatnonzero(turn) if turn[0] else np.concatenate([[0], np.flatnonzero(turn)])
            sums = np.add.reduceat(w, heads)
            few = nth[heads] < at_most if at_most is not None else np.ones(len(heads), bool)
            yield made(RUN, b, heads[few], sums[few], np.zeros(few.sum(), np.int64), is_first[heads[few]])
            first = b.slice(0, 1) if first is None else first
            first_total += int(w[is_first].sum())
            last, ordinal = b.slice(b.num_rows - 1), ordinal + int(seg[-1])
            total, ties = int(lo[-1] + w[-1]), int(nth[-1])
            group, tie = ([c[-1].as_py() for c in part] for part in (cols[:n_group], cols[n_group:n_group + n_tie]))
        if first is not None:
            yield made(TOTAL, first, np.array([0]), np.array([first_total]), np.array([0]), np.array([True]))
            if ordinal > 0:
                yield made(TOTAL, last, np.array([0]), np.array([total]), np.array([0]), np.array([False]))

    return tuples.mapInArrow(run, kind)


def _same(left, right):
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def ranked(rows, group, order, ties, at_most=None):
    """group columns, order columns, pos (from 1 within the group), tied; one row for each row of `rows`.

    order: (column, way) pairs, way a method of Column as "desc_nulls_first"; the first `ties` of them
    make a tie, and `tied` counts the lines of the group that share it. With `at_most` only lines
    of pos up to it are returned (all are ranked and counted).
    """
    names = [*group, *(c for c, _ in order)]
    inner = [f"g{i}" for i in range(len(group))] + [f"o{i}" for i in range(len(order))]
    g, tie = inner[:len(group)], inner[len(group):len(group) + ties]
    tuples = compressed(rows.select(*[F.col(c).alias(i) for c, i in zip(names, inner)]))
    by = [F.col(c).asc() for c in g] + [getattr(F.col(f"o{i}"), way)() for i, (_, way) in enumerate(order)]
    sorted_ = tuples.repartitionByRange(*by).sortWithinPartitions(*by)
    step = written(ranked_ranges(sorted_, len(group), ties, at_most), "ranges")

    shared = sums_before(step.where(F.col("kind") == TOTAL).select("pid", *g, "n", "first"), "pid", "n", g)
    ahead = shared.where("first").select(F.col("pid").alias("p"), "before")
    row = step.where(F.col("kind") == ROW)
    row = row.where("NOT first").withColumn("before", F.lit(0).cast("long")).unionByName(row.where("first").join(ahead.hint("shuffle_hash"), F.col("pid") == F.col("p")).drop("p"))
    row = row.withColumn("lo", F.col("lo") + F.col("before")).where(F.col("lo") < at_most) if at_most is not None else row.withColumn("lo", F.col("lo") + F.col("before"))

    key = [*g, *tie]
    run = step.where(F.col("kind") == RUN).groupBy(*key).agg(F.sum("n").alias("tied")).select(*[F.col(c).alias(f"r_{c}") for c in key], "tied")
    row = row.join(run.hint("merge"), _same(key, [f"r_{c}" for c in key])).select(*inner, "n", "lo", "tied")

    till = F.col("lo") + F.col("n") if at_most is None else F.least(F.col("lo") + F.col("n"), F.lit(at_most))
    places = lambda a, b: F.explode(F.sequence(a, b))
    out = row.where(F.col("n") <= CHUNK).select(*inner, places(F.col("lo") + 1, till).alias("pos"), "tied")
    if at_most is None or at_most > CHUNK:
        piece = row.where(F.col("n") > CHUNK).withColumn("till", till).select(*inner, "lo", "till", "tied", F.explode(F.expr(f"sequence(lo, till - 1, {CHUNK}L)")).alias("a"))
        out = out.unionByName(piece.repartition("a").select(*inner, places(F.col("a") + 1, F.least(F.col("a") + CHUNK, F.col("till"))).alias("pos"), "tied"))
    else:
        out = out.unionByName(row.where(F.col("n") > CHUNK).select(*inner, places(F.col("lo") + 1, till).alias("pos"), "tied"))
    pos, tied = free_name("pos", rows.select(*names)), free_name("tied", rows.select(*names))
    return out.select(*[F.col(i).alias(c) for c, i in zip(names, inner)], F.col("pos").alias(pos), F.col("tied").alias(tied))


def sale_line_ranks(lines, places=2):
    """The lines of each vendor, part and month of sale_lines with place at most `places`."""
    one = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    part = F.coalesce(F.pmod("item_id", F.lit(5)), F.lit(-1))
    month = F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1))
    of = lambda c: F.when(one, F.lit(-1)).otherwise(c).cast("long")
    cents = lambda c: F.floor(100 * F.col(c) + 0.5).cast("long")
    rows = lines.select(of(F.col("vendor_id")).alias("vendor_id"), of(part).alias("part"), of(month).alias("month"), F.floor(F.col("quantity") / 10).cast("long").alias("tens"), cents("discount").alias("percent"),
                        F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"), F.col("quantity").cast("long").alias("quantity"), cents("amount").alias("amount_cents"))
    order = [("tens", "desc_nulls_first"), ("percent", "asc_nulls_first")] + [(c, "asc_nulls_last") for c in ("sale_id", "line_no", "quantity", "amount_cents")]
    got = ranked(rows, ["vendor_id", "part", "month"], order, 2, places)
    return got.select("vendor_id", "part", "month", "pos", F.col("pos").alias("place"), "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")
