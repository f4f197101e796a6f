"""Pattern state that grows batch by batch: a versioned table that a stream or a caller adds to."""
import os

from pyspark.sql import functions as F


class PatternStore:
    """patterns(pattern, support) as Parquet under `path`, one folder for each version.

    An upsert writes the merged table as a new version and is done once that is whole, so an
    executor or driver lost on the way leaves the last version as it was. A batch that has been
    taken in is known by its id and not added twice.
    """

    def __init__(self, spark, path, schema="pattern string, support long"):
        self.spark, self.path, self.schema = spark, path, schema

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self):
        fs, p = self._fs()
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        whole = [n for n in names if n.startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in whole)

    def scan(self):
        v = self.versions()
        return self.spark.read.schema(self.schema).parquet(os.path.join(self.path, f"v{v[-1]}")) if v else self.spark.createDataFrame([], self.schema)

    def upsert(self, new, version=None):
        """Adds the supports of new; `version` (a batch id + 1) makes a repeated call void."""
        v = self.versions()
        to = version if version is not None else (v[-1] if v else 0) + 1
        if v and to <= v[-1]:
            return self
        self.scan().unionByName(new.select("pattern", "support")).groupBy("pattern").agg(F.sum("support").alias("support")).write.mode("overwrite").parquet(os.path.join(self.path, f"v{to}"))
        return self


def stream_patterns(stream, item, path, checkpoint, least=1):
    """Runs a stream of rows to its present end: each micro-batch's counts of `item` that reach
    `least` are added to the store at `path`."""
    store = PatternStore(stream.sparkSession, path)

    def take(batch, number):
        n = batch.groupBy(F.col(item).cast("string").alias("pattern")).agg(F.count(F.lit(1)).alias("support"))
        store.upsert(n.where(F.col("support") >= least), number + 1)

    q = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return store.scan()


def appended(accepted, corpus_path, rebuild):
    """Adds accepted rows to a corpus of Parquet and gives rebuild(corpus), rules drawn anew from all of it."""
    accepted.write.mode("append").parquet(corpus_path)
    return rebuild(accepted.sparkSession.read.parquet(corpus_path))


def windowed_counts(stream, at, item, width="1 hour", late="2 hours"):
    """Counts of items by window of event time, late rows up to `late` counted."""
    t = F.col(at).cast("timestamp")
    return stream.withColumn("_at", t).withWatermark("_at", late).groupBy(F.window("_at", width), F.col(item)).count()
