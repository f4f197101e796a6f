"""Tables in the folder that all executors share: lineage ends where one is written."""
import os
import uuid


def shared_dir(spark):
    """The cluster's checkpoint folder; in local mode, where none is set, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (path or "file:///tmp/checkpoints").rstrip("/")


def cut(df):
    """df written as Parquet and read again: later steps start from it, and a lost executor costs no more."""
    path = os.path.join(shared_dir(df.sparkSession), f"drydock-step-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def spread(df):
    """Rows dealt anew over as many tasks as a shuffle has, for work that costs far more than its rows weigh in files."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def parted(df, *by, rows=250_000):
    """df dealt by columns over so many tasks that each takes about `rows` rows, however well they pack: AQE goes by
    packed bytes. Counts df, so it should be cheap to read."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, df.count() // rows + 1), *by)
