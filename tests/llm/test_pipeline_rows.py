"""Row numbers of the pipeline: the same for a row in every job, however its files are read."""
from pyspark.sql import functions as F

from drydock.llm.common import numbered


def test_numbers_hold_when_partitions_move(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 50).alias("text"), F.lit(1).alias("row"))
    docs.repartition(7).write.option("maxRecordsPerFile", 150).parquet(str(tmp_path / "d"))
    d = numbered(spark.read.parquet(str(tmp_path / "d")), "n")
    spread, seen = [], []
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = d.select("doc_id", "n", F.spark_partition_id().alias("p")).collect()
            seen.append({r["doc_id"]: r["n"] for r in rows})
            spread.append(len({r["p"] for r in rows}))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert spread[0] > spread[1] and seen[0] == seen[1] and len(set(seen[0].values())) == 3000


def test_numbers_of_other_tables(spark, tmp_path):
    """Computed tables, repeated readings and files of other names are written once."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    docs.repartition(2).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    for d in (docs, read.unionByName(read), read.join(read.select("doc_id"), "doc_id"), read.where("doc_id > 5"), docs.limit(0)):
        n = numbered(d, "n")
        assert n.count() == n.select("n").distinct().count() == d.count() and n.collect() == n.collect()
    (tmp_path / "e").mkdir()
    for i, f in enumerate(sorted((tmp_path / "d").glob("*.parquet"))):
        (tmp_path / "e" / f"{i}.parquet").write_bytes(f.read_bytes())
    assert numbered(spark.read.parquet(str(tmp_path / "e")), "n").select("n").distinct().count() == 40
