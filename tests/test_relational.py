import duckdb
import pytest

from drydock.plans import buildfiles, catalogue, corpora, registered as C, relational as R  # noqa: F401

D = "/root/testdata/sf0.001"


def _plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return "null" if x != x else f"{float(x):.5f}"
    return "null" if x is None or str(x) in ("NaT", "nan", "<NA>") else str(x)


@pytest.mark.parametrize("name", sorted([*R.SQL, *C.ORACLE]))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in R.TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    want = con.execute({**R.ORACLE, **C.ORACLE}[name]).df()
    got = {**R.queries(), **C.queries()}[name](spark, D).toPandas()
    key = sorted(want.columns)
    assert sorted(got.columns) == key and len(got) == len(want)
    norm = lambda d: sorted(tuple(map(_plain, r)) for r in d[key].itertuples(index=False, name=None))
    assert norm(got) == norm(want)


def test_first_match_takes_the_first_of_equal_lines(spark, tmp_path):
    # many small groups over many row groups: every line of an order has one number, nulls behind
    rows = [(k % 500, 7000 - k, None if k < 500 else 1, "R" if k % 3 else "N") for k in range(7000)]
    con = duckdb.connect()
    con.execute("create table l (l_orderkey bigint, l_partkey bigint, l_linenumber int, l_returnflag varchar)")
    con.executemany("insert into l values (?, ?, ?, ?)", rows)
    con.execute(f"copy l to '{tmp_path}/lineitem.parquet' (format parquet, row_group_size 1000)")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r[0]: (r[1], r[2]) for r in R.queries()["q_first_match"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {}
    for o, p, n, f in sorted(rows, key=lambda r: r[2] is None):  # stable: the order of the file within a number
        if f == "R":
            want.setdefault(o, (n, p))
    assert got == want
