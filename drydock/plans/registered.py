"""Where the plan modules register their queries and oracles."""

QUERIES, ORACLE = {}, {}


def query(oracle=None):
    def add(f):
        QUERIES["q_" + f.__name__] = f
        if oracle:
            ORACLE["q_" + f.__name__] = oracle
        return f
    return add


def queries():
    def over(f):
        return lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)
    return {k: over(f) for k, f in QUERIES.items()}
