"""Where the queries of this folder register themselves."""

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    """Register ``f(spark, sf_dir) -> DataFrame`` under ``name``, with DuckDB SQL if there is any."""
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register
