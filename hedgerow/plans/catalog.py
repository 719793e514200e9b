"""Where queries register themselves, and SQL pieces their oracles share."""

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str = None):
    """Register ``f(spark, sf_dir) -> DataFrame`` under ``name``, with DuckDB SQL if there is any."""
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def half_even(x: str, digits: int = 0) -> str:
    """SQL for rounding a double half-even on its exact value; ``x`` should be a plain column."""
    scale = f"{10 ** digits}e0"
    product, shifted = f"({x}*{scale})", f"({x}*134217729e0)"
    high = f"({shifted}-({shifted}-{x}))"
    error = f"(({high}*{scale}-{product})+({x}-{high})*{scale})"
    whole = f"floor({product})"
    rest = f"({product}-{whole})"
    up = (f"(CASE WHEN {rest}>0.5e0 OR ({rest}=0.5e0 AND ({error}>0 OR ({error}=0 AND {whole}%2=1))) "
          "THEN 1e0 ELSE 0e0 END)")
    return f"(({whole}+{up})/{scale})"


def contains_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


def count_contained(text: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {quote(w)}) AS INT)" for w in words) + ")"


def quote(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def listed(words) -> str:
    return "(" + ", ".join(quote(w) for w in words) + ")"
