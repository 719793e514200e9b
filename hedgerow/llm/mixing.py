"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.shared import discard, salted_join, unused, written


@dataclass(frozen=True)
class Mixing:
    """``margins``: the power of its token total that each attribute's values are weighted by (1: as they are, 0: evenly).

    ``budget``: share of all tokens to keep, as an expectation. ``error``: largest relative miss of a margin at which
    fitting ends, after ``rounds`` at most. ``seed`` of the draws. ``cells``: combinations up to which they are broadcast.
    """

    margins: dict[str, float] = field(default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 1.0})
    budget: float = 0.5
    error: float = 1e-4
    rounds: int = 50
    seed: int = 17
    cells: int = 50_000


def token_count(text: Column) -> Column:
    """Runs without white space; null and blank texts have none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), lambda x: x != "")).cast("long")


def layout(text: Column, tokens: Column) -> Column:
    """A coarse topic by how a text is laid out: nothing, a table, a short note, a licensed text, prose."""
    text = F.coalesce(text, F.lit(""))
    return (F.when(tokens == 0, "empty").when(text.contains(" | "), "table").when(text.contains("License"), "licensed")
            .when(tokens < 100, "note").otherwise("prose"))


def tempered(cells: DataFrame, name: str, power: float) -> DataFrame:
    """(name, target): each value's share of the tokens, raised to ``power`` and scaled to sum to 1."""
    totals = cells.groupBy(name).agg(F.sum("tokens").alias("t")).where("t > 0")
    weighted = totals.withColumn("p", F.pow("t", F.lit(power)))
    return weighted.crossJoin(F.broadcast(weighted.agg(F.sum("p").alias("all")))).select(name, (F.col("p") / F.col("all")).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], how: Mixing = Mixing()) -> DataFrame:
    """``cells`` (an attribute for each of ``targets``, tokens) with ``weight``: tokens times weight meets the target shares.

    Each round scales the cells to one margin after the other. Cells without tokens or with a value that has no target
    get weight 0. Targets that no weights can meet end after ``how.rounds`` with the last weights.
    """
    now = cells.where("tokens > 0")
    for name, shares in targets.items():
        now = now.join(shares.select(name, F.col("target").cast("double").alias(f"target_{name}")), name)
    now = written(now, "cells")
    all_tokens, path = now.agg(F.sum("tokens")).first()[0] or 1, now._written
    now = now.withColumn("raked", F.col("tokens") / F.lit(all_tokens))
    now._written = path
    for _ in range(how.rounds):
        after, miss = now, []
        for name in targets:
            # partial sums, joined back: no task holds all cells of a value
            after = salted_join(after, after.groupBy(name).agg(F.sum("raked").alias("margin")), [name])
            after = after.withColumn("miss_" + name, F.abs(F.col("margin") / F.col(f"target_{name}") - 1)).withColumn(
                "raked", F.col("raked") * F.col(f"target_{name}") / F.col("margin")).drop("margin")
            miss.append("miss_" + name)
        after = written(after.withColumn("miss", F.greatest(*miss) if len(miss) > 1 else F.col(miss[0])).drop(*miss), "cells")
        worst = after.agg(F.max("miss")).first()[0]
        discard(now)
        now = after.drop("miss")
        now._written = after._written
        if worst is None or worst <= how.error:
            break
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    names = list(targets)
    fitted = now.select(*names, (F.col("raked") * total / F.col("tokens")).alias("weight"))
    return cells.join(fitted, names, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def calibrated(cells: DataFrame, budget: float) -> DataFrame:
    """``cells`` with ``probability`` = min(1, rate * weight), the rate such that ``budget`` of all tokens are expected."""
    cells = written(cells, "weighted")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    rate, full = 0.0, 0
    for _ in range(100):
        capped = F.col("weight") * rate >= 1 if rate else F.lit(False)
        sure, rest, now = cells.agg(F.sum(F.when(capped, F.col("tokens")).otherwise(0)),
                                    F.sum(F.when(capped, 0.0).otherwise(F.col("tokens") * F.col("weight"))),
                                    F.count(F.when(capped, 1))).first()
        if rate and now == full or not rest:
            break
        rate, full = max(rate, (budget * total - sure) / rest), now
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * rate))


def mix_sources(docs: DataFrame, how: Mixing = Mixing(), id: str = "doc_id", text: str = "text",
                attributes: dict[str, Column] | None = None, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``docs`` with ``mix_weight``, ``mix_probability`` and ``mix_kept``: a sample whose tokens meet the target margins.

    ``attributes``: the columns that margins are taken of (source, language, layout by default; null is a value of its
    own). ``targets``: tables (attribute, target) of shares; by default tempered shares of what is there. Tokens are
    counted over whole texts. A document is drawn by a hash of its id and text, so equal rows are drawn together and
    repeated runs agree. Columns of those three names are replaced, all others are kept as they are. Texts without tokens belong to no margin: weight 0, never kept. No rows give no rows.
    """
    whole = F.col(text).cast("string")
    docs = docs.drop("mix_weight", "mix_probability", "mix_kept")
    own = unused([c.lower() for c in docs.columns])
    tokens = own + "tokens"
    rows = docs.withColumn(tokens, token_count(whole))
    values = attributes or {"source": F.col("source"), "lang": F.col("lang"), "topic": layout(whole, F.col(tokens))}
    names = {name: f"{own}at_{name}" for name in values}
    rows = rows.withColumns({names[name]: F.coalesce(c.cast("string"), F.lit("")) for name, c in values.items()})
    slim = rows.select(*names.values(), tokens)
    cells = written(slim.groupBy(*names.values()).agg(F.sum(tokens).alias("tokens")), "cells").withColumnsRenamed(
        {v: k for k, v in names.items()})
    shares = {name: (targets or {}).get(name) if (targets or {}).get(name) is not None else tempered(cells, name, how.margins.get(name, 1.0))
              for name in values}
    drawn = written(calibrated(rake(cells, shares, how), how.budget), "drawn").select(
        *[F.col(k).alias(v) for k, v in names.items()], F.col("weight").alias("mix_weight"), F.col("probability").alias("mix_probability"))
    chance = F.shiftrightunsigned(F.xxhash64(F.col(id), whole, F.lit(how.seed)), 11) / float(1 << 53)
    keys = list(names.values())
    if drawn.count() <= how.cells:
        joined = rows.join(F.broadcast(drawn), keys, "left")
    else:
        joined = salted_join(rows, drawn, keys, "left")
    return joined.withColumn("mix_kept", (F.col(tokens) > 0) & (chance < F.col("mix_probability"))).select(
        *docs.columns,
        F.when(F.col(tokens) > 0, F.col("mix_weight")).otherwise(0.0).alias("mix_weight"),
        F.when(F.col(tokens) > 0, F.col("mix_probability")).otherwise(0.0).alias("mix_probability"), "mix_kept")
