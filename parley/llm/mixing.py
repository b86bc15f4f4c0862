"""Mixing sources to target weights by iterative proportional fitting.

The token counts of the cells (source x language x topic) are raked: sweep by
sweep they are scaled so that the sums by source, by language and by topic
meet the target shares.  A document is then taken so often as the raked weight
of its cell asks for on average, ``p`` times: below 1 this is the calibrated
probability that it is kept, by a keyed draw from its id; above 1 it is repeated,
the whole part of ``p`` always and once more by the draw.  The scale is a token
budget, so the expected token shares are the raked ones whatever the rarest cell
is.

DataFrame functions only.  Documents are first summed to cells, so a source
that holds a third of all rows is one partial sum for each task; the cell
table is joined back by size (a broadcast only if it is small, else by
shuffle, where skewed keys are split).

Defined results: a null source, language or topic is a value of its own;
documents without words have no tokens and are taken as often as others of
their cell, or never if no document of the cell has words; a null id draws by its
text; repeated rows draw alike; an empty table gives an empty result.  Targets
that a table does not reach (a cell that does not exist) are met as far as
raking converges within ``max_sweeps``.  Columns of ``docs`` named like a
result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import stored

DIMS = ("source", "lang", "topic")


def over_all(value: Column) -> Column:
    """Over all rows: for the cell table and smaller ones only."""
    return value.over(Window.partitionBy())


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A stand-in for a topic column: the form of the text."""
    return (F.when(text.contains(" | "), "table").when(text.contains("!! "), "shouted")
            .when(text.contains("*** ") | text.contains("$$$ ") | text.contains("### "), "symbols").otherwise("prose"))


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares of the values of ``dim``: their token shares to ``power``,
    made to sum to 1."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("_t")).where("_t > 0").withColumn("_w", F.pow("_t", F.lit(power)))
    return sums.select(dim, (F.col("_w") / over_all(F.sum("_w"))).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], max_sweeps: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """``cells`` (the keys of ``targets`` and ``tokens``) with ``weight``, whose
    sums by each key are the target shares of the whole.  ``targets``: for each
    key a table of its values and their ``share``."""
    out = cells.where("tokens > 0").withColumn("weight", F.col("tokens") / over_all(F.sum("tokens")))
    for dim, target in targets.items():
        t = target.toDF(f"_v_{dim}", f"_share_{dim}")
        out = out.join(t, F.col(dim).eqNullSafe(F.col(f"_v_{dim}")), "left").drop(f"_v_{dim}").fillna(0.0, [f"_share_{dim}"])
    out = stored(out, "cells")
    for _ in range(max_sweeps):
        for dim in targets:
            sums = F.sum("weight").over(Window.partitionBy(dim))
            out = out.withColumn("weight", F.when(sums > 0, F.col("weight") * F.col(f"_share_{dim}") / sums).otherwise(0.0))
        out = stored(out, "cells")
        off = [out.groupBy(dim).agg(F.abs(F.sum("weight") - F.max(f"_share_{dim}")).alias("off")).agg(F.max("off").alias("off")) for dim in targets]
        worst = off[0]
        for o in off[1:]:
            worst = worst.unionAll(o)
        gap = worst.agg(F.max("off")).first()[0]  # one number
        if gap is None or gap < tolerance:
            break
    return out.drop(*[f"_share_{d}" for d in targets])


def draw(id_col: Column, text: Column, seed: str) -> Column:
    """A fixed number in [0, 1) for each id (for a null id, for its text)."""
    key = F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit(""))))))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mixing_probabilities(docs: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = 0.8, budget: float = 1.0, seed: str = "mix ",
                         id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """All columns of ``docs`` and ``topic``, ``tokens``, ``p`` (how often a
    document is taken on average), ``copies`` (how often it is) and ``selected``
    (at least once).  The expected tokens are ``budget`` times those of ``docs``.
    Without ``targets`` the shares by source, language and topic are the present
    ones to ``power``, made to sum to 1."""
    docs = docs.drop("tokens", "p", "copies", "selected", "weight", "_p", *([] if topic is None and "topic" in docs.columns else ["topic"]))
    if "topic" not in docs.columns:
        docs = docs.withColumn("topic", F.coalesce(topic if topic is not None else topic_of(F.col(text_col)), F.lit("none")))
    rows = docs.withColumn("tokens", n_words(F.col(text_col)))
    cells = stored(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "sums")
    raked = rake(cells, targets or {d: tempered(cells, d, power) for d in DIMS})
    whole = cells.agg(F.sum("tokens")).first()[0] or 0  # one number
    # The raked weights sum to 1 where the targets can be met; else the budget is shared by what they sum to.
    often = F.lit(budget * whole) * F.col("weight") / over_all(F.sum("weight")) / F.col("tokens")
    factor = raked.select(*[F.col(d).alias(f"_c_{d}") for d in DIMS], often.alias("_p"))
    same = [F.col(d).eqNullSafe(F.col(f"_c_{d}")) for d in DIMS]
    out = rows.join(stored(factor, "factors"), same, "left").drop(*[f"_c_{d}" for d in DIMS])
    out = out.withColumn("p", F.coalesce("_p", F.lit(0.0))).drop("_p")
    more = (draw(F.col(id_col), F.col(text_col), seed) < F.col("p") - F.floor("p")).cast("long")
    return out.withColumn("copies", F.floor("p").cast("long") + more).withColumn("selected", F.col("copies") > 0)
