"""Mixing sources to target weights by entropy balancing.

Document rates are those nearest to one in relative entropy, at most MAX_COPIES, whose tokens
meet each source's target: rate = min(MAX_COPIES, exp(tilt * size / mean size of the source)).
The tilts solve the convex dual, by safeguarded Newton steps of which each is one distributed
sum over (source, size, documents) cells. Rates become whole copies, with the rounding carried
from cell to cell and made up by single copies, so that each source ends near its target.

DataFrame operations only; sums are taken in decimals, so that reruns agree to the last copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm._cluster import drop_kept, keep, n_buckets, ranked
from siltstone.llm._words import WORD_SQL

#: A source's target stops at this many times its size, and a document's copies too.
MAX_COPIES = 3
#: Weights of the sources in code point order, over and over; fixed by the mix.
WEIGHTS = (1, 2, 3)
MAX_STEPS, TOLERANCE = 60, 1e-9


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size) with size the number of words; a null text has none."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_SQL)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """`sources` (source, source_size) with weight and target: one row per source.

    Shares follow the weights; where a share exceeds cap times the size, it stops there and the
    rest goes to the others by weight. The outcome is the level at which sources, ordered by
    cap * size / weight, stop being capped. Empty sources get 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(by_name) - 1
    weighted = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights)).cast("int") + 1))
    ratio = cap * F.col("source_size") / F.col("weight")
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    until, every = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    levels = weighted.withColumn("ratio", ratio).withColumns({
        "total": F.sum("source_size").over(every),
        "capped": F.coalesce(F.sum(cap * F.col("source_size")).over(until), F.lit(0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(until), F.lit(0.0)),
    })
    # the level if this source and all after it stay under their caps; capping more lowers it
    level = (F.col("total") - F.col("capped")) / F.col("open")
    found = levels.withColumn("level", F.max(F.when(level <= F.col("ratio"), level)).over(every))
    return found.select("source", "source_size", "weight", F.least((cap * F.col("source_size")).cast("double"), F.coalesce(F.col("level") * F.col("weight"), (cap * F.col("source_size")).cast("double"))).alias("target"))


def _exact(x: Column) -> Column:
    """A double as a decimal, whose sums do not depend on the order of the rows."""
    return x.cast("decimal(38,9)")


def tilts(cells: DataFrame, goals: DataFrame, cap: int = MAX_COPIES, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """`goals` (source, source_size, mean_size, target) with the tilt that meets each target.

    A step sums tokens and their slope over `cells` (source, size, n) for all sources at once;
    only the largest relative error comes to the driver. A step that leaves the bracket known
    to hold the root is replaced by the bracket's middle.
    """
    saturated = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    state = keep(
        goals.withColumns({"tilt": F.lit(0.0), "low": F.lit(-1e6), "high": F.lit(1e6), "saturated": saturated, "error": F.when(saturated, 0.0).otherwise(1.0)}),
        "tilts",
    )
    for _ in range(max_steps):
        z = F.col("size") / F.col("mean_size")
        rate = F.exp(F.col("tilt") * z)
        tokens = F.col("n") * F.col("size")
        sums = (
            cells.join(state.where(~F.col("saturated")), cells["source"].eqNullSafe(state["source"]))
            .groupBy(state["source"])
            .agg(
                F.sum(_exact(tokens * F.least(rate, F.lit(float(cap))))).cast("double").alias("tokens"),
                F.sum(_exact(F.when(rate < cap, tokens * z * rate).otherwise(0.0))).cast("double").alias("slope"),
            )
            .select(F.col("source").alias("of"), "tokens", "slope", F.lit(True).alias("found"))
        )
        off = F.col("tokens") - F.col("target")
        low = F.when(off < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(off >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("tilt") - F.greatest(F.least(off / F.when(F.col("slope") > 0, F.col("slope")), F.lit(6.0)), F.lit(-6.0)))
        middle = (F.col("low_") + F.col("high_")) / 2
        error = F.abs(off) / F.greatest(F.col("target"), F.lit(1.0))
        done = error <= tolerance
        joined = state.join(sums, state["source"].eqNullSafe(sums["of"]), "left")
        stepped = joined.withColumns({"low_": low, "high_": high, "newton": newton})
        inside = (F.col("newton") > F.col("low_")) & (F.col("newton") < F.col("high_"))
        fresh = stepped.select(
            *goals.columns,
            F.when(F.col("saturated") | F.col("found").isNull() | done, F.col("tilt")).otherwise(F.when(inside, F.col("newton")).otherwise(middle)).alias("tilt"),
            F.when(F.col("found").isNull(), F.col("low")).otherwise(F.col("low_")).alias("low"),
            F.when(F.col("found").isNull(), F.col("high")).otherwise(F.col("high_")).alias("high"),
            "saturated",
            F.when(F.col("saturated") | F.col("found").isNull(), 0.0).otherwise(error).alias("error"),
        )
        before, state = state, keep(fresh, "tilts")
        drop_kept(before)
        if (state.agg(F.max("error")).first()[0] or 0.0) <= tolerance:
            break
    return state


def rounded(cell: DataFrame, cap: int = MAX_COPIES, rounds: int = 6) -> DataFrame:
    """Cells (source, size, n, target, rate) with copies: `base` each and one more for `extra` documents.

    Going through a source's cells by size, the fractions of copies are summed up and a cell
    gets the whole ones that fall into it: the error stays within the longest document. What is
    then missing or too much is made up by single copies, `rounds` times from the largest cell
    whose size fits into it, and then from any cell within 0 and `cap` copies. Windows are over the cells of a source, one per distinct size.
    """
    upto = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.floor(F.col("rate")).cast("long")
    fraction = _exact(F.col("n") * (F.col("rate") - F.col("base")))
    out = cell.withColumn("base", base).withColumn("sum", F.sum(fraction).over(upto)).withColumn("own", fraction)
    out = out.withColumn("extra", (F.floor(F.col("sum") + F.lit(0.5)) - F.floor(F.col("sum") - F.col("own") + F.lit(0.5))).cast("long"))
    out = out.withColumn("extra", F.greatest(F.least(F.col("extra"), F.col("n")), F.lit(0)))
    given = F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("extra"))).over(whole)
    out = out.withColumn("missing", F.col("target") - given)
    # copies of a cell in all; first cells whose rate lies between whole copies give or take some
    out = out.withColumn("total", F.col("n") * F.col("base") + F.col("extra"))
    partial = (F.col("rate") > F.col("base")) & (F.col("size") > 0)
    for i in range(rounds + rounds // 2):
        if i < rounds:
            least, most = F.when(partial, F.col("n") * F.col("base")).otherwise(F.col("total")), F.when(partial, F.col("n") * (F.col("base") + 1)).otherwise(F.col("total"))
        else:
            least, most = F.lit(0), F.when(F.col("size") > 0, F.col("n") * cap).otherwise(0)
        free = F.when(F.col("missing") > 0, most - F.col("total")).otherwise(F.col("total") - least)
        fits = (free > 0) & (F.col("size") > 0) & (F.col("size") <= F.abs(F.col("missing")))
        out = out.withColumn("pick", F.max(F.when(fits, F.col("size"))).over(whole))
        change = F.when(fits & (F.col("size") == F.col("pick")), F.least(free, F.floor(F.abs(F.col("missing")) / F.col("size")).cast("long"))).otherwise(0)
        out = out.withColumn("change", (F.signum(F.col("missing")) * change).cast("long"))
        out = out.withColumn("total", F.col("total") + F.col("change"))
        out = out.withColumn("missing", F.col("missing") - F.sum(F.col("change") * F.col("size")).over(whole))
    out = out.withColumns({"base": F.floor(F.col("total") / F.col("n")).cast("long"), "extra": (F.col("total") % F.col("n")).cast("long")})
    return out.drop("sum", "own", "missing", "pick", "change", "total")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = MAX_COPIES,
) -> DataFrame:
    """One row per input row: id_col, source, size, source_size, target, rate, copies, taken.

    Null texts and texts without words have size 0 and 0 copies; a null source is a source of
    its own, after all others. Documents of a source with the same size have the same rate; the
    ones that get the extra copy are chosen by a hash of their id, and repeated rows may differ
    by one copy. An empty table gives an empty result. Other columns are not read.
    """
    rows = keep(sizes(docs, id_col, text_col, source_col), "sizes")
    cells = keep(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    totals = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    goals = targets(totals.select("source", "source_size"), weights, cap).join(totals.select(F.col("source").alias("of"), "docs"), F.col("source").eqNullSafe(F.col("of")))
    goals = goals.select("source", "source_size", "target", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)).alias("mean_size"))
    solved = tilts(cells, goals, cap)
    # Copies of a cell: its documents' rates summed up, rounded with what the cells before left over.
    joined = cells.join(solved.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("saturated"), float(cap)).otherwise(F.least(F.exp(F.col("tilt") * F.col("size") / F.col("mean_size")), F.lit(float(cap))))
    cell = joined.select("source", "size", "n", "source_size", "target", F.when(F.col("size") > 0, rate).otherwise(0.0).alias("rate"))
    cell = rounded(cell, cap)
    numbered = ranked(rows, ["source", "size"], [F.xxhash64("id"), F.col("id")], n_buckets(rows.sparkSession), "nth")
    cell = cell.select(F.col("source").alias("of"), F.col("size").alias("cell_size"), "source_size", "target", "rate", "base", "extra")
    placed = numbered.join(cell, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("cell_size")))
    copies = F.col("base") + F.when(F.col("nth") < F.col("extra"), 1).otherwise(0)
    return placed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, each as often as mix() has copies of it; those with none go.

    All columns pass through, whatever their names. Rows that share an id get the copies of the
    one with most; an empty table gives an empty one.
    """
    copies = mix(docs, id_col, text_col, source_col).groupBy(F.col(id_col).alias("of")).agg(F.max("copies").alias("copies")).where(F.col("copies") > 0)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i"))
    joined = rows.join(copies, F.col("i").eqNullSafe(F.col("of")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op4(docs: DataFrame) -> DataFrame:
    """The contract's columns of mix() over `documents`."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
