"""Confusion matrices, precision and recall, and their printed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, gold: str = "gold", predicted: str = "predicted", fill: bool = True) -> DataFrame:
    """(gold, predicted, n) for all pairs of labels that occur on either side."""
    n = df.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    if not fill:
        return n
    labels = n.select("gold").union(n.select("predicted")).distinct()
    grid = labels.select(F.col("gold").alias("__g")).crossJoin(labels.select(F.col("gold").alias("__p")))
    return grid.join(n, F.col("__g").eqNullSafe(F.col("gold")) & F.col("__p").eqNullSafe(F.col("predicted")), "left").select(F.col("__g").alias("gold"), F.col("__p").alias("predicted"), F.coalesce("n", F.lit(0)).alias("n"))


def marginals(df: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """(gold, predicted, n) with totals where a label is null, by one cube."""
    return df.cube(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def examples(df: DataFrame, item: str, most: int, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Up to `most` items of each cell, the lowest first."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(gold, predicted).orderBy(item))
    return df.withColumn("__r", rank).where(F.col("__r") <= most).groupBy(gold, predicted).agg(F.sort_array(F.collect_list(item)).alias("items"))


def measures(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, n_gold, n_predicted) of a confusion matrix; 0 where nothing can be divided."""
    cell = F.explode(F.array(F.struct(F.col("gold").alias("label"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p"), F.when(F.col("gold").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(F.lit(0)).alias("ok")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p"), F.lit(0).cast("long").alias("ok"))))
    sums = matrix.select(cell.alias("c")).groupBy(F.col("c.label").alias("label")).agg(F.sum("c.g").alias("n_gold"), F.sum("c.p").alias("n_predicted"), F.sum("c.ok").alias("__ok"))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = sums.select("label", part(F.col("__ok"), F.col("n_predicted")).alias("precision"), part(F.col("__ok"), F.col("n_gold")).alias("recall"), "n_gold", "n_predicted")
    return out.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def report(matrix: DataFrame) -> DataFrame:
    """One row: accuracy and the means of precision, recall and F1 over labels."""
    acc = matrix.agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("gold").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(0)), F.sum("n")), F.lit(0.0)).alias("accuracy"))
    return acc.crossJoin(measures(matrix).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")]))


def printed(matrix: DataFrame) -> str:
    """The matrix as text, with totals. Its size is the number of labels squared."""
    cells = {(str(r.gold), str(r.predicted)): r.n for r in matrix.collect()}
    golds, preds = sorted({g for g, _ in cells}), sorted({p for _, p in cells})
    head = [*preds, "total"]
    rows = [[str(cells.get((g, p), 0)) for p in preds] + [str(sum(cells.get((g, p), 0) for p in preds))] for g in golds]
    rows.append([str(sum(cells.get((g, p), 0) for g in golds)) for p in preds] + [str(sum(cells.values()))])
    width = max(len(x) for x in [*head, *(c for r in rows for c in r)]) + 2
    side = max([5, *(len(g) for g in golds)])
    lines = [" " * side + "".join(h.rjust(width) for h in head)]
    return "\n".join(lines + [n.ljust(side) + "".join(c.rjust(width) for c in r) for n, r in zip([*golds, "total"], rows, strict=True)])
