"""Assessment of indices and measures over runs: ranks, groups, stepwise tests, truth against worst, matching, sequences."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import numeric
from strandweave.functions.columns import r6, ratio
from strandweave.operators.correlation import pearson, ranked
from strandweave.operators.inference import with_p

#: Indices of which a low value is good.
LOW_IS_BEST = ("dbi",)


def ranked_by_index(values: DataFrame, run: str) -> DataFrame:
    """Adds the dense rank of each measure within run and index, the best first. `values` has `<run>, measure, index, value`."""
    order = F.when(F.col("index").isin(*LOW_IS_BEST), F.col("value")).otherwise(-F.col("value"))
    return values.withColumn("rank", F.dense_rank().over(Window.partitionBy(run, "index").orderBy(order)))


def grouped(ranks: DataFrame) -> DataFrame:
    """`index, measure, median, grp`: measures by their median rank over runs; equal medians make one group, the best is 1."""
    m = ranks.groupBy("index", "measure").agg(F.percentile("rank", 0.5).alias("median"))
    return m.withColumn("grp", F.dense_rank().over(Window.partitionBy("index").orderBy("median")))


def stepwise_signed_ranks(ranks: DataFrame, run: str, alpha: float = 0.05, tests: int = 1, non_zero: float = 1e-8) -> DataFrame:
    """Wilcoxon tests per index: all pairs of the best group, then the best group against the second, the third and so on, up to the first of which every measure differs significantly.

    `index, grp, a, b, statistic, p, n_nonzero, effect, alpha, significant`; grp 1 are pairs of the best
    group. Values of indices of which a low one is good change sides, so that signs mean the same. An
    index has a row per run and measure: tens to thousands, one task each.
    """
    x = ranks.join(grouped(ranks), ["index", "measure"]).select("index", run, "measure", "value", "grp")
    schema = "index string, grp int, a string, b string, statistic double, p double, n_nonzero long, effect double, alpha double, significant boolean"
    level = round(alpha / tests, 4)

    def test(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot_table(index=run, columns="measure", values="value", aggfunc="max")
        group = g.groupby("measure")["grp"].first()
        top = sorted(group.index[group == 1])
        rows = []

        def add(n: int, a: str, b: str) -> bool:
            two = (b, a) if key[0] in LOW_IS_BEST else (a, b)
            pair = wide[list(two)].dropna()
            stat, p, k, sign = numeric.signed_rank(pair[two[0]].to_numpy(), pair[two[1]].to_numpy(), non_zero)
            rows.append((key[0], n, a, b, stat, round(p, 5), k, round(numeric.effect_size(p, k, sign), 6), level, bool(p < level)))
            return rows[-1][-1]

        for a, b in combinations(top, 2):
            add(1, a, b)
        for n in range(2, int(group.max()) + 1):
            if all([add(n, a, b) for a, b in product(top, sorted(group.index[group == n]))]):
                break
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return x.groupBy("index").applyInPandas(test, schema)


def truth_and_worst(described: DataFrame, run: str, label: str, truth: str, value: str, external: str, z: float = 1.96) -> DataFrame:
    """One row: mean and deviation (of all) over runs of the truth's value and of that with the least agreement, their standardised difference and its interval."""
    x = described.groupBy(run).agg(F.max(F.when(F.col(label) == truth, F.col(value))).alias("gt"), F.min_by(value, F.struct(external, label)).alias("worst")).where("gt is not null and worst is not null")
    g = x.agg(F.count(F.lit(1)).alias("n"), F.avg("gt").alias("m1"), F.stddev_pop("gt").alias("s1"), F.avg("worst").alias("m2"), F.stddev_pop("worst").alias("s2"))
    se, diff = F.sqrt((F.col("s1") ** 2 + F.col("s2") ** 2) / F.col("n")), F.col("m1") - F.col("m2")
    return g.select("n", *[r6(c).alias(a) for c, a in ((F.col("m1"), "truth_mean"), (F.col("s1"), "truth_sd"), (F.col("m2"), "worst_mean"), (F.col("s2"), "worst_sd"), (ratio(diff, se), "effect_size"), (diff - z * se, "lo"), (diff + z * se, "hi"))])


def greedy_matching(confusion: DataFrame, by: list[str]) -> DataFrame:
    """`<by>, matches, f1`: predicted labels matched to true ones by the largest counts left, each once, and the macro F1 of the matching.

    `confusion` has `<by>, cluster_id, predicted, n`; a table has as many rows and columns as there are labels.
    """
    kinds = {f.name: f.dataType.simpleString() for f in confusion.schema.fields}

    def match(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n", "cluster_id", "predicted"], ascending=[False, True, True])
        truth, guess = g.groupby("cluster_id")["n"].sum(), g.groupby("predicted")["n"].sum()
        pairs: dict[int, tuple[int, int]] = {}
        used: set[int] = set()
        for c, p, n in zip(g["cluster_id"], g["predicted"], g["n"]):
            if c not in pairs and p not in used:
                pairs[c] = (p, n)
                used.add(p)
        f1 = [2 * pairs[c][1] / (truth[c] + guess[pairs[c][0]]) if c in pairs else 0.0 for c in truth.index]
        return pd.DataFrame([[*key, len(pairs), round(float(np.mean(f1)), 6)]], columns=[*by, "matches", "f1"])

    return confusion.groupBy(*by).applyInPandas(match, ", ".join(f"{c} {kinds[c]}" for c in by) + ", matches int, f1 double")


def sequence_correlations(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """`<by>, other_id, n, r, p`: rank correlation of each group's sequence with that of the next group by name, cut to the shorter.

    Sequences are numbered within their group (one row per segment), groups by name among themselves (one row per group).
    """
    q = df.select(by, F.col(value).alias("v"), (F.row_number().over(Window.partitionBy(by).orderBy(*order))).alias("i"))
    near = df.select(by).distinct().withColumn("other_id", F.lead(by).over(Window.orderBy(by))).where("other_id is not null")
    x = q.withColumnRenamed("v", "u").join(near, by).join(q.select(F.col(by).alias("other_id"), "i", "v"), ["other_id", "i"])
    r = pearson(ranked(x, [by, "other_id"], ("u", "v")), [by, "other_id"], ("u", "v"), digits=None)
    return with_p(r.select(by, "other_id", "n", F.when(F.isnan(F.get("correlation", F.lit(0))), float("nan")).otherwise(r6(F.get("correlation", F.lit(0)))).alias("r")))
