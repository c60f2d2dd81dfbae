"""Mixing sources to target weights.

Documents are counted in tokens, their language is that of their prose (see `tallies`), their topic a
cluster of the words they use (see `topics`). Languages are told by counts over all labelled documents,
and topics are fitted to all documents that may be used. Iterative proportional fitting rakes the token weights of the
cells source x language x topic to the target shares of the sources, keeping the languages' and
topics' shares of the collection as far as the sources allow; within a source no cell goes beyond
its allowed repeats. Documents are then sampled by the calibrated weight of their cell: whole
repeats are certain, and the fraction is drawn by a hash of the id under one threshold per source,
chosen so that the source's tokens come out at their target.

How it scales: labelled texts pass once to be counted; then the texts pass once, through the tokenizer,
to one small row each; all else reads those. Only sums of fixed size for languages and topics, cells
(sources x languages x topics) and a histogram of fixed size per source come to the driver. Ranks are needed within a source's boundary bin alone, never within a whole source.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.bpe import VOCABULARY
from strandweave.llm.labels import language_of  # noqa: F401
from strandweave.llm.tallies import tallied
from strandweave.llm.topics import Topics, described
from strandweave.runtime import scratch, written

BINS, REACH = 2048, 8.0


def filled(x: np.ndarray, cap: np.ndarray, total: float) -> np.ndarray:
    """Scale x in proportion to the total without passing cap; what caps cut off goes to the rest."""
    free = np.ones(len(x), bool)
    out = np.minimum(x, cap)
    for _ in range(len(x) + 1):
        rest = total - cap[~free].sum()
        s = x[free].sum()
        if not free.any() or s <= 0:
            break
        scaled = x * (rest / s)
        over = free & (scaled > cap * (1 + 1e-12))
        out = np.where(free, scaled, cap)
        if not over.any():
            break
        free &= ~over
    return np.minimum(out, cap)


def raked(tokens: np.ndarray, cells: np.ndarray, shares: np.ndarray, repeats: np.ndarray, total: float, rounds: int = 100) -> np.ndarray:
    """Tokens to draw from each cell (rows of `cells`: source, language, topic), source totals last."""
    x, cap = tokens.astype(float).copy(), tokens * repeats[cells[:, 0]]
    want = [np.bincount(cells[:, k], tokens, minlength=cells[:, k].max() + 1) / tokens.sum() * total for k in (1, 2)]
    for _ in range(rounds):
        was = x.copy()
        for k in (2, 1):
            now = np.bincount(cells[:, k], x, minlength=len(want[k - 1]))
            x *= np.divide(want[k - 1], now, out=np.ones_like(now), where=now > 0)[cells[:, k]]
        for s in range(len(shares)):
            own = cells[:, 0] == s
            if own.any():
                x[own] = filled(np.maximum(x[own], 1e-12 * tokens[own]), cap[own], min(shares[s] * total, cap[own].sum()))
        if np.abs(x - was).max(initial=0) <= 1e-9 * total:
            break
    return x


def mixed(
    docs: DataFrame, targets: DataFrame, aliases: DataFrame, total_tokens: int | None = None, seed: int = 5, vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents used `doc_id, source, lang_code, topic, n_tokens, copies`, report per target source, report of marginals).

    `targets` (`source, weight, max_repeats`, small) is joined without case and outer blanks. The
    total is the largest at which every source that has tokens reaches its share, or `total_tokens`
    if that is less. The report has `source, target_share, actual_share, tokens, available_tokens,
    n_docs, most_copies`; that of marginals has `marginal, value, target_share, actual_share, tokens`
    for each language and topic, the targets being the shares of the documents that may be used.

    Defined cases: documents of null or unlisted sources and without tokens are not used; a source
    without tokens has an actual share of 0, and the others keep their shares to one another;
    targets with null or non-positive weight or repeats count as 0; a repeated target row counts
    once; unknown languages are one language; with no document the mix is empty.
    """
    spark = docs.sparkSession
    rows = targets.select(F.lower(F.trim("source")).alias("s"), F.coalesce("weight", F.lit(0.0)).cast("double").alias("w"), F.coalesce("max_repeats", F.lit(0)).cast("int").alias("r")).where("s is not null").distinct().orderBy("s", "w", "r").collect()
    spec = {r["s"]: (max(r["w"], 0.0), max(r["r"], 0)) for r in rows}
    names = sorted(spec)
    source = F.lower(F.trim("source"))
    d = described(docs.where(source.isin(names)).select("doc_id", source.alias("source"), "text"), tallied(docs, aliases), vocabulary)
    with scratch(d.where("n_tokens > 0")) as d:
        sized = written(Topics.fitted(d).labelled(d))
    cells = sized.groupBy("source", "lang_code", "topic").agg(F.sum("n_tokens").alias("n")).orderBy("source", "lang_code", "topic").collect()
    weight = np.array([spec[s][0] for s in names], float)
    repeats = np.array([spec[s][1] for s in names], float)
    shares = weight / weight.sum() if weight.sum() > 0 else weight
    held = np.zeros(len(names))
    for c in cells:
        held[names.index(c["source"])] += c["n"]
    usable = (held > 0) & (shares > 0) & (repeats > 0)
    fixed = np.where(usable, shares, 0.0)
    fixed = fixed / fixed.sum() if fixed.sum() > 0 else fixed
    total = min([held[i] * repeats[i] / fixed[i] for i in np.flatnonzero(usable)], default=0.0)
    total = min(total, float(total_tokens)) if total_tokens is not None else total
    use = [c for c in cells if usable[names.index(c["source"])]]
    kinds = [sorted({c[k] for c in use}) for k in ("lang_code", "topic")]
    index = np.array([[names.index(c["source"]), kinds[0].index(c["lang_code"]), kinds[1].index(c["topic"])] for c in use], np.int64).reshape(-1, 3)
    tokens = np.array([c["n"] for c in use], float)
    w = raked(tokens, index, fixed, repeats, total) / tokens if use else tokens
    w = np.where(np.abs(w - np.round(w)) < 1e-9, np.round(w), w)
    plan = spark.createDataFrame(
        [(c["source"], c["lang_code"], c["topic"], int(np.floor(x)), float(x - np.floor(x))) for c, x in zip(use, w)], "source string, lang_code string, topic string, sure int, part double")
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) / float(1 << 52)
    drawn = sized.join(F.broadcast(plan), ["source", "lang_code", "topic"]).withColumn("v", F.when(F.col("part") > 0, u / F.col("part")))
    drawn = drawn.withColumn("bin", F.least(F.floor(F.col("v") * (BINS / REACH)), F.lit(BINS)).cast("int"))
    need = {s: fixed[i] * total for i, s in enumerate(names)}
    for r in drawn.groupBy("source").agg(F.sum(F.col("sure") * F.col("n_tokens")).alias("n")).collect():
        need[r["source"]] -= r["n"]
    at: dict[str, tuple[int, float]] = {}  # the bin in which a source's tokens run full, and what is left for it
    bins = drawn.where("bin is not null").groupBy("source", "bin").agg(F.sum("n_tokens").alias("n")).orderBy("source", "bin").collect()
    for r in bins:
        if r["source"] not in at:
            if need[r["source"]] <= r["n"]:
                at[r["source"]] = (r["bin"], need[r["source"]])
            else:
                need[r["source"]] -= r["n"]
    edge = spark.createDataFrame([(s, b, float(n)) for s, (b, n) in at.items()], "source string, edge int, room double")
    x = drawn.join(F.broadcast(edge), "source", "left")
    extra = F.when(F.col("bin").isNull(), 0).when(F.col("edge").isNull() | (F.col("bin") < F.col("edge")), 1).when(F.col("bin") > F.col("edge"), 0)
    x = x.withColumn("extra", extra)
    near = x.where("extra is null")
    # the boundary bin once more in as many bins: ranks are needed within one of these only
    wide = REACH / BINS
    near = near.withColumn("bin2", F.when(F.col("bin") < BINS, F.least(F.floor((F.col("v") - F.col("bin") * wide) / wide * BINS), F.lit(BINS - 1))).otherwise(0).cast("int"))
    at2: dict[str, tuple[int, float]] = {}
    left = {s: n for s, (_, n) in at.items()}
    for r in near.groupBy("source", "bin2").agg(F.sum("n_tokens").alias("n")).orderBy("source", "bin2").collect():
        if r["source"] not in at2:
            if left[r["source"]] <= r["n"]:
                at2[r["source"]] = (r["bin2"], left[r["source"]])
            else:
                left[r["source"]] -= r["n"]
    edge2 = spark.createDataFrame([(s, b, float(n)) for s, (b, n) in at2.items()], "source string, edge2 int, room2 double")
    near = near.join(F.broadcast(edge2), "source", "left").withColumn("extra", F.when(F.col("edge2").isNull() | (F.col("bin2") < F.col("edge2")), 1).when(F.col("bin2") > F.col("edge2"), 0))
    sure = near.where("extra is not null").select(*x.columns)
    near = near.where("extra is null").withColumn("room", F.col("room2")).withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("source").orderBy("v", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    near = near.withColumn("extra", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("room")).cast("int")).drop("upto")
    done = x.where("extra is not null").unionByName(sure).unionByName(near.select(*x.columns)).withColumn("copies", F.col("sure") + F.col("extra"))
    used = done.where("copies > 0").select("doc_id", "source", "lang_code", "topic", "n_tokens", "copies")
    told = spark.createDataFrame([(s, float(shares[i]), int(held[i])) for i, s in enumerate(names)], "source string, target_share double, available_tokens long")
    sums = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_copies"))
    report = told.join(sums, "source", "left").na.fill(0, ["tokens", "n_docs", "most_copies"])
    report = report.withColumn("actual_share", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy())), F.lit(0.0)))
    want = {("language", "lang_code"): 1, ("topic", "topic"): 2}
    rows = [(name, v, float(tokens[index[:, k] == i].sum() / tokens.sum())) for (name, _), k in want.items() for i, v in enumerate(kinds[k - 1])] if use else []
    wanted = spark.createDataFrame(rows, "marginal string, value string, target_share double")
    got = used.select(F.explode(F.array(*[F.struct(F.lit(name).alias("marginal"), F.col(c).alias("value")) for name, c in want])).alias("x"), (F.col("n_tokens") * F.col("copies")).alias("t")).groupBy("x.marginal", "x.value").agg(F.sum("t").alias("tokens"))
    marginals = wanted.join(got, ["marginal", "value"], "left").na.fill(0, ["tokens"])
    marginals = marginals.withColumn("actual_share", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy("marginal"))), F.lit(0.0)))
    return used, report.select("source", "target_share", "actual_share", "tokens", "available_tokens", "n_docs", "most_copies"), marginals.select("marginal", "value", "target_share", "actual_share", "tokens")
