import random

from strandweave.llm.runs import collapsed_runs

SCHEMA = "subject_id string, clustering_desc string, segment_id int, start_idx int, end_idx int, length int, cluster_id int, s string"


def brute(rows, gap=10):
    seen = {}
    for a, d, i, s, e, n, k, _ in rows:
        e = e if e is not None else (s + n - 1 if s is not None and n is not None else None)
        if s is not None and e is not None:
            seen[a, d, i] = min(seen.get((a, d, i), ((1 << 40),)), (s, e, k), key=lambda t: t[:2])
    out = []
    for ent in {x[:2] for x in seen}:
        run = None
        for s, e, i, k in sorted((s, e, i if i is not None else -1, k) for (a, d, i), (s, e, k) in seen.items() if (a, d) == ent):
            if run and k is not None and run["k"] == k and s - run["e"] - 1 <= gap:
                run["c"] |= set(range(s, e + 1))
                run["e"], run["n"] = max(run["e"], e), run["n"] + 1
            else:
                run = {"k": k, "s": s, "e": e, "n": 1, "c": set(range(s, e + 1))}
                out.append((*ent, run))
    return sorted([(a, d, r["k"], r["s"], r["e"], r["n"], len(r["c"])) for a, d, r in out], key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        s = rng.randrange(3000)
        n = rng.randrange(1, 40)
        rows.append((rng.choice(["a", "b", None]), rng.choice(["x", "y"]), i, s, rng.choice([s + n - 1, None]), n, rng.choice([1, 1, 1, 2, None]), "extra"))
    rows += [rows[3], rows[4], ("a", "x", 5000, None, 4, 2, 1, ""), ("a", "x", 5001, 7, None, None, 1, "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 7, 60):
        got = sorted([tuple(r) for r in collapsed_runs(df, partitions=parts).collect()], key=str)
        assert got == brute(rows)


def test_one_run_over_many_chunks_and_empty(spark):
    rows = [("a", "x", i, 20 * i, 20 * i + 9, 10, 1, "") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in collapsed_runs(df, partitions=20).collect()] == [("a", "x", 1, 0, 9989, 500, 5000)]
    assert collapsed_runs(df.limit(0)).count() == 0


def test_long_overlaps_reach_over_partitions(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        s = rng.randrange(2500)
        n = rng.choice([1, 3, 900]) if i % 50 == 0 else rng.randrange(1, 4)
        rows.append(("a", "x" if i % 3 else None, i, s, s + n - 1, n, rng.choice([1] * 30 + [2, None]), ""))
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 9, 200):
        assert sorted([tuple(r) for r in collapsed_runs(df, partitions=parts).collect()], key=str) == brute(rows)


def test_small_batches(spark):
    rng = random.Random(9)
    rows = [("a", "x", i, s := rng.randrange(4000), s + rng.randrange(12), 1, rng.choice([1, 1, 1, 2]), "") for i in range(800)]
    rows = [(a, d, i, s, e, e - s + 1, k, x) for a, d, i, s, e, _, k, x in rows]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted([tuple(r) for r in collapsed_runs(spark.createDataFrame(rows, SCHEMA), partitions=5).collect()], key=str) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
