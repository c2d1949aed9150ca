"""Event operators where one job has nearly all events, against plain loops."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from kilnspark.operators import ledger, lifecycle
from kilnspark.operators.scan import blocks
from kilnspark.operators.shared import Scratch


def test_a_million_events_of_one_job(spark):
    n = 1_000_000
    events = spark.range(n).select(F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(99).alias("job"), (F.col("id") * 7919 % n).alias("at"), (F.col("id") % 3).alias("cost"))
    held = blocks(events, ["job"], [F.col("at")], Scratch(spark))
    shares = [r["count"] for r in held.where("job = 99").groupBy("__block").count().collect()]
    assert len(shares) >= 3 and max(shares) < 0.5 * n
    state = ledger.budget_state(events, "job", ["at"], "cost", 400_000)
    whole = {r["job"]: (r["n"], r["total"], r["last"]) for r in state.groupBy("job").agg(F.count("*").alias("n"), F.sum("cost").alias("total"), F.max("spent").alias("last")).collect()}
    assert len(whole) == 8 and all(total == last for _, total, last in whole.values()) and sum(x[0] for x in whole.values()) == n
    # running sums never fall, and grow by the event's own cost
    numbered = ledger.next_sequence(events.limit(0).select("job", F.lit(0).alias("sequence")), state.drop("over"), "job", ["at"])
    pairs = numbered.alias("a").join(numbered.alias("b"), F.expr("a.job = b.job and b.sequence = a.sequence + 1"))
    assert pairs.where("b.spent <> a.spent + b.cost or b.at <= a.at").count() == 0 and pairs.count() == n - 8


def test_windows_of_a_hot_principal(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 20 else rng.choice(["x", None]), None if i % 97 == 0 else rng.randrange(3000)) for i in range(4000)]
    got = {r["id"]: r["in_window"] for r in ledger.sliding_count(spark.createDataFrame(rows, "id int, who string, s long"), "who", F.col("s"), 60).collect()}
    by = defaultdict(list)
    for i, who, s in rows:
        by[who].append((i, s))
    want = {}
    for members in by.values():
        for i, s in members:
            want[i] = sum(t is None if s is None else t is not None and s - 60 < t <= s for _, t in members)
    assert got == want


def test_states_and_versions_of_a_hot_job(spark):
    states = list(ledger.JOB_TRANSITIONS)
    rows = [("hot", i, states[i * 7 % len(states)]) for i in range(3000)] + [("cold", i, states[0]) for i in range(3)]
    df = spark.createDataFrame(rows, "job string, n int, state string")
    got = {(r["job"], r["n"]) for r in ledger.invalid_transitions(df, "job", ["n"], "state").collect()}
    want = {(b[0], b[1]) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and b[2] not in ledger.JOB_TRANSITIONS.get(a[2], ())}
    assert got == want and want
    chain = lifecycle.version_chain(df.withColumnRenamed("n", "version_id"), "job", ["version_id"]).collect()
    assert all((r["parent_version_id"], r["version_no"]) == (r["version_id"] - 1 if r["version_id"] else None, r["version_id"] + 1) for r in chain)
    newest = lifecycle.latest(df, "job", [F.col("n")]).collect()
    assert {(r["job"], r["n"]) for r in newest} == {("hot", 2999), ("cold", 2)}


def test_limits_of_a_hot_job(spark):
    rows = [("hot", i, 3, "m" if i % 4 else "n") for i in range(2000)]
    calls = spark.createDataFrame(rows, "job string, at int, cost_micro long, model string").withColumns({"input_tokens": F.lit(1).cast("long"), "output_tokens": F.lit(2).cast("long")})
    got = {r["at"]: r for r in ledger.budget_checks(calls, "job", ["at"], {"cost": 4500}, per_model={"n": 600}).collect()}
    spent, model = 0, {"m": 0, "n": 0}
    for _, at, cost, name in rows:
        spent, model[name] = spent + cost, model[name] + cost
        r = got[at]
        assert (r["spent_cost"], r["spent_calls"], r["spent_output_tokens"], r["spent_model"]) == (spent, at + 1, 2 * at + 2, model[name])
        assert r["exceeded"] == ("cost" if spent >= 4500 else "model_cost" if name == "n" and model["n"] >= 600 else None)
