"""Reply trees against plain recursion, and plans that do not grow with a conversation."""

import random

from pyspark.sql import functions as F

from topicloom.llm import chat
from topicloom.runtime import cut

COLUMNS = "conv long, msg long, parent long, role string, text string, score double"


def random_trees(rng, many):
    rows = []
    for c in range(many):
        for m in range(rng.randrange(1, 40)):
            parent = None if m == 0 or rng.random() < 0.05 else rng.randrange(max(0, m - rng.choice([1, 1, 6])), m)
            rows.append((c, m, parent, rng.choice(["user", "assistant"]), f"t{c}.{m} ### a", rng.choice([0.0, 0.25, 0.5])))
    return rows


def plain_paths(rows, branches):
    """conv -> the best root-to-leaf paths, by the sum of scores, ties by the leaf's number."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = {r[1]: r for r in rows if r[0] == conv}
        answered = {r[2] for r in mine.values()}
        found = []
        for leaf in mine:
            if leaf in answered:
                continue
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = mine[at][2]
            found.append((-sum(mine[m][5] for m in path), leaf, path[::-1]))
        out[conv] = [[mine[m] for m in p] for _, _, p in sorted(found)[:branches]]
    return out


def test_best_branches_equal_plain_recursion(spark):
    rows = random_trees(random.Random(8), 60)
    df = cut(spark.createDataFrame(rows, COLUMNS).repartition(5))
    made = chat.format_paths(df, "conv", "msg", "parent", "score", "role", "text", branches=3)
    made = made.withColumns(
        {"turns": chat.read_turns(F.col("formatted")), "said": chat.read_loss(F.col("formatted"), F.col("loss"))}
    )
    got = {}
    for r in made.collect():
        got.setdefault(r.conv, {})[r.branch] = r
    want = plain_paths(rows, 3)
    assert set(got) == set(want)
    for conv, paths in want.items():
        assert sorted(got[conv]) == list(range(1, len(paths) + 1))
        for i, path in enumerate(paths, 1):
            assert [tuple(t) for t in got[conv][i].turns] == [(m[3], m[4]) for m in path]
            assert got[conv][i].said == [m[4] for m in path if m[3] == "assistant"]


def test_the_plan_does_not_grow_with_a_conversation(spark):
    plans = []
    for turns in (16, 2000):
        rows = [(1, i, i - 1 if i else None, "user", f"t{i}", 0.0) for i in range(turns)] + [(2, 0, None, "user", "x", 0.0)]
        df = cut(spark.createDataFrame(rows, COLUMNS))
        out = chat.format_paths(df, "conv", "msg", "parent", "score", "role", "text")
        plans.append(out._jdf.queryExecution().optimizedPlan().toString().count("Join"))
        read = {r.conv: r.turns for r in out.select("conv", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
        assert [t.text for t in read[1]] == [f"t{i}" for i in range(turns)] and len(read[2]) == 1
    assert plans[0] == plans[1]
