"""Names by levels against naming one row after the other."""

import numpy as np
import pytest

from sheetwise.operators import matching


def one_by_one(names, taken):
    used, out = set(taken), []
    for name in names:
        stem, dot, ext = name.rpartition(".")
        stem, tail = (stem, dot + ext) if dot else (name, "")
        found = next(c for c in (name if i == 0 else f"{stem} ({i}){tail}" for i in range(10000)) if c not in used)
        used.add(found)
        out.append(found)
    return out


def named(spark, names, taken):
    batch = spark.createDataFrame(list(enumerate(names)), "id long, name string").repartition(4)
    reserved = spark.createDataFrame([(t,) for t in taken], "name string")
    got = {r.id: r.final_name for r in matching.assign_unique_names(batch, reserved, "id").collect()}
    return [got[i] for i in range(len(names))]


@pytest.mark.parametrize("seed", [1])
def test_as_if_one_by_one(spark, seed):
    rng = np.random.default_rng(seed)
    forms = ["", " (1)", " (2)", " (3)", " (7)", " (1) (1)", " (1) (2)", " (2) (1)", " (1) (1) (1)", " (01)", " (0)"]
    weights = np.array([8, 3, 2, 2, 1, 2, 1, 1, 1, 1, 1]) / 23
    names = [f"{rng.choice(['a', 'b', 'c.d'])}{rng.choice(forms, p=weights)}{rng.choice(['.txt', '', '.x'])}" for _ in range(400)]
    taken = ["a (2).txt", "a.txt", "b (1) (1)", "b (3).x", "c.d (1).txt"]
    assert named(spark, names, taken) == one_by_one(names, taken)


def test_a_thousand_collisions_take_a_round_for_each_depth(spark, monkeypatch):
    names = [n for i in range(1, 1001) for n in ("a.txt", f"a ({i}).txt")] + ["a (5) (1).txt", "a (5) (1).txt"]
    rounds = []
    settle = matching.settle
    monkeypatch.setattr(matching, "settle", lambda df, label: rounds.append(label) or settle(df, label))
    assert named(spark, names, []) == one_by_one(names, [])
    assert rounds.count("level") == 3


def test_no_rows(spark):
    assert named(spark, [], ["a.txt"]) == []
