import tracemalloc

import numpy as np
import pyarrow as pa

from gaugeflow.operators import compare
from gaugeflow.operators.metrics import ranking_metrics


def table(n, blocks, block, seed=1):
    g = np.random.default_rng(seed)
    columns = {"g": pa.array(["one"] * n), "__m": pa.array([f"one|member{i}" for i in range(n)]), "__s": pa.array(g.random(n).round(3)), "__y": pa.array((g.random(n) < 0.1).astype(float)), "__n": pa.array(np.ones(n))}
    return pa.table({**columns, "__blocks": pa.array([blocks] * n, pa.int32()), "__block": pa.array([block] * n, pa.int32())})


def test_a_million_members_stay_below_500_mb():
    rows = table(1_000_000, 125, 3)
    tracemalloc.start()
    got = compare._drawn(["g"], 1000, "s")(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.column("b").to_pylist() == list(range(24, 32)) and got.column("ap").null_count == 0
    assert peak + rows.nbytes < 500e6


def test_blocks_of_draws_together_are_all_draws():
    whole = compare._drawn(["g"], 30, "s")(table(500, 1, 0)).to_pydict()
    parts = [compare._drawn(["g"], 30, "s")(table(500, 3, i)).to_pydict() for i in range(3)]
    assert whole["b"] == list(range(30))
    assert [x for p in parts for x in p["b"]] == whole["b"] and [x for p in parts for x in p["ap"]] == whole["ap"]


def test_tasks_of_few_cells_equal_rows_weighted_in_sql(spark, monkeypatch):
    g = np.random.default_rng(2)
    rows = [(None if i % 3 == 0 else "x", f"m{i % 40}", float(g.integers(0, 12)), int(g.random() < 0.4), 1) for i in range(400)]
    slim = spark.createDataFrame(rows, "g string, member string, score double, event_label int, rows long")
    weighted = compare.with_draws(slim, ["g", "member"], 21, "w")
    want = {(r["g"], r["b"]): r["ap"] for r in ranking_metrics(weighted, ["g", "b"], weight=(weighted["rows"] * weighted["times"]).cast("double")).collect()}
    for cells in (10_000_000, 900, 1):
        monkeypatch.setattr(compare, "TASK_CELLS", cells)
        got = compare.drawn_ap(slim, ["g"], ["g", "member"], 21, "w").collect()
        assert sorted((r["g"] or "", r["b"]) for r in got) == sorted((k or "", b) for k in (None, "x") for b in range(21))
        assert all(abs(r["ap"] - want[r["g"], r["b"]]) < 1e-9 for r in got)


def test_memory_of_a_task_does_not_grow_with_its_rows():
    g = np.random.default_rng(3)

    def batches(n):
        for i in range(n):
            rows, m = 10_000, pa.array([f"one|member{j}" for j in g.integers(0, 900, 10_000)])
            score = np.sort(g.random(rows).round(4))[::-1] + (n - i)
            numbers = {"__s": pa.array(score), "__y": pa.array((g.random(rows) < 0.1).astype(float)), "__n": pa.array(np.ones(rows))}
            yield pa.record_batch({"g": pa.array(["one"] * rows), "__m": m, **numbers, "__blocks": pa.array([1] * rows, pa.int32()), "__block": pa.array([0] * rows, pa.int32())})

    tracemalloc.start()
    (got,) = compare._drawn_sorted(["g"], 16, "s")(batches(40))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 16 and got.column("ap").null_count == 0
    assert peak < 12e6  # the scores, labels, members and weights of 400,000 rows take more
