import numpy as np
import pytest

from clickweir.llm import neighbours


def brute(rows):
    ids, vectors = [], []
    for key, values in rows:
        if values and None not in values and np.isfinite(values).all() and np.any(values):
            v = np.array(values, np.float64)
            ids.append(key)
            vectors.append(v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()))
    near = np.array([[len(v) == len(w) and v @ w >= 0.95 for w in vectors] for v in vectors])
    label = np.arange(len(ids))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    lowest = {c: min(ids[i] for i in np.flatnonzero(label == c)) for c in set(label.tolist())}
    out = {key: (0, key, True) for key, _ in rows}
    for i, key in enumerate(ids):
        out[key] = (int(near[i].sum()) - 1, lowest[label[i]], lowest[label[i]] == key)
    return out


def sample(n, seed):
    pick = np.random.default_rng(seed)
    rows = [(1000 + i, v.tolist()) for i, v in enumerate(pick.normal(size=(n, 16)).astype(np.float32))]
    for base in range(25):
        for copy in range(pick.integers(1, 9)):
            rows.append((len(rows) * 3, (np.array(rows[base][1]) + pick.normal(size=16) * pick.choice([0.0, .05, .25])).tolist()))
    return rows


@pytest.mark.parametrize("block", [2048, 60])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "SHARD", 150)
    rows = sample(700, block) + [(5, None), (6, []), (7, [0.0] * 16), (8, [None] + [1.0] * 15), (9, [float("nan")] * 16), (10, [float("inf")] + [1.0] * 15),
                                 (11, [1.0, 2.0]), (12, [1.0, 2.0]), (13, [1e-30] * 16), (14, [1e30] * 16), (15, [3.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS node", "2 AS unit", "3 AS n")
    got = neighbours.near_duplicates(spark, frame).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    true, found = sum(n for n, _, _ in want.values()), sum(r["n_links"] for r in got)
    assert 0.97 * true <= found <= true and got[0]["audited_recall"] > 0.95
    assert sum((r["n_links"], r["component_id"], r["kept"]) == want[r["vec_id"]] for r in got) >= 0.97 * len(rows)
    assert {r["vec_id"]: r["n_links"] for r in got}[13] == 2


def test_equal_vectors(spark):
    frame = spark.createDataFrame([(i % 40, [1.0, 2.0, 3.0]) for i in range(3000)] + [(None, [1.0, 2.0, 3.0]), (50, [1.0, 2.0, -3.0])], "vec_id long, embedding array<float>")
    got = neighbours.near_duplicates(spark, frame).collect()
    assert len(got) == 3002 and {(r["n_links"], r["component_id"]) for r in got} == {(3000, 0), (0, 50)}


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.near_duplicates(spark, frame).count() == 0


def test_lengths_link_among_themselves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 60)
    pick = np.random.default_rng(5)
    rows = [(i, pick.normal(size=8).tolist()) for i in range(300)] + [(500 + i, pick.normal(size=6).tolist()) for i in range(200)]
    rows += [(1000 + i, (np.array(rows[i * 4][1]) * 3).tolist()) for i in range(100)]
    rows += [(2000 + i, [1.0] * (i // 2 + 1)) for i in range(24)]  # a pair of each length; those of 8 and 6 stand alone
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = brute(rows)
    assert sum(n for n, _, _ in want.values()) >= 200 and {k: (r["n_links"], r["component_id"], r["kept"]) for k, r in got.items()} == want


def test_a_low_recall_searches_again_and_then_raises(spark, monkeypatch):
    frame = spark.createDataFrame(sample(100, 3), "vec_id long, embedding array<double>")
    overlaps, linked = [], neighbours.linked
    monkeypatch.setattr(neighbours, "linked", lambda spark, nodes, overlap: (overlaps.append(overlap), linked(spark, nodes, overlap))[1])
    monkeypatch.setattr(neighbours, "audited_recall", lambda nodes, links: 0.8 if len(overlaps) < 2 else 0.95)
    assert neighbours.near_duplicates(spark, frame).first()["audited_recall"] == 0.95 and overlaps == [3, 6]
    monkeypatch.setattr(neighbours, "audited_recall", lambda nodes, links: 0.8)
    with pytest.raises(RuntimeError, match="0.800"):
        neighbours.near_duplicates(spark, frame)
    assert overlaps == [3, 6, 3, 6, 12]
