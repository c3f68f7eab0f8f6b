import math

from clickweir.llm import mixing


def water(sizes, weights=(1, 2, 3), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(epochs * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: epochs * sizes[s] if s in full else left * weight[s] / total for s in names}
        new = {s for s in names if s not in full and target[s] > epochs * sizes[s]}
        if not new:
            return target
        full |= new


def check(spark, frame, rows):
    got = mixing.mix(spark, frame).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    target, longest = water(sizes), max(len((t or "").split()) for _, t, _, _ in rows)
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], abs_tol=1e-6)
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) <= sum(sizes.values())
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 2 * longest + 1, (source, taken[source], target[source])
    return sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in got)


def test_targets_and_shares(spark, docs):
    rows = [(i, "w " * (i * 7 % 13), "en", "abcdefg"[i % 7] if i % 3 else "a") for i in range(400)]
    rows += [(500, None, "en", None), (501, "x y z", "en", None), (502, "", "en", "empty"), (7, "w w", "en", "b"), (7, "w w", "en", "b"),
             (None, "q", None, "Z"), (503, "r " * 900, "en", "é"), (504, "r\x0bs\u00a0t", "en", "zz")]
    assert check(spark, docs(rows), rows) == check(spark, docs(rows).repartition(7), rows)


def test_one_source_and_none(spark, docs):
    rows = [(i, "a b", "en", None) for i in range(9)]
    assert all(taken == 2 for _, _, taken in check(spark, docs(rows), rows))
    assert mixing.mix(spark, docs([])).count() == 0
    assert [r["taken"] for r in mixing.mix(spark, docs([(1, None), (2, " ")])).collect()] == [0, 0]
