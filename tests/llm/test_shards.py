import zlib

import numpy as np
import pytest

from clickweir.llm import shards
from clickweir.session import scratch


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 4, 5, 16, 17, 1000, 4096, 100_003])
def test_permutation(rows):
    permutation = shards.Permutation(rows, "seed")
    places = permutation.forward(np.arange(rows))
    assert sorted(places) == list(range(rows))
    assert (permutation.inverse(places) == np.arange(rows)).all()
    if rows >= 1000:
        assert (places != shards.Permutation(rows, "other").forward(np.arange(rows))).mean() > 0.9
        with pytest.raises(ValueError):
            permutation.forward([rows])


def test_large_numbers_and_spread():
    large = shards.Permutation((1 << 62) - 5)
    some = np.arange(0, 1 << 61, (1 << 61) // 1000)
    assert (large.inverse(large.forward(some)) == some).all()
    places = shards.Permutation(80_000).forward(np.arange(80_000))
    for block in range(0, 80_000, 8000):    # neighbours in the table go to all shards and to all parts of them
        counts = np.bincount(places[block:block + 8000] % 8, minlength=8)
        assert counts.min() > 850 and counts.max() < 1150
        assert abs((places[block:block + 8000] // 8).mean() - 5000) < 200
    assert abs(np.corrcoef(places[:-1], places[1:])[0, 1]) < 0.02


def test_every_row_has_its_slot(spark, docs):
    rows = [(i, f"text {i} é" * (i % 5)) for i in range(300)] + [(None, None), (5, "again"), (5, "again"), (-3, ""), (6, None)] + [(9, "same")] * 40
    once, again = (shards.assign(spark, docs(rows).repartition(n), shards=7).collect() for n in (3, 11))
    assert sorted(map(tuple, once), key=repr) == sorted(map(tuple, again), key=repr)
    assert len(once) == len(rows) and {r["law"] for r in once} == {"rows"}
    slots = {}
    for r in once:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert (r["shard"], r["slot"]) == shards.locate(r["number"], len(rows), 7) and shards.number_at(r["shard"], r["slot"], len(rows), 7) == r["number"]
    for shard in range(7):
        assert sorted(slots[shard]) == list(range(shards.shard_rows(shard, len(rows), 7)))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    want = sorted((key is not None, key or 0, len((text or "").encode()) + 1, zlib.crc32((text or "").encode())) for key, text in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in once) == want
    in_order = [r["doc_id"] for r in sorted(once, key=lambda r: r["number"])]
    assert in_order[0] is None and in_order[1:] == sorted(in_order[1:])


def test_few_rows_and_none(spark, docs):
    assert shards.assign(spark, docs([])).collect() == []
    (only,) = shards.assign(spark, docs([(1, None)])).collect()
    assert (only["size"], only["text_crc32"], only["shard"], only["slot"]) == (1, 0, 0, 0)
    assert sorted(r["shard"] for r in shards.assign(spark, docs([(1, "a"), (2, "b"), (3, "c")])).collect()) == [0, 1, 2]


def test_written_shards(spark, docs):
    """All columns come back from the computed place, from the parts that hold it alone."""
    rows = docs([(i, f"text {i}") for i in range(100)]).selectExpr("*", "'y' AS number", "'y' AS kept", "'y' AS shard", "'y' AS part", "map('a', doc_id) AS m")
    path = scratch(spark, "shards")
    shards.write_shards(spark, rows, path, shards=3, slots=10)
    shard, slot = shards.locate(42, 100, 3)
    (found,) = shards.read_slots(spark, path, shard, slot, slot + 1, slots=10).collect()
    assert found["row"]["doc_id"] == 42 and found["row"]["kept"] == "y" and found["row"]["m"] == {"a": 42} and set(found["row"].asDict()) == set(rows.columns)
    for shard in range(3):
        got = [r["slot"] for r in shards.read_slots(spark, path, shard, 5, slots=10).collect()]
        assert sorted(got) == list(range(5, shards.shard_rows(shard, 100, 3)))
    files = shards.read_slots(spark, path, 0, 12, 18, slots=10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in files and "shard" in files and "part" in files.split("PartitionFilters")[1][:300]
