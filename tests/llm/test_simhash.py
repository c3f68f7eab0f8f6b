import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clickweir.llm import simhash

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = (text or "").translate(A_TO_Z).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def lowest(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def test_documents_against_brute_force(spark, docs):
    pick = random.Random(3)
    base = [" ".join(pick.choice("abcdefghij") * pick.randint(1, 3) for _ in range(80)) for _ in range(6)]
    texts = [None, "", " \n", "one", "One two", "x y z", "a b c É d e", "X y Z"] + base
    for text in base:
        for _ in range(12):
            words = text.split()
            words[pick.randrange(80)] = "new%d" % pick.randrange(9)
            texts.append(" ".join(words))
    texts += [base[0]] * 5 + ["long word " * 40_000]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    prints = {i: plain(t) for i, t in rows}
    want = lowest(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = simhash.near_duplicates(spark, docs(rows)).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert len(got) == len(rows)


def test_hash_is_the_one_of_spark(spark):
    got = spark.sql("SELECT xxhash64('one two') AS h").first()["h"]
    assert got == np.array([xxhash.xxh64_intdigest(b"one two", 42)], np.uint64).view(np.int64)[0]


@pytest.mark.parametrize("cell", [2048, 7])
def test_no_link_is_lost(spark, monkeypatch, cell):
    """Random and crowded fingerprints; small cells split every key into pairs of blocks."""
    monkeypatch.setattr(simhash, "CELL", cell)
    pick = random.Random(cell)
    fps = {0, 2**64 - 1, 2**63}
    for _ in range(40):
        seed = pick.getrandbits(64)
        for _ in range(12):
            fps.add(seed := seed ^ sum(1 << b for b in pick.sample(range(64), pick.randint(1, 5))))
    fps = sorted(fps)
    want = lowest(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    back = dict(zip(signed, fps))
    found = [(back[r["u"]], back[r["v"]]) for r in simhash.links(spark, spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    pairs = {frozenset(p) for p in found}
    assert lowest(fps, lambda a, b: frozenset((a, b)) in pairs) == want


def test_rows_without_id_and_no_rows(spark, docs):
    got = simhash.near_duplicates(spark, docs([(None, "a b"), (None, "a b"), (4, "A b"), (None, "z z z z z z")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 4), (-1, 4), (4, 4)]
    assert simhash.near_duplicates(spark, docs([])).count() == 0


def test_keys_are_merged_whatever_size_spark_takes_them_for(spark):
    found = simhash.links(spark, spark.range(3000).select(F.shiftleft(F.col("id"), 40).alias("fp")))
    assert len(found.collect()) >= 2999
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
