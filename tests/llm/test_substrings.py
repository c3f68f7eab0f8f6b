import random

import pytest

from clickweir.llm import packs, substrings


def brute(rows):
    words = [(key, (text or "").encode().split()) for key, text in rows]
    seen, out = set(), []
    for key, own in words:
        gone = [False] * len(own)
        for i in range(len(own) - 19):
            window = tuple(own[i:i + 20])
            if window in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(window)
        out.append((key, len(own), sum(gone), b" ".join(w for w, g in zip(own, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("size", [8 << 20, 4000])
def test_against_brute_force(spark, docs, monkeypatch, size):
    """Shared passages at all offsets, copies, self-repeats; packs of one and of several documents."""
    monkeypatch.setattr(packs, "PACK_BYTES", size)
    monkeypatch.setattr(substrings, "BUCKET_WORDS", 500)
    pick = random.Random(size)
    fresh = lambda n: " ".join(f"w{pick.randrange(10**6)}" for _ in range(n))
    shared = [fresh(n) for n in (19, 20, 21, 29, 30, 47, 400)]
    rows = []
    for i in range(120):
        parts = [fresh(pick.randrange(30)) if pick.random() < .7 else pick.choice(shared) for _ in range(5)]
        if pick.random() < .3:
            parts.append(" ".join(pick.choice(shared).split()[pick.randrange(9):]))
        rows.append((i * 2, "\n ".join(parts)))
    rows += [(300, rows[3][1]), (301, None), (302, " "), (303, "a b c"), (304, "a b c"), (305, "same " * 300), (306, "same " * 20 + "end"),
             (307, shared[1]), (308, "x " + shared[1].replace(" ", " ", 1) + " y"), (309, "Ünï\x0bcöde " * 30), (310, "long " + fresh(30_000))]
    got = substrings.dedup_substrings(spark, docs(rows).repartition(5)).collect()
    assert sorted((r["doc_id"], r["n_words"], sum(s["to"] - s["from"] for s in r["removed"]), r["kept"]) for r in got) == brute(rows)


def test_repeated_rows_and_none(spark, docs):
    text = " ".join(map(str, range(25)))
    got = substrings.dedup_substrings(spark, docs([(7, text), (7, text), (None, text)])).collect()
    assert sorted((r["doc_id"] or -1, len(r["kept"].split())) for r in got) == [(-1, 25), (7, 0), (7, 0)]
    assert substrings.dedup_substrings(spark, docs([])).count() == 0


def test_replies_move_no_packs(spark, docs):
    own = packs.write_packs(spark, docs([(1, "a")]), ordered=True)
    replies = spark.createDataFrame([(1, 0, b"x")], "pack long, bucket int, flags binary")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = packs.with_replies(own, replies, ["bucket", "flags"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(pack") == 1
