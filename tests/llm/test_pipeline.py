"""The stages against plain definitions, on documents with every awkward case and on the smallest data set."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from .test_leaks import held
from .test_mixing import water
from .test_simhash import lowest, plain
from tokenizers import Tokenizer

import corpus_pipeline
from clickweir.llm import language, leaks, simhash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_rows(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def plain_language(spark, df):
    model = language.Classifier(language.learn(df.where(~language.held_out())))
    out = Counter()
    for row, n in plain_rows(df).items():
        name, _, margin = model.predict((language.letters(pa.array([row[1] or ""]))[0].as_py() or "").encode())
        if name != "und" and margin >= language.MARGIN:
            out[row] += n
    return out


def plain_dedup(df):
    rows = plain_rows(df)
    prints = {row: plain(row[1]) for row in rows}
    group = lowest(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    best = {}
    for row, p in prints.items():
        order = (row[0] is None, row[0] or 0)
        best[group[p]] = min(best.get(group[p], (order, row)), (order, row), key=lambda x: (x[0], str(x[1])))
    return Counter(row for _, row in best.values())


def plain_clean(df, items):
    return Counter({row: n for row, n in plain_rows(df).items() if not any(held(i, row[1]) for i in items)})


def plain_mix(df):
    rows = sorted(plain_rows(df).elements(), key=lambda r: str(r))
    size = lambda r: len((r[1] or "").encode().split())
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r)
    target, queue = water(sizes), []
    for source in sizes:
        at = 0
        own = sorted((r for r in rows if r[3] == source), key=lambda r: (hashlib.md5(f"mix{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, size(r)))
        for r in own:
            at += size(r)
            if size(r):
                queue += [((epoch * sizes[source] + at) / target[source], (source is None, source or ""), epoch, r) for epoch in range(3)]
    out, served = Counter(), 0
    for _, _, _, r in sorted(queue, key=lambda q: q[:3]):
        served += size(r)
        if served > sum(sizes.values()):
            break
        out[r] += 1
    return out


@pytest.fixture(scope="module")
def smallest(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_on_the_smallest_data(spark, smallest):
    df = smallest
    items = [leaks.Item(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = {"language_id": lambda d: plain_language(spark, d), "simhash_dedup": plain_dedup,
                "decontamination": lambda d: plain_clean(d, items), "source_mixing": plain_mix}
    assert [name for name, _ in corpus_pipeline.STAGES] == [*expected, "token_output"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, SF).cache()
        assert sorted(got.columns) == sorted(COLUMNS)
        want = expected[name](df)
        assert plain_rows(got) == want, name
        df = got
    got = corpus_pipeline.STAGES[-1][1](spark, df, SF).collect()
    model = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r["doc_id"], len(model.encode(r["text"], add_special_tokens=False).ids) + 1) for r in df.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == want
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0] + [r["n_tokens"] for r in ordered])[:-1].tolist()


def test_awkward_rows(spark, docs):
    pick = random.Random(4)
    text = lambda n: " ".join(pick.choice(["the thing", "and with", "often there"]) + str(pick.randrange(99)) for _ in range(n))
    rows = [(i, text(1 + i % 40), "en", f"s{i % 4}") for i in range(60)]
    rows += [(60, None, "en", "s1"), (61, "", None, None), (62, "12 34 ,", "en", "s2"), (63, "der die das und nicht " * 20, "de", None), (64, text(50_000), "en", "s0"),
             (None, text(9), "en", None), (5, rows[5][1], "en", "s1"), (5, rows[5][1], "en", "s1"), (66, text(30), None, "s3")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = docs(rows)
        got = stage(spark, frame, SF)
        assert got.columns == frame.columns and got.where("size <> 'x' OR copies <> 2 OR leaks <> 'x'").count() == 0, name
        assert stage(spark, docs([]), SF).count() == 0, name
    assert plain_rows(corpus_pipeline.STAGES[1][1](spark, docs(rows), SF)) == plain_dedup(docs(rows))
    assert plain_rows(corpus_pipeline.STAGES[3][1](spark, docs(rows), SF)) == plain_mix(docs(rows))


def test_names_with_underscores_come_back_unchanged(spark, docs):
    frame = docs([(i, f"plain words number {i} of an ordinary text in a language like others", "en", "ab"[i % 2]) for i in range(40)] * 2)
    names = [c for c in frame.columns if c.startswith("_")]
    given = frame.select(*names).first()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, frame, SF)
        rows = got.select(*names).distinct().collect()
        assert got.columns == frame.columns and rows == [given], name


def test_dedup_broadcasts_no_keys(spark, docs, monkeypatch):
    """Forty keys a fingerprint: Spark takes them to be as large as the fingerprints, so at some 0.6 GB it sent them all to the driver."""
    plans, keep = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda spark, links: plans.append(links._jdf.queryExecution().executedPlan().toString()) or keep(spark, links))
    frame = docs([(i, f"a{i} b{i} c{i} d{i}") for i in range(50)] + [(99, "a1 b1 c1 d1")])
    assert corpus_pipeline.STAGES[1][1](spark, frame, SF).count() == 50
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_run(spark, smallest):
    got = corpus_pipeline.run(spark, SF)
    assert 0 < got.count() < 3 * smallest.count() and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
