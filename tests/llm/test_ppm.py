import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from clickweir.llm import packs, ppm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Trie:
    """The model by its definition, one symbol at a time."""

    def __init__(self, texts):
        self.next = {}
        for text in texts:
            codes = [0] * ppm.ORDER + [b + 1 for b in text] + [0]
            for i in range(ppm.ORDER, len(codes)):
                for k in range(ppm.ORDER + 1):
                    self.next.setdefault(tuple(codes[i - k:i]), Counter())[codes[i]] += 1

    def chance(self, context, symbol):
        p, excluded = 1.0, set()
        for k in range(ppm.ORDER, -1, -1):
            seen = {s: n for s, n in self.next.get(tuple(context[len(context) - k:]), {}).items() if s not in excluded}
            n, q = sum(seen.values()), len(seen)
            if not q:
                continue
            if symbol in seen:
                return p * (2 * seen[symbol] - 1) / (2 * n)
            p *= q / (2 * n)
            excluded |= set(seen)
        return p / (ppm.SYMBOLS - len(excluded))

    def log10(self, text):
        codes = [0] * ppm.ORDER + [b + 1 for b in text] + [0]
        return sum(math.log10(self.chance(codes[i - ppm.ORDER:i], codes[i])) for i in range(ppm.ORDER, len(codes)))


def test_chances_sum_to_one():
    trie = Trie([b"abracadabra", b"abc", b""])
    for context in ([0] * 5, [0, 98, 99, 115, 98], [9, 1, 2, 3, 4]):
        assert math.isclose(sum(trie.chance(context, s) for s in range(ppm.SYMBOLS)), 1)


@pytest.mark.parametrize("dense,size", [(1 << 24, 4 << 20), (100, 300)])
def test_against_brute_force(spark, docs, monkeypatch, dense, size):
    monkeypatch.setattr(ppm, "DENSE", dense)
    monkeypatch.setattr(ppm, "PACK_BYTES", size)
    monkeypatch.setattr(ppm, "MERGED", 2)
    monkeypatch.setattr(ppm, "WORDS_PER_BUCKET", 20)
    pick = random.Random(8)
    rows = [(i, " ".join(pick.choice(["the", "The", "cat", "Sat", "ÉTÉ", "über", "on\tmat", "a\x00b", "x%d" % pick.randrange(99)]) for _ in range(pick.randrange(25))))
            for i in range(90)]
    rows += [(100, None), (101, ""), (102, " \n "), (103, "日本 ÿ"), (104, "cat " * 3000), (5, rows[5][1]), (None, "the cat")]
    train = [(k, t or "") for k, t in rows if ppm.in_training(k)]
    trie = Trie([t.encode() for _, t in train])
    counts = Counter(w for _, t in train for w in t.translate(LOWER).encode().split())
    counts[b""] = len(train)
    total = sum(counts.values())
    got = ppm.score(spark, docs(rows).repartition(3)).collect()
    assert len(got) == len(rows)
    want = {}
    for key, text in rows:
        text = text or ""
        own = [*text.translate(LOWER).encode().split(), b""]
        want[key] = (len(own), sum(counts[w] > 0 for w in own), total, sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own), trie.log10(text.encode()))
    for r in got:
        assert r["trained"] == ppm.in_training(r["doc_id"])
        assert np.allclose([r[n] for n in ("n_tokens", "n_known", "train_tokens", "base_score", "score")], want[r["doc_id"]], rtol=1e-6)


def test_nothing_to_learn(spark, docs):
    assert ppm.score(spark, docs([])).count() == 0
    got = ppm.score(spark, docs([(1, "ab")]), lambda _: False).first()
    assert math.isclose(got["score"], -3 * math.log10(257), rel_tol=1e-6) and (got["n_tokens"], got["n_known"], got["train_tokens"], got["base_score"]) == (2, 0, 0, 0)


def row_of(texts):
    return {"pack": 0, "doc_ids": list(range(len(texts))), "lens": [len(t) for t in texts], "body": packs.squeeze(b"".join(texts))}


def test_paths_of_texts_that_are_sorted_in_several_runs(monkeypatch):
    monkeypatch.setattr(ppm, "DENSE", 7)
    pick = random.Random(3)
    texts = [bytes(pick.choice(b"ab\x00\xff ") for _ in range(pick.choice([0, 0, 1, 4, 40]))) for _ in range(50)]
    want = []
    for text in texts:
        codes = [0] * ppm.ORDER + [b + 1 for b in text] + [0]
        want.append(Counter(sum(c * ppm.SYMBOLS ** k for k, c in enumerate([codes[i], *codes[i - ppm.ORDER:i]])) for i in range(ppm.ORDER, len(codes))))
    keys, counts = ppm.Counted(row_of(texts), lambda i: i % 3 == 0).grams()
    trained = sum(want[::3], Counter())
    assert keys.tolist() == sorted({k for w in want for k in w}) and counts.tolist() == [trained[k] for k in keys.tolist()]
    got = []
    for own, often, of, n in ppm.Counted(row_of(texts), lambda _: True).by_text():
        assert n <= 7 and own.tolist() == sorted(set(own.tolist()))
        some = [Counter() for _ in range(n)]
        for key, text in zip(np.repeat(own, often).tolist(), of.tolist()):
            some[text][key] += 1
        got += some
    assert got == want


def test_only_empty_texts():
    held = ppm.Counted(row_of([b"", b""]), lambda _: True)
    keys, counts = held.grams()
    assert (keys.tolist(), counts.tolist()) == ([0], [2])
    words, counts, own = held.vocabulary(5)
    assert set(words.to_pylist()) == {b""} and (counts[-1], counts.sum()) == (2, 2) and len(set(own.tolist())) == 1


def test_counting_a_pack_costs_as_much_as_a_few_sorts_of_its_paths():
    pick = random.Random(4)
    words = [bytes(pick.choice(b"aaabcdeeeefghiiiklmnooooprsttuvwyz") for _ in range(pick.randrange(1, 11))) for _ in range(40000)]
    texts = [b" ".join(pick.choices(words, k=500)) for _ in range(1200)]

    def seconds(do):
        took = []
        for _ in range(3):
            began = time.process_time()
            do()
            took.append(time.process_time() - began)
        return min(took)
    row, numbers = row_of(texts), np.random.default_rng(5).integers(0, 1 << 49, sum(map(len, texts)), np.uint64)
    assert seconds(lambda: ppm.Counted(row, ppm.in_training).grams()) < 12 * seconds(lambda: np.sort(numbers))


def test_words_are_dealt_evenly_and_the_same_in_every_pack():
    words = [b"", *(b"w%d" % i for i in range(20000)), b"x" * 1000, *(bytes([b]) for b in range(128, 256))]
    own = ppm._word_buckets(pa.array(words, pa.large_binary()), 40)
    assert np.bincount(own, minlength=40).max() < 1.25 * len(words) / 40 and own.min() >= 0
    assert ppm._word_buckets(pa.array(words[::-3], pa.large_binary()).slice(5), 40).tolist() == own[::-3][5:].tolist()
