import random

import numpy as np
import pytest

from clickweir.llm import leaks


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_longest_common_subsequence():
    pick = random.Random(1)
    for _ in range(200):
        item = leaks.Item(1, " ".join(pick.choice("abcde") for _ in range(pick.randint(1, 40))))
        words = [pick.choice("abcdefg") for _ in range(pick.randrange(60))]
        assert round(item.found(words)[0] * len(item.words)) == subsequence(item.words, words)


def held(item, text):
    """The decision without retrieval: at every passage of the text."""
    words = leaks.plain_words(text or "")
    around = max(leaks.STEP, len(item.words))
    for start in range(0, len(words), leaks.STEP):
        matched, answered = item.found(words[max(0, start - around):start + leaks.SPAN + around])
        if matched >= leaks.VERBATIM or matched >= leaks.PARAPHRASE and answered >= leaks.ANSWER:
            return True
    return False


@pytest.mark.parametrize("pieces, terms, items_at_once", [(512, 1 << 14, 2000), (7, 1 << 14, 2000), (512, 300, 2000), (512, 1 << 14, 9)])
def test_against_brute_force(spark, docs, monkeypatch, pieces, terms, items_at_once):
    """Also with several latent spaces, with words that share dimensions, and in several passes over the items."""
    monkeypatch.setattr(leaks, "PIECES", pieces)
    monkeypatch.setattr(leaks, "TERMS", terms)
    monkeypatch.setattr(leaks, "ITEMS", items_at_once)
    pick = random.Random(pieces)
    common = ["the", "of", "and", "to", "in"]
    words = lambda n, kinds=30_000: [pick.choice(common) if pick.random() < .1 else f"w{int(kinds * pick.random() ** 2)}" for _ in range(n)]
    items = [(i, " ".join(words(n)) + ". The end " + " ".join(words(3)) + ".") for i, n in enumerate([8, 12, 20, 30, 45, 60, 150, 31, 33, 64] * 2)]
    items += [(90, None), (91, ""), (92, "?!"), (93, items[3][1]), (94, "of the and"), (None, items[4][1])]
    rows = []
    for i in range(300):
        own = words(pick.randrange(400))
        if i % 4 == 0:
            text = pick.choice(items[:20])[1]
            kind = i // 4 % 4
            leak = text.upper().replace(" ", " \n") if kind == 1 else text
            leak = leak.split()
            if kind == 2:  # a word in five changed
                leak = [w if pick.random() < .8 else "other" for w in leak]
            if kind == 3:  # words dropped and added, the answer kept
                leak = [w for w in leak[:-5] if pick.random() < .8 or own.append(w)] + ["plus"] + leak[-5:]
            at = pick.randrange(len(own) + 1)
            own[at:at] = leak
        rows.append((i, " ".join(own)))
    rows += [(400, None), (401, ""), (402, "... !!"), (403, items[6][1]), (403, items[6][1]), (404, " ".join(words(60_000)) + " " + items[5][1]), (None, items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS term")
    known = lambda k: -1 if k is None else k
    got = sorted((known(r["doc_id"]), known(r["item_id"])) for r in leaks.find_leaks(spark, docs(rows).repartition(3), bench).collect())
    judged = [leaks.Item(known(k), t) for k, t in items if t and leaks.plain_words(t)]
    want = sorted((known(k), i.item_id) for k, t in rows for i in judged if i.item_id != 94 and held(i, t))
    assert [p for p in got if p[1] != 94] == want


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    assert leaks.find_leaks(spark, docs([]), bench).count() == 0
    assert leaks.find_leaks(spark, docs([(1, "some words here")]), bench.limit(0)).count() == 0
    assert leaks.find_leaks(spark, docs([(1, "Some words, here"), (2, None)]), bench).first()["doc_id"] == 1


def test_weights_do_not_depend_on_size():
    """Shares decide, and every piece keeps its rarest words."""
    vocabulary = leaks.Vocabulary([leaks.Item(1, "a b c d e f g h i j k l m n o p")])
    pieces = [np.arange(12), np.arange(12, 16), np.array([15])]
    share = np.array([0, .001, .0019, .0021] + [.1 + .01 * i for i in range(12)])
    for passages in (10_000, 10_000_000):
        weights, fewest = leaks.word_weights(vocabulary, pieces, share * passages, passages)
        assert np.flatnonzero(weights).tolist() == [0, 1, 2, 12, 13, 14, 15] and fewest == 1
    assert leaks.word_weights(vocabulary, pieces[:2], share * 10_000, 10_000)[1] == 2
    none, fewest = leaks.word_weights(vocabulary, pieces[:2], share * 0, 0)
    assert (none > 0).any() and fewest >= 1


@pytest.mark.parametrize("kinds", [100, 20_000])
def test_planted_items_at_any_vocabulary(spark, docs, kinds):
    pick = random.Random(kinds)
    words = lambda n: [f"w{int(kinds * pick.random())}" for _ in range(n)]
    items = [(i, " ".join(words(40))) for i in range(kinds // 50)]
    rows = [(i, " ".join(words(150))) for i in range(400)]
    rows += [(1000 + i, " ".join([*words(70), *[w for w in text.split() if pick.random() < .9], *words(70)])) for i, text in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(spark, docs(rows), bench).collect()}
    judged = [leaks.Item(k, t) for k, t in items]
    assert found == {(k, i.item_id) for k, t in rows for i in (judged if kinds == 100 else [j for j in judged if k == 1000 + j.item_id]) if held(i, t)}
    assert len(found) >= .95 * len(items)


def test_singular_vectors(spark, docs):
    """The subspace is that of a full decomposition of the same matrix."""
    pick = random.Random(2)
    texts = [" ".join(pick.choice("abcdefghijkl") for _ in range(leaks.SPAN)) for _ in range(60)]
    items = [leaks.Item(1, "a b c"), leaks.Item(2, "d e l")]
    vocabulary = leaks.Vocabulary(items)
    weights = np.arange(1.0, 7.0)
    pieces = [np.array([vocabulary.index[w] for w in i.words]) for i in items]
    got = leaks.latent_space(docs(list(enumerate(texts))), vocabulary, weights, pieces)
    rows = np.array([[t.split().count(w) for w in "abcdel"] for t in texts]) * weights
    rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    own = np.array([[w in i.words for w in "abcdel"] for i in items]) * weights
    own = own / np.linalg.norm(own, axis=1, keepdims=True)
    want = np.linalg.svd(np.concatenate([rows, own * np.sqrt(60 / 2)]))[2][:2].T
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-3)
