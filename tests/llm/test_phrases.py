import random
import re
from collections import Counter

import pytest

from clickweir.llm import phrases


def brute(rows, least, first, contained=100):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = tuple(re.findall("[^ \t]+", piece))
            totals[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[words[i:i + k]] += 1
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        held = {p for p, a in candidates.items() for q, b in candidates.items()
                if len(q) > len(p) and 100 * b >= contained * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))}
        listed = []
        for p, a in candidates.items():
            if p not in held:
                score, k = min((1000 * a * totals[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
                listed.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(listed)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(t, l, "x", 1.5, 2, "y", "z") for t, l in rows],
                                 "text string, lang string, words string, n double, prefix int, part string, phrase string")


def check(spark, rows, **options):
    got = phrases.collocations(spark, frame(spark, rows).repartition(5), **options)
    assert sorted(map(tuple, got.collect())) == brute(rows, options.get("least", 100), options.get("first", 2000), options.get("contained", 100))


@pytest.mark.parametrize("budget", [200_000, 12, 1])
def test_against_brute_force(spark, budget):
    """Few words, so that phrases of all lengths are frequent; separators of all kinds, words that differ in bytes below
    the space, languages that share words; partitions of many and of single leaves."""
    pick = random.Random(budget)
    words = ["a", "b", "ab", "É", "é", "a\x01", "a\x00b", "the", "The", "of", "x" * 50, " ", "日本"]
    fixed = ["the cat sat on the mat today", "no and yes", "b b b b b b b"]
    rows = []
    for i in range(260):
        parts = [pick.choice(fixed) if pick.random() < .3 else pick.choice(words) for _ in range(pick.randrange(25))]
        text = "".join(p + pick.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " \r\n", "?!"]) for p in parts)
        rows.append((text, pick.choice(["en", "en", "en", "fr", None, "und"])))
    rows += [(None, "en"), ("", "de"), (" .", "de"), ("a b " * 3000, "en"), ("one", None)] + [("same old text again, and again", "es")] * 30
    check(spark, rows, least=5, budget=budget)
    if budget == 12:
        check(spark, rows, least=3, first=7, budget=budget, contained=60)


def test_several_slices(spark, monkeypatch):
    rows = [(f"the common words of document {i % 3} end here. " * 20, "en") for i in range(40)]
    want = brute(rows, 100, 2000)
    whole = sorted(map(tuple, phrases.collocations(spark, frame(spark, rows)).collect()))
    monkeypatch.setattr(phrases, "SLICE_BYTES", 1000)
    assert sorted(map(tuple, phrases.collocations(spark, frame(spark, rows)).collect())) == whole == want


def test_none(spark):
    for rows in ([], [(None, None)], [("a b c", "en")]):
        assert phrases.collocations(spark, frame(spark, rows)).collect() == []


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    def counted(spark, docs, least, budget):
        return (spark.createDataFrame([("en", 7 * big)], "lang string, n long"),
                spark.createDataFrame([("en", ["a"], 2 * big + 1), ("en", ["b"], 3 * big), ("en", ["a", "b"], 2 * big)], "lang string, words array<string>, n long"))
    monkeypatch.setattr(phrases, "count_phrases", counted)
    (row,) = phrases.collocations(spark, frame(spark, [])).collect()
    assert row["score"] == 1000 * (2 * big) * (7 * big) // ((2 * big + 1) * (3 * big))


def test_a_saturated_filter_changes_nothing(spark, monkeypatch):
    """Filters too small for what they hold let rare words through; counts stay exact."""
    pick = random.Random(3)
    rows = [(" ".join(f"w{int(pick.expovariate(.05))}" for _ in range(60)), "en") for _ in range(120)]
    monkeypatch.setattr(phrases, "LEAST_FILTER_BITS", 64)
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    monkeypatch.setattr(phrases, "LEAST_CELLS", 64)
    monkeypatch.setattr(phrases, "CELLS", 64)
    check(spark, rows, least=6, budget=50)
