import random

import pytest

from clickweir.llm import language
from clickweir.llm.queries import op6_zstd_language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op6_zstd_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    tested = [r for r in got if r["held_out"]]
    assert 100 < len(tested) < 300
    assert sum(r["lang"] == r["lang_pred"] for r in tested) / len(tested) > 0.97
    assert sum(r["accepted"] for r in got) >= 985
    assert all(0 <= r["score"] <= 1 for r in got)


@pytest.fixture(scope="module")
def words():
    return {"aa": b"alpha beta gamma delta epsilon zeta eta theta " * 40, "bb": "üben öfter ähnlich größer früh spät schön ".encode() * 40}


def test_cases(spark, docs, words):
    rows = [(1, "Beta, GAMMA! delta alpha"), (2, "öfter FRÜH spät"), (3, None), (4, ""), (5, "123 !? \n"), (6, "alpha beta gamma " * 20_000),
            (7, "日本"), (8, "Beta, GAMMA! delta alpha"), (None, "üben öfter ähnlich größer")]
    got = {r["doc_id"]: r for r in language.identify(spark, docs(rows), words).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6, 8, None)] == ["aa", "bb", "und", "und", "und", "aa", "aa", "bb"]
    assert got[3]["score"] == 0 and not got[3]["accepted"] and got[1]["accepted"] and got[1]["score"] == got[8]["score"] > 0.9
    assert got[7]["lang_pred"] in ("aa", "bb") and not got[7]["accepted"]
    assert language.identify(spark, docs([]), words).count() == 0
    assert {r["lang_pred"] for r in language.identify(spark, docs(rows), {}).collect()} == {"und"}


FINNISH = """kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on
toimittava toisiaan kohtaan veljeyden hengessä jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin ilman""".split()


def test_unlearned_languages_and_junk_are_rejected_and_clean_rows_are_not(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    learned = language.learn(table.where(~language.held_out()))
    dice = random.Random(5)
    finnish = [" ".join(dice.choices(FINNISH, k=n)) for n in (60, 150, 300) for _ in range(50)]
    junk = [" ".join("".join(dice.choices("abcdefghijklmnopqrstuvwxyz", k=dice.randint(2, 9))) for _ in range(n)) for n in (60, 150, 300) for _ in range(50)]
    clean = table.where(language.held_out() & (language.F.length("text") > 300)).select("doc_id", "text").dropna().collect()
    rows = [(k, text, None, kind) for kind, texts in (("finnish", finnish), ("junk", junk), ("clean", [r["text"] for r in clean])) for k, text in enumerate(texts)]
    got = language.identify(spark, docs(rows), learned).collect()
    share = {kind: sum(r["accepted"] for r in got if r["source"] == kind) / sum(r["source"] == kind for r in got) for kind in ("finnish", "junk", "clean")}
    assert share["finnish"] <= 0.05 and share["junk"] <= 0.05 and share["clean"] >= 0.99


def test_learning(spark, docs):
    rows = [(i, f"wort{i} ja", "de", "s") for i in range(900)] + [(-1, None, "de", "s"), (-2, "x", None, "s"), (-3, "12", "zz", "s"), (None, "q", "qq", "s")]
    found = language.learn(docs(rows))
    assert set(found) == {"de"} and 0 < len(found["de"]) <= language.DICTIONARY_BYTES and len(found["de"].split()) <= 2 * language.SAMPLE_DOCS
    assert found == language.learn(docs(rows).repartition(5)) and language.learn(docs([])) == {}
