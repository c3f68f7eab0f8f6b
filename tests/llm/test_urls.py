import random

from clickweir.llm import urls
from clickweir.llm.queries import RULES


def brute(url, rules=RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_judged_like_rules(spark):
    given = [None, "", "nothing", "http://", "https://EXAMPLE.org/en/12?x#y", "http://a.Example.org/es/", "http://example.org?q=/es/", "x://org/",
             "http://notexample.org/es/1", "http://example.org/en/2", "http://com/fr/", "http://a.com/de", "http://a.com/de/", "http://É.com/fr/\n://x",
             "http://a..com/de/1", "http://.com/de/", "http://example.org#/es/", "http://u:p@b.com:80/de/", "http://x.org/" + "a" * 5000, "http://x.org/" ] * 3
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS rule", "1 AS verdict", "2 AS _fit", "3 AS key")
    rows = urls.judge(spark, pages, RULES).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert {(r["_fit"], r["key"]) for r in rows} == {(2, 3)} and got == {i: brute(u) for i, u in enumerate(given)}


def test_no_pages(spark):
    assert urls.judge(spark, spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    pick = random.Random(5)
    universe = [f"host{i}.example/{pick.randrange(9)}" for i in range(6000)]
    listed = set(universe[:1500]) | {"outside"}
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = urls.build_cascade(spark, frame([*listed, None, "outside"]), frame(universe + universe[:9] + [None]))
    assert len(cascade) > 1
    assert all(urls.listed(k, cascade) == (k in listed) for k in universe)
    assert urls.build_cascade(spark, frame([]), frame(universe)) == [] and not urls.listed("x", [])
