import math
from collections import defaultdict

import pytest

from chainloom.llm import language


def documents(spark):
    en = "the house of the rising sun and that which was with them in this thing "
    de = "der die das und nicht mit einem großen haus zwischen den straßen ist "
    return spark.createDataFrame([(i, (en if i % 2 else de) * (1 + i % 5), "en" if i % 2 else "DE") for i in range(40)] + [(99, None, "fr"), (98, "x", None)], "doc_id bigint, text string, lang string")


def page(lang, words):
    return f'<html lang="{lang}"><head><title>zz</title></head><body><p>{words}</p><script>der die das</script></body></html>'


def test_evidence_and_priors(spark):
    model = language.train(documents(spark))
    assert model.languages == ["de", "en"]
    rows = [
        (1, "http://a.site.de/x", page("de", "das haus und die straßen")),
        (2, "http://b.org/en/1", page("fr", "the rising sun and the house")),
        (3, "http://c.org/", "<html><body></body></html>"),
        (4, None, None),
        (5, "http://d.com/en-GB/x", ""),
        (6, "HTTP://A.site.de:80/y", page("xx", "")),
        (6, "HTTP://A.site.de:80/y", page("xx", "")),
        (7, "http://e.com/", page("en", "das haus und die straßen nicht mit einem großen haus " * 50)),
        (8, "http://f.com", page("en", "")),
    ]
    got = language.identify(spark.createDataFrame(rows, "page_id bigint, url string, html string"), model).collect()
    assert len(got) == len(rows)
    found = {r.page_id: r for r in got}
    assert [found[i].lang for i in (1, 2, 6, 7, 8)] == ["de", "en", "de", "de", "en"]
    assert (found[1].declared, found[1].address, found[1].host) == ("de", "de", "a.site.de")
    assert (found[2].declared, found[2].address) == (None, "en") and found[5].address == "en" and found[6].declared is None
    assert all(0.5 <= r.confidence <= 1 for r in got)


def test_priors_match_brute_force(spark):
    model = language.Model(["aa", "bb"], __import__("numpy").ones((2, language.BUCKETS)))
    rows = [(i, f"http://h{i % 3}.d{i % 2}.{'x' if i % 5 else 'y'}/p", page(["aa", "bb", "cc"][i * i % 7 % 3], "")) for i in range(60)] + [(99, None, page("aa", ""))]
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(rows, "page_id bigint, url string, html string"), model).collect()}
    own = {}
    for i, url, html in rows:
        said = html[12:14]
        own[i] = {"aa": language.DECLARED, "bb": 1 - language.DECLARED}.get("aa") if said == "aa" else 1 - language.DECLARED if said == "bb" else 0.5
    host = {i: url.split("/")[2] if url else None for i, url, _ in rows}
    sums = defaultdict(lambda: [0.0, 0.0])
    for i, p in own.items():
        h = host[i]
        for key in {("", "all")} | ({("h", h), ("d", ".".join(h.split(".")[-2:])), ("x", h.split(".")[-1])} if h else set()):
            sums[key][0] += p
            sums[key][1] += 1 - p
    base = (sums["", "all"][0] + 1) / (len(rows) + 2)

    def prior(key, up):
        a, b = sums[key]
        return (a + language.STRENGTH * up) / (a + b + language.STRENGTH)

    for i, p in own.items():
        up = base
        if h := host[i]:
            for key in (("x", h.split(".")[-1]), ("d", ".".join(h.split(".")[-2:])), ("h", h)):
                up = prior(key, up)
        both = p * up / (p * up + (1 - p) * (1 - up))
        assert math.isclose(got[i].confidence, max(both, 1 - both), rel_tol=1e-9) and got[i].lang == ("aa" if both >= 0.5 else "bb")


def test_held_out_and_empty(spark):
    model = language.train(documents(spark).where("doc_id < 20"))
    rest = documents(spark).where("doc_id between 20 and 39").selectExpr("doc_id", "text as html", "cast(null as string) as url", "lower(lang) as lang", "1 as host")
    out = language.identify(rest, model)
    assert out.columns == ["doc_id", "url", "lang", "host", "_lang", "confidence", "declared", "address", "_host"]
    assert all(r.lang == r._lang for r in out.collect())
    assert language.identify(rest.limit(0), model).count() == 0
    assert language.identify(rest, language.train(documents(spark).limit(0))).where("_lang is null").count() == 20


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 1)
    with pytest.raises(ValueError, match="more than 1 languages"):
        language.train(documents(spark))
