"""Column functions on edge cases."""

import pytest
from pyspark.sql import functions as F

from leadloom.functions import predicates as P
from leadloom.functions import review as R
from leadloom.functions import text as T
from leadloom.functions import urls as U
from leadloom.operators.directory import split_address
from leadloom.operators.extract import business, emails, json_ld_objects, phones, variant_text
from leadloom.operators.frontier import extract_search_urls, geography_terms, keyword_variants


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(function(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


#: Listing pages and lead websites, written by hand from the rules' description: a host part, and a part of the path if one is asked for.
LISTINGS = {
    "https://www.barberhead.com/x": True, "barberhead.com": True, "https://google.com/maps/place/1": True, "https://www.google.pt/search": False, "https://maps.google.com/x": True,
    "https://maps.app.goo.gl/abc": True, "https://www.hotfrog.pt/search/lisboa": True, "https://www.hotfrog.pt/company/1": False, "https://www.fresha.com/a/b": True, "https://booksy.com/pt": True,
    "https://noona.app/x": True, "https://agendoor.com.br/x": True, "https://ondecortar.pt/cidades/porto": True, "https://ondecortar.pt/salao/1": False, "https://www.cylex.pt/barbearia/": True,
    "https://www.cylex.pt/barbearia": True, "https://www.cylex.pt/barbearia/x": False, "https://www.pai.pt/pesquisa/x": True, "https://www.pai.pt/ms/x": False, "https://empresite.jornaldenegocios.pt/actividade/x": True,
    "https://www.racius.com/pesquisa/x": True, "https://loja.pt/": False, "": False, "not a url /search/": True, "loja nova": False,
}
LEAD_WEBSITES = {
    "https://www.pai.pt/searches?x": True, "https://www.pai.pt/pesquisa/x": False, "https://google.com/maps": True, "https://booksy.com/search": True, "https://www.cylex.pt/search/x": True, "https://www.cylex.pt/barbearia": False,
    "https://www.infobel.com/search": True, "https://www.tuugo.pt/search": True, "https://www.tuugo.pt/c/1": False, "https://loja.pt/search": False, "x y/maps": True,
}
BLOCKED = {
    "javascript:void(0)": True, "mailto:a@b.pt": True, "tel:1": True, "https://www.google.com/search?q=1": True, "https://google.de/search": False, "https://www.bing.com/search?q=1": True, "https://search.yahoo.com/search?p=1": True,
    "https://search.brave.com/search?q=1": True, "https://www.mojeek.com/search?q": True, "https://www.qwant.com/?q=1": True, "https://th.bing.com/th": True, "https://www.microsoft.com/pt": True, "https://x.pt/fd/ls/1": True, "https://duckduckgo.com/html/?q": True, "https://loja.pt/google": False,
}
CLEAN = {
    "https://loja.pt/a/b.html?x=1": "https://loja.pt/a/b.html?x=1", "http://loja.pt/a/../b": "http://loja.pt/b", "http://loja.pt/./a": "http://loja.pt/a", "https://loja.pt": "https://loja.pt/", "https://Loja.pt/A": "https://loja.pt/A",
    "https://loja.pt:443/a": "https://loja.pt/a", "https://loja.pt/a b": "https://loja.pt/a%20b", "https://www.qwant.com/about": "https://www.qwant.com/about", "/a": "https://example.com/a", "https://loja.pt/a#b": "https://loja.pt/a#b", "https://loja.pt/..": "https://loja.pt/", "https://www.google.com/url?url=https://a.pt/x": "https://a.pt/x",
}
CASES = [
    (P.is_generic_listing_url, list(LISTINGS), list(LISTINGS.values())),
    (P.is_generic_lead_website, list(LEAD_WEBSITES), list(LEAD_WEBSITES.values())),
    (U.is_blocked_url, list(BLOCKED), list(BLOCKED.values())),
    (U.clean_url, list(CLEAN), list(CLEAN.values())),
    (T.strip, [" x ", None, "﻿ a\t"], ["x", "", "a"]),
    (T.normalize_text, ["  São  João ", None, ""], ["são joão", "", ""]),
    (T.fold_text, ["Bragança AÇORES", "Ünï", "é"], ["braganca acores", "uni", "e"]),
    (T.slugify, ["  Vila Real!", "Évora", "--"], ["vila-real", "evora", ""]),
    (T.title_from_slug, ["barbearia-do-ze-lisboa.html", None], ["Barbearia Do Ze", ""]),
    (T.strip_tags, ["<p>a&amp;b</p><script>x</script> c", None], ["a&b c", ""]),
    (T.html_decode, ["&lt;a&gt;&nbsp;&#39;", "&amp;lt;"], ["<a> '", "<"]),
    (T.decode_url, ["a+b%20c", "100%", "%zz+x"], ["a b c", "100%", "%zz+x"]),
    (T.encode_uri_component, ["a b+c'(é)~!"], ["a%20b%2Bc'(%C3%A9)~!"]),
    (T.normalize_phone, ["+351 912-345 678", None], ["351912345678", ""]),
    (U.normalize_domain, ["WWW.Foo.pt/a", "http://user:pw@foo.pt:8080/x", "foo bar.pt/x", "httpfoo.com", "https://x.pt/a | https://y.pt", "", None], ["foo.pt", "foo.pt", "foo bar.pt", "httpfoo.com", "x.pt", "", ""]),
    (U.is_blocked_url, ["mailto:x@y", "https://www.google.pt/search?q=1", "https://foo.pt/"], [True, True, False]),
    (U.clean_url, ["https://www.google.com/url?q=https%3A%2F%2Ffoo.pt%2Fa&sa=U", "https://duckduckgo.com/l/?uddg=https%3A%2F%2Ffoo.pt", "https://r.search.yahoo.com/x/RU=https%3a%2f%2ffoo.pt%2fb/RK=2", "https://www.bing.com/search?q=x", "HTTPS://Foo.PT", ""], ["https://foo.pt/a", "https://foo.pt/", "https://foo.pt/b", "", "https://foo.pt/", ""]),
    (P.is_generic_listing_url, ["https://www.fresha.com/a/x", "https://google.pt/maps/x", "https://cylex.pt/lisboa/talho/", "https://cylex.pt/talho/x", "loja /search/", "https://loja.pt", "", None], [True, True, True, False, True, False, False, False]),
    (P.is_public_business_email, ["a@b.pt", "a@x.pt | b@y.pt", "x@notbooksy.com", "A@EXAMPLE.com", "a@b", None], [True, False, False, False, False, False]),
    (P.is_plausible_phone, ["912345678", "12 34", "1234567890123456", None], [True, False, False, False]),
    (P.is_portuguese_phone, ["+351 912345678", "912345678", "812345678", "351812345678"], [True, True, False, False]),
    (P.is_brazilian_phone, ["55 11 912345678", "11912345678", "912345678"], [True, True, False]),
    (P.is_country_wide, ["Portugal", "PT-PT", "Lisboa"], [True, True, False]),
    (P.requested_country, ["São Paulo", "Espinho"], ["BR", "PT"]),
    (P.is_category_page, ["Barbearias em Lisboa", "Onde Cortar", "Barbearia emblema"], [True, True, False]),
    (P.classify_error, ["x HTTP 429", "HTTP 403", "timeout", None], ["motor bloqueou temporariamente (429)", "motor sem acesso publico (403)", "timeout", ""]),
    (P.source_note, ["maps", "search"], ["Fonte Maps", "Fonte web"]),
    (keyword_variants, ["Barbearias", "carnes", "dentista", "", None], [["barbearia", "barber shop", "barbershop"], ["talho", "talhos", "butcher", "butcher shop"], ["dentista"], ["leads"], ["leads"]]),
    (phones, ['<a href="tel:+351912345678">x</a> 213 456 789 01', "912 345 678", "+351 213-456-789"], [[" 351912345678", "+351912345678", "213 456 789 01"], [], ["351 213-456-789"]]),
    (emails, ['x a@b.pt <a href="mailto:c@d.pt?subject=x">', None], [["a@b.pt", "c@d.pt", "c@d.pt?subject=x"], []]),
    (R.describe_event, ['{"type":"turn.started"}', "texto", "", '{"type":"x"', '{"type":"item.started","item":{}}'], ["Codex a pensar", "texto", None, '{"type":"x"', "A trabalhar (tarefa)"]),
]


@pytest.mark.parametrize("function, values, expected", CASES, ids=[c[0].__name__ for c in CASES])
def test_function(spark, function, values, expected):
    assert apply(spark, function, values) == expected


def test_json_ld(spark):
    block = '<script type="application/ld+json">{}</script>'
    found = lambda c: variant_text(business(json_ld_objects(c)), "$.name")
    pages = [block.format('[{"@type":"Thing","name":"a"},{"@type":"Organization","name":"b"}]'), block.format("{bad") + block.format('{"@type":"LocalBusiness","name":"c"}'), block.format('{"@type":["LocalBusiness"],"name":"d"}'), None]
    assert apply(spark, found, pages) == ["b", "c", "", ""]


def test_verdicts(spark):
    answers = ['{"approved":true,"normalized":{"Nome":"x"}}', "```json\n{\"approved\":0}\n```", "texto", ""]
    told = apply(spark, lambda c: R.to_verdict(R.review_payload(c)), answers)
    assert [(t.approved, t.reason) for t in told] == [(True, R.APPROVED), (False, R.REJECTED), (True, R.INCONCLUSIVE), (True, R.INCONCLUSIVE)]
    assert told[0].normalized == {"Nome": "x"}


def test_search_urls(spark):
    google = '<a href="/url?q=https://a.pt/%C3%A9&sa=1">x</a>'
    generic = '<a class="x" href="https://a.pt/&amp;">x</a><a href="https://www.bing.com/x">y</a>'
    df = spark.createDataFrame([("google", google), ("qwant", generic), ("bing", None)], "p string, h string")
    assert [r[0] for r in df.select(extract_search_urls(F.col("p"), F.col("h"))).collect()] == [["https://a.pt/é"], ["https://a.pt/&"], []]


def test_places(spark):
    df = spark.createDataFrame([("Portugal", "maps"), ("Faro", "maps"), ("", "web"), ("PT", "search")], "g string, s string")
    assert [len(r[0]) for r in df.select(geography_terms(F.col("g"), F.col("s"))).collect()] == [7, 1, 1, 6]


def test_address(spark):
    df = spark.createDataFrame([("Rua A, Porto, Portugal", "", ""), ("Rua B", "Faro", ""), (None, "", "")], "a string, l string, r string")
    found = df.select(*split_address(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [tuple(r) for r in found] == [("Rua A, Porto,", "Porto", "Porto"), ("Rua B", "Faro", "Rua B"), ("", "", "")]
