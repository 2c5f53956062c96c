"""Hosts and links by hand."""

from pyspark.sql import functions as F

from leadloom.functions import hosts as H
from leadloom.functions import urls as U
from leadloom.operators import consolidate as C

def applied(spark, function, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, x string").select("i", function(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


# written by hand
SPELLED = {
    "café.pt": "xn--caf-dma.pt", "CAFÉ.pt": "xn--caf-dma.pt", "café.pt": "xn--caf-dma.pt", "xn--caf-dma.pt": "xn--caf-dma.pt", "caf%C3%A9.pt": "xn--caf-dma.pt", "www.café.pt": "xn--caf-dma.pt",
    "bücher.example": "xn--bcher-kva.example", "straße.de": "xn--strae-oqa.de", "ｃａｆｅ。pt": "cafe.pt", "東京.jp": "xn--1lqs71d.jp",
    "0x7f.1": "127.0.0.1", "127.1": "127.0.0.1", "2130706433": "127.0.0.1", "0177.0.0.01": "127.0.0.1", "127.0.0.1.": "127.0.0.1", "1.2.3.4": "1.2.3.4", "0x": "0.0.0.0", "4294967295": "255.255.255.255",
    "user:pw@bücher.example:8080": "xn--bcher-kva.example", "a@b@foo.pt": "foo.pt", "soft­hyphen.pt": "softhyphen.pt", "plain.pt": "plain.pt", "1und1.de": "1und1.de", "a.1b": "a.1b",
}


def test_spelled_hosts(spark):
    assert applied(spark, U.normalize_domain, [f"https://{x}/a" for x in SPELLED]) == list(SPELLED.values())
    assert applied(spark, U.normalize_domain, list(SPELLED)) == list(SPELLED.values())
    no_hosts = ["256.1.1.1", "1.2.3.4.5", "09", "1..2", "4294967296", "a%20b.pt", "a%zz.pt", "0x1g.0x"]
    assert [H.ascii_host(x) for x in no_hosts] == [None] * 8


def test_one_business_for_both_spellings(spark):
    rows = [("https://café.pt/x", 0), ("http://www.xn--caf-dma.pt", 1), ("https://0x7f.1/", 2), ("http://127.0.0.1/contacto", 3)]
    leads = spark.createDataFrame([("Barbearia A", w, "", "", "", "", "", "", "", (0, i)) for w, i in rows], ", ".join(f"{f} string" for f in C.FIELDS) + ", seq struct<profile_rank:int,row_no:bigint>")
    keyed = [r.k for r in leads.select("seq", C.merge_key().alias("k")).orderBy("seq").collect()]
    assert keyed == ["web:xn--caf-dma.pt|barbearia a"] * 2 + ["web:127.0.0.1|barbearia a"] * 2


def test_links_behind_any_number_of_redirects():
    from urllib.parse import quote

    link = wrapped = "https://loja.example.pt/a?b=1"
    for depth in range(12):
        wrapped = ["https://www.google.com/url?q=", "https://duckduckgo.com/l/?uddg=", "https://bing.com/aclick?u="][depth % 3] + quote(wrapped, safe="")
        assert U._clean(wrapped) == link
    assert U._clean("https://www.google.com/url?q=") == "" and U._clean("https://café.pt/é") == "https://xn--caf-dma.pt/%C3%A9"
    assert U._clean("http://0x7f.1:80/a/../b") == "http://127.0.0.1/b" and U._clean("http://1.2.3.256/") == "http://1.2.3.256/"
