"""What a page shows: expected texts written by hand."""

import pytest

from leadloom.llm.html_text import visible_text

CASES = {
    "without scripts": ("a<noscript><p>on</p></noscript>b", "a\n\non\n\nb"),
    "without scripts, in the head": ("<head><noscript><style>p{margin:0}</style></noscript><title>t</title></head><p>x", "x"),
    "content ends a head's noscript": ("<head><noscript><p>on</p></noscript></head><body>x", "on\n\nx"),
    "fallback of objects": ('<object data="x.swf">no <b>player</b></object> after', "no player after"),
    "maps": ('<map name="m"><a href="/a">area</a></map>', "area"),
    "media are played": ("<video>old</video><audio>old</audio><canvas>old</canvas>new", "new"),
    "visible child of a hidden parent": ('<div style="visibility:hidden">a<b style="visibility: visible">b</b>c</div>d', "b\nd"),
    "hidden parent hands it down": ('<div style="visibility:hidden"><p>a</p><i>b</i></div>c', "c"),
    "hidden item, visible part": ('<ul><li style="visibility:hidden">a <b style="visibility:visible">b</b></li><li>c</li></ul>', "  b\n- c"),
    "display isn't undone": ('<div style="display:none"><b style="display:block;visibility:visible">b</b></div>c', "c"),
    "strings are no declarations": ("<p style='content:\"display:none\"'>x</p>", "x"),
    "comments are no declarations": ("<p style='/*display:none*/color:red'>x</p>", "x"),
    "addresses are no declarations": ("<p style='background:url(a;display:none)'>x</p>", "x"),
    "last declaration counts": ("<p style='display:none;display:block'>x</p>", "x"),
    "invalid declarations don't": ("<p style='display:none;display:blok'>x</p>y", "y"),
    "important ones win": ("<p style='display:none!important;display:block'>x</p>y", "y"),
    "display of a hidden attribute": ("<p hidden style='display:block'>x</p>", "x"),
    "other properties": ("<p style='-x-display:none;empty-cells:hide'>x</p>", "x"),
    "ruby": ("<ruby>kan<rp>(</rp><rt>ji</rt><rp>)</rp></ruby>", "kanji"),
    "style sheet, class": ("<style>.h{display:none}</style><p class='a h'>x</p><p class=hh>y</p>", "y"),
    "style sheet, id and tag": ("<style>p#a, span.b{display:none}</style><p id=a>x</p><div id=a>y</div><span class=b>z</span>", "y"),
    "style sheet, descendants": ("<style>.menu li a{display:none}</style><div class=menu><ul><li><b><a>x</a></b>k</li></ul></div><a>y</a>", "- k\n\ny"),
    "style sheet, children": ("<style>div>b{display:none}</style><div><b>x</b><i><b>y</b></i></div>", "y"),
    "style sheet, order": ("<style>.h{display:none}.h{display:block}</style><p class=h>x</p>", "x"),
    "style sheet, specificity": ("<style>#i{display:block}.h{display:none}</style><p class=h id=i>x</p>", "x"),
    "own style before sheet": ("<style>.h{display:none}</style><p class=h style='display:block'>x</p>", "x"),
    "important sheet before own style": ("<style>.h{display:none!important}</style><p class=h style='display:block'>x</p>y", "y"),
    "other media": ("<style>@media print{.h{display:none}}@media (max-width:9px){p{display:none}}</style><p class=h>x</p>", "x"),
    "screen": ("<style>@media screen{.h{display:none}} .k{visibility:hidden}</style><p class=h>x</p><p class=k>z<b>w</b></p>y", "y"),
    "print sheet": ("<style media=print>p{display:none}</style><p>x</p>", "x"),
    "scripts stay hidden": ("<style>script,style{display:block}</style><script>s</script>x", "x"),
    "rows without a table": ("<tr><td>a</td><td>bbb</td></tr><tr><td>cc</td><td>d</td></tr>", "a   bbb\ncc  d"),
    "cells without a table": ("<div><td>a</td><td>b</td></div>after", "a  b\n\nafter"),
    "content ends an implied table": ("x<td>a<td>b</td>y<p>z", "x\n\na  b\n\ny\n\nz"),
}


@pytest.mark.parametrize("name", CASES)
def test_shown(name):
    markup, want = CASES[name]
    assert visible_text(markup) == want


def test_deep_page_with_style_sheet():
    page = "<style>div div div .h{display:none}</style>" + "<div>" * 20_000 + "<b class=h>x</b>y"
    assert visible_text(page) == "y"


class Seen:
    """The words of a page by Python's own parser, without a tree: what lies outside hidden elements."""

    @staticmethod
    def words(markup):
        from html.parser import HTMLParser

        hidden = {"script", "style", "title", "template", "iframe", "video", "audio", "canvas"}
        out, shut = [], []

        class Parser(HTMLParser):
            def handle_starttag(self, tag, attrs):
                if shut:
                    if tag == shut[-1]:
                        shut.append(tag)
                elif tag in hidden or "hidden" in dict(attrs) or "display:none" in (dict(attrs).get("style") or "").replace(" ", ""):
                    shut.append(tag)
                else:
                    out.append(" ")

            def handle_endtag(self, tag):
                if shut and shut[-1] == tag:
                    shut.pop()
                out.append(" ")

            def handle_data(self, data):
                if not shut:
                    out.append(data)

        parser = Parser(convert_charrefs=True)
        parser.feed(markup)
        parser.close()
        return "".join(out).split()


def test_given_pages():
    """Letters of the words of all given pages, in any order: as Python's parser finds them, but for list marks and tag borders."""
    from collections import Counter

    import pyarrow.parquet as pq

    for markup in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist():
        got = Counter(c for c in visible_text(markup) if c.isalpha())
        want = Counter(c for w in Seen.words(markup) for c in w if c.isalpha())
        assert got == want


def test_wide_cells_and_many_rules_stay_small():
    """A very long cell doesn't pad all rows, and each element meets only the rules that may select it."""
    import time

    long = "x " * 10_000
    page = "<table>" + f"<tr><td>{long}<td>b" + "<tr><td>a<td>b" * 20_000 + "</table>"
    text = visible_text(page)
    assert len(text) < 5 * len(page) and text.count("b") == 20_001 and long.strip() in text and "\na  b" not in text
    sparse = "<table><tr>" + "<td>abcdefgh" * 900 + "<tr><td colspan=899>x<td>y" * 5000 + "</table>"
    assert len(visible_text(sparse)) < 6 * len(sparse)
    assert visible_text("<table><tr><td>aaaa<td>b<tr><td>c<td>d</table>") == "aaaa  b\nc     d"
    rules = "".join(f".r{i} {{display:none}} div.q{i} > p.s{i} {{display:none}} #t{i} {{visibility:hidden}}" for i in range(700))
    styled = f"<style>{rules}</style>" + "".join(f'<div class="q{i % 9}"><p class="s{i % 9} x">gone<p class="r{i}">also<p id="t{i}">too<p>kept{i}</div>' for i in range(700))
    began = time.process_time()
    text = visible_text(styled)
    assert time.process_time() - began < 3
    assert [w for w in text.split()] == [f"kept{i}" for i in range(700)]
