"""Pages nested deeper than any usual page keep their layout and what is hidden."""

import pytest

from leadloom.llm.html_text import visible_text

SECRETS = ['<div style="display:none">x<b>y</b></div>', "<p hidden>x</p>", "<template><i>x</i></template>", "<dialog>x</dialog>", "<details><summary>s</summary>x</details>"]
SHOWN = "<ul><li>a</li><li>b</li></ul><table><tr><td>c</td><td>d</td></tr><tr><td>eee</td><td>f</td></tr></table>"


@pytest.mark.parametrize("depth", [199, 300, 20_000])
@pytest.mark.parametrize("tag", ["font", "b", "div"])
def test_deep_pages(depth, tag):
    for hidden in SECRETS:
        page = hidden + SHOWN
        assert visible_text(f"<{tag}>" * depth + page) == visible_text(f"<{tag}>" + page)


def test_deep_end_tag_closes_its_own_element():
    page = "<div hidden><div>" + "<b>" * 300 + "<div>x</div>y</div>z</div>seen"
    assert visible_text(page) == "seen"


def test_deep_blocks_and_tables():
    assert visible_text("<blockquote>" * 20_000 + "x") == "x"
    assert visible_text("<table><tr><td>" * 3_000 + "x") == "x"
