"""Elements that hide what is in them, with and without their end tags."""

import pytest

from tidewire.llm import html

BODY = "<article><h1>Top</h1><p>First text.</p><p>Second text.</p></article>"
BLOCKS = ["Top", "First text.", "Second text."]


def texts(page):
    return [x[1] for x in html.blocks(page)[0]]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<html><head><title>T</title><meta charset=x><body>" + BODY, BLOCKS),
        ("<html><head><title>T</title>" + BODY, BLOCKS),
        ("<head><title>T<body>" + BODY, BLOCKS),
        ("<head><noscript><img src=x><div>no</div></noscript><title>T</title></head><body>" + BODY, BLOCKS),
        ("<title>T</title>Plain text", ["Plain text"]),
        ("<head><title>T</title>Plain text", ["Plain text"]),
        ("<body><div><label>Name</div>" + BODY, BLOCKS),
        ("<body><p><label>Name<p>Text.</p>" + BODY, ["Text.", *BLOCKS]),
        ("<body><label>Name <div>inner</div></label>" + BODY, BLOCKS),
        ("<body><datalist><option>a<option>b</datalist>" + BODY, BLOCKS),
        ("<body><select><option>a<option>b</select>" + BODY, BLOCKS),
        ("<body><div><select><option>a</div>" + BODY, BLOCKS),
        ("<body><div><noscript>Turn it on <p>now</p></div>" + BODY, BLOCKS),
        ("<body><div><template><p>x</p></template></div>" + BODY, BLOCKS),
        ("<body><div><title>odd</div>" + BODY, BLOCKS),
        ("<body><svg><title>in</title><svg><text>a</text></svg><text>b</text></svg>" + BODY, BLOCKS),
        ("<body><svg viewBox='0'><svg/><text>b</text></svg>" + BODY, BLOCKS),
        ("<body><div><video><p>no video</p></video><canvas>old</div>" + BODY, BLOCKS),
        ("<body><button><div>go</div></button>" + BODY, BLOCKS),
        ("<body><noscript><script>'</noscript></div>'</script>x</noscript>" + BODY, BLOCKS),
        ("<body>" + BODY.replace("</p>", ""), BLOCKS),
        ("<body><ul><li>one<li>two</ul><table><tr><td>a<td>b</table>" + BODY, ["one", "two", "a", "b", *BLOCKS]),
    ],
)
def test_hidden(page, want):
    assert texts(page) == want


def test_a_page_of_ten_megabytes():
    page = "<html><head><title>T</title><body><article>" + "<p>Some text with <b>marks</b> and a &amp; sign.<label>x</label></p>" * 150_000
    found = texts(page)
    assert len(found) == 150_000 and set(found) == {"Some text with marks and a & sign."}
