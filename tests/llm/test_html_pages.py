"""Main-text extraction on pages as they are found: optional tags, odd quotes, compound class names, unmarked menus, hostile input."""

import time

import pytest

from helixframe.llm.html_extract import extract

PROSE = ("A sentence, with some words in it; and more of them. " * 7).strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<html><head><title>t</title><meta charset=x><body><p>{PROSE}</p><p>Two.</p></body>", PROSE + "\nTwo."),
        (f"<html><head><title>t</title><p>{PROSE}</p>", PROSE),
        (f"<body><div class='page has-sidebar'><article><p>{PROSE}</p></article></div>", PROSE),
        (f"<body><div class='overflow-hidden'><article><p>{PROSE}</p></article></div>", PROSE),
        (f"<body><div class='sidebar'><div><h1>T</h1><p>{PROSE}</p></div></div><div>c</div>", "T\n" + PROSE),
        (f"<body><div class=c><p>{PROSE}</p><ul><li>a</li><li>b</li></ul><blockquote>Yes.</blockquote></div>", PROSE + "\na\nb\nYes."),
        (f"<body><article><div><p>{PROSE}</p><ul><li>a</li><li>b</li></ul></div><blockquote>Yes.</blockquote></article>", PROSE + "\na\nb\nYes."),
        (f"<body><p title=o'brien>{PROSE}</p><p>It's</p><p>x</p>", PROSE + "\nIt's\nx"),
        (f'<body><p title="a > b">{PROSE}</p><p title=\'<p>\'>x</p>', PROSE + "\nx"),
        (f"<body><article><p>{PROSE}</p><ul><li><a href=1>Home</a></li><li><a href=2>Next</a></li></ul></article>", PROSE),
        (f"<body><ul><li><a href=1>Home</a></li><li><a href=2>Next</a></li></ul><article><p>{PROSE}</p><div><a>Home</a> | <a>Next</a></div></article>", PROSE),
        (f"<body><div><a>Home</a> <a>Next</a></div><div><p>{PROSE}</p></div>", PROSE),
        ('<article><p>A <span class="ad">x <span>y <span>z</span> w</span> tail</span> B</p></article>', "A B"),
        (f"<body><article><p>{PROSE}</p></article><div id=comments><article class=comment><p>{PROSE} {PROSE}</p></article></div>", PROSE),
        (f"<body><div class=post><h1>T</h1><div class=entry><p>{PROSE}</p><p>s</p></div></div><div id=comments><div class=comment>{PROSE * 3}</div></div><div class=foot>Copyright 2024. All rights.</div>", f"T\n{PROSE}\ns"),
        (f"<body><form id=f><div class=hd><a>a</a></div><div class=c><p>{PROSE}</p><p>{PROSE}</p></div></form>", f"{PROSE}\n{PROSE}"),
        (f"<body><table><tr><td>a<td>b<tr><td>{PROSE}</table>", f"a\nb\n{PROSE}"),
        ("a < b and c > d <3", "a < b and c > d <3"),
        ("<ul><li><a>One</a><li><a>Two</a></ul>", "One\nTwo"),
        ("<script>var a = '<p>x</p>'", ""),
        ("<title>t<p>x", "t\nx"),
        ("  \n ", ""),
    ],
)
def test_pages(page, want):
    assert extract(page) == want


@pytest.mark.parametrize(
    "page",
    [
        '"a <b ' * 170_000, "a <b " * 200_000, "<p x=\"'" * 120_000, "<p x='" * 150_000 + ">", "<div>" * 60_000 + "t", "<i>" + "<div>" * 20_000 + "</i>" * 20_000, "<b class=ad>" * 50_000,
        "<li>" * 50_000 + "x", "<blockquote>" * 20_000 + "<li>x" * 20_000, "<" * 500_000, "<!--" * 100_000, "<a><b><br>" * 30_000, "<table>" * 5_000 + "<td>x" * 5_000, "<span class=ad><br>" * 20_000,
        "&" * 300_000, "<p " + "class=ad " * 100_000 + ">x",
    ],
)
def test_time_grows_with_the_page(page):
    start = time.time()
    extract(page)
    assert time.time() - start < 10
