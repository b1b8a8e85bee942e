"""Main text where paths decide in an article, where articles are something else, and for text without marks."""

import pytest

from loomspan.llm.html_text import main_text

LONG = "One long sentence of the body, with marks, and so on; it ends only here. And another, to be sure."
BODY = f"<p>{LONG} {LONG}</p><p>{LONG}</p><p>{LONG} {LONG} {LONG}</p>"
WANT = f"{LONG} {LONG}\n\n{LONG}\n\n{LONG} {LONG} {LONG}"
THAI = "ประเทศไทยมีประวัติศาสตร์ยาวนานและวัฒนธรรมที่หลากหลาย"
HINDI = "यह एक लंबा वाक्य है। और यह दूसरा लंबा वाक्य है।"
ARABIC = "هذه جملة طويلة، أليس كذلك؟"


def test_links_in_an_article():
    page = f"<article><h1>Head</h1>{BODY}<ul><li><a href=/a>Another story, one.</a><li><a href=/b>Another story, two.</a></ul><div><p><a href=/c>Buy shoes now, today!</a></p></div></article><div>Imprint</div>"
    assert main_text(page) == f"Head\n\n{WANT}"


def test_lists_and_tables_in_an_article_stay():
    page = f"<article>{BODY}<ol><li>First, do this.</li><li>Then that</li></ol><table><tr><td>2010</td><td>12</td></tr><tr><td>2011</td><td>15</td></tr></table></article>"
    assert main_text(page) == f"{WANT}\n\nFirst, do this.\n\nThen that\n\n2010\n\n12\n\n2011\n\n15"


@pytest.mark.parametrize("name", ["", ' class="comment"'])
def test_articles_beside_the_text(name):
    comments = f"<article{name}><p>Nice, I like it.</p></article>" * 3
    teasers = "<article><h3><a href=/x>Another head</a></h3><p>A short text, of a teaser.</p></article>" * 3
    assert main_text(f"<div><h1>Head</h1>{BODY}</div>{comments}") == f"Head\n\n{WANT}"
    assert main_text(f"<div><h1>Head</h1>{BODY}</div>{teasers}") == f"Head\n\n{WANT}"
    assert main_text(f"<article><h1>Head</h1>{BODY}</article>{teasers}") == f"Head\n\n{WANT}"


def test_text_beside_a_short_article():
    assert main_text(f"<div>{BODY}</div><article><p>{LONG} {LONG}</p></article>") == f"{WANT}\n\n{LONG} {LONG}"


def test_article_of_a_named_topic():
    assert main_text(f'<article class="post tag-nav category-comments hentry">{BODY}</article>') == WANT


@pytest.mark.parametrize("text", [THAI, HINDI, ARABIC, "Roses are red and violets are blue and so on"])
def test_scripts_and_text_without_marks(text):
    assert main_text(f"<div><a href=/>A</a> <a href=/b>B</a></div><div><p>{text} {text}</p><p>{text}</p></div>") == f"{text} {text}\n\n{text}"
    assert main_text(f"<ul><li>{text}<li>{text}</ul><pre>{text}</pre>") == f"{text}\n\n{text}\n\n{text}"


@pytest.mark.parametrize("name", ["right-sidebar", "page-with-sidebar", "layout sidebar-left", "header-fixed nav-open"])
def test_layout_names_on_wrappers(name):
    side = '<div class="sidebar"><p>Beside the text, short.</p></div>'
    assert main_text(f'<div class="{name}">{side}<div>{BODY}</div></div>') == WANT
    assert main_text(f'<form><div class="{name}">{side}<div>{BODY}</div></div></form>') == WANT
    assert main_text(f'<div>{BODY}</div><div class="comments"><p>{LONG}</p>{BODY}{BODY}</div>') == WANT
