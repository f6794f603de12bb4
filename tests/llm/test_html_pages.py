"""Pages of other make-ups than the tables' own."""

import pytest

from fathom.llm.html_text import evidence, main_text

L = "A long paragraph of real content, with many words in it, so that its ratio of text to tags is high and it is in a cluster."
M = "Another one, which tells of other things at some length, as the second paragraph of a text would do on most pages."

PAGES = {
    "siblings in main": (f"<main><article>{''.join(f'<p>{L} {i}</p>' for i in range(6))}</article><article>{''.join(f'<p>{M} {i}</p>' for i in range(4))}</article></main>", [*[f"{L} {i}" for i in range(6)], *[f"{M} {i}" for i in range(4)]]),
    "siblings in body": (f"<body><nav>x</nav><article><p>{L}</p></article><article><p>{M}</p></article></body>", [L, M]),
    "lead before the article": (f"<main><h1>T</h1><p>Lead</p><article><p>{L}</p></article></main>", ["T", "Lead", L]),
    "heading before the article": (f"<body><div class=page><h1>T</h1><article><p>{L}</p></article><div class=sidebar><p>{M}</p></div></div></body>", ["T", L]),
    "words of subjects": (f"<article><h1>T</h1><p>{L}</p><section id='discussion'><h2 id='social-impact'>Impact</h2><p id='share-of-gdp'>{M}</p><p class='ad-hoc'>Ad hoc.</p></section></article>", ["T", L, "Impact", M, "Ad hoc."]),
    "related work": (f"<article><p>{L}</p><section id='related'><h2>Related work</h2><p>{M}</p></section></article>", [L, "Related work", M]),
    "related links": (f"<article><p>{L}</p><section id='related'><h2>More</h2><ul><li><a href=x>{M}</a></li></ul></section></article>", [L]),
    "short lines": (f"<p>{L} {M}</p><p>a</p><p>b</p><p>c</p><p>d</p>", [f"{L} {M}", "a", "b", "c", "d"]),
    "title and end beside": (f"<body><h1>T</h1><p class=lead>Lead</p><div class='body'><p>{L}</p><p>{M}</p></div><div><p>Last section, short.</p></div></body>", ["T", "Lead", L, M, "Last section, short."]),
    "menu without a class": (f"<body><div><a href=a>Home</a> <a href=b>About us</a></div><div><p>{L}</p><p>{M}</p></div><div>© 2020 Foo</div></body>", [L, M]),
    "table": (f"<table><tr><td><a href=x>Home</a><br><a href=y>News</a></td><td><p>{L}</p><p>{M}</p></td></tr></table>", [L, M]),
    "comments outweigh": (f"<body><div class='post'><h1>T</h1><p>{L}</p></div><div id='comments'><h3>2 comments</h3><p>{M * 5}</p></div><div class='footer'>x</div></body>", ["T", L]),
    "readers' words": (f"<article><h1>T</h1><p>{L}</p><div class='reader-comments'><p>{M}</p></div><div class='user-discussion'><p>{M}</p></div></article>", ["T", L]),
    "layout class": (f"<body class='has-sidebar'><div class='sidebar page'><h1>T</h1><p>{L}</p></div></body>", ["T", L]),
    "notice": (f"<body><div class='cookie-notice'><p>{M}</p><button>ok</button></div><div class='content'><h1>T</h1><p>{L}</p></div></body>", ["T", L]),
    "roles": (f"<body><div role='navigation'>x</div><div role='main'><h2>H</h2><p>{L}</p><div class='ad'>Buy {M}</div></div><p>out</p></body>", ["H", L]),
    "buttons and forms": (f"<article><p>{L}</p><div class='share-buttons'><a href=x>Tweet</a></div><div id='social'><a href=y>Face</a></div><div class='newsletter-box'><p>Sign up</p><input></div><p>End.</p></article>", [L, "End."]),
    "links in the text": (f"<article><p><a href=x>{L}</a></p><p>See <a href=y>the list</a></p></article>", [L, "See the list"]),
    "inline advert": (f"<article><p>{L} <span class='ad'>Buy</span> more</p></article>", [L, "more"]),
    "unclosed": (f"<article><p><b>{L}<p>{M}</article><footer>f", [L, M]),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, blocks = PAGES[name]
    assert main_text(page) == "\n\n".join(blocks)


def test_evidence():
    assert [evidence(c, i, False) for c, i in (("ad", ""), ("ad-hoc", ""), ("", "share-of-gdp"), ("", "share"), ("share", ""), ("cookieNotice", ""), ("with-sidebar", ""), ("entry-header", ""), ("discussion", ""), ("content", ""))] == [2, 1, 1, 1, 2, 2, 0, 2, 1, 0]
    assert evidence("entry-header", "", True) == 0


def test_odd_pages():
    assert [main_text(x) for x in (None, "", " ", "<", "<p", "</p></div>", "<div>" * 3000 + "x", "<nav>a", "&amp;&lt;", "<p hidden>x</p>y")] == ["", "", "", "<", "<p", "", "x", "", "&<", "y"]


def test_deep_pages_take_linear_time():
    import time

    for part in ("<div>x", "<b>x", "<p>x</i>", "<table><tr><td>x", "<li>x", "<div class='ad'>x", "<article>x", "<h1>x", "<a href=x>y"):
        began = time.process_time()
        main_text(part * 20_000)
        assert time.process_time() - began < 6, part
