import random

import pytest

from tallyframe.llm.html_text import extract, main_text

LONG = "It was the best of times and it was the worst of times, and all of us were in it for the sake of one more day."
MORE = "The house that he had built for them stood on a hill, and from there they could see all of the land that was theirs."

PAGES = [
    (None, ""), ("", ""), ("<p>", ""), ("plain words", ""),
    (f"<html><body><nav><a href=x>Home</a></nav><article><header><h1>A title</h1></header><p>{LONG}</p><p>Yes.</p><footer>By me</footer></article><footer>Foot</footer>", f"A title\n\n{LONG}\n\nYes."),
    (f"<div class='cookie-notice'>{LONG}</div><main><p>{LONG}<p>{MORE}</main><aside>{MORE}</aside>", f"{LONG}\n\n{MORE}"),
    (f"<article><p>{LONG}</p><div class=\"ad\">Buy it for the sake of it</div><p>{MORE}</p><section id=comments><article class=comment><p>{LONG}</p></article></section></article>", f"{LONG}\n\n{MORE}"),
    (f"<div>{LONG}</div><div>Short one.</div><div>{MORE}</div><div><a href=1>Next page</a> <a href=2>Last page</a></div>", f"{LONG}\n\nShort one.\n\n{MORE}"),
    (f"<body><div><a href=1>Home</a></div><div>Menu</div><div><a href=1>News</a></div><div>{LONG}</div>", LONG),
    (f"<nav><ul><li><a href=x>Home</a><article><p>{LONG}</p></article>", LONG),
    (f"<article><p>a &amp;amp; b &copy &#233; &lt;p&gt;</p><p>{LONG}</p></article>", f"a &amp; b © é <p>\n\n{LONG}"),
    (f"<article><script>var t='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><p title='a>b'>{LONG}</p><form><p>{LONG}</p></form><noscript>{LONG}</noscript></article>", LONG),
    (f"<ARTICLE><P>One<BR>two\n\t three<B>bold</B></P><P>{LONG}</ARTICLE>", f"One two threebold\n\n{LONG}"),
    (f"<article><p>{LONG}</p><p>cut &am", f"{LONG}\n\ncut &am"), (f"<article><p>{LONG}</p><p cla", LONG),
    (f"<article><p>{LONG}</p><p class='share'>Share it</p><p>Kurz.</p><div style='display:none'>{LONG}</div></article>", f"{LONG}\n\nKurz."),
    ("<article><h1>Nur</h1><p>Kurz</p></article>", "Nur\n\nKurz"),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_pages(html, want):
    assert main_text(html) == want


def test_rows(spark):
    rows = [(i, f"http://h/{i}", h, "clash") for i, (h, _) in enumerate(PAGES)] + [(2, None, PAGES[5][0], "clash"), (None, "u", PAGES[4][0], None)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    for r, (i, u, h, _) in zip(got, rows):
        assert (r.page_id, r.url, r.text, r.n_chars) == (i, u, main_text(h), len(main_text(h)))
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_awkward_pages_take_linear_time():
    rng = random.Random(0)
    for piece in ("<a \"", "<p", "<!--", "&amp", "<div class='", "<<<", "<script>", "</p>", "<div>", "'>\"<b"):
        main_text(piece * 20_000)
    for _ in range(300):
        main_text("".join(rng.choice(["<p>", "</div>", "<article>", "<nav", ">", '"', "'", " the ", "<div class=ad>", "</article>", "&", "<!--", "-->", "<script>", "word"]) for _ in range(60)))
    words = " ".join(["the word"] * 200_000)
    assert main_text(f"<article><p>{words}</p></article>") == words


@pytest.mark.parametrize("before", ["<svg width=1/>", "<math/>", "<video-player src=a></video-player>", "<button-group>", "<p title='" + "x>" * 3000 + "'>", '<p data-x="' + "x>" * 3000 + '">', "<p title=it's>"])
def test_what_stands_before_an_article_leaves_it_whole(before):
    text = f"{LONG} It isn't cut."
    assert main_text(f"{before}<article><p>{text}</p></article>") == text


def page(rng, article):
    """A page and its main text, known by how it is made."""
    words = {"known": "the of and to in a is that house river stone walked", "other": "и в не на он что дом река камень шёл"}
    speak = rng.choice(list(words))
    line = lambda n: " ".join(rng.choice(words[speak].split()) for _ in range(n))
    inline = lambda t: t if rng.random() < 0.5 else f"<{(e := rng.choice('b em span dfn label data acronym ruby nobr output picture x-note'.split()))}>{t}</{e}>"
    main, body = [], ""
    for _ in range(rng.randrange(2, 9)):
        kind = rng.choice(["text", "text", "text", "aside", "ad", "links", "form", "comments", "script"])
        t = line(rng.randrange(30, 60))
        if kind == "text":
            cut = t.split(" ")
            main.append(t)
            body += "<p>" + " ".join([*cut[:5], inline(" ".join(cut[5:9])), *cut[9:]]) + "</p>"
        else:
            body += {"aside": f"<aside><p>{t}</p></aside>", "ad": f'<div class="ad-box">{t}</div>', "links": "<ul>" + "".join(f'<li><a href="/x">{line(4)}</a></li>' for _ in range(6)) + "</ul>", "form": f"<form><label>{t}</label><input></form>", "comments": f'<section id="comments"><p>{t}</p></section>', "script": f"<script>var x = '<p>{t}</p>'</script>"}[kind]
    body = f"<article>{body}</article>" if article else f"<div>{body}</div>"
    return f"<html><head><title>{line(3)}</title></head><body><nav><a href='/'>{line(2)}</a></nav>{body}<footer>{line(30)}</footer></body></html>", "\n\n".join(main)


@pytest.mark.parametrize("article", [True, False])
def test_generated_pages(article):
    rng = random.Random(5)
    for _ in range(300):
        html, want = page(rng, article)
        assert main_text(html) == want


def test_elements_of_a_pages_own():
    text = "The whole of the story is told to the reader in a few words, and that is that."
    assert main_text(f"<body><cookie-banner><p>{text}</p></cookie-banner><my-story><p>{text}</p></my-story><x-share-bar/><p>{text} <x-mark>More</x-mark></p></body>") == f"{text}\n\n{text} More"
    assert main_text(f"<p title='{'>' * 9000}'>{text}</p><p") == text
