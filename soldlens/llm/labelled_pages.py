"""Labelled training pages: layouts written as nested blocks, each block marked as content (1) or not (0).

`pages()` fills the layouts with sentences from a seeded generator, so that the model learns from structure and not from words.
"""

from __future__ import annotations

import random

SYLLABLES = "ka lo mi ren tas vo del shi pur ga nem tor is el wa bri".split()


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))


def _sentences(r: random.Random, n: int) -> str:
    return " ".join(_words(r, r.randint(3, 18)).capitalize() + r.choice(".....!?") for _ in range(n))


def _links(r: random.Random, n: int) -> str:
    return "".join(f'<li data-y="0"><a href="/{k}">{_words(r, r.randint(1, 3))}</a></li>' for k in range(n))


def _paragraphs(r: random.Random, n: int, y: int = 1) -> str:
    out = []
    for _ in range(n):
        text = _sentences(r, r.randint(1, 6))
        if r.random() < 0.2:
            text = f'<b>{_words(r, 3)}</b> {text} <a href="#">{_words(r, 2)}</a>'
        out.append(f'<p data-y="{y}">{text}</p>')
    return "".join(out)


def _block(tag: str, y: int, inner: str, attrs: str = "") -> str:
    return f'<{tag}{" " + attrs if attrs else ""} data-y="{y}">{inner}</{tag}>'


#: Names that pages commonly give to blocks of either kind.
BOILER_NAMES = (
    "ad ads advert advertisement banner sponsored promo promotion sidebar side related recommended widget menu navigation navbar nav breadcrumb breadcrumbs footer site-footer copyright header site-header masthead "
    "topbar cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login search share sharing social comments comment comment-list replies disqus pagination pager tags form toolbar"
).split()
CONTENT_NAMES = "article content main main-content post post-content post-body entry entry-content body story story-body text article-body article-content page-content".split()


def _furniture(r: random.Random, where: str) -> str:
    """Blocks that are not content, for the top, the inside, the side or the end of a page."""
    name = lambda *xs: r.choice(['class="%s"', 'id="%s"', 'class="box %s"']) % r.choice(xs)
    nav = lambda: _block(r.choice(["nav", "nav", "div", "ul"]), 0, _block("ul", 0, _links(r, r.randint(2, 9))), r.choice(["", name("menu", "navigation", "navbar", "nav", "breadcrumb", "breadcrumbs", "topbar")]))
    ad = lambda: _block(r.choice(["div", "div", "section", "aside"]), 0, _sentences(r, r.randint(1, 3)) if r.random() < 0.7 else _paragraphs(r, 1, 0), name(*BOILER_NAMES[:7]))
    notice = lambda: _block("div", 0, _sentences(r, 1) + " <button>ok</button>" if r.random() < 0.5 else _paragraphs(r, 1, 0), name("cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe"))
    header = lambda: _block("header", 0, _block(r.choice(["div", "p", "h1"]), 0, _words(r, 3)) + (nav() if r.random() < 0.5 else ""), r.choice(["", name("header", "site-header", "masthead", "topbar")]))
    form = lambda: _block("form", 0, r.choice([f"<label>{_words(r, 2)}</label> <input> <button data-y='0'>{_words(r, 1)}</button>", _paragraphs(r, 1, 0) + "<input>"]), r.choice(["", name("search", "signup", "login", "form", "subscribe")]))
    footer = lambda: _block("footer", 0, r.choice([f"&copy; {_words(r, 2)} &middot; {_sentences(r, 1)}", _paragraphs(r, 1, 0), _block("ul", 0, _links(r, 4))]), r.choice(["", name("footer", "site-footer", "copyright")]))
    side = lambda: _block(r.choice(["aside", "aside", "div"]), 0, r.choice([_block("h3", 0, _words(r, 2)), ""]) + r.choice([_block("ul", 0, _links(r, 5)), _paragraphs(r, 2, 0)]), name("sidebar", "side", "related", "recommended", "widget"))
    comments = lambda: _block(r.choice(["section", "div", "ol"]), 0, _block("h3", 0, _words(r, 2)) + "".join(_block(r.choice(["div", "li", "article"]), 0, _paragraphs(r, r.randint(1, 3), 0), name("comment", "replies", "comment-list")) for _ in range(r.randint(1, 5))), name("comments", "disqus", "comment-list", "replies"))
    share = lambda: _block("div", 0, _block("ul", 0, _links(r, 3)) if r.random() < 0.5 else _words(r, 3), name("share", "sharing", "social", "tags", "pagination", "pager", "toolbar"))
    kinds = {"top": [header, nav, nav, ad, notice, form], "inside": [ad, share, side, form, comments], "side": [side, ad, nav, form], "end": [footer, footer, comments, notice, ad, share, side]}[where]
    return r.choice(kinds)()


def _some(r: random.Random, where: str, p: float) -> str:
    out = ""
    while r.random() < p:
        out += _furniture(r, where)
    return out


def _content(r: random.Random) -> str:
    head = f'<h1 data-y="1">{_words(r, r.randint(1, 9))}</h1>' if r.random() < 0.8 else ""
    inner = head
    for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
        inner += _some(r, "inside", 0.15) + _paragraphs(r, r.randint(1, 4))
        extra = r.random()
        if extra < 0.1:
            inner += _block("ul", 1, "".join(f'<li data-y="1">{_sentences(r, 1)}</li>' for _ in range(r.randint(2, 4))))
        elif extra < 0.2:
            inner += _block("blockquote", 1, _paragraphs(r, 1))
        elif extra < 0.3:
            inner += _block("h2", 1, _words(r, 4))
        elif extra < 0.35:
            inner += _block("pre", 1, _words(r, 8))
        elif extra < 0.4:
            inner += _block("table", 1, _block("tr", 1, _block("td", 1, _words(r, 2)) + _block("td", 1, _words(r, 2))))
        elif extra < 0.45:
            inner += _block("figure", 1, '<img src="x">' + _block("figcaption", 1, _words(r, 5)))
        elif extra < 0.55:
            inner += _block(r.choice(["div", "section"]), 1, _paragraphs(r, 2))
    if r.random() < 0.15:
        inner += _sentences(r, 2)
    inner += _some(r, "inside", 0.15)
    shape = r.random()
    if shape < 0.55:
        inner = _block("article", 1, inner, r.choice(["", "", f'class="{r.choice(CONTENT_NAMES)}"']))
    elif shape < 0.8:
        inner = _block(r.choice(["div", "section"]), 1, inner, f'{r.choice(["class", "id"])}="{r.choice(CONTENT_NAMES)}"')
    else:
        inner = _block("main", 1, inner)
    if r.random() < 0.2:
        inner = _block(r.choice(["main", "div"]), 1, inner, r.choice(["", f'id="{r.choice(CONTENT_NAMES)}"']))
    return inner


def pages(n: int = 400, seed: int = 7) -> list[str]:
    out = []
    for k in range(n):
        r = random.Random(seed * 100_003 + k)
        body = _some(r, "top", 0.6) + _content(r) + _some(r, "side", 0.35) + _some(r, "end", 0.6)
        if r.random() < 0.3:
            body = _block("div", 1, body, r.choice(["", 'class="wrapper"', 'id="page"', 'class="container"']))
        out.append(f'<!DOCTYPE html><html data-y="1"><head data-y="0"><title data-y="0">{_words(r, 4)}</title></head><body data-y="1">{body}</body></html>')
    return out
