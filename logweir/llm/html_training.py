"""Training pages of known labels for the block classifier, laid out at random; and the training.

A page is put together from the parts that pages have: menus, headers, notices, adverts, the article,
sidebars, forms, comments, footers. Each part is marked up in one of several ways: by a semantic
tag, by a class or id, by a name that says nothing, or not at all. Words are random letters, so only
shape can be learnt. Content blocks carry a mark in their first word, which tells their label.
"""

from __future__ import annotations

import random

import numpy as np

from logweir.llm.html_extract import FEATURES, Labeller, blocks, edges, features, min_cut

#: Pages to fit on and pages to choose the edges' strength on; the mark of content.
FIT, CHOOSE, MARK = 300, 150, "qz"


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(rng.randint(low, high)))


def _sentence(rng: random.Random, low: int = 4, high: int = 16) -> str:
    text = _words(rng, low, high)
    if rng.random() < 0.4:
        text = text.replace(" ", ", ", 1)
    return text.capitalize() + rng.choice("....?!")


def _prose(rng: random.Random, most: int = 6) -> str:
    return " ".join(_sentence(rng, rng.choice([1, 4])) for _ in range(rng.randint(1, most)))


def _odd(rng: random.Random) -> str:
    """A name that says nothing, or none."""
    return rng.choice(["", "", f' class="{rng.choice(["box", "x1", "wrap", "c-3", "unit", "lorem", "grid"])}"', f' id="{rng.choice(["a1", "region", "blk"])}"'])


def _box(rng: random.Random, inner: str, tags: list[str], names: list[str], marked: bool = False) -> str:
    """Marked by a tag, by a name, or, unless it has to be, by neither."""
    kind = rng.random() * (0.85 if marked else 1)
    if kind < 0.4 and tags:
        tag = rng.choice(tags)
        return f"<{tag}{_odd(rng)}>{inner}</{tag}>"
    if kind < 0.85:
        name = rng.choice(names)
        return f'<div {rng.choice(["class", "id"])}="{name}">{inner}</div>'
    return f"<div{_odd(rng)}>{inner}</div>"


def _links(rng: random.Random) -> str:
    items = [f'<a href="/{k}">{_words(rng, 1, 4)}</a>' for k in range(rng.randint(3, 9))]
    kind = rng.random()
    if kind < 0.7:
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
    return " | ".join(items) if kind < 0.85 else "".join(f"<div>{i}</div>" for i in items)


def _teasers(rng: random.Random) -> str:
    return f"<h3>{_words(rng, 1, 3)}</h3>" + "".join(f'<a href="/{k}"><h4>{_words(rng, 3, 9)}</h4></a>' + (f"<p>{_sentence(rng)}</p>" if rng.random() < 0.4 else "") for k in range(rng.randint(2, 5)))


def _menu(rng):
    return _box(rng, _links(rng), ["nav", "menu"], ["nav", "menu", "navbar", "main-menu", "breadcrumbs"])


def _header(rng):
    return _box(rng, f'<a href="/">{_words(rng, 1, 3)}</a> <p>{_words(rng, 2, 6)}</p>', ["header"], ["header", "masthead", "site-header", "topbar"])


def _notice(rng):
    return _box(rng, f"<p>{_prose(rng, 2)}</p><button>{_words(rng, 1, 2)}</button>", ["dialog", "aside"], ["cookie-notice", "consent", "alert", "gdpr-banner", "popup"])


def _advert(rng, marked=False):
    return _box(rng, _prose(rng, 2), ["aside"], ["ad", "advert", "sponsored", "promo-box", "banner"], marked)


def _sidebar(rng, marked=False):
    return _box(rng, rng.choice([_teasers, _teasers, lambda r: f"<h3>{_words(r, 1, 3)}</h3><p>{_prose(r, 2)}</p>"])(rng), ["aside"], ["sidebar", "related", "side", "recommended-list", "widget", "trending"], marked)


def _form(rng, marked=False):
    return _box(rng, f"<form><p>{_sentence(rng)}</p><label>{_words(rng, 1, 3)}</label><input><button>{_words(rng, 1, 2)}</button></form>", [], ["newsletter", "search-box", "signup", "subscribe"], marked)


def _comments(rng):
    one = lambda: _box(rng, f'<a href="/u">{_words(rng, 1, 2)}</a><p>{_prose(rng, 3)}</p>', ["li", "article"], ["comment", "comment-body", "reply"])
    name = rng.choice(["comments", "comment-list", "respond", "disqus_thread", "discussion"])
    return f'<{(tag := rng.choice(["section", "div", "ol"]))} id="{name}"><h2>{_words(rng, 1, 3)}</h2>' + "".join(one() for _ in range(rng.randint(1, 5))) + f"</{tag}>"


def _footer(rng):
    return _box(rng, f"<p>© {_words(rng, 1, 4)} {_sentence(rng) if rng.random() < 0.5 else ''}</p>{_links(rng) if rng.random() < 0.5 else ''}", ["footer"], ["footer", "legal", "copyright", "site-footer"])


def _article(rng):
    own = lambda text: f"{MARK} {text}"
    parts = [f"<h{(n := rng.choice([1, 1, 1, 2]))}>{own(_words(rng, 2, 9))}</h{n}>"]
    for _ in range(rng.choice([1, 2, 4, 8, 12])):
        kind = rng.random()
        if kind < 0.6:
            text = own(_prose(rng))
            if rng.random() < 0.3:
                text += f' <a href="/in">{_words(rng, 1, 3)}</a> {_sentence(rng)}'
            parts.append(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>"]).format(text))
        elif kind < 0.7:
            parts.append(f"<h3>{own(_words(rng, 1, 6))}</h3>")
        elif kind < 0.78:
            parts.append("<ul>" + "".join(f"<li>{own(_words(rng, 1, 8))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.83:
            parts.append("<ul>" + "".join(f'<li><a href="/r">{own(_words(rng, 2, 5))}</a></li>' for _ in range(rng.randint(1, 3))) + "</ul>")
        elif kind < 0.9:
            parts.append(f"<p>{MARK}{rng.choice([_words(rng, 1, 4), _words(rng, 0, 1), _sentence(rng, 1, 4)])}{rng.choice(['', '.'])}</p>")
        elif kind < 0.93:
            parts.append(f"<blockquote>{own(_prose(rng, 2))}</blockquote>")
        elif kind < 0.96:
            parts.append("<table>" + "".join(f"<tr><td>{own(_words(rng, 1, 3))}</td><td>{own(_words(rng, 1, 2))}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
        else:
            parts.append(rng.choice([_advert, _sidebar, _form])(rng, True))
    inner = "".join(parts)
    kind = rng.random()
    if kind < 0.45:
        return f"<{(tag := rng.choice(['article', 'article', 'main']))}{_odd(rng)}>{inner}</{tag}>"
    if kind < 0.75:
        return f'<div {rng.choice(["class", "id"])}="{rng.choice(["content", "entry-content", "post", "story-body", "main", "article-text"])}">{inner}</div>'
    return f"<div{_odd(rng)}>{inner}</div>"


def page(seed: int) -> str:
    """A page; the text of its content blocks begins with ``MARK``."""
    rng = random.Random(seed)
    some = lambda part, p: part(rng) if rng.random() < p else ""
    before = [some(_header, 0.7), some(_menu, 0.8), some(_notice, 0.3), some(_advert, 0.4)]
    after = [some(_sidebar, 0.5), some(_form, 0.3), some(_comments, 0.4), some(_advert, 0.2)]
    rng.shuffle(before)
    rng.shuffle(after)
    inner = "".join(before) + _article(rng) + "".join(after)
    if rng.random() < 0.3:
        inner = f'<div class="{rng.choice(["has-sidebar", "post-comments-enabled", "page", "search-results-main", "wrap"])}">{inner}</div>'
    if rng.random() < 0.1:
        inner = f"<form>{inner}</form>"
    return f"<html><head><title>{_words(rng, 2, 6)}</title></head><body>{inner}{some(_footer, 0.8)}</body></html>"


def labelled(seeds: range) -> list[tuple[list, list[bool]]]:
    """Pages as blocks, and whether each is content."""
    pages = [blocks(page(s)) for s in seeds]
    return [(p, [b.text.startswith(MARK) for b in p]) for p in pages]


def mistakes(pages: list[tuple[list, list[bool]]], how: Labeller) -> int:
    return sum(x != y for p, truth in pages for x, y in zip(how.labels(p), truth, strict=True))


def train(fit: int = FIT, choose: int = CHOOSE) -> Labeller:
    known = labelled(range(fit))
    x = np.array([features(b) for p, _ in known for b in p])
    y = np.array([t for _, truth in known for t in truth], float)
    w = np.zeros(len(FEATURES))
    # Newton's method with a ridge.
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (y - p) - 0.5 * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    weights = tuple(round(float(v), 4) for v in w)
    new = labelled(range(fit, fit + choose))
    prefer = [[Labeller(weights, 0, 0).preference(b) for b in p] for p, _ in new]

    def wrong(adjacent: float, sibling: float) -> int:
        return sum(a != b for (p, truth), own in zip(new, prefer, strict=True) for a, b in zip(min_cut(own, edges(p, adjacent, sibling)), truth, strict=True))

    adjacent, sibling = min(((a, s) for a in (0.0, 1.0, 2.0, 4.0, 6.0) for s in (0.0, 0.5, 1.0, 2.0)), key=lambda e: (wrong(*e), e))
    return Labeller(weights, adjacent, sibling)
