"""Labelled pages for training: layouts of parts that are labelled by hand, put together and filled with words by a seeded draw.

A part is a template: ``{s}`` is a sentence, ``{p}`` a paragraph, ``{w}`` one to four words, ``{n}`` a number, ``{o}`` and ``{c}``
a name of the part's kind.  Parts of the article are labelled ``main``, all others ``rest``.
"""

from __future__ import annotations

import random

# Ordinary layouts of web pages and the names that their parts go by.
NAMES = {
    "nav": "nav menu navbar navigation topnav main-menu breadcrumbs breadcrumb pagination pager tabs toc skip site-nav subnav links".split(),
    "header": "header masthead topbar site-header branding banner logo page-head tagline".split(),
    "footer": "footer site-footer copyright bottom colophon legal page-footer foot credits".split(),
    "aside": "sidebar aside widget related recommended popular trending rail secondary more-stories teaser promo-list tags tagcloud share social sharing".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo banner-ad adsense adslot commercial affiliate outbrain".split(),
    "notice": "cookie cookies consent notice alert gdpr cookie-bar popup modal overlay privacy-notice announcement toast paywall disclaimer".split(),
    "form": "newsletter subscribe signup search search-form login contact-form register feedback survey poll".split(),
    "comments": "comments comment comment-list replies reply discussion disqus responses thread reader-comments".split(),
    "main": "content article post entry story main post-content entry-content article-body story-body body-text main-content page text prose markdown".split(),
}
PARTS = {
    "nav": [
        "<nav><ul><li><a href='/{w}'>{w}</a></li><li><a href='/{w}'>{w}</a></li><li><a href='/{w}'>{w}</a></li><li><a href='/{w}'>{w}</a></li></ul></nav>",
        '<div class="{o}"><a href="#">{w}</a> | <a href="#">{w}</a> | <a href="#">{w}</a></div>',
        '<ul id="{o}"><li><a href="#">{w}</a><li><a href="#">{w}</a><li><a href="#">{w}</a></ul>',
        '<div role="navigation"><p><a href="#">{w}</a> &raquo; <a href="#">{w}</a> &raquo; {w}</p></div>',
        "<table><tr><td><a href='#'>{w}</a></td><td><a href='#'>{w}</a></td><td><a href='#'>{w}</a></td></tr></table>",
        '<nav class="{o}"><span>{w}</span><a href="#">{w} {n}</a><a href="#">{w}</a></nav>',
    ],
    "header": [
        "<header><h1><a href='/'>{w}</a></h1><p>{s}</p></header>",
        '<div class="{o}"><a href="/"><img src="x.png"></a><p>{w}</p></div>',
        '<div id="{o}"><h2>{w}</h2><span>{s}</span></div>',
        '<header class="{o}" role="banner"><div>{w}</div><div>{n} {w}</div></header>',
    ],
    "footer": [
        "<footer>&copy; {n} {w}. {s}</footer>",
        "<footer>&copy; {w} &middot; {s}</footer>",
        '<div class="{o}"><p>Copyright &copy; {n} {w}</p><p><a href="#">{w}</a> <a href="#">{w}</a></p></div>',
        '<div id="{o}">{s} <a href="#">{w}</a></div>',
        '<footer class="{o}" role="contentinfo"><ul><li><a href="#">{w}</a></li><li>{w}</li></ul><p>{s}</p></footer>',
    ],
    "aside": [
        "<aside><h3>{w}</h3><ul><li><a href='#'>{s}</a></li><li><a href='#'>{s}</a></li></ul></aside>",
        '<div class="{o}"><h4>{w}</h4><p>{s}</p><p><a href="#">{s}</a></p></div>',
        '<aside class="{o}"><p>{p}</p></aside>',
        '<section class="{o}"><h2>{w}</h2><div><a href="#">{s}</a><p>{s}</p></div></section>',
        '<div id="{o}" role="complementary"><p>{p}</p><p>{s}</p></div>',
        '<p class="{o}"><a href="#">{w}</a> <a href="#">{w}</a></p>',
    ],
    "ad": [
        '<div class="{o}">{s}</div>',
        '<div class="{o}">{s} {s}</div>',
        '<div id="{o}"><p>{p}</p><a href="#">{w}</a></div>',
        '<ins class="{o}"><p>{s}</p></ins>',
        '<section class="{o}"><h3>{w}</h3><p>{p}</p></section>',
        '<p class="{o}">{p}</p>',
    ],
    "notice": [
        '<div class="{o}"><p>{p}</p><button>{w}</button></div>',
        '<div role="alert">{s}</div>',
        '<dialog class="{o}"><p>{s}</p><a href="#">{w}</a></dialog>',
        '<div id="{o}" role="dialog"><h2>{w}</h2><p>{s}</p></div>',
        '<section class="{o}">{p}</section>',
    ],
    "form": [
        '<form><label>{w}</label><input name="q"><button>{w}</button></form>',
        '<form class="{o}"><p>{s}</p><select><option>{w}<option>{w}</select><input type="submit" value="x"></form>',
        '<div class="{o}"><h3>{w}</h3><form><p>{p}</p><textarea>x</textarea><button>{w}</button></form></div>',
        '<form role="search"><fieldset><legend>{w}</legend><label>{w} <input></label></fieldset></form>',
    ],
    "comments": [
        '<section class="{o}"><h3>{n} {w}</h3><article><p><b>{w}</b> {n}</p><p>{p}</p></article><article><p>{p}</p></article></section>',
        '<div id="{o}"><ol><li><cite>{w}</cite><p>{p}</p></li><li><cite>{w}</cite><p>{s}</p></li></ol></div>',
        '<div class="{o}"><div class="{o}"><h4>{w}</h4><p>{p}</p><a href="#">{w}</a></div></div>',
    ],
    "opening": ["<article>", "<article>", "<article>", '<article class="{c}">', "<main>", '<div class="{c}">', '<div id="{c}">', '<section class="{c}">', '<main><article id="{c}">', '<div class="{c}"><div class="{c}">', '<div role="main">', "<table><tr><td>", "<div>"],
    "main": [
        "<h1>{w} {w}</h1>",
        "<h1>{s}</h1>",
        "<p>{p}</p>",
        "<p>{p}</p>",
        "<p>{s}</p>",
        "<p>{w}.</p>",
        "<p><b>{s}<br><p>{p}</p>",
        "<p>{p} <a href='#'>{w}</a> {s} <em>{w}</em>.</p>",
        "<h2>{w}</h2>",
        "<h3>{s}</h3>",
        "<ul><li>{s}</li><li>{s}</li><li>{w}</li></ul>",
        "<ol><li>{p}</li><li>{s}</li></ol>",
        "<blockquote><p>{p}</p></blockquote>",
        "<blockquote>{s}</blockquote>",
        "<pre>{w} = {n};\n{w}({n})</pre>",
        "<figure><img src='x.png'><figcaption>{s}</figcaption></figure>",
        "<table><tr><th>{w}</th><th>{w}</th></tr><tr><td>{n}</td><td>{w}</td></tr></table>",
        "<dl><dt>{w}</dt><dd>{s}</dd></dl>",
        "<div>{p}</div>",
        "{p}<br><br>{p}",
        "<p>{w} | {w} | {w} | {w} | {w} | {w}</p>",
        "<p>{w} | {w} | {s}</p>",
        "<p>{w}&amp;&amp;&amp; {w}$$$ {n} {w}### {w}</p>",
        "<p>{n} {n} &copy; {w} {n}</p>",
        "<p>{w}</p>",
    ],
}
SYLLABLES = "an be ca do el fi ga ho in jo ka le ma no on pa qui re sa to un ver wi ya zu th er ing ou est çi é ü ña".split()


def words(draw: random.Random, n: int) -> str:
    return " ".join("".join(draw.choices(SYLLABLES, k=draw.choice((1, 2, 2, 3, 4)))) for _ in range(n))


def sentence(draw: random.Random) -> str:
    body = words(draw, draw.choice((1, 3, 6, 9, 14, 22)))
    if draw.random() < 0.3:
        body = body.replace(" ", ", ", 1)
    return body.capitalize() + draw.choice((".", ".", ".", ".", "!", "?", ""))


def filled(draw: random.Random, part: str, kind: str) -> str:
    made = {
        "{s}": sentence,
        "{p}": lambda d: " ".join(sentence(d) for _ in range(d.choice((1, 2, 4, 7)))),
        "{w}": lambda d: words(d, d.choice((1, 1, 2, 4))),
        "{n}": lambda d: str(d.choice((d.randint(1, 99), d.randint(1990, 2030), d.randint(1000, 99999)))),
        "{o}": lambda d: name(d, kind),
        "{c}": lambda d: name(d, "main"),
    }
    for slot, make in made.items():
        while slot in part:
            part = part.replace(slot, make(draw), 1)
    return part


def name(draw: random.Random, kind: str) -> str:
    return draw.choice(NAMES[kind])


def labelled_page(draw: random.Random) -> str:
    """One page; ``<!--label:x-->`` labels the blocks after it."""
    some = lambda kinds, most: [("rest", filled(draw, draw.choice(PARTS[k]), k)) for k in draw.choices(kinds, k=draw.randint(0, most))]
    before = some(["nav", "header", "notice", "ad", "form"], 4)
    after = some(["aside", "comments", "nav", "ad", "form", "notice"], 4)
    last = some(["footer", "footer", "nav", "notice"], 2)
    opening = draw.choice(PARTS["opening"])
    body = [("main", filled(draw, draw.choice(PARTS["main"]), "main")) for _ in range(draw.choice((1, 2, 4, 8, 14)))]
    while draw.random() < 0.6:  # something that isn't the article's inside its element
        inside = ["aside", "ad", "form", "nav", "notice"]
        body.insert(draw.randint(0, len(body)), ("rest", filled(draw, draw.choice(PARTS[k := draw.choice(inside)]), k)))
    if draw.random() < 0.2:
        body.append(("rest", filled(draw, draw.choice(PARTS["comments"]), "comments")))
    closing = "".join(f"</{t}>" for t in reversed([t[1:].split(">")[0].split()[0] for t in filled(draw, opening, "main").replace("><", ">\n<").split("\n")]))
    parts = [*before, ("main", filled(draw, opening, "main")), *body, ("rest", closing), *after, *last]
    if draw.random() < 0.3:
        parts = [("rest", '<div class="wrapper" id="page">'), *parts, ("rest", "</div>")]
    return "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(f"<!--label:{label}-->{part}" for label, part in parts) + "</body></html>"


def labelled_pages(n: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    return [labelled_page(draw) for _ in range(n)]
