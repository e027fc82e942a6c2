"""Labelled pages from which ``htmlextract`` learns its weights.

Each page is written once, in the manner of a kind of site; what stands between ``[[`` and
``]]`` is its main text. Placeholders are filled with words: ``{t}`` a title, ``{s}`` a short
line, ``{p}`` a paragraph (which may be one word), ``{l}`` list items with links, ``{n}`` links
in a row. Words are no features; their number, their links and the marks at their end are.
Pages of one kind are learned from or held out together.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Fillings of each page.
FILLINGS = 4

_HEAD = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>{t}</title><style>b{{}}</style></head>'

PAGES = {
    "blog": _HEAD + """<body class="home single"><header class="site-header" role="banner"><div class="site-title"><a href="/">{t}</a></div><p class="tagline">{s}</p></header>
<nav class="main-navigation" role="navigation"><ul class="menu">{l}</ul></nav>
<div id="content" class="site-content"><main id="main" role="main"><article class="post hentry">[[<header class="entry-header"><h1 class="entry-title">{t}</h1></header><div class="entry-content"><p>{p}</p><p>{p}</p><h2>{t}</h2><p>{p}</p><blockquote><p>{p}</p></blockquote><p>{p}</p></div>]]
<div class="sharedaddy social-share"><h3>{s}</h3><ul class="share">{l}</ul></div><footer class="entry-footer"><span class="tags-links">{n}</span></footer></article>
<nav class="post-navigation"><div class="nav-previous"><a href="#">{t}</a></div><div class="nav-next"><a href="#">{t}</a></div></nav>
<section id="comments" class="comments-area"><h2 class="comments-title">{s}</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><footer class="comment-meta">{s}</footer><div class="comment-content"><p>{p}</p></div><div class="reply">{n}</div></article></li><li class="comment"><article class="comment-body"><div class="comment-content"><p>{p}</p><p>{p}</p></div></article></li></ol><div id="respond" class="comment-respond"><h3>{s}</h3><form id="commentform"><label>{s}</label><textarea name="comment"></textarea><input type="submit" value="x"></form></div></section></main></div>
<aside id="secondary" class="widget-area sidebar" role="complementary"><section class="widget"><h2 class="widget-title">{s}</h2><ul>{l}</ul></section><section class="widget"><p>{p}</p></section></aside>
<footer id="colophon" class="site-footer" role="contentinfo"><div class="site-info"><p>{p}</p>{n}</div></footer></body></html>""",
    "news": _HEAD + """<body><div id="cookie-banner" class="cookie-notice"><p>{p}</p><button>{s}</button></div><div class="topbar"><ul>{l}</ul></div><header><div class="logo">{n}</div><form class="search-form"><input name="q"><button>{s}</button></form></header><nav><ul>{l}</ul></nav>
<div class="breadcrumb">{n}</div><div class="page"><main><article itemtype="article">[[<h1>{t}</h1><p class="lead">{p}</p><figure><img src="x"><figcaption>{s}</figcaption></figure><p>{p}</p>]]<div class="ad advertisement"><p>{p}</p></div>[[<p>{p}</p><p>{p}</p><h2>{t}</h2><p>{p}</p>]]<aside class="related related-articles"><h3>{s}</h3><ul>{l}</ul></aside>[[<p>{p}</p><p>{p}</p>]]<div class="newsletter signup"><p>{p}</p><form><input></form></div></article></main>
<aside class="sidebar"><div class="ad-slot banner"><a href="#">{s}</a></div><div class="trending popular"><h3>{s}</h3><ol>{l}</ol></div></aside></div><div class="recommended"><h3>{s}</h3>{n}</div><footer><p>{p}</p><ul>{l}</ul><p class="copyright">{s}</p></footer></body></html>""",
    "plain": _HEAD + """<body><div id="header"><h1><a href="/">{s}</a></h1></div><div id="nav"><ul>{l}</ul></div><div id="content">[[<h2>{t}</h2><p>{p}</p><p>{p}</p><p>{p}</p><ul><li>{p}</li><li>{p}</li></ul><p>{p}</p>]]</div><div id="sidebar"><h3>{s}</h3><ul>{l}</ul></div><div id="footer"><p>{p}</p></div></body></html>""",
    "tables": _HEAD + """<body><table><tr><td colspan="2" class="banner"><a href="/">{s}</a></td></tr><tr><td class="leftmenu">{n}<br>{n}</td><td>[[<p>{p}</p><p>{p}<br>{p}</p><p>{p}</p>]]</td></tr><tr><td colspan="2" class="copyright">{s}</td></tr></table></body></html>""",
    "docs": _HEAD + """<body><header class="navbar"><a class="navbar-brand" href="/">{s}</a><ul class="navbar-nav">{l}</ul></header><div class="sidebar-left toc"><ul>{l}</ul></div><div class="document" role="main"><div class="body">[[<h1>{t}</h1><p>{p}</p><pre>{p}</pre><h2>{t}</h2><p>{p}</p><table><tr><th>{s}</th><td>{s}</td></tr><tr><th>{s}</th><td>{p}</td></tr></table><p>{p}</p>]]</div><div class="pagination prev-next">{n}</div></div><div class="footer">{s}</div><script>x</script></body></html>""",
    "wiki": _HEAD + """<body><div class="notice sitenotice"><p>{p}</p></div><div id="mw-content" class="mw-body"><main>[[<h1 id="firstHeading">{t}</h1>]]<div id="toc" class="toc"><ul>{l}</ul></div><div class="mw-parser-output">[[<p>{p}</p><h2>{t}</h2><p>{p}</p><p>{p}</p><ul><li>{p}</li><li>{p}</li></ul><p>{p}</p>]]<div class="navbox" role="navigation">{n}</div></div></main></div><div id="mw-navigation"><div id="p-search" role="search"><form><input></form></div><div class="portal" id="p-tb"><h3>{s}</h3><ul>{l}</ul></div></div><footer id="footer-info"><ul><li>{s}</li><li>{s}</li></ul></footer></body></html>""",
    "shop": _HEAD + """<body><div class="announcement promo-bar"><p>{s}</p></div><header class="page-header"><div class="mini-cart">{n}</div><div class="login account">{n}</div></header><div class="mega-menu"><ul>{l}</ul></div><div class="breadcrumbs">{n}</div><section class="product"><div class="product-description description">[[<h1>{t}</h1><p>{p}</p><p>{p}</p><p>{p}</p><p>{p}</p>]]</div><form class="cart"><select><option>{s}</option></select><button>{s}</button></form></section><section class="reviews user-reviews"><h3>{s}</h3><div class="review"><p>{p}</p></div><div class="review"><p>{p}</p></div></section><div class="upsell related-products"><ul>{l}</ul></div><div class="modal popup overlay"><p>{p}</p></div><footer class="page-footer"><div class="links">{n}</div><p class="legal disclaimer">{p}</p></footer></body></html>""",
    "magazine": _HEAD + """<body><div class="skip-link"><a href="#m">{s}</a></div><div class="masthead"><a href="/">{s}</a></div><div class="subnav nav">{n}</div><section class="story story-body">[[<h1 class="headline title">{t}</h1><div class="byline">{s}</div><div class="article-text text"><p>{p}</p><p>{p}</p>]]<div class="ads sponsored"><a href="#">{s}</a><p>{p}</p></div>[[<p>{p}</p><h3>{t}</h3><p>{p}</p><p>{p}</p></div>]]</section><section class="discussion"><div class="comments"><h4>{s}</h4><div class="comment"><p class="comment-text">{p}</p></div><div class="comment"><p>{p}</p></div></div></section><div class="social follow">{n}</div><div class="subscribe cta"><p>{p}</p></div><div class="bottom footer-links">{n}</div></body></html>""",
    "german": _HEAD + """<body><div class="kopf"><a href="/">{s}</a></div><div class="navigation menue"><ul>{l}</ul></div><div class="hinweis cookie-hinweis"><p>{p}</p></div><div class="inhalt hauptinhalt"><div class="artikel beitrag">[[<h1>{t}</h1><p>{p}</p><p>{p}</p>]]<div class="anzeige werbung"><p>{p}</p></div>[[<p>{p}</p><p>{p}</p>]]</div><div class="kommentare"><h3>{s}</h3><div class="kommentar"><p>{p}</p></div></div></div><div class="seitenleiste"><ul>{l}</ul></div><div class="fusszeile"><p>{s}</p>{n}</div></body></html>""",
    "french": _HEAD + """<body><div class="entete">{n}</div><div class="barre-navigation"><ul>{l}</ul></div><div class="contenu"><div class="article texte">[[<h1>{t}</h1><p>{p}</p><p>{p}</p>]]<div class="publicite pub"><p>{p}</p></div>[[<p>{p}</p><p>{p}</p>]]</div><div class="commentaires"><div class="commentaire"><p>{p}</p></div></div></div><div class="avis bandeau"><p>{p}</p></div><div class="lateral"><ul>{l}</ul></div><div class="pied"><p>{s}</p></div></body></html>""",
    "spanish": _HEAD + """<body><div class="cabecera">{n}</div><div class="menu-principal"><ul>{l}</ul></div><div class="contenido"><div class="articulo noticia">[[<h1>{t}</h1><p>{p}</p><p>{p}</p>]]<div class="publicidad anuncio"><p>{p}</p></div>[[<p>{p}</p><p>{p}</p>]]</div><div class="comentarios"><div class="comentario"><p>{p}</p></div></div></div><div class="aviso"><p>{p}</p></div><div class="lateral barra"><ul>{l}</ul></div><div class="pie"><p>{s}</p></div></body></html>""",
    "semantic": _HEAD + """<body><header><h1>{s}</h1><p>{s}</p></header><nav>{n}</nav><main><article>[[<header><h1>{t}</h1></header><section><h2>{t}</h2><p>{p}</p><p>{p}</p></section><section><h2>{t}</h2><p>{p}</p></section>]]<footer><p>{s}</p></footer></article><section class="comments"><article><p>{p}</p></article><article><p>{p}</p></article></section></main><aside><p>{p}</p><ul>{l}</ul></aside><dialog open><p>{p}</p></dialog><div role="alert"><p>{p}</p></div><div hidden><p>{p}</p></div><div aria-hidden="true"><p>{s}</p></div><form><p>{s}</p><label>{s}</label><input></form><footer><p>{p}</p>{n}</footer></body></html>""",
    "portal": _HEAD + """<body><div class="consent gdpr-message"><p>{p}</p></div><div class="site-message warning"><p>{p}</p></div><div class="toolbar tools">{n}</div><div class="main-menu hamburger">{l}</div><div class="container"><div class="main-content content-text">[[<h1>{t}</h1><p>{p}</p><p>{p}</p>]]<div class="promotion partner-content sponsor"><p>{p}</p></div>[[<p>{p}</p><p>{p}</p></div>]]<div class="right-column rail"><div class="adsense adsbox">{s}</div><div class="box most-read"><ul>{l}</ul></div></div></div><div class="feedback reader-comments"><p>{p}</p><p>{p}</p></div><div class="contact-form"><p>{s}</p><form><p>{p}</p><input></form></div><div class="toast alert"><p>{s}</p></div><div class="credits bottom-bar">{s}</div></body></html>""",
    "cms": _HEAD + """<body><div id="top-bar">{n}</div><div id="page-header"><h2>{s}</h2></div><div id="left-nav">{n}</div><div id="page"><div id="main-column"><div class="post-content post-body">[[<h1 class="post-title">{t}</h1><p>{p}</p><p>{p}</p><p>{p}</p>]]</div><div class="author-box bio"><p>{p}</p></div><div id="disqus_thread" class="comments"><p>{p}</p></div></div><div id="right-sidebar"><p>{p}</p></div></div><div id="page-footer"><p>{p}</p></div></body></html>""",
    "bare": _HEAD + """<body><div><a href="/">{s}</a></div><div><ul>{l}</ul></div><div><div>[[<h1>{t}</h1><p>{p}</p><p>{p}</p><p>{p}</p><p>{p}</p><p>{p}</p>]]</div></div><div><ul>{l}</ul></div><div>{n}</div></body></html>""",
    "article": _HEAD + """<body><nav><ul>{l}</ul></nav><div class="ads"><p>{s}</p></div><article>[[<h1>{t}</h1><p><b>{p}<br><p>{p}</p><p>{p}</p><p>{p}</p>]]</article><div class="advert">{s}</div><footer>&copy; {s}</footer></body></html>""",
}


def _fill(page: str, r: random.Random) -> str:
    words = lambda n: " ".join("w" * r.randint(1, 9) for _ in range(n))

    def paragraph() -> str:
        if r.random() < 0.12:
            return words(r.randint(1, 3)) + "."
        text = ". ".join(words(r.randint(4, 22)) for _ in range(r.randint(1, 5))) + "."
        return text.replace(" w", ' <a href="#">w</a> w', 1) if r.random() < 0.15 else text

    links = lambda tag, n: "".join(f'<{tag}><a href="#">{words(r.randint(1, 4))}</a></{tag}>' if tag else f' <a href="#">{words(r.randint(1, 2))}</a> ' for _ in range(n))
    out = page.replace("{{}}", "")
    for mark, make in (("{t}", lambda: words(r.randint(2, 9))), ("{s}", lambda: words(r.randint(1, 7))), ("{p}", paragraph), ("{l}", lambda: links("li", r.randint(3, 9))), ("{n}", lambda: links("", r.randint(2, 7)))):
        parts = out.split(mark)
        out = parts[0] + "".join(make() + x for x in parts[1:])
    return out


def labelled(kinds: tuple[str, ...] | None = None) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(html, ranges of the html that are main text) for the pages of ``kinds`` (all)."""
    for kind in kinds or tuple(PAGES):
        for k in range(FILLINGS):
            marked = _fill(PAGES[kind], random.Random(f"{kind} {k}"))
            html, ranges, at = "", [], 0
            for piece in marked.split("[["):
                main, found, rest = piece.partition("]]")
                if found:
                    ranges.append((len(html), len(html) + len(main)))
                    html += main + rest
                else:
                    html += piece
            yield html, ranges
