"""Labelled pages that the extraction model is trained on.

`data-label="1"` marks content and everything below it, `data-label="0"` what is
no content inside of it; elements above or beside carry 0.  Texts are stand-ins:
{s} a short line, {m} a sentence, {l} a paragraph.
"""

SHORT = "Read on"
MIDDLE = "The quick brown fox jumps over the lazy dog near the river."
LONG = " ".join([MIDDLE, "It was seen, by many, on the way to town.", "Nobody minded it at all."] * 3)

_PAGES = [
    # a news article
    """<html><head><title>{m}</title><meta charset=utf-8><style>a{}</style></head><body>
    <header class="site-header"><div class="logo">{s}</div><nav class="menu"><ul><li><a href=/>{s}</a></li><li><a href=/>{s}</a></li>
    <li><a href=/>{s}</a></li></ul></nav></header><div class="ad banner">{m}</div>
    <article data-label="1"><h1>{m}</h1><p>{l}</p><p>{s}</p><p>{l}</p><h2>{s}</h2><p>{m}</p><blockquote>{m}</blockquote></article>
    <aside class="sidebar"><h3>{s}</h3><ul><li><a href=/>{m}</a></li><li><a href=/>{m}</a></li></ul></aside>
    <footer>{m}</footer></body></html>""",
    # the same kind with an advert inside the article
    """<html><head><title>{m}</title></head><body><nav><ul><li><a href=/>{s}</a></li><li><a href=/>{s}</a></li></ul></nav>
    <div class="ad">{m}</div><article data-label="1"><h1>{m}</h1><p>{l}</p><div class="ad promo" data-label="0">{m}</div><p>{l}</p>
    <ul><li>{m}</li><li>{m}</li></ul><p>{s}</p></article><footer>{s}</footer></body></html>""",
    # a blog with reader comments
    """<html><body><div id="header"><h1 class="site-title">{s}</h1><div class="menu nav"><a href=/>{s}</a> <a href=/>{s}</a></div></div>
    <div id="content" class="main"><div class="post entry" data-label="1"><h2>{m}</h2><p>{l}</p><p>{m}</p><p>{l}</p></div>
    <div id="comments" class="comments"><h3>{s}</h3><div class="comment"><p>{m}</p></div><div class="comment"><p>{l}</p></div>
    <form class="comment-form"><label>{s}</label><textarea></textarea><button>{s}</button></form></div></div>
    <div id="sidebar" class="widget"><p>{m}</p><ul><li><a href=/>{s}</a></li></ul></div><div id="footer">{s}</div></body></html>""",
    # a page with a cookie notice and a newsletter form
    """<html><body><div class="cookie-notice banner" id="consent"><p>{m}</p><button>{s}</button></div><header><nav><a href=/>{s}</a></nav></header>
    <main data-label="1"><h1>{m}</h1><p>{l}</p><h2>{s}</h2><p>{l}</p><ol><li>{m}</li><li>{s}</li></ol></main>
    <section class="newsletter"><form><p>{m}</p><input><button>{s}</button></form></section><section class="related"><h3>{s}</h3>
    <a href=/>{m}</a><a href=/>{m}</a></section><footer><p>{m}</p><ul><li><a href=/>{s}</a></li></ul></footer></body></html>""",
    # a table layout
    """<html><body><table class="layout"><tr><td class="nav menu"><a href=/>{s}</a><a href=/>{s}</a></td>
    <td class="content text" data-label="1"><h1>{m}</h1><p>{l}</p><p>{m}</p><table><tr><th>{s}</th><td>{s}</td></tr></table></td></tr>
    </table><div class="copyright footer">{m}</div></body></html>""",
    # notices, share links and breadcrumbs around an article
    """<html><body><div class="breadcrumb"><a href=/>{s}</a></div><div class="notice alert" role="alert"><p>{m}</p></div>
    <div class="article-body story" data-label="1"><h1>{m}</h1><p>{m}</p><p>{l}</p><figure><figcaption>{m}</figcaption></figure><pre>{m}</pre></div>
    <div class="share social"><a href=/>{s}</a><a href=/>{s}</a></div><div class="advertisement sponsored">{m}</div>
    <div class="popup subscribe"><p>{m}</p></div><footer class="footer">{m}</footer></body></html>""",
    # comments below an article, in a section of their own
    """<html><body><nav>{s}</nav><article data-label="1"><h1>{s}</h1><p>{l}</p><p>{s}</p><p>{s}</p><p>{m}</p>
    <section class="comments" data-label="0"><h2>{s}</h2><p>{m}</p><p>{l}</p></section></article>
    <aside>{m}</aside><form><p>{s}</p></form><footer>{m}</footer></body></html>""",
    # plain pages
    """<html><body data-label="1"><h1>{m}</h1><p>{l}</p><p>{m}</p><p>{l}</p></body></html>""",
    """<html><body><div class="top search"><form>{s}<input></form></div><div class="page" data-label="1"><p>{l}</p><p>{l}</p><h3>{s}</h3>
    <p>{m}</p></div><div class="links menu"><ul><li><a href=/>{s}</a></li><li><a href=/>{s}</a></li></ul></div></body></html>""",
]


def labelled_pages() -> list[str]:
    pages = [p.replace("{s}", SHORT).replace("{m}", MIDDLE).replace("{l}", LONG) for p in _PAGES]
    # an article of short paragraphs is content as well
    return pages + [p.replace("{s}", SHORT).replace("{m}", SHORT + ".").replace("{l}", MIDDLE) for p in _PAGES]
