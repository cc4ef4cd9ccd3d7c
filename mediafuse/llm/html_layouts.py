"""Synthetic pages with known labels, from which the block labeller is trained. Deterministic by seed."""

from __future__ import annotations

import random

#: Names that pages use for their parts. Fixed values.
NAMES = {
    "nav": "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs site-nav mainNav links tabs pagination pager skip-links toc-nav mobile-menu".split(),
    "header": "header masthead site-header page-header topbar top banner branding logo hero-bar siteHeader pageTop".split(),
    "footer": "footer site-footer page-footer bottom copyright colophon foot legal site-info footer-links siteFooter".split(),
    "side": "sidebar aside widget related recommended popular trending side rail secondary more-stories read-next rightcol tags archive author-box sideBar".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion banner-ad adbox ad-slot adsense commercial partner".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert popup modal newsletter subscribe signup paywall message toast overlay privacy disclaimer announcement warning cookieBar".split(),
    "form": "form search search-box login contact newsletter-form signup-form comment-form poll survey searchForm".split(),
    "comment": "comments comment comment-list comment-body discussion replies reply respond responses user-comments disqus thread reader-comments feedback reviews commentList".split(),
    "share": "share social sharing share-buttons social-links follow meta byline toolbar print actions".split(),
    "article": "article content post entry story main body text article-body post-content entry-content story-body main-content articleBody prose page-content blog-post news-text richtext".split(),
    "wrap": "wrapper container page row col grid inner outer layout site wrap section box block region panel".split(),
}
#: Words of such parts. Fixed values.
WORDS = {
    "nav": "home about contact news products services blog search login menu next previous help sitemap forum shop".split(),
    "header": "welcome your daily source sign in register search menu the official site est subscribe".split(),
    "footer": "copyright © all rights reserved privacy policy terms of use contact us · imprint sitemap powered by".split(),
    "side": "related articles popular posts most read trending tags archives recent you may also like about the author follow".split(),
    "ad": "sponsored advertisement buy now save sale offer discount free shipping click here limited deal order today best price".split(),
    "notice": "we use cookies to improve your experience accept consent privacy policy settings subscribe newsletter sign up update your browser javascript".split(),
    "form": "name email message send submit search password remember me login your address phone subscribe required".split(),
    "comment": "reply posted by says ago great post thanks i agree comment like report user anonymous comments leave a".split(),
    "share": "share tweet facebook print email pin follow posted on by min read views".split(),
}
TAGS = {"nav": ["nav", "div", "ul", "div"], "header": ["header", "div", "header"], "footer": ["footer", "div", "footer"], "side": ["aside", "div", "section"],
        "ad": ["div", "aside", "section", "div"], "notice": ["div", "section", "div", "p"], "form": ["form"], "comment": ["section", "div", "ol", "ul", "div"], "share": ["div", "ul", "p"]}


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice("bcdfghjklmnprstvwz") * (self.r.random() < 0.8) + self.r.choice("aeiouäéöü" if self.r.random() < 0.2 else "aeiou")
                                  + self.r.choice("nrstl") * (self.r.random() < 0.4)) for _ in range(400)]

        self.names = "own"

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def prose(self, n: int, kind: str | None = None, share: float = 0.4) -> str:
        junk = self.r.random() < 0.1
        words = [self.r.choice(WORDS[kind]) if kind and self.r.random() < share else self.word() for _ in range(n)]
        if self.r.random() < 0.06:
            words = [words[i % self.r.choice((1, 2, 3))] for i in range(n)]
        if junk:
            words = [w + self.r.choice(["***", "%%%", "!!", "$$$", "&amp;&amp;", " |", "###"]) for w in words]
        if self.r.random() < 0.1:
            words = [w.upper() if "&" not in w else w for w in words]
        for i in range(0, n, self.r.randint(5, 14)):
            words[i] = words[i].capitalize()
            if i:
                words[i - 1] += self.r.choice(".,.!.")
        return " ".join(words) + ("." if n > 4 and self.r.random() < 0.8 else "")

    def invented(self) -> str:
        """A name that says nothing, as tools make them."""
        r = self.r
        return r.choice((lambda: f"{r.choice('abcdefghkmpqstxyz')}{r.choice(('', '-', '_'))}{r.randint(1, 99)}", lambda: r.choice(("css", "sc", "jsx", "_", "e")) + "-" + "".join(r.choice("abcdefghijkmnpqrstuvwxyz0123456789") for _ in range(r.randint(4, 7))),
                         self.word, lambda: f"{self.word()}-{self.word()}", lambda: f"{self.word()}_{r.randint(1, 9)}"))()

    def name(self, kind: str) -> str:
        if self.names == "none" or self.r.random() < (0.12 if kind != "article" else 0.3):
            return ""
        if self.names == "invented" or kind == "article" and self.r.random() < 0.25:
            return f' {self.r.choice(["class", "id", "class"])}="{self.invented()}"'
        n = self.r.choice(NAMES[kind])
        if self.r.random() < 0.2:
            n += self.r.choice(["-1", " clearfix", "-wrap", "_inner", " col-8", "-v2", " " + self.r.choice(NAMES["wrap"])])
        return f' {self.r.choice(["class", "id", "class"])}="{n}"'

    def other(self, kind: str) -> str:
        r, tag = self.r, self.r.choice(TAGS[kind])
        name = self.name(kind)
        if tag in ("div", "p", "ul", "ol", "section") and not name and self.names == "own":
            name = f' class="{r.choice(NAMES[kind])}"'
        size = r.choice((1, 3, 8, 20)) if kind not in ("comment", "ad", "footer", "side", "notice") else r.choice((2, 6, 15, 40))
        link = lambda s: f'<a href="/{s[:4]}">{s}</a>'
        if kind in ("nav", "share") or kind in ("side", "footer") and r.random() < 0.5:
            items = [link(self.prose(r.randint(1, 5), kind, r.choice((0.0, 0.5)))) for _ in range(r.randint(2, 9))]
            inner = "".join(f"<li>{i}</li>" for i in items)
            inner = inner if tag in ("ul", "ol") else r.choice((f"<ul>{inner}</ul>", " | ".join(items), "".join(f"<div>{i}</div>" for i in items)))
            if kind == "side":
                inner = f"<h3>{self.prose(2, kind)}</h3>" + inner
        elif kind == "form":
            inner = "".join(r.choice((f"<label>{self.prose(2, kind)}</label><input name=x>", f"<p>{self.prose(r.randint(2, 12), kind)}</p>", f"<div>{self.prose(3, kind)} <input></div>", f"<fieldset><legend>{self.prose(2, kind)}</legend><input></fieldset>")) for _ in range(r.randint(1, 4)))
        elif kind == "comment":
            one = lambda: r.choice((f"<p>{self.prose(size, kind, 0.2)}</p>", f"<div class=\"{r.choice(['meta', 'author', 'comment-author', 'user'])}\">{self.prose(3, kind)}</div><p>{self.prose(size, kind, 0.1)}</p>", f"<b>{self.word()}</b>: {self.prose(size, kind, 0.1)}"))
            items = [one() for _ in range(r.randint(1, 6))]
            inner = "".join((f"<li>{i}</li>" if tag in ("ol", "ul") else r.choice((f"<div>{i}</div>", f"<article class=\"comment\">{i}</article>", f'<div class="comment">{i}</div>'))) for i in items)
            if tag not in ("ol", "ul") and r.random() < 0.6:
                inner = f"<h{r.choice('234')}>{self.prose(2, kind, 0.7)}</h3>" + inner
        else:
            share = r.choice((0.0, 0.2, 0.6))
            inner = r.choice((lambda: self.prose(size, kind, share), lambda: "".join(f"<p>{self.prose(size, kind, share)}</p>" for _ in range(r.randint(1, 3))),
                              lambda: f"<h{r.choice('1234')}>{self.prose(3, kind, share)}</h2><p>{self.prose(size, kind, share)}</p>",
                              lambda: f"<span>{self.prose(3, kind, share)}</span> {link(self.prose(2, kind, share))}"))()
            if tag == "p":
                inner = self.prose(size, kind, share)
            if kind == "header" and r.random() < 0.5:
                inner += self.other("nav")
            if kind == "footer" and r.random() < 0.5:
                inner = "&copy; " + inner
        return f"<{tag}{name}>{inner}</{tag}>"

    def content(self) -> list[str]:
        r, y = self.r, ' data-y="1"'
        out = [f"<h1{y}>{self.prose(r.randint(1, 12))}</h1>"] if r.random() < 0.85 else []
        if out and r.random() < 0.15:
            out = [f"<header>{out[0]}</header>"]
        for _ in range(r.choice((1, 2, 4, 8, 14))):
            n = r.choice((1, 4, 15, 40, 80))
            u = r.random()
            if u < 0.7:
                s = self.prose(n)
                if r.random() < 0.2 and "&" not in s:
                    half = len(s) // 2
                    s = r.choice((f"<b>{s}</b>", f"{s[:half]}<br>{s[half:]}", f'{s} <a href="x">{self.word()}</a> {self.prose(6)}', f"<b>{s}<br>", f"<em>{s[:half]}</em>{s[half:]}"))
                tag = r.choice(("p", "p", "p", "div"))
                out.append(f"<{tag}{y}>{s}" + (f"</{tag}>" if tag == "div" or r.random() < 0.9 else ""))
            elif u < 0.78:
                out.append(f"<h{r.choice('23')}{y}>{self.prose(r.randint(1, 7))}</h2>")
            elif u < 0.86:
                out.append(f"<ul{y}>" + "".join(f"<li>{self.prose(r.choice((2, 8, 20)))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif u < 0.91:
                out.append(f"<blockquote{y}>{self.prose(n)}</blockquote>")
            elif u < 0.95:
                out.append(f"<table{y}>" + "".join(f"<tr><td>{self.word()}</td><td>{self.prose(3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                out.append(f"<figure{y}><img src=x><figcaption>{self.prose(6)}</figcaption></figure>")
        return out

    def page(self) -> str:
        r = self.r
        self.names = r.choice(("own", "own", "own", "own", "invented", "invented", "none"))
        body = self.content()
        for kind, p in (("ad", 0.25), ("share", 0.25), ("side", 0.15), ("form", 0.1), ("notice", 0.1)):
            if r.random() < p:
                body.insert(r.randint(0, len(body)), self.other(kind))
        if r.random() < 0.15:
            body.append(self.other("comment"))
        tag = r.choice(("article", "article", "main", "div", "section", "div", "td", ""))
        name = self.name("article") if tag in ("article", "main") or r.random() < 0.9 else ""
        middle = "".join(body)
        if tag:
            middle = f"<{tag}{name}>{middle}</{tag}>" if tag != "td" else f"<table{name}><tr><td>{middle}</td></tr></table>"
        while r.random() < 0.3:
            wrap = r.choice(("div", "div", "section", "main"))
            middle = f"<{wrap}{self.name(r.choice(('wrap', 'article')))}>{middle}</{wrap}>"
        before, after = [], []
        for kind, p, first in (("notice", 0.3, 0.8), ("header", 0.55, 1), ("nav", 0.75, 0.9), ("ad", 0.5, 0.6), ("side", 0.45, 0.3), ("form", 0.3, 0.4), ("share", 0.2, 0.3), ("comment", 0.4, 0), ("notice", 0.15, 0.2), ("ad", 0.2, 0.3), ("footer", 0.85, 0)):
            if r.random() < p:
                (before if r.random() < first else after).append(self.other(kind))
        if r.random() < 0.3:
            r.shuffle(before)
        whole = "".join(before) + middle + "".join(after)
        if r.random() < 0.3:
            whole = f"<div{self.name('wrap')}>{whole}</div>"
        return f"<html><head><title>x</title></head><body>{whole}</body></html>"
