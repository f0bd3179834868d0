"""Written pages whose blocks are known to be content or not: what the main-text classifier is fitted on and tested with."""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape

_SYLLABLES = "an ba ce do el fi go ha in jo ka le mi no or pa qui re so ti un ver wo xi yen zu é ç ñ über".split()
#: Names that pages give to parts; "" is none, and the last ones tell nothing.
NAMES = {
    "nav": "nav menu main-menu navbar site-nav breadcrumbs pagination navigation",
    "header": "header site-header masthead top-bar branding",
    "footer": "footer site-footer page-footer copyright bottom",
    "side": "sidebar side widget-area rail secondary-sidebar",
    "ad": "ad ads advert ad-slot sponsored promo-box advertisement promo",
    "notice": "cookie-notice notice consent alert popup newsletter privacy-banner subscribe",
    "comment": "comments comment-list comment-section discussion responses disqus",
    "share": "share social related related-posts recommended tags popular",
    "form": "search login-form signup contact-form search-box",
    "body": "article content post-body entry-content story main-content article-body post",
    "plain": "c1 box wrap row inner x9 grid block",
}
TOLD = ["We use cookies to improve {}", "© 2024 {}", "Copyright {} All rights reserved", "Subscribe to our newsletter {}", "Advertisement {}", "Sign in {}", "By using this site you accept our privacy policy {}"]


class Writer:
    def __init__(self, r: random.Random, clear: float):
        self.r, self.clear = r, clear  # how often a part's name or tag tells what it is
        self.brief = r.random() < 0.25  # an article of a few words
        self.labels: dict[str, bool] = {}
        self.words = ["".join(r.choice(_SYLLABLES) for _ in range(r.randrange(1, 4))) for _ in range(300)]

    def say(self, n: int, content: bool, end: str = ".", within: str = "{}") -> str:
        while True:
            words = [self.r.choice(self.words) for _ in range(max(1, n))]
            for k in range(self.r.randrange(5, 14), n - 1, self.r.randrange(6, 18)):
                words[k] += self.r.choice([".", ",", ".", "?"])
            text = within.format(" ".join(words).capitalize() + end)
            if text not in self.labels:
                break
            n += 1
        self.labels[text] = content
        if "&" in text or "<" in text:
            return escape(text)
        return text

    def named(self, kind: str) -> str:
        r, x = self.r, self.r.random()
        name = r.choice(NAMES[kind].split()) if x < self.clear else r.choice(NAMES["plain"].split()) if x < 0.5 + self.clear / 2 else ""
        return f' {r.choice(["class", "class", "id"])}="{name}"' if name else ""

    def link(self, n: int, content: bool) -> str:
        return f'<a href="/{self.r.randrange(99)}">{self.say(n, content, "")}</a>'

    def part(self, kind: str, tags: str, inside: str) -> str:
        tag = self.r.choice(tags.split()) if self.r.random() < self.clear else "div"
        return f"<{tag}{self.named(kind)}>{inside}</{tag}>"

    def links(self, n: int) -> str:
        r = self.r
        if r.random() < 0.6:
            return "<ul>" + "".join(f"<li>{self.link(r.randrange(1, 4), False)}</li>" for _ in range(n)) + "</ul>"
        return "".join(f"<div>{self.link(r.randrange(1, 4), False)}</div>" for _ in range(n))

    def nav(self) -> str:
        return self.part("nav", "nav nav menu", self.links(self.r.randrange(3, 10)))

    def header(self) -> str:
        r = self.r
        tag = "h1" if r.random() < 0.2 else "div"
        inside = f"<{tag}>{self.say(r.randrange(1, 4), False, '')}</{tag}>" if r.random() < 0.7 else ""
        if r.random() < 0.5:
            inside += f"<p>{self.say(r.randrange(2, 9), False)}</p>"
        return self.part("header", "header", inside + (self.nav() if r.random() < 0.5 else ""))

    def footer(self) -> str:
        r = self.r
        inside = self.links(r.randrange(2, 7)) if r.random() < 0.5 else ""
        inside += f"<p>{self.say(r.randrange(2, 14), False, '.', r.choice(['{}', '{}', *TOLD[1:3]]))}</p>" if r.random() < 0.7 else self.say(r.randrange(3, 14), False, ".", r.choice(["{}", TOLD[1]]))
        return self.part("footer", "footer", inside)

    def side(self) -> str:
        r, inside = self.r, ""
        for _ in range(r.randrange(1, 4)):
            inside += f"<h3>{self.say(r.randrange(1, 4), False, '')}</h3>"
            inside += self.links(r.randrange(2, 7)) if r.random() < 0.6 else f"<p>{self.say(r.randrange(4, 40), False)}</p>"
        return self.part("side", "aside", inside)

    def ad(self) -> str:
        r = self.r
        text = self.say(r.randrange(2, 20), False, r.choice([".", "!", ""]), r.choice(["{}", "{}", "{}", TOLD[4]]))
        return self.part("ad", "aside div div", r.choice(["{}", "<p>{}</p>", '<a href="/x">{}</a>']).format(text))

    def notice(self) -> str:
        r = self.r
        text = self.say(r.randrange(5, 30), False, ".", r.choice(["{}", TOLD[0], TOLD[3], TOLD[6]]))
        return self.part("notice", "div dialog div", f"<p>{text}</p>" + (f"<button>{self.r.choice(['OK', 'Accept'])}</button>" if r.random() < 0.5 else ""))

    def form(self) -> str:
        r = self.r
        inside = "".join(f"<p>{self.say(r.randrange(1, 8), False, '')}</p><input>" for _ in range(r.randrange(1, 4)))
        return self.part("form", "form", inside + "<textarea>Your text</textarea>")

    def comments(self) -> str:
        r = self.r
        inside = f"<h3>{self.say(r.randrange(1, 3), False, '')}</h3>" if r.random() < 0.6 else ""
        for _ in range(r.randrange(1, 9)):
            tag = r.choice(["div", "li", "article", "div"])
            inside += f"<{tag}{' class=comment' if r.random() < self.clear else ''}>"
            inside += r.choice(["<b>{}</b>", "<p>{}</p>", '<div><a href="/u">{}</a></div>', "<h4>{}</h4>"]).format(self.say(r.randrange(1, 3), False, ""))
            inside += "".join(f"<p>{self.say(r.randrange(2, 60), False)}</p>" for _ in range(r.randrange(1, 3))) + f"</{tag}>"
        # nothing but its name tells what long comments are
        tag = r.choice(["section", "div", "ol", "aside"])
        return f'<{tag} {r.choice(["class", "id"])}="{r.choice(NAMES["comment"].split())}">{inside}</{tag}>'

    def share(self) -> str:
        r = self.r
        return self.part("share", "div section", (f"<h3>{self.say(r.randrange(1, 4), False, '')}</h3>" if r.random() < 0.5 else "") + self.links(r.randrange(2, 6)))

    def paragraph(self) -> str:
        r = self.r
        n = r.randrange(1, 12) if self.brief else r.choice([r.randrange(1, 12), r.randrange(8, 60), r.randrange(30, 160)])
        text = self.say(n, True, r.choice([".", ".", ".", "?", "", ":"]), r.choice(["{}"] * 30 + TOLD))
        if r.random() < 0.15 and " " in text:
            a, b = text.split(" ", 1)
            text = r.choice([f'{a} <a href="/i">{b}</a>' if n < 8 else f'<a href="/i">{a}</a> {b}', f"<b>{a}</b> {b}", f"<em>{text}</em>", f"{a}<br>{b}"])
        return r.choice([f"<p>{text}</p>"] * 6 + [f"<p>{text}"] + [f"<div>{text}</div>"])

    def article(self) -> str:
        r = self.r
        parts = [f"<h1>{self.say(r.randrange(2, 12), True, r.choice(['', '', '.']))}</h1>"] if r.random() < 0.85 else []
        if parts and r.random() < 0.15:
            parts[0] = f"<header{self.r.choice(['', ' class=entry-header'])}>{parts[0]}</header>"
        for _ in range(r.randrange(1, 4) if self.brief else r.choice([1, 2, r.randrange(2, 9), r.randrange(4, 25)])):
            x = r.random()
            if x < 0.08:
                parts.append(f"<h2>{self.say(r.randrange(1, 8), True, '')}</h2>")
            elif x < 0.15:
                parts.append("<ul>" + "".join(f"<li>{self.say(r.randrange(1, 25), True, r.choice(['', '.']))}</li>" for _ in range(r.randrange(2, 6))) + "</ul>")
            elif x < 0.18:
                parts.append(f"<blockquote>{self.say(r.randrange(5, 40), True)}</blockquote>")
            elif x < 0.20:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.say(r.randrange(1, 4), True, '')}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randrange(1, 4))) + "</table>")
            elif x < 0.22:
                parts.append(f"<figure><img src=x><figcaption>{self.say(r.randrange(3, 15), True)}</figcaption></figure>")
            else:
                parts.append(self.paragraph())
        if r.random() < 0.25:
            parts.insert(r.randrange(len(parts) + 1), self.ad())
        if r.random() < 0.12:
            parts.append(self.share())
        if r.random() < 0.08:
            parts.append(self.comments())
        inside = "".join(parts)
        x = r.random()
        if x < 0.45:
            return f"<article{self.named('body') if r.random() < 0.5 else ''}>{inside}</article>"
        if x < 0.6:
            return f"<main{self.named('body') if r.random() < 0.4 else ''}>{inside}</main>"
        if x < 0.7:
            return f'<main><article><div{self.named("body")}>{inside}</div></article></main>'
        if x < 0.95:
            return f"<div{self.named('body')}>{inside}</div>"
        return inside

    def page(self) -> str:
        r = self.r
        before = [x for x, p in ((self.notice, 0.3), (self.header, 0.5), (self.nav, 0.6), (self.ad, 0.3), (self.form, 0.2), (self.side, 0.15)) if r.random() < p]
        after = [x for x, p in ((self.share, 0.3), (self.ad, 0.25), (self.comments, 0.35), (self.side, 0.3), (self.form, 0.15), (self.notice, 0.15), (self.nav, 0.15)) if r.random() < p]
        r.shuffle(after)
        body = "".join(x() for x in before) + self.article() + "".join(x() for x in after) + (self.footer() if r.random() < 0.75 else "")
        if r.random() < 0.3:
            body = f'<div{self.named("plain")}>{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{r.random()}</title><style>p{{}}</style></head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int, clear: float | None = None) -> Iterator[tuple[str, dict[str, bool]]]:
    """n pages, and of each block of text (white space as single spaces) whether it is content. clear: how often parts
    have telling names or tags; by default pages differ in that."""
    for k in range(n):
        r = random.Random(f"{seed}/{k}")
        writer = Writer(r, r.choice([0.5, 0.8, 1.0, 1.0]) if clear is None else clear)
        yield writer.page(), writer.labels
