"""Fits the block labeller on invented pages and writes ``blocks.npz``.

    python -m spanloom.llm.train_blocks

The pages come from a small grammar of layouts with known labels; the seed is fixed. Layouts are
families: how the main text is held (an article element, named or nameless containers, nothing at all,
table cells, sections in sections, plain text) and how the rest stands around it. Some families are
never trained on and measure how the labeller does on layouts it has not seen.
"""

from __future__ import annotations

import html
import random
from pathlib import Path

import numpy as np

from spanloom.llm.blocks import DIMS, Block, Labeller, blocks, features, lstm, sigmoid, turned

HIDDEN = 16
#: Names that layouts give to what is not main text, by kind, and to main text.
OTHER = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav links sitemap pagination pager tabs toolbar".split(),
    "header": "header masthead banner topbar site-header page-header branding logo".split(),
    "footer": "footer site-footer page-footer copyright bottom colophon legal".split(),
    "sidebar": "sidebar aside side rail widget related recommended popular trending more-stories tags author-box archive".split(),
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay disclaimer message subscribe-box paywall".split(),
    "ad": "ad ads advert advertisement sponsored promo promotion adsense ad-slot banner-ad sponsor commercial".split(),
    "form": "form search login signup newsletter subscribe contact search-form register".split(),
    "comments": "comments comment comment-list discussion replies reply responses user-comments disqus thread".split(),
    "share": "share social sharing follow toolbar share-buttons".split(),
}
MAIN = "article content main post entry story body text article-body post-content entry-content main-content story-body page-content prose".split()
TAGS = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "notice": ["div", "section", "aside"], "ad": ["div", "aside", "section", "ins"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "share": ["div", "ul"]}
WORDS = {
    "menu": "home about news contact blog shop login help index next previous".split(),
    "footer": "© copyright rights reserved privacy terms imprint 2024".split(),
    "notice": "cookies accept we use privacy agree settings notice".split(),
    "ad": "buy now sale offer free deal advertisement sponsored shop".split(),
    "form": "email name password search submit send sign subscribe".split(),
    "comments": "reply posted by says ago like great thanks comment".split(),
    "sidebar": "related popular recent archive read more tags".split(),
    "header": "welcome to the site search".split(),
    "share": "share tweet facebook follow email print".split(),
}


class Pages:
    """Invented pages; ``one()`` gives a page and the label of every block."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        return "".join(r.choice("b c d f g h l m n p r s t v w th st ch".split()) + r.choice("a e i o u é ä ó ie ou".split()) for _ in range(r.choice((1, 1, 2, 2, 3))))

    def prose(self, least: int, most: int) -> str:
        r, out = self.r, []
        for _ in range(r.randint(least, most)):
            w = self.word() + ("" if r.random() < 0.85 else r.choice([",", ".", ".", "!", "?", ";"]))
            out.append(w.capitalize() if not out or out[-1][-1] in ".!?" else w)
        text = " ".join(out).rstrip(",;")
        if r.random() < 0.04:
            text = " ".join(w for w in text.split() for _ in range(r.randint(1, 30)))
        if r.random() < 0.08:
            # damaged text: words run into signs of any sort
            signs, share = r.sample("!\"#$%&'()*+,-/:;<=>?@[]^_{|}~§°±×", r.randint(1, 6)), r.random()
            text = " ".join(w + r.choice(signs) * r.randint(1, 4) if r.random() < share else w for w in text.split())
        return html.escape(text + ("." if r.random() < 0.85 and text[-1] not in ".!?" else ""))

    def attributes(self, names: list[str], chance: float) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        name = r.choice(names)
        return r.choice([f' class="{name}"', f' id="{name}"', f" class='x{r.randint(1, 99)} {name}'", f' class={name}', f' class="{name} wide" id="b{r.randint(1, 9)}"'])

    def other(self, kind: str) -> list[tuple[str, int]]:
        """Pieces of markup with the label of the block in them (-1: none)."""
        r = self.r
        tag = r.choice(TAGS[kind])
        named = tag == "div" or tag == "section"
        out = [(f"<{tag}{self.attributes(OTHER[kind], 1.0 if named else 0.5)}>", -1)]
        if kind in ("menu", "share") or (kind in ("footer", "sidebar", "header") and r.random() < 0.5):
            if tag != "ul":
                out.append(("<ul>", -1))
            for _ in range(r.randint(2, 9)):
                text = r.choice(WORDS[kind]).capitalize() if r.random() < 0.4 else self.prose(1, 6)
                out.append((f'<li><a href="/{r.randint(1, 99)}">{text}</a></li>', 0))
            if tag != "ul":
                out.append(("</ul>", -1))
        elif kind == "comments":
            for _ in range(r.randint(1, 6)):
                if r.random() < 0.5:
                    out.append((f"<h4>{self.prose(1, 4)}</h4>", 0))
                out.append((r.choice(["<p>{}</p>", "<div>{}</div>", "<li>{}</li>"]).format(self.prose(2, 60)), 0))
        elif kind == "form":
            for _ in range(r.randint(1, 3)):
                out.append((f"<p>{self.prose(1, 8)}</p>", 0))
            out.append((f"<button>{r.choice(WORDS['form'])}</button>", 0))
        else:
            for k in range(r.randint(1, 3)):
                text = self.prose(2, 35)
                if r.random() < 0.5:
                    text = " ".join([r.choice(WORDS[kind]) for _ in range(r.randint(1, 4))]) + " " + text
                out.append((text if k == 0 and r.random() < 0.6 else f"<p>{text}</p>", 0))
        return [*out, (f"</{tag}>", -1)]

    def part(self) -> list[tuple[str, int]]:
        """One piece of main text."""
        r = self.r
        x = r.random()
        text = self.prose(1, r.choice((3, 20, 60, 120))) if r.random() < 0.96 else self.prose(200, 700)
        if x < 0.66:
            return [(f"<p>{text}</p>", 1)]
        if x < 0.74:  # tags that nobody closes
            inner = r.choice(("b", "i", "em", "strong", "font", "span"))
            return [(r.choice(("<p>{}", f"<p><{inner}>{{}}", f"<p><{inner}>{{}}<br>", "<div>{}</p></div>")).format(text), 1)]
        if x < 0.8:
            return [(f"<h{r.randint(2, 4)}>{self.prose(1, 8)}</h{r.randint(2, 4)}>", 1)]
        if x < 0.85:
            return [("<ul>", -1), *((f"<li>{self.prose(1, 15)}</li>", 1) for _ in range(r.randint(1, 5))), ("</ul>", -1)]
        if x < 0.89:
            return [(f"<blockquote>{text}</blockquote>", 1)]
        if x < 0.93:
            return [(f'<p>{text} <a href="/x">{self.prose(1, 3)}</a> <em>{self.prose(1, 3)}</em></p>', 1)]
        if x < 0.96:
            return [("<table>", -1), *((f"<tr><td>{self.prose(1, 6)}</td>", 1) for _ in range(r.randint(1, 4))), ("</table>", -1)]
        return self.other(r.choice(["ad", "ad", "share", "sidebar", "notice", "form"]))

    def article(self) -> list[tuple[str, int]]:
        r = self.r
        out: list[tuple[str, int]] = [(f"<h{r.choice((1, 1, 1, 2))}>{self.prose(1, 12)}</h1>", 1)] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 2, 3, 5, 8, 13, 25))):
            out += self.part()
        return out

    def held(self, family: str) -> list[tuple[str, int]]:
        """The main text in the container of a family, with reader comments in or behind it."""
        r = self.r
        tail = self.other("comments") if r.random() < 0.35 and family not in ("bare", "plain") else []
        inside = r.random() < 0.3
        body = self.article()
        if family == "plain":
            lines = [self.prose(3, 60) for _ in range(r.randint(1, 8))]
            glue = r.choice(("<hr>", "</p>", "<div>")) if r.random() < 0.7 else ""
            return [(x + glue, 1) for x in lines] if glue else [(" ".join(lines), 1)]
        if family == "bare":
            return [(x, y) for x, y in body] if r.random() < 0.5 else [(f"<h1>{self.prose(1, 9)}</h1>", 1), *((f"<p>{self.prose(2, 70)}</p>", 1) for _ in range(r.randint(1, 4)))]
        if family == "nameless":
            depth = r.randint(1, 4)
            names = [r.choice(("", f' class="{self.word()}-{r.randint(1, 99)}"', f' class="c{r.randint(1, 999)}"')) for _ in range(depth)]
            open_, close = [(f"<div{n}>", -1) for n in names], [("</div>", -1)] * depth
        elif family == "cells":
            side = self.other(r.choice(("menu", "sidebar", "ad")))
            open_ = [("<table><tr>", -1), *([("<td>", -1), *side, ("</td>", -1)] if r.random() < 0.7 else []), ("<td>", -1)]
            close = [("</td>", -1), *([("<td>", -1), *self.other("sidebar"), ("</td>", -1)] if r.random() < 0.4 else []), ("</tr></table>", -1)]
        elif family == "sections":
            open_, close = [(r.choice(("<main>", "<div>", "<article>")), -1)], [("</main>", -1)]
            body = [y for part in (body, *(self.article() for _ in range(r.randint(0, 2)))) for y in (("<section>", -1), ("<div>", -1), *part, ("</div>", -1), ("</section>", -1))]
        elif family == "post":
            open_, close = [(f'<div class="{r.choice(("post", "message", "entry", "story"))}"><div class="{r.choice(("content", "text", "body"))}">', -1)], [("</div></div>", -1)]
        else:
            tag = {"article": "article", "main": "main"}.get(family, "div")
            open_, close = [(f"<{tag}{self.attributes(MAIN, 1 if tag == 'div' else 0.4)}>", -1)], [(f"</{tag}>", -1)]
        return [*open_, *body, *(tail if inside else []), *close, *([] if inside else tail)]

    def one(self, families: tuple[str, ...]) -> tuple[str, list[int]]:
        r = self.r
        family = r.choice(families)
        quiet = family in ("plain", "bare") and r.random() < 0.6
        out: list[tuple[str, int]] = []
        for kind, chance in (("notice", 0.25), ("header", 0.4), ("menu", 0.8), ("form", 0.2), ("ad", 0.5), ("sidebar", 0.25)):
            if not quiet and r.random() < chance:
                out += self.other(kind)
        out += self.held(family)
        for kind, chance in (("share", 0.3), ("sidebar", 0.5), ("ad", 0.3), ("form", 0.2), ("menu", 0.2), ("footer", 0.85), ("notice", 0.2)):
            if not quiet and r.random() < chance:
                out += self.other(kind)
        if quiet and r.random() < 0.5:
            return "".join(x for x, _ in out), [y for _, y in out if y >= 0]
        head = f"<!DOCTYPE html><html><head><title>{self.prose(1, 8)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        glue = r.choice(["", "\n", "\n  "])
        return head + glue.join(x for x, _ in out) + ("</body></html>" if r.random() < 0.9 else ""), [y for _, y in out if y >= 0]


#: Layouts that are fitted, and layouts that only measure.
FITTED = ("article", "article", "main", "main", "named", "named", "bare", "bare", "plain", "nameless", "nameless", "nameless", "sections", "sections")
HELD_OUT = ("cells", "post")


def sample(n: int, seed: int, families: tuple[str, ...] = FITTED) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks and labels of n pages (those where the grammar and the cutter count alike)."""
    pages, out = Pages(seed), []
    while len(out) < n:
        page, labels = pages.one(families)
        cut = blocks(page)
        if len(cut) == len(labels):
            out.append((cut, np.array(labels, np.float32)))
    return out


def backward(x: np.ndarray, recurrent: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of the recurrent weights."""
    steps, n, h = grad.shape
    out, weights = np.zeros((steps, n, 4 * h), np.float32), np.zeros_like(recurrent)
    d_state, d_cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    for t in range(steps - 1, -1, -1):
        state, cell, gates, g, shown = kept[t]
        i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        d = grad[t] + d_state
        d_cell = d_cell + d * o * (1 - shown**2)
        z = np.concatenate([d_cell * g * i * (1 - i), d_cell * cell * f * (1 - f), d * shown * o * (1 - o), d_cell * i * (1 - g**2)], 1)
        out[t] = z
        weights += state.T @ z
        d_state, d_cell = z @ recurrent.T, d_cell * f
    return out, weights


def fit(pages: list[tuple[list[Block], np.ndarray]], epochs: int, seed: int = 1, rate: float = 1.5e-2, batch: int = 32) -> Labeller:
    """Adam on the logistic loss of every block, by back-propagation through time."""
    r = np.random.default_rng(seed)
    data = [(features(page), labels) for page, labels in pages]
    w = {}
    for side in ("fore", "back"):
        w[f"w_{side}"] = r.normal(0, 0.08, (DIMS, 4 * HIDDEN))
        w[f"u_{side}"] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
        w[f"b_{side}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
    w["v"], w["c"] = r.normal(0, 0.2, (2 * HIDDEN, 1)), np.zeros(1)
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    by_size = sorted(range(len(data)), key=lambda i: len(data[i][0]))
    for _ in range(epochs):
        for b in r.permutation(range(0, len(data), batch)):
            group = by_size[b : b + batch]
            sizes = np.array([len(data[i][0]) for i in group])
            steps, n = int(sizes.max()), len(group)
            x, y, real = np.zeros((steps, n, DIMS), np.float32), np.zeros((steps, n), np.float32), np.arange(steps)[:, None] < sizes
            for k, i in enumerate(group):
                x[: sizes[k], k], y[: sizes[k], k] = data[i]
            x *= r.random(x.shape, np.float32) > 0.08  # path tokens and words are missed at random
            place = turned(sizes, steps), np.arange(n)
            fore, kept_f = lstm(x @ w["w_fore"] + w["b_fore"], w["u_fore"], True)
            back, kept_b = lstm((x @ w["w_back"] + w["b_back"])[place], w["u_back"], True)
            joined = np.concatenate([fore, back[place]], 2)
            p = sigmoid(joined @ w["v"] + w["c"])[:, :, 0]
            e = ((p - y) * real / real.sum()).astype(np.float32)[:, :, None]
            grad = {"v": np.einsum("tnh,tnk->hk", joined, e), "c": e.sum((0, 1))}
            d = e @ w["v"].T
            for side, kept, part, seen in (("fore", kept_f, d[:, :, :HIDDEN], x), ("back", kept_b, d[:, :, HIDDEN:][place], x[place])):
                z, grad[f"u_{side}"] = backward(seen, w[f"u_{side}"], kept, part)
                grad[f"w_{side}"] = np.tensordot(seen, z, ((0, 1), (0, 1)))
                grad[f"b_{side}"] = z.sum((0, 1))
            step += 1
            pace = rate * (1 - (step - 1) / (epochs * -(-len(data) // batch)))
            for k, g in grad.items():
                g = g + 1e-5 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= (pace * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Labeller(w)


def accuracy(labeller: Labeller, pages: list[tuple[list[Block], np.ndarray]]) -> float:
    scores = labeller.scores([labeller.gates(page) for page, _ in pages])
    return float(np.mean(np.concatenate([(s > 0.5) == y for s, (_, y) in zip(scores, pages, strict=True)])))


if __name__ == "__main__":
    made = fit(sample(7000, 1), 12, rate=6e-3)
    print("held-out pages:", accuracy(made, sample(500, 2)), "held-out layouts:", accuracy(made, sample(500, 2, HELD_OUT)))
    np.savez_compressed(Path(__file__).with_name("blocks.npz"), **{k: v.astype(np.float16) for k, v in made.weights.items()})
