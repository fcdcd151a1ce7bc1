"""HTML pages as sequences of leaf blocks, and a recurrent labeller for them.

A block is the text between two block-level tags. A bidirectional LSTM in numpy reads, for every
block of a page in order, a vector of its tag path and a vector of its hashed words, and tells
main text from all else with the whole page as context. ``train_blocks`` fits it.
"""

from __future__ import annotations

import html
import re
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np

TAG = re.compile(r"<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>)", re.S)
#: A tag whose quotes do not close, and one that the page's end cuts off.
LOOSE, CUT_OFF = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"), re.compile(r"</?[a-zA-Z][^>]*\Z")
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
TOKEN = re.compile(r"[a-z]+")

#: Elements by their part in the layout of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe".split())
HIDDEN = frozenset("head title template noframes noscript select datalist object audio video canvas svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)

PATH_DIMS, WORD_DIMS, SHAPE_DIMS = 256, 64, 8
#: Characters above which a block looks no longer to the labeller. The training pages have few longer
#: blocks, so lengths beyond it would be read outside of what was fitted; the text is kept whole.
LONG = 900
DIMS = PATH_DIMS + WORD_DIMS + SHAPE_DIMS


@lru_cache(maxsize=200_000)
def bucket(token: str, dims: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % dims


@lru_cache(maxsize=20_000)
def element_tokens(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element adds to the path: its tag and the words of its telling attributes."""
    out = ["t:" + tag]
    for name, *values in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        value = next((v for v in values if v), "").lower()
        if name.lower() == "style":
            if re.search(r"display:none|visibility:hidden", re.sub(r"\s", "", value)):
                out.append("c:hidden")
        elif name.lower() in ("hidden", "aria-hidden"):
            if value != "false":
                out.append("c:hidden")
        else:
            out += ["c:" + w for w in TOKEN.findall(value)]
    return tuple(out)


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: list[str], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order. Character references are decoded, white space is folded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = linked = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            out.append(Block([t for _, tokens in stack for t in tokens], text, linked))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if not raw or any(tag in HIDDEN for tag, _ in stack):
            return
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text)

    while True:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        found = TAG.match(page, lt) or LOOSE.match(page, lt)
        if not found:
            if CUT_OFF.match(page, lt):
                break
            add("<")
            at = lt + 1
            continue
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:  # an end tag
            if tag == "a":
                links = max(links - 1, 0)
            if tag in INLINE:
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        flush()
        links = 0
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "body":
            stack.clear()
        elif tag not in HIDDEN and any(t == "head" for t, _ in stack):
            del stack[next(k for k, (t, _) in enumerate(stack) if t == "head") :]  # as browsers do
        while stack and (stack[-1][0] == "p" or (tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == tag)):
            stack.pop()
        stack.append((tag, element_tokens(tag, found[3] or "")))
    flush()
    return out


class Buckets(dict):
    """Hash buckets of words, each found once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = made = bucket(word, WORD_DIMS)
        return made


WORDS = Buckets()
DIGIT = re.compile(r"\d")


def features(page: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """One row per block in [first, last): tag path, hashed words, shape."""
    part = page[first:last]
    x = np.zeros((len(part), DIMS), np.float32)
    for i, b in enumerate(part):
        x[i, [bucket(t, PATH_DIMS) for t in b.path]] = 1
        words = b.text.lower().split()
        x[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.bincount([WORDS[w] for w in words], minlength=WORD_DIMS)
        n, m = len(b.text), len(words)
        x[i, -SHAPE_DIMS:] = (np.log1p(min(n, LONG)) / 8, np.log1p(min(m, LONG // 6)) / 6, b.linked / n, b.text[-1] in ".!?…", b.text.count(",") / m, (first + i + 1) / len(page), len(DIGIT.findall(b.text)) / n, 1)
    words = x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS]
    words[:] = np.minimum(words, 1) / 4
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, recurrent: np.ndarray, keep: bool = False):
    """States (time, page, hidden) for gate inputs x (time, page, 4 * hidden); gates i, f, o, g."""
    steps, n, width = x.shape
    h = width // 4
    state, cell, out, kept = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((steps, n, h), np.float32), []
    for t in range(steps):
        z = x[t] + state @ recurrent
        gates, g = sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
        before = cell
        cell = gates[:, h : 2 * h] * cell + gates[:, :h] * g
        shown = np.tanh(cell)
        if keep:
            kept.append((state, before, gates, g, shown))
        state = gates[:, 2 * h :] * shown
        out[t] = state
    return (out, kept) if keep else out


def turned(sizes: np.ndarray, steps: int) -> np.ndarray:
    """Places (time, page) that read every sequence from its end; padding stays in place."""
    t = np.arange(steps)[:, None]
    return np.where(t < sizes, sizes - 1 - t, t)


class Labeller:
    """Two LSTMs, one from either end, and a logistic output."""

    NAMES = ("w_fore", "u_fore", "b_fore", "w_back", "u_back", "b_back", "v", "c")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = {k: np.asarray(weights[k], np.float32) for k in self.NAMES}

    def gates(self, page: list[Block]) -> np.ndarray:
        """Gate inputs of every block for both directions, made from few features at a time."""
        w = self.weights
        parts = [x @ np.concatenate([w["w_fore"], w["w_back"]], 1) for x in (features(page, at, at + 4096) for at in range(0, len(page), 4096))]
        both = np.concatenate(parts) if parts else np.zeros((0, 2 * w["b_fore"].size), np.float32)
        return both + np.concatenate([w["b_fore"], w["b_back"]])

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text of each block from the gate inputs of each page; pages of like
        length go together."""
        w, out = self.weights, [np.zeros(0, np.float32)] * len(pages)
        half = w["b_fore"].size
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: -len(pages[i]))
        at = 0
        while at < len(order):
            steps = len(pages[order[at]])
            group = order[at : at + max(1, 40_000 // steps)]
            at += len(group)
            sizes = np.array([len(pages[i]) for i in group])
            x = np.zeros((steps, len(group), 2 * half), np.float32)
            for k, i in enumerate(group):
                x[: sizes[k], k] = pages[i]
            place = turned(sizes, steps), np.arange(len(group))
            fore = lstm(x[:, :, :half], w["u_fore"])
            back = lstm(x[:, :, half:][place], w["u_back"])[place]
            p = sigmoid(np.concatenate([fore, back], 2) @ w["v"] + w["c"])[:, :, 0]
            for k, i in enumerate(group):
                out[i] = p[: sizes[k], k]
        return out


@lru_cache(maxsize=1)
def fitted() -> Labeller:
    """The labeller with the weights that ``train_blocks`` made."""
    with np.load(Path(__file__).with_name("blocks.npz")) as f:
        return Labeller(dict(f))


def main_texts(pages: list[str], labeller: Labeller | None = None) -> list[str]:
    """The main text of each page: blocks labelled as such, one per line."""
    labeller = labeller or fitted()
    cut = [blocks(p) for p in pages]
    scores = labeller.scores([labeller.gates(b) for b in cut])
    return ["\n".join(b.text for b, s in zip(page, score, strict=True) if s > 0.5) for page, score in zip(cut, scores, strict=True)]
