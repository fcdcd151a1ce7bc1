"""Best encodings of all prefixes of many words at once, from the left to the right.

An Aho-Corasick automaton reads the words; at each place its output links list the pieces that end
there, and each of them relaxes the best score of the prefix (Viterbi): the score of the shorter
prefix before it and its own. Words are walked in step as rows of a matrix, so the work per symbol
is a few array operations.

Unigram models need no more. In byte-pair models a piece may follow another only if encoding their
joined text gives just these two; all other steps cost infinitely much. Then the encoding of a prefix
ends in exactly one piece, and a row leaves the output links once it has been relaxed.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np

#: Compatible pairs that a worker remembers, and cells of a matrix of words.
PAIRS, CELLS = 400_000, 1_000_000


def merge(symbols: Sequence, rank: Callable) -> list:
    """Plain byte-pair encoding: join the adjacent pair of the best rank, leftmost first, until none is left."""
    parts, after, before = list(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    queue = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (r := rank(parts[i], parts[j])) is not None:
            heapq.heappush(queue, (r, i, parts[i], parts[j]))

    for i in range(len(parts) - 1):
        offer(i)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        if parts[i] != a or a is None:
            continue
        j = after[i]
        if j >= len(parts) or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [x for x in parts if x is not None]


class Automaton:
    """Aho-Corasick over pieces (sequences of symbol numbers) as flat arrays.

    A node may end an inner piece and a final piece; ``link`` leads to the next shorter end.
    """

    def __init__(self, pieces: list[tuple[Sequence[int], int, bool]], alphabet: int):
        self.alphabet = alphabet
        child: list[dict[int, int]] = [{}]
        depth, inner, final = [0], [-1], [-1]
        for symbols, number, last in pieces:
            node = 0
            for s in symbols:
                node = child[node].setdefault(s, len(child))
                if node == len(child):
                    child.append({})
                    depth.append(0)
                    inner.append(-1)
                    final.append(-1)
            (final if last else inner)[node] = number
        fail, link = [0] * len(child), [-1] * len(child)
        queue = [(0, 0)]
        for node, deep in queue:
            depth[node] = deep
            for s, to in child[node].items():
                queue.append((to, deep + 1))
                if node:
                    f = fail[node]
                    while f and s not in child[f]:
                        f = fail[f]
                    fail[to] = child[f].get(s, 0)
                f = fail[to]
                link[to] = f if inner[f] >= 0 or final[f] >= 0 else link[f]
        keys = np.array([node * alphabet + s for node, c in enumerate(child) for s in c], np.int64)
        to = np.array([t for c in child for t in c.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.fail, self.link, self.depth, self.inner, self.final = (np.array(x, np.int64) for x in (fail, link, depth, inner, final))
        self.first = np.zeros(alphabet, np.int64)
        for s, t in child[0].items():
            self.first[s] = t

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = np.zeros(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo):
            s, c = state[todo], symbol[todo]
            at_root = s == 0
            out[todo[at_root]] = self.first[c[at_root]]
            todo, s, c = todo[~at_root], s[~at_root], c[~at_root]
            key = s * self.alphabet + c
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            out[todo[hit]] = self.to[place[hit]]
            todo = todo[~hit]
            state = state.copy() if len(todo) else state
            state[todo] = self.fail[s[~hit]]
        return out


class PrefixEncoder:
    """Last pieces, counts and scores of the encodings of all prefixes.

    ``compatible(a, b)`` tells for piece numbers whether their joined text is encoded as just these
    (a = -1 stands for the beginning); without it any piece may follow any other. ``scores`` by piece
    number; longer pieces win ties.
    """

    def __init__(self, automaton: Automaton, compatible: Callable[[int, int], bool] | None, scores: np.ndarray | None = None):
        self.automaton, self.compatible = automaton, compatible
        most = max(int(automaton.inner.max(initial=0)), int(automaton.final.max(initial=0))) + 1
        self.scores = np.zeros(most, np.float32) if scores is None else np.asarray(scores, np.float32)
        self.known: dict[int, bool] = {}

    def fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        key = ((before + 1) << 24) | piece
        unique, inverse = np.unique(key, return_inverse=True)
        known, out = self.known, np.empty(len(unique), bool)
        if len(known) > PAIRS:
            known.clear()
        for i, k in enumerate(unique.tolist()):
            r = known.get(k)
            if r is None:
                r = known[k] = self.compatible((k >> 24) - 1, k & 0xFFFFFF)
            out[i] = r
        return out[inverse]

    def _relax(self, node, at: int, rows, inner, counts, best, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best last piece of this kind, count and score at prefix length ``at`` in each of the rows."""
        a = self.automaton
        piece_of = a.final if kind else a.inner
        last, count, top = np.full(len(rows), -1), np.zeros(len(rows), np.int32), np.full(len(rows), -np.inf, np.float32)
        todo = np.arange(len(rows))
        node = node.copy()
        while len(todo):
            piece = piece_of[node[todo]]
            start = at - a.depth[node[todo]]
            before = np.where(start > 0, inner[start, rows[todo]], -1)
            able = (piece >= 0) & ((start == 0) | (before >= 0))
            if self.compatible is not None:
                able[able] = self.fits(before[able], piece[able])
            here, piece, start = todo[able], piece[able], start[able]
            score = best[start, rows[here]] + self.scores[piece]
            better = score > top[here]
            here, start = here[better], start[better]
            last[here], top[here], count[here] = piece[better], score[better], counts[start, rows[here]] + 1
            if self.compatible is not None:
                todo = todo[~able]  # no second piece can follow
            node[todo] = a.link[node[todo]]
            todo = todo[node[todo] >= 0]
        return last, count, top

    def run(self, matrix: np.ndarray, sizes: np.ndarray, finals: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows sorted by falling size: inner last pieces by prefix length, and last pieces and
        counts of every prefix taken as a whole word (as inner pieces where there are no finals)."""
        width = matrix.shape[1]
        shape = (width + 1, len(matrix))
        inner, counts, best = np.full(shape, -1, np.int64), np.zeros(shape, np.int32), np.zeros(shape, np.float32)
        ends = (np.full(shape, -1, np.int64), np.zeros(shape, np.int32)) if finals else (inner, counts)
        state = np.zeros(len(matrix), np.int64)
        a = self.automaton
        for i in range(width):
            n = int(np.searchsorted(-sizes, -i, side="left"))  # rows longer than i
            rows = np.arange(n)
            state[:n] = a.step(state[:n], matrix[:n, i])
            node = state[:n]
            ended = (a.inner[node] >= 0) | (a.final[node] >= 0)
            node = np.where(ended, node, a.link[node])
            ok = node >= 0
            for kind in (False, True) if finals else (False,):
                last, count, top = self._relax(node[ok], i + 1, rows[ok], inner, counts, best, kind)
                to = ends if kind else (inner, counts)
                to[0][i + 1, rows[ok]], to[1][i + 1, rows[ok]] = last, count
                if not kind:
                    best[i + 1, rows[ok]] = top
        return inner, *ends

    def many(self, words: list[np.ndarray], finals: bool):
        """Yields ``(numbers of the words, sizes, inner, ends, counts)`` in matrices of bounded size."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        at = 0
        while at < len(order):
            width = int(sizes[order[at]])
            rows = max(1, CELLS // max(width, 1))
            # rows of a matrix are at least half as long as its first
            less = at + int(np.searchsorted(-sizes[order[at:]], -(width // 2), side="left"))
            part = order[at : max(at + 1, min(at + rows, less))]
            matrix = np.zeros((len(part), width), np.int64)
            own = sizes[part]
            matrix[np.arange(width) < own[:, None]] = np.concatenate([words[k] for k in part]) if width else 0
            yield part, own, *self.run(matrix, own, finals)
            at += len(part)
