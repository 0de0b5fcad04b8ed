"""A linear-chain conditional random field over word shapes, in numpy."""

from __future__ import annotations

import re

import numpy as np

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s\w]|_")
_KEPT = 200_000


def shape(token: str) -> str:
    """Digits by their number, letters by case and rough length, signs as they are."""
    if token.isascii() and token.isdigit():
        return f"d{min(len(token), 7)}"
    if token[0].isalpha():
        case = "X" if token.isupper() else "Xx" if token[0].isupper() else "x"
        return case + str(min(len(token), 4))
    return token


def contexts(tokens: list[tuple[str, bool]]) -> list[tuple]:
    """For each (token, space before it): its shape, two neighbours to either side, and the gaps around it."""
    shapes = ["<", "<", *(shape(t) for t, _ in tokens), ">", ">"]
    gaps = [g for _, g in tokens] + [True]
    return [
        (*shapes[k : k + 5], gaps[k], gaps[k + 1], t.lower() if len(t) <= 5 and t.isalpha() else "")
        for k, (t, _) in enumerate(tokens)
    ]


def features(c: tuple) -> tuple[str, ...]:
    a, b, own, d, e, before, after, word = c
    return (
        f"0{own}", f"-{b}|{before}", f"+{d}|{after}", f"-2{a}|{b}", f"+2{d}|{e}", f"-0{b}|{own}|{before}",
        f"0+{own}|{d}|{after}", f"w{word}", f"-0+{b}|{own}|{d}", "bias",
    )


class Crf:
    """Tag weights by feature and tag pair; ``fit`` climbs the conditional likelihood, ``decode`` finds best paths."""

    def __init__(self, tags: list[str]) -> None:
        self.tags = tags
        self.ids: dict[str, int] = {}
        self.weights = np.zeros((1, len(tags)))
        self.moves = np.zeros((len(tags), len(tags)))
        self.seen: dict[tuple, np.ndarray] = {}

    def fit(self, sequences: list[list[tuple]], tags: list[list[str]], rounds: int = 120, decay: float = 1e-4) -> Crf:
        """``sequences`` hold contexts. Full-batch steps (Adam) on the likelihood with ``decay`` on squares."""
        if not sequences:
            return self
        number = {t: k for k, t in enumerate(self.tags)}
        n, length, size = len(sequences), max(map(len, sequences)), len(self.tags)
        width = len(features(sequences[0][0]))
        idx = np.zeros((n, length, width), np.int64)
        gold = np.zeros((n, length), np.int64)
        mask = np.zeros((n, length), bool)
        for i, (seq, own) in enumerate(zip(sequences, tags, strict=True)):
            for t, (c, tag) in enumerate(zip(seq, own, strict=True)):
                idx[i, t] = [self.ids.setdefault(f, len(self.ids) + 1) for f in features(c)]
                gold[i, t], mask[i, t] = number[tag], True
        self.weights = np.zeros((len(self.ids) + 1, size))
        flat, live = idx[mask], mask.ravel()
        truth = np.eye(size)[gold]
        pairs = np.zeros((size, size))
        both = mask[:, 1:]
        np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        state = [np.zeros_like(self.weights), np.zeros_like(self.weights), np.zeros_like(self.moves), np.zeros_like(self.moves)]
        for step in range(1, rounds + 1):
            scores = self.weights[idx].sum(2)
            marginals, moved = self._marginals(scores, mask)
            slope = (truth - marginals).reshape(-1, size)[live]
            g_w = np.zeros_like(self.weights)
            np.add.at(g_w, flat.ravel(), np.repeat(slope, width, axis=0))
            g_w[0] = 0
            for value, grad, m, v in ((self.weights, g_w, state[0], state[1]), (self.moves, pairs - moved, state[2], state[3])):
                grad = grad / n - decay * value
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value += 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def _marginals(self, scores: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag probabilities and expected tag pairs by the forward-backward passes, scaled at each place."""
        n, length, size = scores.shape
        local = np.exp(scores - scores.max(2, keepdims=True))
        moves = np.exp(self.moves)
        ahead, back = np.empty_like(local), np.ones_like(local)
        ahead[:, 0] = local[:, 0] / local[:, 0].sum(1, keepdims=True)
        for t in range(1, length):
            step = (ahead[:, t - 1] @ moves) * local[:, t]
            ahead[:, t] = step / step.sum(1, keepdims=True)
        moved = np.zeros((size, size))
        for t in range(length - 2, -1, -1):
            after = local[:, t + 1] * back[:, t + 1]
            step = after @ moves.T
            back[:, t] = np.where(mask[:, t + 1, None], step / step.sum(1, keepdims=True), 1.0)
            pair = ahead[:, t, :, None] * moves * after[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            moved += pair[mask[:, t + 1]].sum(0)
        both = ahead * back
        return both / both.sum(2, keepdims=True), moved

    def _scores(self, c: tuple) -> np.ndarray:
        found = self.seen.get(c)
        if found is None:
            if len(self.seen) >= _KEPT:
                self.seen.clear()
            found = self.seen[c] = self.weights[[self.ids.get(f, 0) for f in features(c)]].sum(0)
        return found

    def decode(self, sequences: list[list[tuple]]) -> list[list[str]]:
        """Viterbi over batches of sequences of similar length."""
        out: list[list[str]] = [[] for _ in sequences]
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        at = 0
        while at < len(order):
            length = len(sequences[order[at]])
            stop = at + 1
            while stop < len(order) and len(sequences[order[stop]]) <= length + 8 and stop - at < 512:
                stop += 1
            self._decode(order[at:stop], sequences, out)
            at = stop
        return out

    def _decode(self, batch: list[int], sequences: list[list[tuple]], out: list[list[str]]) -> None:
        lengths = np.array([len(sequences[i]) for i in batch])
        longest, size = int(lengths.max()), len(self.tags)
        if not longest:
            return
        scores = np.zeros((len(batch), longest, size))
        for k, i in enumerate(batch):
            if sequences[i]:
                scores[k, : lengths[k]] = [self._scores(c) for c in sequences[i]]
        best = scores[:, 0]
        came = np.zeros((len(batch), longest, size), np.int8)
        for t in range(1, longest):
            paths = best[:, :, None] + self.moves
            came[:, t] = paths.argmax(1)
            live = (t < lengths)[:, None]
            best = np.where(live, paths.max(1) + scores[:, t], best)
        tag = best.argmax(1)
        path = np.empty((len(batch), longest), np.int64)
        for t in range(longest - 1, -1, -1):
            path[:, t] = tag
            tag = np.where(t < lengths, came[np.arange(len(batch)), t, tag], tag)
        for k, i in enumerate(batch):
            out[i] = [self.tags[x] for x in path[k, : lengths[k]]]
