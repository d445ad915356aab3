"""A linear-chain conditional random field in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Tokens whose features count for a label, counted from the token itself.
REACH = (-4, -3, -2, -1, 0, 1, 2, 3, 4)
#: Tokens whose scores are summed at once.
AT_ONCE = 2048


@dataclass
class Chain:
    """weights: (features x reach x labels) of a token's features and where it stands; steps: (labels x labels) from one label to the next."""

    weights: np.ndarray
    steps: np.ndarray
    first: np.ndarray

    def scores_of(self, features: list[list[int]]) -> np.ndarray:
        """(tokens x reach x labels): what each of some tokens, by its features, adds to the labels of the tokens in its reach."""
        out = np.zeros((len(features), len(REACH), self.steps.shape[0]), dtype=np.float32)
        if features:
            lens = np.array([len(f) for f in features])
            flat = np.fromiter((x for f in features for x in f), dtype=np.int64, count=int(lens.sum()))
            some = lens > 0
            starts = np.concatenate(([0], np.cumsum(lens)))[:-1][some]
            if len(flat):
                out[some] = np.add.reduceat(self.weights[flat], starts, axis=0)
        return out

    def emissions(self, tokens: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """(texts x length x labels) for padded rows of scores; the row of padding is zero."""
        many, length = tokens.shape
        out = np.empty((many, length, self.steps.shape[0]), np.float32)
        block = max(1, AT_ONCE // length)
        for lo in range(0, many, block):  # so few at once that they stay in the processor's cache
            each, sums = scores[tokens[lo : lo + block]], out[lo : lo + block]
            sums[:] = each[:, :, REACH.index(0)]
            for k, o in enumerate(REACH):
                if o < 0 and length > -o:
                    sums[:, -o:] += each[:, :o, k]
                elif 0 < o < length:
                    sums[:, :-o] += each[:, o:, k]
        return out

    def viterbi(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The likeliest labels of each text, texts side by side; positions beyond a text's length have no meaning."""
        n, length, m = emissions.shape
        e = np.ascontiguousarray(emissions.transpose(1, 2, 0))  # places, labels, texts: each step runs over all texts at once
        back = np.zeros((length, m, n), dtype=np.int8)
        best = e[0] + self.first[:, None]
        for t in range(1, length):
            ahead, way = best[0] + self.steps[0][:, None], back[t]
            for f in range(1, m):
                ways = best[f] + self.steps[f][:, None]
                way[ways > ahead] = f
                np.maximum(ahead, ways, out=ahead)
            ahead += e[t]
            best = ahead if t < lengths.min() else np.where(t < lengths, ahead, best)
        out = np.zeros((n, length), dtype=np.int8)
        label = best.argmax(axis=0)
        rows = np.arange(n)
        for t in range(length - 1, -1, -1):
            out[:, t] = label
            if t:
                label = np.where(t < lengths, back[t, label, rows], label)
        return out


def _sum_rows(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows summed by number."""
    wide = rows.shape[1]
    return np.bincount((at[:, None] * wide + np.arange(wide)).ravel(), rows.ravel(), n * wide).reshape(n, wide)


def _gaps(e: np.ndarray, first: np.ndarray, steps: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of the log-likelihood of labels y by emissions e (both: places first, then texts) and by steps.

    Forward and backward passes in probabilities, scaled at each place, all texts side by side.
    """
    size, many, m = e.shape
    p = np.exp(e - e.max(axis=2, keepdims=True))
    p[0] *= np.exp(first)
    way = np.exp(steps.astype(np.float64))
    fore, back, scale = np.zeros_like(p), np.ones_like(p), np.ones((size, many, 1))
    for t in range(size):
        a = p[0] if t == 0 else (fore[t - 1] @ way) * p[t]
        scale[t] = np.where(live[t][:, None], a.sum(axis=1, keepdims=True), 1.0)
        fore[t] = np.where(live[t][:, None], a / scale[t], fore[t - 1] if t else a)
    for t in range(size - 2, -1, -1):
        b = (p[t + 1] * back[t + 1] / scale[t + 1]) @ way.T
        back[t] = np.where(live[t + 1][:, None], b, 1.0)
    own = fore * back
    miss = -own / own.sum(axis=2, keepdims=True)
    places, texts = np.ogrid[:size, :many]
    miss[places, texts, y] += 1
    miss *= live[:, :, None]
    later = p[1:] * back[1:] / scale[1:] * live[1:, :, None]
    expected = way * (fore[:-1].reshape(-1, m).T @ later.reshape(-1, m))
    seen = np.bincount((y[:-1] * m + y[1:])[live[1:]], minlength=m * m).reshape(m, m)
    return miss, seen - expected


def train(tokens: np.ndarray, lengths: np.ndarray, labels: np.ndarray, features: list[list[int]], n_features: int, n_labels: int, passes: int = 10, batch: int = 64, rate: float = 0.15, shrink: float = 3e-5, seed: int = 1) -> Chain:
    """The chain that makes the given labels likely: stochastic gradient ascent of the log-likelihood, with AdaGrad's rates and weight decay.

    tokens and labels: (texts x length), padded with len(features) and 0; features: those of each distinct token.
    """
    rng = np.random.default_rng(seed)
    chain = Chain(np.zeros((n_features, len(REACH), n_labels), np.float32), np.zeros((n_labels, n_labels), np.float32), np.zeros(n_labels, np.float32))
    seen = [np.full_like(x, 1e-2) for x in (chain.weights, chain.steps, chain.first)]
    lens = np.array([len(f) for f in features])
    flat = np.fromiter((x for f in features for x in f), dtype=np.int64)
    holder = np.repeat(np.arange(len(features)), lens)
    none, total = len(features), len(tokens)
    for _ in range(passes):
        order = rng.permutation(total)
        for lo in range(0, total, batch):
            pick = order[lo : lo + batch]
            size = int(lengths[pick].max())
            x, y, n = tokens[pick, :size], labels[pick, :size], lengths[pick]
            used, x = np.unique(x, return_inverse=True)
            x = x.reshape(len(pick), size)
            if used[-1] != none:
                used = np.append(used, none)
            scores = np.concatenate([chain.scores_of([features[u] for u in used[:-1]]), np.zeros((1, len(REACH), n_labels), np.float32)])
            e = chain.emissions(x, scores).astype(np.float64).transpose(1, 0, 2)
            live = np.arange(size)[:, None] < n[None, :]
            miss, g_steps = _gaps(e, chain.first, chain.steps, y.T, live)
            g_first = miss[0].sum(axis=0)
            miss, x = miss.reshape(size, -1, n_labels), x.T
            by_token = np.zeros((len(used), len(REACH), n_labels))
            for k, o in enumerate(REACH):
                src, err = (x[:o], miss[-o:]) if o < 0 else (x, miss) if o == 0 else (x[o:], miss[:-o])
                by_token[:, k] = _sum_rows(src.ravel(), err.reshape(-1, n_labels), len(used))
            place = np.full(none + 1, -1)
            place[used] = np.arange(len(used))
            mine = place[holder] >= 0
            f, at = flat[mine], place[holder[mine]]
            mine_used, inverse = np.unique(f, return_inverse=True)
            g = _sum_rows(inverse, by_token[at].reshape(len(at), -1), len(mine_used)).reshape(-1, len(REACH), n_labels)
            g = g / len(pick) - shrink * chain.weights[mine_used]
            seen[0][mine_used] += (g**2).astype(np.float32)
            chain.weights[mine_used] += (rate * g / np.sqrt(seen[0][mine_used])).astype(np.float32)
            for i, (w, g) in enumerate(((chain.steps, g_steps), (chain.first, g_first)), 1):
                g = g / len(pick) - shrink * w
                seen[i] += (g**2).astype(np.float32)
                w += (rate * g / np.sqrt(seen[i])).astype(np.float32)
    return chain
