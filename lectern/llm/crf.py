"""Linear-chain conditional random field over word-shape features in numpy: training by minibatches, decoding by Viterbi in batches of sequences."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

#: Places around a token whose features count for it.
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)


_MAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")


def word_shape(w: str) -> str:
    """Form of a token: A, a and x for capital, small and caseless letters, 9 for digits; runs are cut to two (letters) or three (digits)."""
    s = re.sub(r"[^\W\d_]", lambda m: "A" if m.group().isupper() else "a" if m.group().islower() else "x", re.sub(r"\d", "9", w))
    return re.sub(r"9{4,}", "9999", re.sub(r"([Aax])\1{2,}", r"\1\1", s))


def token_features(w: str, known: Callable[[str], bool]) -> list[str]:
    """Features of one token: itself if known, its form, affixes, length, digits, signs."""
    low = w.lower()
    out = ["bias", "s=" + word_shape(w)]
    if known(low):
        out.append("w=" + low)
    elif any(c.isalpha() for c in w):
        out.append("unknown")
        out.append("unknown:" + ("A" if w[:1].isupper() else "a" if w[:1].islower() else "x") + ("9" if any(c.isdigit() for c in w) else "") + ("-" if "-" in w else ""))
    if w.isalpha():
        out += ["p2=" + low[:2], "e2=" + low[-2:], "e3=" + low[-3:], "e4=" + low[-4:]]
    digits = sum(c.isdigit() for c in w)
    out += [f"n={min(len(w), 12)}", f"d={min(digits, 14)}"]
    out += ["has" + c for c in "@.-/_'" if c in w and len(w) > 1]
    if _MAIL.fullmatch(w):
        out.append("mail")
    return out


# Words before a name, and words within one.
_TITLES = frozenset("mx mr mrs ms miss dr prof dipl ing herr frau sr sra mme mlle".split())
_WITHIN = frozenset("al el bin ibn bint ben abu von van de der den da do dos das del la le du di y e".split())
#: Rough kinds of tokens; of each place, the kinds of it and its two neighbours together are one more feature.
GROUPS = 18


def rough_kind(w: str, known: Callable[[str], bool]) -> int:
    """The rough kind of a token: a break, a sign, an initial, a title, a small word of names, by script, case and whether it is known, digits, an address."""
    low = w.lower()
    if w == "\n":
        return 1
    if not any(c.isalnum() for c in w):
        return 2 if w == "," else 3 if w == "." else 4 if w in "()[]" else 5
    if "@" in w:
        return 6
    if any(c.isdigit() for c in w):
        return 7 if w.isdigit() else 8
    if low in _TITLES:
        return 9
    if low in _WITHIN:
        return 10
    if len(w) == 1:
        return 11
    if w[0].islower():
        return 12 if known(low) else 13
    if w[0].isupper():
        return 14 if known(low) else 15
    return 16 if known(low) else 17


class Crf:
    """Labels, feature ids and weights. A sequence is a list of tokens; emissions are sums over the features of the tokens around each place."""

    def __init__(self, labels: Sequence[str], vocabulary: frozenset[str]) -> None:
        self.labels, self.vocabulary = list(labels), vocabulary
        self.ids: dict[str, int] = {}
        self.weights = np.zeros((0, len(OFFSETS), len(labels)), np.float32)
        n = len(labels)
        self.around = np.zeros((GROUPS**3, n), np.float32)
        self.moves, self.start = np.zeros((n, n), np.float32), np.zeros(n, np.float32)
        # An inside label follows only its own kind.
        self.allowed = np.array([[0.0 if not b.startswith("I-") or a[2:] == b[2:] and a != "O" else -1e4 for b in labels] for a in labels], np.float32)
        self.first = np.array([-1e4 if b.startswith("I-") else 0.0 for b in labels], np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def features(self, w: str, grow: bool = False) -> list[int]:
        names = token_features(w, self.vocabulary.__contains__)
        if grow:
            return [self.ids.setdefault(f, len(self.ids)) for f in names]
        return [i for f in names if (i := self.ids.get(f)) is not None]

    def _around(self, g: np.ndarray) -> np.ndarray:
        """Places in ``around`` of each place's own group and those beside it; -1, the padding, is group 0."""
        g = np.pad(np.maximum(g, 0), ((0, 0), (1, 1)))
        return (g[:, :-2] * GROUPS + g[:, 1:-1]) * GROUPS + g[:, 2:]

    def fit(self, rows: list[tuple[list[str], list[int]]], epochs: int = 5, batch: int = 64, rate: float = 0.15, decay: float = 1e-5, seed: int = 0) -> Crf:
        """Maximise the likelihood of the labels by Adagrad; deterministic for a seed."""
        rng = np.random.default_rng(seed)
        tokens: dict[str, int] = {}
        data = [(np.array([tokens.setdefault(w, len(tokens)) for w in ws]), np.array(ys)) for ws, ys in rows if ws]
        feats = [self.features(w, grow=True) for w in tokens]
        of_feature = np.concatenate([np.array(f) for f in feats])
        first = np.concatenate([[0], np.cumsum([len(f) for f in feats])])
        n, k = len(self.labels), len(OFFSETS)
        self.weights = np.zeros((len(self.ids), k, n), np.float32)
        groups_of = np.array([*(rough_kind(w, self.vocabulary.__contains__) for w in tokens), 0])  # the last is the padding
        past_a = np.full_like(self.around, 1e-6)
        past_w, past_m, past_s = np.full_like(self.weights, 1e-6), np.full_like(self.moves, 1e-6), np.full_like(self.start, 1e-6)
        order = np.argsort([len(x) for x, _ in data], kind="stable")
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        mean: list[np.ndarray] | None = None
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                chosen = [data[i] for i in groups[g]]
                length = np.array([len(x) for x, _ in chosen])
                t = int(length.max())
                x, y = np.full((len(chosen), t), -1), np.zeros((len(chosen), t), np.int64)
                for r, (a, b) in enumerate(chosen):
                    x[r, : len(a)], y[r, : len(b)] = a, b
                used, inverse = np.unique(x, return_inverse=True)
                inverse = inverse.reshape(x.shape)
                sizes = np.where(used >= 0, first[used + 1] - first[used], 0)  # -1, the padding, has no features
                rows_ = np.repeat(np.arange(len(used)), sizes)
                cols = of_feature[np.repeat(first[np.maximum(used, 0)] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(rows_))]
                table = _sums(self.weights[cols], rows_, len(used))
                places = self._around(groups_of[x])
                e = _emissions(table, inverse) + self.around[places]
                mask = np.arange(t) < length[:, None]
                p, pair, p0 = self._expect(e, mask)
                gold = np.zeros_like(p)
                np.put_along_axis(gold, y[:, :, None], 1.0, axis=2)
                diff = (gold - p) * mask[:, :, None]
                gm = -pair
                both = mask[:, 1:]
                np.add.at(gm, (y[:, :-1][both], y[:, 1:][both]), 1.0)
                gs = np.zeros(n, np.float32)
                np.add.at(gs, y[:, 0], 1.0)
                gs -= p0
                gt = np.zeros_like(table)
                flat = inverse.ravel()
                by_token = np.argsort(flat, kind="stable")
                for j, o in enumerate(OFFSETS):
                    a, b = (slice(max(0, -o), t - max(0, o)), slice(max(0, o), t - max(0, -o)))
                    if a.start < a.stop:
                        moved = np.zeros_like(diff)
                        moved[:, b] = diff[:, a]
                        gt[:, j] = _sums(moved.reshape(-1, n)[by_token], flat[by_token], len(used))
                by_feature = np.argsort(cols, kind="stable")
                distinct, where = np.unique(cols[by_feature], return_inverse=True)
                gw = _sums(gt[rows_[by_feature]], where, len(distinct))
                gw -= decay * len(chosen) * self.weights[distinct]
                past_w[distinct] += gw * gw
                self.weights[distinct] += rate * gw / np.sqrt(past_w[distinct])
                by_place = np.argsort(places.ravel(), kind="stable")
                met, to = np.unique(places.ravel()[by_place], return_inverse=True)
                ga = _sums(diff.reshape(-1, n)[by_place], to, len(met)) - decay * len(chosen) * self.around[met]
                past_a[met] += ga * ga
                self.around[met] += rate * ga / np.sqrt(past_a[met])
                past_m += gm * gm
                past_s += gs * gs
                self.moves += rate * gm / np.sqrt(past_m)
                self.start += rate * gs / np.sqrt(past_s)
            if epoch >= epochs // 2:  # the mean over the later epochs varies less than the last
                now = [self.weights, self.moves, self.start, self.around]
                mean = [x.astype(np.float64) for x in now] if mean is None else [m + x for m, x in zip(mean, now, strict=True)]
        if mean is not None:
            self.weights, self.moves, self.start, self.around = ((m / (epochs - epochs // 2)).astype(np.float32) for m in mean)
        return self

    def _expect(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b, t, n = e.shape
        moves = np.exp(self.moves + self.allowed)
        f, scale = np.zeros_like(e), np.zeros((b, t), np.float32)
        ex = np.exp(e - e.max(axis=2, keepdims=True))
        a = np.exp(self.start + self.first - (self.start + self.first).max()) * ex[:, 0]
        scale[:, 0] = a.sum(axis=1)
        f[:, 0] = a / scale[:, :1]
        for i in range(1, t):
            a = (f[:, i - 1] @ moves) * ex[:, i]
            a = np.where(mask[:, i, None], a, f[:, i - 1])
            scale[:, i] = a.sum(axis=1)
            f[:, i] = a / scale[:, i, None]
        back = np.ones_like(e)
        pair = np.zeros((n, n), np.float32)
        for i in range(t - 2, -1, -1):
            r = ex[:, i + 1] * back[:, i + 1]
            m = mask[:, i + 1, None]
            joint = f[:, i, :, None] * moves * r[:, None, :]
            z = joint.sum(axis=(1, 2), keepdims=True)
            pair += np.where(m[:, :, None], joint / np.maximum(z, 1e-30), 0).sum(axis=0)
            nb = r @ moves.T
            back[:, i] = np.where(m, nb / np.maximum(nb.sum(axis=1, keepdims=True), 1e-30), back[:, i + 1] * 0 + 1)
        p = f * back
        p /= np.maximum(p.sum(axis=2, keepdims=True), 1e-30)
        return p, pair, p[:, 0].sum(axis=0)

    def _entry(self, w: str) -> tuple[np.ndarray, int]:
        """What a token says of the labels of the places around it, and its rough kind."""
        return self.weights[self.features(w)].sum(axis=0), rough_kind(w, self.vocabulary.__contains__)

    def decode(self, sequences: list[list[str]], batch: int = 256) -> list[np.ndarray]:
        """The best labels of each sequence (places in ``labels``), by Viterbi over batches of sequences of like length."""
        entry = getattr(self, "_table", None)
        if entry is None:
            entry = self._table = lru_cache(150_000)(self._entry)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = [i for i in np.argsort([len(s) for s in sequences], kind="stable").tolist() if sequences[i]]
        moves = self.moves + self.allowed
        at, group = 0, []
        while at < len(order):
            group = order[at : at + max(1, min(batch, 60_000 // len(sequences[order[min(at + batch, len(order)) - 1]])))]
            at += len(group)
            ids: dict[str, int] = {}
            t = max(len(sequences[i]) for i in group)
            x = np.full((len(group), t), -1)
            for r, i in enumerate(group):
                x[r, : len(sequences[i])] = [ids.setdefault(w, len(ids)) for w in sequences[i]]
            entries = [entry(w) for w in ids]
            table = np.concatenate([np.stack([v for v, _ in entries]), np.zeros((1, len(OFFSETS), len(self.labels)), np.float32)])
            groups_of = np.array([*(k for _, k in entries), 0])
            e = _emissions(table, x) + self.around[self._around(groups_of[x])]  # -1 is the closing row of zeros
            score = self.start + self.first + e[:, 0]
            back = np.zeros((len(group), t, len(self.labels)), np.int8)
            length = np.array([len(sequences[i]) for i in group])
            for k in range(1, t):
                options = score[:, :, None] + moves
                back[:, k] = options.argmax(axis=1)
                step = options.max(axis=1) + e[:, k]
                score = np.where((k < length)[:, None], step, score)
            best = score.argmax(axis=1)
            path = np.zeros((len(group), t), np.int64)
            rows = np.arange(len(group))
            for k in range(t - 1, -1, -1):
                path[:, k] = best
                if k:
                    best = np.where(k < length, back[rows, k, best], best)
            for r, i in enumerate(group):
                out[i] = path[r, : length[r]]
        return out


def _sums(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group; groups are in ascending order."""
    out = np.zeros((n, *values.shape[1:]), np.float32)
    if len(groups):
        starts = np.concatenate([[0], np.nonzero(np.diff(groups))[0] + 1])
        out[groups[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def _emissions(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of each label at each place: the sum of what the tokens around it, by offset, say."""
    b, t = x.shape
    e = np.zeros((b, t, table.shape[2]), np.float32)
    for j, o in enumerate(OFFSETS):
        a, c = (slice(max(0, -o), t - max(0, o)), slice(max(0, o), t - max(0, -o)))
        if a.start < a.stop:
            e[:, a] += table[:, j][x[:, c]]
    return e
