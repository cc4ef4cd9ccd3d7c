"""A bidirectional LSTM in numpy that tells the article's blocks of a page from all others."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from mediafuse.llm.html_blocks import DIM, Block, blocks, features
from mediafuse.llm.html_layouts import Pages

HIDDEN = 24
#: Blocks of a long page whose features are in memory at a time.
CHUNK = 4096
#: Synthetic pages, passes over them, and the seed of all that is random in training.
TRAIN_PAGES, EPOCHS, SEED = 900, 14, 11


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        init = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("wx", init(DIM, 4 * HIDDEN)), ("wh", init(HIDDEN, 4 * HIDDEN)), ("b", np.zeros(4 * HIDDEN, np.float32)))}
        for d in "fb":
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1.0
        self.p |= {"wo": init(2 * HIDDEN, 1), "wd": np.zeros((DIM, 1), np.float32), "bo": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, state: tuple | None = None, tape: list | None = None) -> tuple[np.ndarray, tuple]:
        """Hidden states (T, N, HIDDEN) of one direction and the last state; x is (T, N, DIM), mask (T, N, 1). ``tape`` gets what gradients need."""
        zx = x @ self.p["wx" + d] + self.p["b" + d]
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h, c = state or (np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32))
        out = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        for t in steps:
            z = zx[t] + h @ self.p["wh" + d]
            g = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            u = np.tanh(z[:, 3 * HIDDEN :])
            before = (h, c)
            c = np.where(mask[t], f * c + i * u, c)
            s = np.tanh(c)
            h = np.where(mask[t], o * s, h)
            out[t] = h
            if tape is not None:
                tape.append((t, i, f, o, u, s, *before))
        return out, (h, c)

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d)[0] for d in "fb"], axis=2)
        return (both @ self.p["wo"] + x @ self.p["wd"] + self.p["bo"])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        tapes: dict[str, list] = {d: [] for d in "fb"}
        both = np.concatenate([self._run(x, mask, d, tape=tapes[d])[0] for d in "fb"], axis=2)
        prob = _sigmoid((both @ self.p["wo"] + x @ self.p["wd"] + self.p["bo"])[:, :, 0])
        m = mask[:, :, 0]
        loss = -float((m * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum() / m.sum())
        e = ((prob - y) * m / m.sum())[:, :, None].astype(np.float32)
        g = {"wo": np.einsum("tnh,tno->ho", both, e), "wd": np.einsum("tnd,tno->do", x, e), "bo": e.sum(axis=(0, 1))}
        dh_all = e @ self.p["wo"].T
        for k, d in enumerate("fb"):
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            gw = np.zeros_like(self.p["wh" + d])
            for t, i, f, o, u, s, h0, c0 in reversed(tapes[d]):
                live = mask[t]
                dh = dh + dh_all[t][:, k * HIDDEN : (k + 1) * HIDDEN]
                dhl = dh * live
                dcl = dc * live + dhl * o * (1 - s * s)
                dz = np.concatenate([dcl * u * i * (1 - i), dcl * c0 * f * (1 - f), dhl * s * o * (1 - o), dcl * i * (1 - u * u)], axis=1)
                dz_all[t] = dz
                gw += h0.T @ dz
                dh = dz @ self.p["wh" + d].T + dh * ~live
                dc = dcl * f + dc * ~live
            g["wh" + d] = gw
            g["wx" + d] = x.reshape(-1, DIM).T @ dz_all.reshape(-1, 4 * HIDDEN)
            g["b" + d] = dz_all.sum(axis=(0, 1))
        return loss, g

    def long_page(self, page: list[Block]) -> np.ndarray:
        """As for other pages, with the features of CHUNK blocks at a time: memory holds the hidden states of the page only."""
        ends = [(a, min(a + CHUNK, len(page))) for a in range(0, len(page), CHUNK)]
        back, state = np.zeros((len(page), HIDDEN), np.float32), None
        for a, b in reversed(ends):
            x = features(page, a, b)[:, None]
            part, state = self._run(x, np.ones((b - a, 1, 1), bool), "b", state)
            back[a:b] = part[:, 0]
        out, state = np.zeros(len(page)), None
        for a, b in ends:
            x = features(page, a, b)[:, None]
            part, state = self._run(x, np.ones((b - a, 1, 1), bool), "f", state)
            both = np.concatenate([part[:, 0], back[a:b]], axis=1)
            out[a:b] = _sigmoid(both @ self.p["wo"] + x[:, 0] @ self.p["wd"] + self.p["bo"])[:, 0]
        return out

    def predict(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page the probability of each block to belong to the article. Pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            if longest > CHUNK:
                long = order.pop()
                out[long] = self.long_page(pages[long])
                continue
            n = max(1, min(64, 4096 // longest))
            group, order = order[-n:], order[:-n]
            x, mask, _ = padded([features(pages[i]) for i in group])
            prob = _sigmoid(self.logits(x, mask))
            for k, i in enumerate(group):
                out[i] = prob[: len(pages[i]), k]
        return out


def padded(pages: list[np.ndarray], labels: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max(len(p) for p in pages)
    x = np.zeros((longest, len(pages), DIM), np.float32)
    mask, y = np.zeros((longest, len(pages), 1), bool), np.zeros((longest, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
        if labels is not None:
            y[: len(p), k] = labels[k]
    return x, mask, y


def labelled_pages(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    made, out = Pages(seed), []
    while len(out) < n:
        found = blocks(made.page())
        if found:
            out.append((found, np.array([any("data-y=1" in names for _, names in b.path) for b in found], dtype=np.float32)))
    return out


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller trained by Adam on synthetic pages; the same on every machine up to rounding."""
    data = sorted(((features(b), y) for b, y in labelled_pages(pages, seed)), key=lambda d: len(d[0]))
    groups = [padded([x for x, _ in data[i : i + 20]], [y for _, y in data[i : i + 20]]) for i in range(0, len(data), 20)]
    model, r = Labeller(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (0.5 if epoch > epochs // 2 else 1.0) * (0.3 if epoch > epochs * 3 // 4 else 1.0)
        for k in r.permutation(len(groups)):
            x, mask, y = groups[k]
            keep = r.random(DIM) > 0.1  # whole features are left out at random, so that no single name decides
            _, g = model.gradients(x * keep.astype(np.float32), mask, y)
            step += 1
            for name, d in g.items():
                first[name] = 0.9 * first[name] + 0.1 * d
                second[name] = 0.999 * second[name] + 0.001 * d * d
                model.p[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model
