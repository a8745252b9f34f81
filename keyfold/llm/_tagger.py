"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

#: Characters with a symbol of their own; others share one by their kind.
_OWN = " \n@.+-(),_:/\"=%#*!|[]"
SYMBOLS = 6 + len(_OWN)
_TABLE = np.full(0x250, 5, dtype=np.int64)
_TABLE[0xC0:0x250] = 4
_TABLE[48:58], _TABLE[97:123], _TABLE[65:91] = 1, 2, 3
for _k, _c in enumerate(_OWN):
    _TABLE[ord(_c)] = 6 + _k


def symbols(text: str) -> np.ndarray:
    """A symbol for every code point; 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], 4)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Scores of tags from both directions, and of each tag after each other."""

    def __init__(self, tags: int, size: int = 16, width: int = 20, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tags, self.width = tags, width

        def start(*shape: int) -> np.ndarray:
            return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"embed": start(SYMBOLS, size), "out": start(2 * width, tags), "bias": np.zeros(tags, np.float32)}
        self.p["next"] = np.zeros((tags, tags), np.float32)
        for way in ("ahead", "back"):
            self.p[f"{way}_x"], self.p[f"{way}_h"] = start(size, 4 * width), start(width, 4 * width)
            bias = np.zeros(4 * width, np.float32)
            bias[width : 2 * width] = 1  # remember at first
            self.p[f"{way}_b"] = bias

    def _run(self, x: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        p, n = self.p, self.width
        h = c = np.zeros((x.shape[1], n), np.float32)
        steps, out = [], np.empty((len(x), x.shape[1], n), np.float32)
        inputs = x @ p[f"{way}_x"] + p[f"{way}_b"]
        for t in range(len(x)) if way == "ahead" else range(len(x) - 1, -1, -1):
            z = inputs[t] + h @ p[f"{way}_h"]
            gates = _sigmoid(z[:, : 3 * n])
            new = np.tanh(z[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            before = (h, c)
            c = f * c + i * new
            held = np.tanh(c)
            h = o * held
            out[t] = h
            steps.append((t, i, f, o, new, held, *before))
        return out, steps

    def _run_back(self, x: np.ndarray, way: str, steps: list, grad: np.ndarray, g: dict) -> np.ndarray:
        p, n = self.p, self.width
        dh = dc = np.zeros((x.shape[1], n), np.float32)
        dz_all = np.empty((len(x), x.shape[1], 4 * n), np.float32)
        for t, i, f, o, new, held, h0, c0 in reversed(steps):
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - held * held)
            dz = dz_all[t]
            dz[:, :n] = dc * new * i * (1 - i)
            dz[:, n : 2 * n] = dc * c0 * f * (1 - f)
            dz[:, 2 * n : 3 * n] = dh * held * o * (1 - o)
            dz[:, 3 * n :] = dc * i * (1 - new * new)
            g[f"{way}_h"] += h0.T @ dz
            dh = dz @ p[f"{way}_h"].T
            dc = dc * f
        flat = dz_all.reshape(-1, 4 * n)
        g[f"{way}_x"] += x.reshape(-1, x.shape[2]).T @ flat
        g[f"{way}_b"] += flat.sum(axis=0)
        return dz_all @ p[f"{way}_x"].T

    def unary(self, windows: np.ndarray) -> np.ndarray:
        """Scores ``[place, window, tag]`` of windows of symbols ``[window, place]``."""
        x = self.p["embed"][windows.T]
        both = np.concatenate([self._run(x, "ahead")[0], self._run(x, "back")[0]], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def marginals(self, unary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of tags by forward-backward, and the expected transitions."""
        length, step = len(unary), self.p["next"]
        ahead, back = np.empty_like(unary), np.zeros_like(unary)
        ahead[0] = unary[0]
        for t in range(1, length):
            ahead[t] = unary[t] + _log_sum(ahead[t - 1][:, :, None] + step, 1)
        for t in range(length - 2, -1, -1):
            back[t] = _log_sum(step + (unary[t + 1] + back[t + 1])[:, None, :], 2)
        total = _log_sum(ahead[-1], 1)
        expected = np.zeros_like(step)
        for t in range(1, length):
            pair = ahead[t - 1][:, :, None] + step + (unary[t] + back[t])[:, None, :] - total[:, None, None]
            expected += np.exp(pair).sum(axis=0)
        return np.exp(ahead + back - total[None, :, None]), expected

    def decode(self, unary: np.ndarray) -> np.ndarray:
        """The best tags ``[window, place]``."""
        best, came, step = unary[0], [], self.p["next"]
        for t in range(1, len(unary)):
            options = best[:, :, None] + step
            came.append(options.argmax(axis=1))
            best = unary[t] + options.max(axis=1)
        tags = [best.argmax(axis=1)]
        for back in reversed(came):
            tags.append(back[np.arange(len(back)), tags[-1]])
        return np.stack(tags[::-1], axis=1)

    def fit(self, windows: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 32, rate: float = 0.03) -> None:
        """Adam on the likelihood of the tags; the order of batches is fixed."""
        rng = np.random.default_rng(11)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        done = 0
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                w, y = windows[part], tags[part].T
                x = self.p["embed"][w.T]
                ahead, steps_ahead = self._run(x, "ahead")
                back, steps_back = self._run(x, "back")
                both = np.concatenate([ahead, back], axis=2)
                probability, expected = self.marginals(both @ self.p["out"] + self.p["bias"])
                g = {k: np.zeros_like(v) for k, v in self.p.items()}
                g["next"] = expected
                np.add.at(g["next"], (y[:-1], y[1:]), -1)
                grad = probability
                np.put_along_axis(grad, y[:, :, None], np.take_along_axis(grad, y[:, :, None], 2) - 1, 2)
                g["out"] = both.reshape(-1, both.shape[2]).T @ grad.reshape(-1, self.tags)
                g["bias"] = grad.sum(axis=(0, 1))
                into = grad @ self.p["out"].T
                dx = self._run_back(x, "ahead", steps_ahead, into[:, :, : self.width], g)
                dx = dx + self._run_back(x, "back", steps_back, into[:, :, self.width :], g)
                np.add.at(g["embed"], w.T, dx)
                done += 1
                speed = rate * (1 - epoch / epochs) + 1e-4
                for k, v in self.p.items():
                    d = g[k] / len(part)
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.99 * second[k] + 0.01 * d * d
                    v -= speed * (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-6)
