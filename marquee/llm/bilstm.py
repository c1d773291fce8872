"""A small bidirectional LSTM that labels every step of a sequence, in numpy: training and use."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class BiLstm:
    """Two LSTMs read a sequence from either end; a logistic layer over both states gives each step's probability."""

    def __init__(self, inputs: int, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.weights: dict[str, np.ndarray] = {}
        for d in "lr":
            bias = np.zeros(4 * hidden, dtype=np.float32)
            bias[hidden : 2 * hidden] = 1  # remember at first
            self.weights |= {f"{d}x": draw(inputs, 4 * hidden), f"{d}h": draw(hidden, 4 * hidden), f"{d}b": bias}
        self.weights |= {"out": draw(2 * hidden, 1), "out_b": np.zeros(1, dtype=np.float32)}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, tape: list | None) -> np.ndarray:
        n, steps, _ = x.shape
        k = self.hidden
        z_all = x @ self.weights[f"{d}x"] + self.weights[f"{d}b"]
        h = np.zeros((n, k), dtype=np.float32)
        c = np.zeros_like(h)
        out = np.zeros((n, steps, k), dtype=np.float32)
        for t in range(steps):
            z = z_all[:, t] + h @ self.weights[f"{d}h"]
            i, f, o = (sigmoid(z[:, j * k : (j + 1) * k]) for j in range(3))
            g = np.tanh(z[:, 3 * k :])
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            m = mask[:, t, None]
            if tape is not None:
                tape.append((h, c, i, f, o, g, tc, m))
            h = m * (o * tc) + (1 - m) * h
            c = m * c_new + (1 - m) * c
            out[:, t] = h
        return out

    def _back(self, d: str, x: np.ndarray, d_out: np.ndarray, tape: list) -> dict[str, np.ndarray]:
        k = self.hidden
        wh = self.weights[f"{d}h"]
        dz_all = np.zeros((*x.shape[:2], 4 * k), dtype=np.float32)
        d_wh = np.zeros_like(wh)
        dh = np.zeros((len(x), k), dtype=np.float32)
        dc = np.zeros_like(dh)
        for t in range(x.shape[1] - 1, -1, -1):
            h, c, i, f, o, g, tc, m = tape[t]
            dh = dh + d_out[:, t]
            dh_in, dc_in = m * dh, m * dc
            dcn = dc_in + dh_in * o * (1 - tc * tc)
            dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), dh_in * tc * o * (1 - o), dcn * i * (1 - g * g)], axis=1)
            dz_all[:, t] = dz
            d_wh += h.T @ dz
            dh = dz @ wh.T + (1 - m) * dh
            dc = dcn * f + (1 - m) * dc
        flat = dz_all.reshape(-1, 4 * k)
        return {f"{d}x": x.reshape(-1, x.shape[2]).T @ flat, f"{d}h": d_wh, f"{d}b": flat.sum(0)}

    @staticmethod
    def _turned(mask: np.ndarray) -> np.ndarray:
        """For each row the order of steps that reads its valid part backwards; its own inverse."""
        n = mask.sum(1).astype(int)[:, None]
        t = np.arange(mask.shape[1])[None]
        return np.where(t < n, n - 1 - t, t)

    def probabilities(self, x: np.ndarray, mask: np.ndarray, tapes: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, states) for padded sequences (rows, steps, inputs); mask is 1 for valid steps."""
        turn = self._turned(mask)[:, :, None]
        left = self._run("l", x, mask, tapes[0] if tapes else None)
        right = np.take_along_axis(self._run("r", np.take_along_axis(x, turn, 1), mask, tapes[1] if tapes else None), turn, 1)
        states = np.concatenate([left, right], axis=2)
        return sigmoid(states @ self.weights["out"] + self.weights["out_b"])[..., 0], states

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        tapes: tuple[list, list] = ([], [])
        p, states = self.probabilities(x, mask, tapes)
        n = mask.sum()
        loss = -(mask * np.log(np.where(labels > 0, p, 1 - p) + 1e-7)).sum() / n
        d_logit = (mask * (p - labels) / n).astype(np.float32)[..., None]
        d_states = d_logit @ self.weights["out"].T
        k, turn = self.hidden, self._turned(mask)[:, :, None]
        grads = {"out": states.reshape(-1, 2 * k).T @ d_logit.reshape(-1, 1), "out_b": d_logit.sum((0, 1))}
        grads |= self._back("l", x, d_states[..., :k], tapes[0])
        grads |= self._back("r", np.take_along_axis(x, turn, 1), np.take_along_axis(d_states[..., k:], turn, 1), tapes[1])
        return float(loss), grads

    def fit(self, batches, rate: float = 0.01) -> list[float]:
        """Adam over the batches (x, mask, labels); the losses."""
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses = []
        for n, batch in enumerate(batches, 1):
            loss, grads = self.gradients(*batch)
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.weights[k] = (self.weights[k] - rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
        return losses
