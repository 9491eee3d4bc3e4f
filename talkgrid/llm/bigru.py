"""A bidirectional gated recurrent network in numpy: forward pass, backpropagation through time, Adam.

Arrays are (time, feature, batch): gates are contiguous slices, and a step is one small matrix product
over a large batch. `x` holds the input's share of the gates (update, reset, candidate), which callers
look up in tables, as an input is a byte or a word. The candidate takes the reset gate after the
recurrent product: c = tanh(x_c + r * (U_c h)), h' = c + z * (h - c).
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> None:
    """In place."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)


def scan(x: np.ndarray, u: np.ndarray, reverse: bool) -> np.ndarray:
    """States (time, h, batch) of one direction."""
    steps, wide, batch = x.shape
    h = wide // 3
    out = np.empty((steps, h, batch), np.float32)
    state, a, g = np.zeros((h, batch), np.float32), np.empty((wide, batch), np.float32), np.empty((2 * h, batch), np.float32)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        np.matmul(u, state, out=a)
        np.add(a[: 2 * h], x[t, : 2 * h], out=g)
        _sigmoid(g)
        c = a[2 * h :]
        c *= g[h:]
        c += x[t, 2 * h :]
        np.tanh(c, out=c)
        new = out[t]
        np.subtract(state, c, out=new)
        new *= g[:h]
        new += c
        state = new
    return out


def scan_back(x: np.ndarray, u: np.ndarray, states: np.ndarray, grad: np.ndarray, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u, given those of the states."""
    steps, wide, batch = x.shape
    h = wide // 3
    dx, du, carry = np.empty_like(x), np.zeros_like(u), np.zeros((h, batch), np.float32)
    order = list(range(steps - 1, -1, -1) if reverse else range(steps))
    for k in range(steps - 1, -1, -1):
        t = order[k]
        before = states[order[k - 1]] if k else np.zeros((h, batch), np.float32)
        a = u @ before
        g = a[: 2 * h] + x[t, : 2 * h]
        _sigmoid(g)
        z, r = g[:h], g[h:]
        c = np.tanh(x[t, 2 * h :] + r * a[2 * h :])
        d = grad[t] + carry
        dc = d * (1 - z) * (1 - c * c)
        dz, dr = d * (before - c) * z * (1 - z), dc * a[2 * h :] * r * (1 - r)
        dx[t, :h], dx[t, h : 2 * h], dx[t, 2 * h :] = dz, dr, dc
        da = np.concatenate([dz, dr, dc * r])
        du += da @ before.T
        carry = d * z + u.T @ da
    return dx, du


class Adam:
    def __init__(self, params: Params, rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: Params, most: float = 5.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        shrink = np.float32(min(1.0, most / (norm + 1e-9)))
        for k, g in grads.items():
            g = g * shrink
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            fix = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
            self.params[k] -= (fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)
