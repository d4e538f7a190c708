"""A byte-level convolutional network in numpy: embedding, filters of several widths, max pooling, a dense layer.

Filters of all widths are one matrix over patches of the widest (narrower ones are zero there and stay so), so a pass
over a batch of fixed-length windows is one matrix product. A bag of windows is one example: its pooled features are
combined over the windows (mean, or mean and maximum) before the dense softmax layer, which makes one prediction of a
text of any length from all of its windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DIM, WIDTHS, EACH = 6, (2, 3, 4), 16  #: embedding size, filter widths, filters of each width
LENGTH = 256  #: bytes of a window
ROWS = 64  #: windows in one matrix product
MOST = 1024  #: windows of a training batch, beyond those of one bag
#: Texts beyond so many bytes are not learned from; those learned from are read whole. Predictions read any text.
TRAIN_BYTES = 1 << 15


@dataclass
class Net:
    emb: np.ndarray  # 256 x DIM
    conv: np.ndarray  # widest * DIM x filters
    bias: np.ndarray  # filters
    dense: np.ndarray  # features x classes
    out: np.ndarray  # classes
    both: bool  # mean and maximum over windows, else the mean


def cut(raw: bytes, stride: int, length: int = LENGTH) -> np.ndarray:
    """All windows of a text, zero-padded; they cover every byte. One empty window for an empty text."""
    n = max(1, -(-max(0, len(raw) - length) // stride) + 1)
    flat = np.zeros((n - 1) * stride + length, np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n, length), (stride, 1)).copy()


def _patches(net: Net, win: np.ndarray) -> np.ndarray:
    wide, dim = max(WIDTHS), net.emb.shape[1]
    x = net.emb[win].reshape(len(win), -1)
    n = win.shape[1] - wide + 1
    view = np.lib.stride_tricks.as_strided(x, (len(win), n, wide * dim), (x.strides[0], dim * x.itemsize, x.itemsize))
    return view.reshape(-1, wide * dim)


def pooled(net: Net, win: np.ndarray) -> np.ndarray:
    """ReLU of the maximum of each filter over each window."""
    out = np.empty((len(win), len(net.bias)), np.float32)
    n = win.shape[1] - max(WIDTHS) + 1
    for i in range(0, len(win), ROWS):
        part = win[i : i + ROWS]
        out[i : i + ROWS] = (_patches(net, part) @ net.conv).reshape(len(part), n, -1).max(axis=1)
    return np.maximum(out + net.bias, 0)


def combine(net: Net, feats: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Features of each bag of consecutive windows; starts are the first windows of the bags."""
    sizes = np.diff(np.append(starts, len(feats)))[:, None]
    mean = np.add.reduceat(feats, starts, axis=0) / sizes
    return np.concatenate([mean, np.maximum.reduceat(feats, starts, axis=0)], axis=1) if net.both else mean


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def predict(net: Net, texts: list[bytes], stride: int, group: int = 2048) -> np.ndarray:
    """Class probabilities of each text, from all its windows; about `group` windows are held at a time."""
    out, held, n = [], [], 0

    def flush():
        if held:
            starts = np.cumsum([0, *map(len, held[:-1])])
            out.append(combine(net, pooled(net, np.concatenate(held)), starts) @ net.dense + net.out)
            held.clear()

    for raw in texts:
        win = cut(raw, stride)
        if len(win) > group:  # a long text by parts: sums and maxima of parts make those of the whole
            flush()
            total, most = 0.0, None
            for i in range(0, len(win), group):
                f = pooled(net, win[i : i + group])
                total = total + f.sum(axis=0)
                most = f.max(axis=0) if most is None else np.maximum(most, f.max(axis=0))
            mean = total / len(win)
            out.append((np.concatenate([mean, most]) if net.both else mean)[None] @ net.dense + net.out)
            n = 0
            continue
        held.append(win)
        n += len(win)
        if n > group:
            flush()
            n = 0
    flush()
    return softmax(np.concatenate(out)) if out else np.empty((0, len(net.out)))


def gradients(net: Net, win: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The weighted mean cross entropy of bags of windows (sizes of them, one after the other), and its gradients by
    emb, conv, bias, dense and out."""
    filters, wide = len(net.bias), max(WIDTHS)
    starts = np.cumsum(sizes) - sizes
    patches = _patches(net, win)
    n = win.shape[1] - wide + 1
    z = (patches @ net.conv).reshape(len(win), n, filters)
    at = z.argmax(axis=1)
    pre = np.take_along_axis(z, at[:, None], axis=1)[:, 0] + net.bias
    feats = np.maximum(pre, 0)
    x = combine(net, feats, starts)
    p = softmax(x @ net.dense + net.out)
    own, share = np.arange(len(sizes)), weights / weights.sum()
    loss = float(-(share * np.log(np.maximum(p[own, labels], 1e-30))).sum())
    p[own, labels] -= 1
    g = (p * share[:, None]).astype(net.dense.dtype)
    back = g @ net.dense.T
    owner = np.repeat(own, sizes)
    df = back[owner, :filters] / sizes[owner, None]
    if net.both:
        df = df + back[owner, filters:] * (x[:, filters:][owner] == feats)
    df = (df * (pre > 0)).astype(net.dense.dtype)
    chosen = patches[np.arange(len(win))[:, None] * n + at]  # windows x filters x wide * DIM
    dconv = np.einsum("nfk,nf->kf", chosen, df) * _mask()
    demb = np.zeros_like(net.emb)
    inner = (df[:, :, None] * net.conv.T[None]).reshape(len(win), filters, wide, DIM)
    where = win[np.arange(len(win))[:, None, None], at[:, :, None] + np.arange(wide)]
    for d in range(DIM):
        demb[:, d] = np.bincount(where.ravel(), inner[..., d].ravel(), 256)
    return loss, [demb, dconv, df.sum(axis=0), x.T.astype(g.dtype) @ g, g.sum(axis=0)]


def _mask() -> np.ndarray:
    """Which rows of the filter matrix each filter has: those of its own width."""
    wide = max(WIDTHS)
    return np.concatenate([np.repeat([1.0] * w * DIM + [0.0] * (wide - w) * DIM, EACH).reshape(wide * DIM, EACH) for w in WIDTHS], axis=1).astype(np.float32)


def start(classes: int, both: bool, rng: np.random.Generator) -> Net:
    filters, mask = EACH * len(WIDTHS), _mask()
    return Net(
        rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        (rng.normal(0, 1, mask.shape) * np.sqrt(1 / mask.sum(axis=0))).astype(np.float32) * mask,
        np.zeros(filters, np.float32),
        rng.normal(0, 0.1, (filters * (1 + both), classes)).astype(np.float32),
        np.zeros(classes, np.float32),
        both,
    )


def _batches(order: np.ndarray, sizes: np.ndarray, batch: int):
    """Runs of order with at most `batch` bags and, beyond one bag, MOST windows."""
    i = 0
    while i < len(order):
        total = np.cumsum(sizes[order[i : i + batch]])
        n = max(1, int(np.searchsorted(total, MOST, "right")))
        yield i, order[i : i + n]
        i += n


def train(bags: list[np.ndarray], labels: np.ndarray, classes: int, weights: np.ndarray | None = None, both: bool = False, epochs: int = 6, least: int = 500, batch: int = 32, rate: float = 0.004, seed: int = 7) -> Net:
    """Adam on the cross entropy; bags[i] holds the windows of example i. Few examples get `least` steps anyway."""
    epochs = max(epochs, -(-least // -(-len(bags) // batch)))
    rng = np.random.Generator(np.random.PCG64(seed))
    net = start(classes, both, rng)
    params = [net.emb, net.conv, net.bias, net.dense, net.out]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weights = np.ones(len(bags)) if weights is None else weights
    every = np.array([len(b) for b in bags])
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for i, take in _batches(order, every, batch):
            _, slopes = gradients(net, np.concatenate([bags[j] for j in take]), every[take], labels[take], weights[take])
            step += 1
            lr = rate * min(1.0, 2 * (1 - (epoch + i / len(order)) / epochs))
            for q, dq, m, v in zip(params, slopes, first, second):
                m *= 0.9
                m += 0.1 * dq
                v *= 0.99
                v += 0.01 * dq * dq
                q -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net
