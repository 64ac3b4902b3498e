"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Windows of characters go in as rows of equal length, tag numbers come out. Everything is a pure function of arrays,
so a trained model is a dictionary of some ten thousand numbers, whatever it was trained on.
"""

import numpy as np

Model = dict[str, np.ndarray]

#: Characters known by themselves (ASCII), all others together, and what stands beyond the end of a text.
_BEYOND, _OTHER, SYMBOLS = 0, 128, 129


def symbols(text: str, length: int) -> np.ndarray:
    """The numbers of a window's characters, filled up to a length."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.full(length, _BEYOND, np.int64)
    out[: len(codes)] = np.clip(codes, 1, _OTHER)
    return out


def new_model(tags: int, embedding: int = 16, hidden: int = 24, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)

    def some(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

    bias = np.zeros(4 * hidden, np.float32)
    bias[hidden : 2 * hidden] = 1  # A cell remembers until it has learned to forget.
    return {
        "E": rng.normal(0, 0.5, (SYMBOLS, embedding)).astype(np.float32), "Wf": some(embedding + hidden, 4 * hidden), "bf": bias.copy(),
        "Wb": some(embedding + hidden, 4 * hidden), "bb": bias.copy(), "Wo": some(2 * hidden, tags), "bo": np.zeros(tags, np.float32),
        "T": np.zeros((tags, tags), np.float32), "S": np.zeros(tags, np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, hidden) of inputs (time, batch, embedding)."""
    size = len(b) // 4
    into, back = w[: x.shape[2]], w[x.shape[2] :]
    given = x @ into + b
    h = c = np.zeros((x.shape[1], size), np.float32)
    out, kept = np.empty((*x.shape[:2], size), np.float32), []
    for t in range(len(x)):
        z = given[t] + h @ back
        gates = _sigmoid(z[:, : 3 * size])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        g = np.tanh(z[:, 3 * size :])
        before, c = c, f * c + i * g
        squashed = np.tanh(c)
        if keep:
            kept.append((i, f, o, g, before, squashed, h))
        h = o * squashed
        out[t] = h
    return out, kept


def _lstm_gradient(x: np.ndarray, w: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of inputs, weights and biases from those of the hidden states."""
    size = dout.shape[2]
    into, back = w[: x.shape[2]], w[x.shape[2] :]
    dz = np.empty((*x.shape[:2], 4 * size), np.float32)
    dh = dc = np.zeros(dout.shape[1:], np.float32)
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, before, squashed, _ = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - squashed**2)
        z = dz[t]
        z[:, :size] = dc * g * i * (1 - i)
        z[:, size : 2 * size] = dc * before * f * (1 - f)
        z[:, 2 * size : 3 * size] = dh * squashed * o * (1 - o)
        z[:, 3 * size :] = dc * i * (1 - g**2)
        dh, dc = z @ back.T, dc * f
    flat = dz.reshape(-1, 4 * size)
    hidden = np.stack([k[6] for k in kept]).reshape(-1, size)
    dw = np.concatenate([x.reshape(-1, x.shape[2]).T @ flat, hidden.T @ flat])
    return dz @ into.T, dw, flat.sum(0)


def _emissions(model: Model, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Scores (time, batch, tag) of windows (batch, time), and what the gradient needs."""
    inputs = model["E"][x.T]
    forth, kept_f = _lstm(inputs, model["Wf"], model["bf"], keep)
    back, kept_b = _lstm(inputs[::-1], model["Wb"], model["bb"], keep)
    both = np.concatenate([forth, back[::-1]], axis=2)
    return both @ model["Wo"] + model["bo"], (inputs, kept_f, kept_b, both)


def _chain(model: Model, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, expected transitions, log of the partition function) of the CRF over scores (time, batch, tag)."""
    steps = np.exp(model["T"].astype(np.float64))
    top = scores.max(axis=2, keepdims=True)
    local = np.exp((scores - top).astype(np.float64))
    ahead, scale = np.empty_like(local), np.empty(local.shape[:2])
    a = local[0] * np.exp(model["S"].astype(np.float64))
    for t in range(len(local)):
        if t:
            a = (a @ steps) * local[t]
        scale[t] = a.sum(axis=1)
        a = a / scale[t][:, None]
        ahead[t] = a
    behind = np.ones_like(local)
    for t in range(len(local) - 2, -1, -1):
        behind[t] = ((behind[t + 1] * local[t + 1]) @ steps.T) / scale[t + 1][:, None]
    marginals = ahead * behind
    later = local[1:] * behind[1:] / scale[1:][..., None]
    transitions = steps * np.einsum("tbi,tbj->ij", ahead[:-1], later)
    return marginals, transitions, np.log(scale).sum(0) + top[..., 0].sum(0)


def marginals(model: Model, x: np.ndarray) -> np.ndarray:
    """The probability of every tag (batch, time, tag) of windows of symbols (batch, time)."""
    scores, _ = _emissions(model, x)
    return _chain(model, scores)[0].transpose(1, 0, 2).astype(np.float32)


def loss_and_gradient(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, Model]:
    """Mean negative log-likelihood of the tags y (batch, time) of windows x, and its gradient."""
    scores, (inputs, kept_f, kept_b, both) = _emissions(model, x, True)
    expected, transitions, partition = _chain(model, scores)
    n, hidden = len(x), both.shape[2] // 2
    tags = y.T
    own = np.take_along_axis(scores, tags[..., None], 2)[..., 0].sum(0)
    own = own + model["T"][tags[:-1], tags[1:]].sum(0) + model["S"][tags[0]]
    given = np.eye(scores.shape[2])[tags]
    dscores = ((expected - given) / n).astype(np.float32)
    met = np.zeros_like(transitions)
    np.add.at(met, (tags[:-1], tags[1:]), 1)
    dboth = dscores @ model["Wo"].T
    dx_f, dw_f, db_f = _lstm_gradient(inputs, model["Wf"], kept_f, dboth[..., :hidden])
    dx_b, dw_b, db_b = _lstm_gradient(inputs[::-1], model["Wb"], kept_b, dboth[::-1][..., hidden:])
    de = np.zeros_like(model["E"])
    np.add.at(de, x.T, dx_f + dx_b[::-1])
    flat = dscores.reshape(-1, dscores.shape[2])
    gradient = {
        "E": de, "Wf": dw_f, "bf": db_f, "Wb": dw_b, "bb": db_b, "Wo": both.reshape(len(flat), -1).T @ flat, "bo": flat.sum(0),
        "T": ((transitions - met) / n).astype(np.float32), "S": dscores[0].sum(0),
    }
    return float((partition - own).mean()), gradient


def train(x: np.ndarray, y: np.ndarray, tags: int, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Model:
    """A model fitted to windows of symbols x and their tags y (both batch, time), by Adam."""
    model, rng = new_model(tags, seed=seed), np.random.default_rng(seed)
    mean, square, step = {k: 0.0 for k in model}, {k: 0.0 for k in model}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            _, gradient = loss_and_gradient(model, x[rows], y[rows])
            norm = np.sqrt(sum(float((g**2).sum()) for g in gradient.values()))
            step += 1
            pace = rate * (0.3 if epoch >= epochs - 2 else 1.0)
            for k, g in gradient.items():
                g = g * min(1.0, 5.0 / max(norm, 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g**2
                change = (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
                model[k] = (model[k] - pace * change).astype(np.float32)
    return model


def best_paths(chances: list[np.ndarray], allowed: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each sequence of tag probabilities (time, tag), the likeliest tags that follow each other as allowed."""
    if not chances:
        return []
    longest, tags = max(map(len, chances)), len(starts)
    logs = np.zeros((longest, len(chances), tags), np.float32)
    for i, c in enumerate(chances):
        logs[: len(c), i] = np.log(np.maximum(c, 1e-9))
    steps = np.where(allowed, 0.0, -1e9).astype(np.float32)
    best = logs[0] + np.where(starts, 0.0, -1e9).astype(np.float32)
    came = np.zeros((longest, len(chances), tags), np.int8)
    ends = np.array([len(c) - 1 for c in chances])
    last = np.zeros((len(chances), tags), np.float32)
    last[ends == 0] = best[ends == 0]
    for t in range(1, longest):
        through = best[:, :, None] + steps
        came[t] = through.argmax(1)
        best = through.max(1) + logs[t]
        last[ends == t] = best[ends == t]
    paths = []
    for i, end in enumerate(ends.tolist()):
        path = np.empty(end + 1, np.int64)
        path[end] = last[i].argmax()
        for t in range(end, 0, -1):
            path[t - 1] = came[t, i, path[t]]
        paths.append(path)
    return paths
