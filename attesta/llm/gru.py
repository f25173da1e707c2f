"""A small gated recurrent network over word classes, in numpy: forward pass, truncated backpropagation and scoring.

The network reads the class of the previous token and predicts the class of the next. State is carried from window to
window of a text, so a text of any length is scored whole; only gradients stop at window ends.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 16
WINDOW = 32
GROUP, SPAN = 128, 16  # texts and steps that are scored at once
LOT = 512  # tokens whose classes are worked on at once


def shapes(classes: int) -> list[tuple[str, tuple[int, ...]]]:
    return [("inputs", (classes, 3 * HIDDEN)), ("recur", (HIDDEN, 3 * HIDDEN)), ("bias", (3 * HIDDEN,)), ("out", (HIDDEN, classes)), ("out_bias", (classes,))]


def start(class_counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """Fresh weights as one vector; the output begins at the class frequencies of the corpus."""
    random = np.random.default_rng(seed)
    parts = []
    for name, shape in shapes(len(class_counts)):
        if name == "out_bias":
            parts.append(np.log((class_counts + 1) / (class_counts.sum() + len(class_counts))))
        else:
            parts.append(np.zeros(shape) if name == "bias" else random.normal(0, 0.3 if name == "recur" else 0.1, shape))
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def unpack(vector: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(classes):
        size = int(np.prod(shape))
        out[name] = vector[at: at + size].reshape(shape)
        at += size
    return out


def _steps(w: dict[str, np.ndarray], inputs: np.ndarray, state: np.ndarray, keep: bool = False):
    """Runs a window (steps x texts of classes) from the state (units x texts): all states, the last one and, if asked, the
    gates z and r, the news and what the past brings to them.

    Texts are the last axis of every array, so that gates are whole rows and a step's numbers lie one after the other.
    What does not depend on the state is looked up for the whole window at once; a step only adds what the state brings.
    """
    # signs and factors of sigmoid(x) = 1 / (1 + exp(-x)) and tanh(x) = 2 / (1 + exp(-2x)) - 1 go into the weights
    factor = np.repeat(np.array([-1, -1, -2], w["recur"].dtype), HIDDEN)
    given = np.ascontiguousarray(((w["inputs"] + w["bias"]) * factor)[inputs].transpose(0, 2, 1))
    recur = np.ascontiguousarray((w["recur"] * factor).T)
    shape, kind = (len(inputs), *state.shape), given.dtype
    states = np.empty(shape, kind)
    news, pasts = (np.empty(shape if keep else (1, *state.shape), kind) for _ in range(2))
    if not keep:
        news, pasts = (np.broadcast_to(x, shape) for x in (news, pasts))
        news.flags.writeable = pasts.flags.writeable = True  # one place for all steps
    past = np.empty((3 * HIDDEN, state.shape[1]), kind)
    past_gates, past_new = past[: 2 * HIDDEN], past[2 * HIDDEN:]
    ones = np.ones_like(past_gates)  # arrays are added faster than single numbers
    one = ones[:HIDDEN]
    two = one + one
    h = np.ascontiguousarray(state, kind)
    with np.errstate(over="ignore"):  # an infinite power gives the right limit
        for gate, z, r, more, new, kept, now in zip(given[:, : 2 * HIDDEN], given[:, :HIDDEN], given[:, HIDDEN: 2 * HIDDEN], given[:, 2 * HIDDEN:], news, pasts, states):
            np.dot(recur, h, out=past)
            np.add(gate, past_gates, out=gate)
            np.exp(gate, out=gate)
            np.add(gate, ones, out=gate)
            np.reciprocal(gate, out=gate)
            if keep:
                kept[:] = past_new
            np.multiply(r, past_new, out=new)
            np.add(new, more, out=new)
            np.exp(new, out=new)
            np.add(new, one, out=new)
            np.divide(two, new, out=new)
            np.subtract(new, one, out=new)
            np.subtract(h, new, out=now)
            np.multiply(now, z, out=now)
            np.add(now, new, out=now)
            h = now
    return states, h, (given[:, :HIDDEN], given[:, HIDDEN: 2 * HIDDEN], news, pasts)


def forward(w: dict[str, np.ndarray], inputs: np.ndarray, state: np.ndarray):
    """Runs a window (steps x texts of classes); all states and the last one, units last, and what ``_steps`` made on the way."""
    states, last, made = _steps(w, inputs, state.T)
    return states.transpose(0, 2, 1), last.T, made


def _flat(x: np.ndarray) -> np.ndarray:
    """(steps, rows, texts) -> (rows, steps * texts)."""
    return x.transpose(1, 0, 2).reshape(x.shape[1], -1)


def log_softmax(w: dict[str, np.ndarray], states: np.ndarray) -> np.ndarray:
    logits = states.reshape(-1, HIDDEN) @ w["out"] + w["out_bias"]
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def gradient(w: dict[str, np.ndarray], inputs: np.ndarray, wanted: np.ndarray, real: np.ndarray, state: np.ndarray):
    """(gradient vector, last state, log likelihood) of one window; ``real`` marks steps inside their text.

    What goes by classes is done for some steps at a time, so that it stays in the processor's nearest memory.
    """
    steps, texts = inputs.shape
    start = state.T
    states, last, (z, r, news, pasts) = _steps(w, inputs, start, keep=True)
    kind, classes = states.dtype, len(w["out_bias"])
    lot = max(1, LOT // texts)
    out, bias = np.ascontiguousarray(w["out"].T), w["out_bias"][:, None]
    share = real.astype(kind)
    share /= max(share.sum(), 1)
    d_states, d_out, d_bias, found = np.empty_like(states), np.zeros((classes, HIDDEN), kind), np.zeros(classes, kind), 0.0
    for t in range(0, steps, lot):
        own = slice(t, t + lot)
        h, wants, part = _flat(states[own]), wanted[own].ravel(), share[own].ravel()
        place = wants, np.arange(len(wants))
        logits = out @ h
        logits += bias
        logits -= logits.max(axis=0)
        hit = logits[place]
        d_logits = np.exp(logits, out=logits)
        total = d_logits.sum(axis=0)
        d_logits *= part / total
        d_logits[place] -= part
        found += float((hit - np.log(total)) @ (part > 0))
        d_out += d_logits @ h.T
        d_bias += d_logits.sum(axis=1)
        d_states[own] = (w["out"] @ d_logits).reshape(HIDDEN, -1, texts).transpose(1, 0, 2)
    # all that a step's gradients are multiplied by, for the whole window at once
    before = np.concatenate([start[None].astype(kind), states[:-1]])
    by_new, by_r = 1 - z, 1 - r
    by_z = before - news
    by_z *= z
    by_z *= by_new
    news *= news
    np.subtract(1, news, out=news)
    by_new *= news
    by_r *= r
    by_r *= pasts
    by_r *= -0.5
    # by rows: what the new gate takes from the past, z, r, and the new gate, so that both uses have their rows together
    d = np.empty((steps, 4 * HIDDEN, texts), kind)
    past, d_z, d_r, d_new = d[:, :HIDDEN], d[:, HIDDEN: 2 * HIDDEN], d[:, 2 * HIDDEN: 3 * HIDDEN], d[:, 3 * HIDDEN:]
    turn = np.roll(np.arange(3 * HIDDEN), HIDDEN)
    recur, d_h, step = np.ascontiguousarray(w["recur"][:, turn]), np.zeros((HIDDEN, texts), kind), np.empty((HIDDEN, texts), kind)
    for grown, all_past, to_past, to_z, to_r, to_new, own_z, own_r, of_z, of_r, of_new in zip(
            *(x[::-1] for x in (d_states, d[:, : 3 * HIDDEN], past, d_z, d_r, d_new, z, r, by_z, by_r, by_new))):
        np.add(d_h, grown, out=d_h)
        np.multiply(d_h, of_z, out=to_z)
        np.multiply(d_h, of_new, out=to_new)
        np.multiply(to_new, of_r, out=to_r)
        np.multiply(to_new, own_r, out=to_past)
        np.multiply(d_h, own_z, out=d_h)
        np.dot(recur, all_past, out=step)
        np.add(d_h, step, out=d_h)
    d_recur, d_inputs = np.zeros((HIDDEN, 3 * HIDDEN), kind), np.zeros((len(w["inputs"]), 3 * HIDDEN), kind)
    for t in range(0, steps, lot):
        own = slice(t, t + lot)
        rows, given = _flat(d[own]), inputs[own].ravel()
        seen = np.zeros((len(given), len(d_inputs)), kind)
        seen[np.arange(len(given)), given] = 1
        d_recur += _flat(before[own]) @ rows[: 3 * HIDDEN].T
        d_inputs += (rows[HIDDEN:] @ seen).T
    parts = [d_inputs, np.roll(d_recur, -HIDDEN, axis=1), d_inputs.sum(axis=0), d_out.T, d_bias]
    return np.concatenate([p.ravel() for p in parts]), last.T, found


def _windows(texts: list[np.ndarray], width: int):
    """Windows of a group of class sequences, longest first: (previous classes, wanted classes, real, texts still running)."""
    longest = len(texts[0])
    lengths = np.array([len(t) for t in texts])
    data = np.concatenate(texts)
    start = np.cumsum(lengths) - lengths
    for first in range(0, longest, width):
        alive = int(np.searchsorted(-lengths, -first, side="left"))  # lengths fall, so these are the leading texts
        step = first + np.arange(min(width, longest - first))[:, None]
        inside, at = step < lengths[:alive], start[:alive] + np.minimum(step, lengths[:alive] - 1)
        wanted = np.where(inside, data[at], np.uint8(0))
        # class 0 is the end of a text and stands before its first word
        before = np.where(inside & (step > 0), data[np.maximum(at - 1, 0)], np.uint8(0))
        yield before, wanted, inside, alive


def train(vector: np.ndarray, classes: int, texts: list[np.ndarray], group: int = 64, rate: float = 0.01) -> tuple[np.ndarray, int]:
    """One pass of truncated backpropagation (Adam) over the texts; returns the new weights and the tokens read."""
    vector, first, second, count, tokens = vector.copy(), np.zeros_like(vector), np.zeros_like(vector), 0, 0
    w = unpack(vector, classes)
    texts = sorted((t for t in texts if len(t)), key=len, reverse=True)
    order = np.random.default_rng(len(texts)).permutation((len(texts) + group - 1) // group)
    for g in order.tolist():
        own = texts[g * group: (g + 1) * group]
        state = np.zeros((len(own), HIDDEN), np.float32)
        for before, wanted, real, alive in _windows(own, WINDOW):
            grad, state, _ = gradient(w, before, wanted, real, state[:alive])
            norm = float(np.sqrt(grad @ grad))
            grad = grad * min(1.0, 1.0 / (norm + 1e-9))
            count += 1
            first += 0.1 * (grad - first)
            second += 0.001 * (grad * grad - second)
            vector -= (rate * (first / (1 - 0.9**count)) / (np.sqrt(second / (1 - 0.999**count)) + 1e-8)).astype(np.float32)
            tokens += int(real.sum())
    return vector, tokens


def score(vector: np.ndarray, classes: int, texts: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each whole class sequence."""
    w = unpack(vector, classes)
    into, bias = np.ascontiguousarray(w["out"].T), w["out_bias"][:, None]
    out = np.zeros(len(texts))
    order = np.argsort([-len(t) for t in texts], kind="stable")
    order = [i for i in order.tolist() if len(texts[i])]
    for g in range(0, len(order), GROUP):
        names = np.array(order[g: g + GROUP])
        own = [texts[i] for i in names]
        state = np.zeros((HIDDEN, len(own)), np.float32)
        for before, wanted, real, alive in _windows(own, SPAN):
            states, state, _ = _steps(w, before, state[:, :alive])
            lot = max(1, LOT // alive)
            for t in range(0, len(states), lot):
                wants = wanted[t: t + lot].ravel()
                logits = into @ _flat(states[t: t + lot])
                logits += bias
                logp = logits[wants, np.arange(len(wants))]
                np.exp(logits, out=logits)
                logp -= np.log(logits.sum(axis=0))
                out[names[:alive]] += np.where(real[t: t + lot], logp.reshape(-1, alive), 0).sum(axis=0, dtype=np.float64)
    return out / np.log(10)
