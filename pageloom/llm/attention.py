"""A small causal self-attention model over subword ids, in numpy.

Ids go through a table to model symbols: 0 the end, 1.. the most frequent ids, REST for all others, PAD before a text. A text
is read in blocks of BLOCK symbols; a block's queries see the CONTEXT = BLOCK symbols before each of them, in one batch of
windows of two blocks under a band mask, and each symbol is predicted once. The hidden layer's activation is the square of the
positive part, which has no kink. The output is a softmax over classes and one
within the class; an id outside the table costs the class REST times its add-one share of all ids outside the table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

BLOCK = 16
CLASSES, PER_CLASS = 32, 32
MEMBERS = CLASSES * PER_CLASS
REST, PAD = MEMBERS, MEMBERS + 1
WIDTH, KEY, HIDDEN = 32, 16, 64
BATCH = 512
GROUP = 16  # symbols whose rows are summed in one product
CEILING = 80.0  # of an exponent in single precision


@dataclass
class Vocabulary:
    symbols: np.ndarray  # model symbol by id
    rest: np.ndarray  # ln of an outside id's share among the outside ids

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Vocabulary:
        """counts: of each id over the training texts."""
        order = np.argsort(-counts, kind="stable")[: MEMBERS - 1]
        symbols = np.full(len(counts), REST, np.int32)
        symbols[order] = np.arange(1, len(order) + 1)
        rest = np.where(symbols == REST, counts + 1.0, 0.0)
        return cls(symbols, np.log(np.maximum(rest, 1e-300) / max(rest.sum(), 1e-300)))


def blocks_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in blocks, each text after a block of PAD and the end symbol: (blocks, BLOCK); which blocks are queried; and
    the targets and their text numbers, flat over the queried blocks, -1 beyond a text's end."""
    lengths = np.array([len(t) + 1 for t in texts])
    n = -(-lengths // BLOCK)
    first = np.cumsum(n + 1) - (n + 1)
    inputs = np.full((int((n + 1).sum()), BLOCK), PAD, np.int32)
    queried = np.ones(len(inputs), bool)
    queried[first] = False
    targets = np.full((len(inputs), BLOCK), -1, np.int32)
    flat_in, flat_out = inputs.reshape(-1), targets.reshape(-1)
    for t, f, m in zip(texts, first.tolist(), lengths.tolist(), strict=True):
        at = (f + 1) * BLOCK
        flat_in[at] = 0
        flat_in[at + 1 : at + m] = t
        flat_out[at : at + m - 1] = t
        flat_out[at + m - 1] = 0
    owner = np.repeat(np.repeat(np.arange(len(texts)), n), BLOCK)
    return inputs, queried, targets[queried].reshape(-1), owner


def _band() -> np.ndarray:
    """How far back each of a window's 2 BLOCK symbols is from each query; out of the band: -1."""
    back = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
    return np.where((back >= 0) & (back < BLOCK), back, -1)


BAND = _band()


def _bigram_start(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input and output vectors whose products start near the log ratios of following to chance."""
    total = pairs.sum()
    chance = pairs.sum(1, keepdims=True) * pairs.sum(0, keepdims=True) / max(total, 1)
    ratio = np.log((pairs + 0.5) / (chance + 0.5)).clip(-4, 4).astype(np.float32)
    left, size, right = np.linalg.svd(ratio, full_matrices=False)
    scale = np.sqrt(size[:WIDTH])
    return left[:, :WIDTH] * scale, right[:WIDTH].T * scale


def pair_counts(inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """How often each target follows each input, flat by (input, target)."""
    known = targets >= 0
    return np.bincount(inputs[known].astype(np.int64) * (REST + 1) + targets[known], minlength=(PAD + 1) * (REST + 1))


def start(inputs: np.ndarray, targets: np.ndarray, seed: int = 0) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Parameters before training, and the member symbols by (class, place)."""
    return start_of(pair_counts(inputs, targets), seed)


def start_of(flat: np.ndarray, seed: int = 0) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """As start, from pair_counts of any number of texts."""
    rng = np.random.default_rng(seed)
    pairs = flat.reshape(PAD + 1, REST + 1).astype(np.float64)
    counts = pairs.sum(0)
    into, out = _bigram_start(pairs)
    groups = [np.arange(MEMBERS)]
    while len(groups) < CLASSES:  # halve by the main direction of the output vectors
        halves = []
        for g in groups:
            centred = out[g] - out[g].mean(0)
            axis = np.linalg.svd(centred, full_matrices=False)[2][0]
            order = g[np.argsort(centred @ axis, kind="stable")]
            halves += [order[: len(g) // 2], order[len(g) // 2 :]]
        groups = halves
    members = np.stack(groups)
    share = counts[members] + 0.5
    per_class = share.sum(1)
    f = np.float32
    p = {
        "E": into.astype(f),
        "Wq": rng.normal(0, 0.1, (WIDTH, KEY)).astype(f),
        "Wk": rng.normal(0, 0.1, (WIDTH, KEY)).astype(f),
        "back": np.zeros(BLOCK, f),
        "W1": rng.normal(0, (2 * WIDTH) ** -0.5, (2 * WIDTH, HIDDEN)).astype(f),
        "b1": np.zeros(HIDDEN, f),
        "W2": np.zeros((HIDDEN, WIDTH), f),
        "A": np.concatenate([(out[members] * share[..., None]).sum(1) / per_class[:, None], out[REST][None]]).T.astype(f),
        "a": np.log(np.concatenate([per_class, [counts[REST] + 0.5]]) / (counts.sum() + 1)).astype(f),
        "U": out[members].astype(f),
        "u": np.log(share / per_class[:, None]).astype(f),
    }
    return p, members


def places(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and place of each symbol; REST is the class after the others."""
    cls, place = np.full(PAD + 1, CLASSES, np.int32), np.zeros(PAD + 1, np.int32)
    cls[members] = np.arange(CLASSES)[:, None]
    place[members] = np.arange(PER_CLASS)[None, :]
    return cls, place


def _class_order(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(classes.astype(np.int16), kind="stable")
    return order, np.searchsorted(classes[order], np.arange(CLASSES + 1))


def ready(p: dict) -> dict:
    """Parameters as scoring uses them: scale folded in, the two halves of a window and of the first layer apart."""
    bias = np.where(BAND >= 0, p["back"][np.maximum(BAND, 0)], np.float32(-80)).astype(np.float32)
    return {
        "E": p["E"],
        "EK": p["E"] @ p["Wk"],  # an id's key does not depend on its place
        "EQ": p["E"] @ (p["Wq"] * np.float32(KEY**-0.5)),
        "before": np.ascontiguousarray(bias[:, :BLOCK]),
        "here": np.ascontiguousarray(bias[:, BLOCK:]),
        "EX": p["E"] @ p["W1"][:WIDTH] + p["b1"],
        "Z1": np.ascontiguousarray(p["W1"][WIDTH:]),
        "W2": p["W2"],
        "A": p["A"],
        "a": p["a"],
        "Ut": np.ascontiguousarray(p["U"].transpose(0, 2, 1)),
        "u": p["u"],
    }


def _states(p: dict, inputs: np.ndarray, queried: np.ndarray, clip: bool = False) -> np.ndarray:
    """What forward calls h, with what depends on the id alone looked up."""
    at = np.flatnonzero(queried)
    here, before = inputs[at], inputs[at - 1]
    q = p["EQ"][here]
    x = p["E"][here]
    total = z = None
    for ids, values, bias in ((before, p["E"][before], p["before"]), (here, x, p["here"])):
        s = q @ p["EK"][ids].transpose(0, 2, 1)
        s += bias
        if clip:
            np.minimum(s, CEILING, out=s)
        np.exp(s, out=s)
        part = s.reshape(-1, BLOCK) @ np.ones(BLOCK, np.float32)
        total = part if total is None else total + part
        z = s @ values if z is None else z + s @ values
    z = z.reshape(-1, WIDTH)
    z /= total[:, None]
    r = z @ p["Z1"]
    r += p["EX"][here].reshape(-1, HIDDEN)
    np.maximum(r, 0, out=r)
    np.square(r, out=r)
    h = r @ p["W2"]
    h += x.reshape(-1, WIDTH)
    return h


def log_likelihood(p: dict, where: tuple[np.ndarray, np.ndarray], inputs: np.ndarray, queried: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """ln of each target's probability, p as from ready; 0 for targets of -1. REST targets get their class's only.

    Exponents are hardly ever out of range; if some sum overflows, all is done once more with a ceiling."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        out = _log_likelihood(p, where, inputs, queried, targets, False)
    return out if np.isfinite(out).all() else _log_likelihood(p, where, inputs, queried, targets, True)


def _log_likelihood(p: dict, where: tuple, inputs: np.ndarray, queried: np.ndarray, targets: np.ndarray, clip: bool) -> np.ndarray:
    h = _states(p, inputs, queried, clip)
    out = np.zeros(len(targets), np.float32)
    live = np.flatnonzero(targets >= 0)
    t = targets[live]
    cls, place = where[0][t], where[1][t]
    order, cuts = _class_order(cls)
    h = h[live[order]]  # by class, so that each class is a slice
    logits = h @ p["A"]
    logits += p["a"]
    made = np.take_along_axis(logits, cls[order][:, None], 1)[:, 0]
    if clip:
        np.minimum(logits, CEILING, out=logits)
    np.exp(logits, out=logits)
    norm = logits @ np.ones(CLASSES + 1, np.float32)
    place, inner = place[order], np.empty((int(cuts[CLASSES]), PER_CLASS), np.float32)
    for c in range(CLASSES):
        if cuts[c + 1] > cuts[c]:
            part = inner[cuts[c] : cuts[c + 1]]
            np.matmul(h[cuts[c] : cuts[c + 1]], p["Ut"][c], out=part)
            part += p["u"][c]
    n = len(inner)
    made[:n] += np.take_along_axis(inner, place[:n, None], 1)[:, 0]
    if clip:
        np.minimum(inner, CEILING, out=inner)
    np.exp(inner, out=inner)
    made -= np.log(norm)
    made[:n] -= np.log(inner @ np.ones(PER_CLASS, np.float32))
    out[live[order]] = made
    return out


def _by_symbol(symbols: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """For each of values, the sum of its rows by symbol. Rows are sorted by symbol and summed GROUP symbols at a time, by a product
    with the rows' places in their group."""
    order = np.argsort(symbols.astype(np.int16), kind="stable")  # short numbers are sorted by their digits
    seen = symbols[order]
    groups = PAD // GROUP + 1
    cuts = np.searchsorted(seen, np.arange(groups + 1) * GROUP)
    sums = []
    place = np.zeros((len(seen), GROUP), values[0].dtype)
    place[np.arange(len(seen)), seen % GROUP] = 1
    for x in values:
        total, rows = np.zeros((groups, GROUP, x.shape[1]), x.dtype), x.take(order, 0)
        for i in range(groups):
            if cuts[i + 1] > cuts[i]:
                np.matmul(place[cuts[i] : cuts[i + 1]].T, rows[cuts[i] : cuts[i + 1]], out=total[i])
        sums.append(total.reshape(groups * GROUP, -1)[: PAD + 1])
    return sums


def _softmax(x: np.ndarray, chosen: np.ndarray) -> float:
    """Turns the rows of x into their softmax less one at the chosen place; returns the loss. A row's greatest value, which is slow
    to find, is only subtracted if some exponent could leave the range."""
    if x.size and max(x.max(), -x.min()) > CEILING:
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    at = np.arange(len(x)), chosen
    loss = -np.log(x[at] + 1e-30).sum(dtype=np.float64)
    x[at] -= 1
    return loss


def gradients(p: dict, where: tuple[np.ndarray, np.ndarray], inputs: np.ndarray, queried: np.ndarray, targets: np.ndarray) -> tuple[float, dict]:
    """Mean loss per target and its gradients.

    What depends on a symbol alone is looked up, as in scoring. Weights out of the band are 0: tiny ones would make the products
    that follow subnormal, which is slow."""
    f, E = p["E"].dtype, p["E"]
    at = np.flatnonzero(queried)
    seen = np.concatenate([inputs[at - 1], inputs[at]], axis=1)
    here = np.ascontiguousarray(seen[:, BLOCK:]).ravel()
    Wq, X1, Z1 = p["Wq"] * f.type(KEY**-0.5), p["W1"][:WIDTH], np.ascontiguousarray(p["W1"][WIDTH:])

    x, xw, kw = E.take(here, 0), E.take(seen, 0), (E @ p["Wk"]).take(seen, 0)
    q = (E @ Wq).take(here, 0).reshape(-1, BLOCK, KEY)
    s = q @ kw.transpose(0, 2, 1)
    s += p["back"][np.maximum(BAND, 0)]
    np.clip(s, -CEILING, CEILING, out=s)
    np.exp(s, out=s)
    s *= (BAND >= 0).astype(f)
    s /= (s.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, f)).reshape(-1, BLOCK, 1)
    z = (s @ xw).reshape(-1, WIDTH)
    r = z @ Z1
    r += (E @ X1 + p["b1"]).take(here, 0)
    np.maximum(r, 0, out=r)
    squares = np.square(r)
    h = squares @ p["W2"]
    h += x

    live = np.flatnonzero(targets >= 0)
    t = targets[live]
    order, cuts = _class_order(where[0][t])
    live, t = live[order], t[order]  # by class, so that each class is a slice
    h = h.take(live, 0)
    soft = h @ p["A"]
    soft += p["a"]
    loss = _softmax(soft, where[0][t])
    inner = np.empty((int(cuts[CLASSES]), PER_CLASS), f)
    for c, (a, b) in enumerate(itertools.pairwise(cuts.tolist())):
        if b > a:
            np.matmul(h[a:b], p["U"][c].T, out=inner[a:b])
            inner[a:b] += p["u"][c]
    if len(inner):
        loss += _softmax(inner, where[1][t[: len(inner)]])
    ones = np.ones(len(targets), f)
    g = {"A": h.T @ soft, "a": ones[: len(t)] @ soft, "U": np.zeros_like(p["U"]), "u": np.zeros_like(p["u"])}
    dh = soft @ p["A"].T
    for c, (a, b) in enumerate(itertools.pairwise(cuts.tolist())):
        if b > a:
            np.matmul(inner[a:b].T, h[a:b], out=g["U"][c])
            np.matmul(ones[: b - a], inner[a:b], out=g["u"][c])
            dh[a:b] += inner[a:b] @ p["U"][c]

    whole = np.zeros((len(targets), WIDTH), f)
    whole[live] = dh
    g["W2"] = squares.T @ whole
    dr = whole @ (2 * p["W2"]).T
    dr *= r
    g["W1"], g["b1"] = np.concatenate([x.T @ dr, z.T @ dr]), ones @ dr
    dz = dr @ Z1.T
    whole += dr @ X1.T
    ds = dz.reshape(-1, BLOCK, WIDTH) @ xw.transpose(0, 2, 1)
    ds -= ((dz * z) @ np.ones(WIDTH, f)).reshape(-1, BLOCK, 1)
    ds *= s
    g["back"] = np.bincount(np.maximum(BAND, 0).ravel(), ones[: len(ds)] @ ds.reshape(len(ds), -1), minlength=BLOCK).astype(f)
    dq = (ds @ kw).reshape(-1, KEY)
    g["Wq"] = (x.T @ dq) * f.type(KEY**-0.5)
    whole += dq @ Wq.T
    dxw = s.transpose(0, 2, 1) @ dz.reshape(-1, BLOCK, WIDTH)
    dxw[:, BLOCK:] += whole.reshape(-1, BLOCK, WIDTH)
    dkw = ds.transpose(0, 2, 1) @ q
    g["E"], dk = _by_symbol(seen.ravel(), dxw.reshape(-1, WIDTH), dkw.reshape(-1, KEY))
    g["E"] += dk @ p["Wk"].T
    g["Wk"] = E.T @ dk
    n = max(len(t), 1)
    for each in g.values():
        each /= n
    return float(loss) / n, g


def train(texts: list[np.ndarray], steps: int = 200, batch: int = BATCH, rate: float = 2e-2, seed: int = 0) -> tuple[dict, tuple[np.ndarray, np.ndarray]]:
    """Adam over batches of blocks of the texts' symbols."""
    inputs, queried, targets, _ = blocks_of(texts)
    p, members = start(inputs[queried].reshape(-1), targets, seed)
    where, state = places(members), begin(p)
    advance(state, where, pairs_of(inputs, queried), targets.reshape(-1, BLOCK), range(1, steps + 1), steps, np.random.default_rng(seed), batch, rate)
    return state["p"], where


def pairs_of(inputs: np.ndarray, queried: np.ndarray) -> np.ndarray:
    """Each queried block after the block before it: (queried, 2, BLOCK)."""
    at = np.flatnonzero(queried)
    return np.stack([inputs[at - 1], inputs[at]], axis=1)


def begin(p: dict) -> dict[str, dict]:
    """Parameters p with Adam's two moments."""
    return {"p": p, "m": {n: np.zeros_like(x) for n, x in p.items()}, "v": {n: np.zeros_like(x) for n, x in p.items()}}


def flat_of(state: dict[str, dict]) -> np.ndarray:
    return np.concatenate([x.ravel() for part in state.values() for x in part.values()]).astype(np.float32)


def of_flat(flat: np.ndarray, like: dict[str, dict]) -> dict[str, dict]:
    out, at = {}, 0
    for part, each in like.items():
        out[part] = {}
        for n, x in each.items():
            out[part][n] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
    return out


def batches(n: int, batch: int, rng: np.random.Generator, skip: int = 0) -> Iterator[np.ndarray]:
    """Batches of n blocks without end: all blocks in one order, then all in another. The first skip batches are left out."""
    order = np.zeros(0, np.int64)
    for i in itertools.count():
        while len(order) < min(batch, n):
            order = np.concatenate([order, rng.permutation(n)])
        if i >= skip:
            yield order[:batch]
        order = order[batch:]


def advance(state: dict, where: tuple, pairs: np.ndarray, by_block: np.ndarray, those: Iterable[float], steps: int, rng: np.random.Generator, batch: int = BATCH, rate: float = 2e-2, skip: int = 0) -> None:
    """Those of all steps of Adam, in place, over batches of the blocks that take every block in turn."""
    p, m, v = state["p"], state["m"], state["v"]
    for step, chosen in zip(those, batches(len(pairs), batch, rng, skip)):  # noqa: B905 - the batches have no end
        _, g = gradients(p, where, pairs[chosen].reshape(-1, BLOCK), np.tile([False, True], len(chosen)), by_block[chosen].reshape(-1))
        now = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for n in p:
            m[n] = 0.9 * m[n] + 0.1 * g[n]
            v[n] = 0.99 * v[n] + 0.01 * g[n] * g[n]
            p[n] = (p[n] - now * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
