"""A causal self-attention language model in numpy: the network, its training step and its scoring.

A token is a slot: 0 for the end of a text (also what stands before its beginning), 1 for every id without a slot of
its own, and one for each of the most frequent ids. Slots lie in classes of ``WIDTH``; the output is a softmax over the
classes and one over the slots of the class, so that it adds up to 1 over all slots.

Texts are scored in windows of ``2 * stride`` tokens that overlap by half: each token is scored once, in the window
where it lies in the second half and so has at least ``stride`` tokens before it. As there is one layer and positions
count by their distance alone, queries, keys and values are looked up by slot.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .graph import Graph

END, RARE, WIDTH = 0, 1, 32
#: Hidden units are cut off here, so that the outputs are bounded; the last one is always 1 and carries the biases.
MOST = 6
F32 = np.float32


@dataclass(frozen=True)
class Shape:
    """Of the network: ``slots`` is a multiple of WIDTH."""

    slots: int = 1024
    dim: int = 16
    heads: int = 1
    hidden: int = 32
    stride: int = 16

    @property
    def window(self) -> int:
        return 2 * self.stride

    @property
    def classes(self) -> int:
        return self.slots // WIDTH

    @property
    def logits(self) -> int:
        """Of a softmax: as many as classes or as slots of a class, whichever are more."""
        return max(self.classes, WIDTH)


def initial(counts: np.ndarray, s: Shape, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters whose output is the frequency of the slots; ``counts``: of each slot in the training texts."""
    rng = np.random.default_rng(seed)
    normal = lambda *n, by: rng.normal(0, by, n).astype(F32)
    p = (counts + 0.5).reshape(s.classes, WIDTH)
    out = {
        "emb": normal(s.slots, s.dim, by=0.3),
        "q": normal(s.dim, s.dim, by=s.dim**-0.5),
        "k": normal(s.dim, s.dim, by=s.dim**-0.5),
        "v": normal(s.dim, s.dim, by=s.dim**-0.5),
        "dist": np.zeros((s.heads, s.window), F32),
        "own": normal(s.dim, s.hidden, by=s.dim**-0.5),
        "seen": normal(s.dim, s.hidden, by=s.dim**-0.5),
        "bias": np.zeros(s.hidden, F32),
        "cls": normal(s.hidden, s.classes, by=0.02),
        "tok": normal(s.classes, s.hidden, WIDTH, by=0.02),
    }
    out["cls"][-1] = np.log(p.sum(1) / p.sum())
    out["tok"][:, -1] = np.log(p / p.sum(1, keepdims=True))
    return out


def pack(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in sorted(p))


def unpack(data: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, "<f4"), {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = flat[at : at + n].reshape(like[k].shape).copy()
        at += n
    return out


def _bounded(q: np.ndarray, k: np.ndarray, dist: np.ndarray, heads: int) -> bool:
    """Whether no attention weight's exponential can overflow, so that the largest need not be taken away first."""
    norm = lambda x: float(np.square(x).reshape(len(x), heads, -1).sum(2).max()) ** 0.5
    return norm(q) * norm(k) + float(np.abs(dist).max()) < 80


def _heads(g: Graph, x: str, s: Shape) -> str:
    """windows x positions x dim to windows x heads x positions x their share of dim, or x itself where one head has all."""
    if s.heads == 1:
        return x
    return g("Transpose", g("Reshape", x, g.constant(np.array([0, 0, s.heads, -1]))), perm=[0, 2, 1, 3])


def _joined(g: Graph, x: str, s: Shape) -> str:
    """Back from ``_heads``, to positions x dim."""
    x = x if s.heads == 1 else g("Transpose", x, perm=[0, 2, 1, 3])
    return g("Reshape", x, g.constant(np.array([-1, s.dim])))


def _hidden(g: Graph, s: Shape, x: str, before: str) -> dict[str, str]:
    """Attention and hidden units; x: the slots of the positions, before: those that they may look at, of which ``dist``
    has the weights by place. What depends on a slot alone is looked up."""
    rank = 3 if s.heads == 1 else 4
    q, k, v = (_heads(g, g("Gather", g.array(n, 2), at, axis=0), s) for n, at in (("q", x), ("k", before), ("v", before)))
    att = g("Softmax", g("Add", g.product(q, k, 0, 1, rank), g.array("dist", 3)), axis=-1)
    z = g.product(att, v, 0, 0, rank)
    joined, seen = _joined(g, z, s), g.array("seen", 2)
    own = g("Reshape", g("Gather", g.array("own", 2), x, axis=0), g.constant(np.array([-1, s.hidden])))
    pre = g("Add", g.product(joined, seen), own)
    u = g("Clip", pre, g.constant(np.array(0, g.kind)), g.constant(np.array(MOST, g.kind)))
    return {"q": q, "k": k, "v": v, "att": att, "z": z, "joined": joined, "seen": seen, "pre": pre, "u": u}


def _logits(g: Graph, s: Shape, u: str) -> tuple[str, list[str], list[str], str]:
    """Two rows of logits for each position in the order of ``order``, which is by class: over the classes and over the
    class's slots; the positions and the weights of each class, and how many positions each has."""
    sizes = g.array("sizes", 1, "int64")
    parts = g("Split", g("Gather", u, g.array("order", 1, "int32"), axis=0), sizes, axis=0, results=s.classes)
    weights = g("Split", g.array("out", 2), axis=0, results=s.classes)  # a class's are hidden x 2 logits
    logits = g("Concat", *map(g.product, parts, weights), axis=0)
    return g("Reshape", logits, g.constant(np.array([-1, s.logits]))), parts, weights, sizes


def _by_slot(p: dict[str, np.ndarray], s: Shape) -> dict[str, np.ndarray]:
    """Queries, keys, values and own shares of hidden units of each slot, and weights, as graphs take them. The last hidden
    unit is 1, whatever its weights; logits that stand for nothing have no share."""
    own, seen, bias = p["own"].copy(), p["seen"].copy(), p["bias"].copy()
    own[:, -1], seen[:, -1], bias[-1] = 0, 0, 1
    scale = p["emb"].dtype.type((s.dim // s.heads) ** -0.5)
    out = np.zeros((s.classes, s.hidden, 2 * s.logits), p["emb"].dtype)
    out[:, -1] = -1e9
    out[..., : s.classes], out[..., s.logits : s.logits + WIDTH] = p["cls"], p["tok"]
    return {"q": p["emb"] @ (p["q"] * scale), "k": p["emb"] @ p["k"], "v": p["emb"] @ p["v"], "own": p["emb"] @ own + bias, "seen": seen, "out": out.reshape(-1, 2 * s.logits)}


def _ordered(target: np.ndarray, s: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by class of those targets that aren't -1; for each, where in the two rows that ``_logits`` has of it its
    class and its slot stand, of all rows' places; how many there are of each class."""
    sizes = np.bincount((target + WIDTH) // WIDTH, minlength=s.classes + 1)
    cls = (target // WIDTH).astype(np.int16 if s.classes > 127 else np.int8)
    order = np.argsort(cls, kind="stable")[sizes[0] :].astype(np.int32)
    at = np.stack(np.divmod(target[order], WIDTH), 1).astype(np.int64).ravel()
    return order, at + np.arange(len(at)) * s.logits, sizes[1:]


@lru_cache(maxsize=4)
def _learning(s: Shape, kind: str):
    """The graph of ``gradients``."""
    g = Graph(kind)
    rank, x = 3 if s.heads == 1 else 4, g.array("x", 2, "int32")
    f = _hidden(g, s, x, x)
    logits, parts, weights, sizes = _logits(g, s, f["u"])
    share, at = g("Reshape", g("Softmax", logits, axis=-1), g.constant(np.array([-1]))), g.array("at", 1, "int64")
    g("Gather", share, at, axis=0, to="told")
    back = g("ScatterND", share, g("Unsqueeze", at, g.constant(np.array([1]))), g.array("minus", 1), reduction="add")
    back = g("Split", g("Reshape", back, g.constant(np.array([-1, 2 * s.logits]))), sizes, axis=0, results=s.classes)
    g("Concat", *(g.product(a, b, 1, 0) for a, b in zip(parts, back, strict=True)), axis=0, to="g_out")
    du = g("Concat", *(g.product(a, b, 0, 1) for a, b in zip(back, weights, strict=True)), g.constant(np.zeros((1, s.hidden), g.kind)), axis=0)
    # Back to the order of positions; those that nothing follows get the last row.
    du = g("Gather", du, g.array("place", 1, "int32"), axis=0)
    dpre = g("Where", g("Equal", f["pre"], f["u"]), du, g.constant(np.array(0, g.kind)))
    g.product(f["joined"], dpre, 1, 0, to="g_seen")
    dz = _heads(g, g("Reshape", g.product(dpre, f["seen"], 0, 1), g("Concat", g("Shape", x), g.constant(np.array([s.dim])), axis=0)), s)
    last = g.constant(np.array([-1]))
    datt = g("Sub", g.product(dz, f["v"], 0, 1, rank), g("ReduceSum", g("Mul", dz, f["z"]), last, keepdims=1))
    ds = g("Mul", datt, f["att"])
    g("ReduceSum", ds, g.constant(np.array([0])), keepdims=0, to="g_dist")
    none, given = g.constant(np.zeros((s.slots, s.dim), g.kind)), g.array("given", 2, "int64")
    for name, a, b, a_t in (("q", ds, f["k"], 0), ("k", ds, f["q"], 1), ("v", f["att"], dz, 1)):
        g("ScatterND", none, given, _joined(g, g.product(a, b, a_t, 0, rank), s), reduction="add", to=f"g_{name}")
    g("ScatterND", g.constant(np.zeros((s.slots, s.hidden), g.kind)), given, dpre, reduction="add", to="g_own")
    return g.session(told=1, g_out=2, g_seen=2, g_dist=rank - 1, g_q=2, g_k=2, g_v=2, g_own=2)


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, s: Shape) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of a batch and its gradients; x: windows x positions, y: the slots that follow, -1 where none does.

    A graph goes forth and back, with the logits by class of what follows, and sums by slot what comes back to what
    depends on a slot alone; the way on to embeddings and weights is then one over slots.
    """
    b, w = x.shape
    emb, kind = p["emb"], p["emb"].dtype
    order, at, sizes = _ordered(y.ravel(), s)
    n = len(order)
    if not n:
        return 0.0, {k: np.zeros_like(v) for k, v in p.items()}
    place = np.full(b * w, n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    gap = np.arange(w)[:, None] - np.arange(w)[None]
    causal = gap >= 0
    told, out, seen, by_gap, *back = _learning(s, kind.name)(
        x=x.astype(np.int32), given=x.reshape(-1, 1).astype(np.int64), dist=np.where(causal, p["dist"][:, np.where(causal, gap, 0)], kind.type(-1e9)),
        order=order, sizes=sizes, place=place, at=at, minus=np.full(2 * n, -1, kind), **_by_slot(p, s),
    )
    share, out = kind.type(1 / n), out.reshape(s.classes, s.hidden, -1)
    back = np.concatenate(back, 1)
    back[:, -1] = seen[:, -1] = 0
    scale, d = kind.type((s.dim // s.heads) ** -0.5), s.dim
    both = emb.T @ back
    g = {"cls": out[..., : s.classes].sum(0), "tok": out[..., s.logits : s.logits + WIDTH], "seen": seen, "bias": back[:, 3 * d :].sum(0)}
    g |= {"q": both[:, :d] * scale, "k": both[:, d : 2 * d], "v": both[:, 2 * d : 3 * d], "own": both[:, 3 * d :]}
    g |= {"emb": back @ np.concatenate([p["q"] * scale, p["k"], p["v"], p["own"]], 1).T}
    g |= {"dist": np.stack([np.bincount(gap[causal], m[causal], s.window) for m in by_gap.reshape(s.heads, w, w)]).astype(kind)}
    return float(-np.log(told + 1e-12).sum() * share), {k: v * share for k, v in g.items()}


class Adam:
    """Adam's moments over all parameters."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.rate, self.step = rate, 0
        self.m, self.v = (np.zeros(sum(x.size for x in p.values()), F32) for _ in range(2))

    def update(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.step += 1
        rate = F32(self.rate * (1 - 0.99**self.step) ** 0.5 / (1 - 0.9**self.step))
        m, v, now = self.m, self.v, np.concatenate([g[k].ravel() for k in p])
        by = now - m
        by *= F32(0.1)
        m += by
        np.square(now, out=by)
        by -= v
        by *= F32(0.01)
        v += by
        np.sqrt(v, out=by)
        by += F32(1e-7)
        np.divide(m, by, out=by)
        by *= rate
        at = 0
        for x in p.values():
            x -= by[at : at + x.size].reshape(x.shape)
            at += x.size


@lru_cache(maxsize=4)
def _scoring(s: Shape):
    """The graph of ``Scorer.tokens``."""
    g = Graph(F32)
    f = _hidden(g, s, g.array("x", 2, "int32"), g.array("before", 2, "int32"))
    logits = _logits(g, s, f["u"])[0]
    g("Gather", g("Reshape", g("LogSoftmax", logits, axis=-1), g.constant(np.array([-1]))), g.array("at", 1, "int64"), axis=0, to="told")
    return g.session(told=1)


class Scorer:
    """Log-probabilities of the tokens of texts, with what depends on a slot alone looked up."""

    #: Blocks of ``stride`` tokens that are scored at once.
    LOT = 512

    def __init__(self, p: dict[str, np.ndarray], s: Shape):
        self.s, self.by_slot = s, _by_slot(p, s)
        gap = np.arange(s.stride)[:, None] + s.stride - np.arange(s.window)[None]
        self.dist = np.where(gap >= 0, p["dist"][:, np.where(gap >= 0, gap, 0)], F32(-1e9)).astype(F32)
        #: Whether logits can't overflow. Nothing hangs on it, as the largest are always taken away.
        self.bounded = (_bounded(self.by_slot["q"], self.by_slot["k"], p["dist"], s.heads),)

    def tokens(self, x: np.ndarray, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target; x, context: blocks x stride, the slots up to each target and the block before."""
        order, at, sizes = _ordered(target.ravel(), self.s)
        before = np.concatenate([context, x], 1).astype(np.int32)
        (told,) = _scoring(self.s)(x=x.astype(np.int32), before=before, dist=self.dist, order=order, sizes=sizes, at=at, **self.by_slot)
        out = np.empty(len(order), F32)
        out[order] = told.reshape(-1, 2).sum(1)
        return out

    def texts(self, slots: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-probability of each text, its end included; ``slots`` has all texts' slots one after another."""
        st = self.s.stride
        lengths = np.asarray(lengths, np.int64)
        blocks = lengths // st + 1  # for the text's slots and its end
        first = np.concatenate(([0], np.cumsum(blocks + 1)))  # a block of what stands before each text
        flat = np.zeros(int(first[-1]) * st + 1, np.int32)
        at = np.repeat(first[:-1] * st + st - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        flat[at + 1] = slots  # the input is one token behind the targets
        grid, after = flat[:-1].reshape(-1, st), flat[1:].reshape(-1, st)
        own = np.ones(len(grid), bool)
        own[first[:-1]] = False
        own = np.flatnonzero(own)
        score = np.zeros((len(grid), st))
        for i in range(0, len(own), self.LOT):
            b = own[i : i + self.LOT]
            score[b] = self.tokens(grid[b], grid[b - 1], after[b]).reshape(len(b), st)
        last = np.full(len(grid), st)
        last[first[1:] - 1] = lengths % st + 1  # what follows a text's end isn't scored
        score[np.arange(st)[None] >= last[:, None]] = 0
        return np.add.reduceat(score.sum(1), first[:-1]) if len(lengths) else np.zeros(0)
