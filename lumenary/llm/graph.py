"""Graphs of array operations that onnxruntime runs on one thread: a writer of its model format, and sessions."""

from __future__ import annotations

from itertools import count

import numpy as np

_KINDS = {"float32": 1, "int32": 6, "int64": 7, "float64": 11}


def _number(n: int) -> bytes:
    n, out = n & (1 << 64) - 1, b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(at: int, value: int | str | bytes) -> bytes:
    """A field of a protocol buffer's message."""
    if isinstance(value, int):
        return _number(at << 3) + _number(value)
    value = value.encode() if isinstance(value, str) else value
    return _number(at << 3 | 2) + _number(len(value)) + value


def _attribute(name: str, value: int | str | list[int]) -> bytes:
    if isinstance(value, list):
        return _field(1, name) + b"".join(_field(8, v) for v in value) + _field(20, 7)
    return _field(1, name) + (_field(3, value) + _field(20, 2) if isinstance(value, int) else _field(4, value) + _field(20, 3))


class Graph:
    """Operations on arrays of one kind of floats, by name; calling it adds one and gives what names its result."""

    def __init__(self, kind: np.dtype):
        self.kind, self.names = np.dtype(kind), map("t{}".format, count())
        self.nodes, self.constants, self.inputs = b"", b"", b""

    def __call__(self, op: str, *given: str, results: int = 0, to: str = "", domain: str = "", **attributes):
        out = [to or next(self.names) for _ in range(results or 1)]
        node = b"".join(_field(1, x) for x in given) + b"".join(_field(2, x) for x in out) + _field(4, op)
        self.nodes += _field(1, node + b"".join(_field(5, _attribute(k, v)) for k, v in attributes.items()) + _field(7, domain))
        return out if results else out[0]

    def array(self, name: str, rank: int, kind: str | None = None) -> str:
        """An input of any size."""
        self.inputs += _field(11, self._described(name, kind or self.kind.name, rank))
        return name

    def constant(self, value) -> str:
        value = np.asarray(value)
        name = next(self.names)
        dims = b"".join(_field(1, n) for n in value.shape)
        self.constants += _field(5, dims + _field(2, _KINDS[value.dtype.name]) + _field(8, name) + _field(9, value.tobytes()))
        return name

    def product(self, a: str, b: str, a_t: int = 0, b_t: int = 0, rank: int = 2, to: str = "") -> str:
        """The matrix product of a and b, of their last two axes; a_t, b_t: of the transposed one."""
        if self.kind == np.float32:
            return self("FusedMatMul", a, b, domain="com.microsoft", transA=a_t, transB=b_t, to=to)
        perm = [*range(rank - 2), rank - 1, rank - 2]
        a, b = (self("Transpose", x, perm=perm) if t else x for x, t in ((a, a_t), (b, b_t)))
        return self("MatMul", a, b, to=to)

    @staticmethod
    def _described(name: str, kind: str, rank: int) -> bytes:
        dims = b"".join(_field(1, _field(2, f"{name}_{i}")) for i in range(rank))
        return _field(1, name) + _field(2, _field(1, _field(1, _KINDS[kind]) + _field(2, dims)))

    def session(self, **results: int):
        """What runs the graph: a function of its inputs, by name, that gives ``results`` (name: rank) in order."""
        import onnxruntime as ort

        outputs = b"".join(_field(12, self._described(n, self.kind.name, rank)) for n, rank in results.items())
        graph = self.nodes + _field(2, "graph") + self.constants + self.inputs + outputs
        model = _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 17)) + _field(8, _field(1, "com.microsoft") + _field(2, 1))
        options = ort.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        options.log_severity_level = 3
        own = ort.InferenceSession(model, options, providers=["CPUExecutionProvider"])
        return lambda **arrays: own.run([*results], arrays)
