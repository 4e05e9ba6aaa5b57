"""ONNX models written without the onnx package: the few protobuf messages that graphs of plain operators need."""

from __future__ import annotations

import numpy as np

OPSET, IR = 17, 8
_TYPES = {"float32": 1, "int64": 7}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _bytes(field: int, value: bytes | str) -> bytes:
    value = value.encode() if isinstance(value, str) else value
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _int(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def node(op: str, inputs: list[str], outputs: list[str], **attributes: int) -> bytes:
    """NodeProto; attributes are integers."""
    ints = [_bytes(1, k) + _int(3, v) + _int(20, 2) for k, v in attributes.items()]
    return b"".join([*(_bytes(1, i) for i in inputs), *(_bytes(2, o) for o in outputs), _bytes(4, op), *(_bytes(5, a) for a in ints)])


def _tensor(name: str, a: np.ndarray) -> bytes:
    return b"".join(_int(1, d) for d in a.shape) + _int(2, _TYPES[a.dtype.name]) + _bytes(8, name) + _bytes(9, np.ascontiguousarray(a).tobytes())


def _value(name: str, shape: tuple) -> bytes:
    dims = b"".join(_bytes(1, _int(1, d) if isinstance(d, int) else _bytes(2, d)) for d in shape)
    return _bytes(1, name) + _bytes(2, _bytes(1, _int(1, _TYPES["float32"]) + _bytes(2, dims)))


def model(nodes: list[bytes], constants: dict[str, np.ndarray], inputs: dict[str, tuple], outputs: dict[str, tuple]) -> bytes:
    """ModelProto; inputs and outputs are float32, a string in their shapes is a size that may change."""
    graph = [*(_bytes(1, n) for n in nodes), _bytes(2, "graph"), *(_bytes(5, _tensor(k, v)) for k, v in constants.items())]
    graph += [*(_bytes(11, _value(k, s)) for k, s in inputs.items()), *(_bytes(12, _value(k, s)) for k, s in outputs.items())]
    return _int(1, IR) + _bytes(7, b"".join(graph)) + _bytes(8, _int(2, OPSET))
