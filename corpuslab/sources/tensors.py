"""Model files: a length, a JSON header, raw tensors. Everything is checked before it is read."""

from __future__ import annotations

import json

import numpy as np

#: Types of the format, and numpy's.
DTYPES = {"F32": "<f4", "F16": "<f2", "I8": "<i1", "I64": "<i8"}
HEADER_MOST = 100_000_000


class ModelFileError(ValueError):
    """A file that isn't what it says."""


def parse(data: bytes) -> tuple[dict[str, np.ndarray], dict[str, str]]:
    """Tensors as float32 (int8 ones with their scale for each row applied) and the metadata."""
    if len(data) < 8:
        raise ModelFileError("no header length")
    n = int.from_bytes(data[:8], "little")
    if n > HEADER_MOST or 8 + n > len(data):
        raise ModelFileError("the header ends after the file")
    try:
        header = json.loads(data[8 : 8 + n])
    except ValueError as e:
        raise ModelFileError("the header isn't JSON") from e
    if not isinstance(header, dict):
        raise ModelFileError("the header isn't an object")
    meta = header.pop("__metadata__", {})
    body = memoryview(data)[8 + n :]
    raw = {}
    for name, spec in header.items():
        try:
            kind, shape, (start, end) = np.dtype(DTYPES[spec["dtype"]]), [int(x) for x in spec["shape"]], spec["data_offsets"]
        except (KeyError, TypeError, ValueError) as e:
            raise ModelFileError(f"{name}: bad description") from e
        size = kind.itemsize
        for x in shape:
            if x < 0:
                raise ModelFileError(f"{name}: a negative size")
            size *= x
        if not 0 <= start <= end <= len(body) or end - start != size:
            raise ModelFileError(f"{name}: bytes and shape differ")
        raw[name] = np.frombuffer(body[start:end], kind).reshape(shape)
    out = {}
    for name, t in raw.items():
        if name.endswith(".scale") and name.removesuffix(".scale") in raw:
            continue
        scale = raw.get(f"{name}.scale")
        if t.dtype == np.int8 and (scale is None or scale.shape != t.shape[:1]):
            raise ModelFileError(f"{name}: int8 without a scale for each row")
        out[name] = t.astype(np.float32) if scale is None else t.astype(np.float32) * scale.astype(np.float32)[:, None]
    return out, meta


def build(tensors: dict[str, np.ndarray], meta: dict[str, str], int8: bool = False) -> bytes:
    """The file of float32 tensors; with ``int8`` two-dimensional ones but positions are quantised row by row."""
    parts: dict[str, np.ndarray] = {}
    for name, t in tensors.items():
        if int8 and t.ndim == 2 and name != "pos.weight":
            scale = np.maximum(np.abs(t).max(1), 1e-8) / 127.0
            parts[name] = np.clip(np.round(t / scale[:, None]), -127, 127).astype(np.int8)
            parts[f"{name}.scale"] = scale.astype(np.float32)
        else:
            parts[name] = t.astype(np.float32)
    header: dict[str, object] = {"__metadata__": meta}
    at = 0
    for name, t in parts.items():
        header[name] = {"dtype": "I8" if t.dtype == np.int8 else "F32", "shape": list(t.shape), "data_offsets": [at, at + t.nbytes]}
        at += t.nbytes
    text = json.dumps(header).encode()
    return len(text).to_bytes(8, "little") + text + b"".join(t.tobytes() for t in parts.values())
