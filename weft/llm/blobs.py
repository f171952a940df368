"""Named arrays in one compressed binary value, as they travel between tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", compression_level=1)


def _planes(v: np.ndarray) -> bytes:
    """The bytes of an array; of eight-byte numbers all first bytes, all second bytes and so on, as sorted and close numbers compress so."""
    v = np.ascontiguousarray(v)
    return v.view(np.uint8).reshape(-1, 8).T.tobytes() if v.dtype.itemsize == 8 else v.tobytes()


def pack(**arrays: np.ndarray) -> bytes:
    """Named arrays in one compressed blob."""
    head = ";".join(f"{k},{v.dtype.str},{len(v)}" for k, v in arrays.items()).encode()
    body = len(head).to_bytes(4, "little") + head + b"".join(_planes(v) for v in arrays.values())
    return len(body).to_bytes(8, "little") + _CODEC.compress(body, asbytes=True)


def unpack(blob: bytes, only: tuple[str, ...] | None = None) -> dict[str, np.ndarray]:
    """The arrays of a blob, or only those named."""
    body = _CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int.from_bytes(body[:4], "little")
    out, at = {}, 4 + n
    for name, dtype, size in (x.split(",") for x in body[4 : 4 + n].decode().split(";")):
        kind, size = np.dtype(dtype), int(size)
        if only is not None and name not in only:
            at += kind.itemsize * size
            continue
        if kind.itemsize == 8:
            out[name] = np.ascontiguousarray(np.frombuffer(body, dtype=np.uint8, count=8 * size, offset=at).reshape(8, size).T).reshape(-1).view(kind)
        else:
            out[name] = np.frombuffer(body, dtype=kind, count=size, offset=at)
        at += out[name].nbytes
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """x as the narrowest unsigned numbers that hold it."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.int64)
