"""Small helpers around volumes: packed arrays, chunk strings, viewer transforms, output to several streams."""

from __future__ import annotations

import enum
import io
import struct
from typing import TextIO

import numpy as np
import pyarrow as pa


class ImageFormat(enum.Enum):
    """What a stored stage holds."""

    NUMPY = 0
    VOXELS = 1
    BLOCKS = 2


def dumps_numpy(array: np.ndarray, codec: str = "zstd") -> bytes:
    """An array as compressed bytes that loads_numpy reads back; no pickled objects."""
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    raw = out.getvalue()
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec, asbytes=True)


def loads_numpy(raw: bytes, codec: str = "zstd") -> np.ndarray:
    size = struct.unpack_from("<q", raw)[0]
    return np.load(io.BytesIO(pa.decompress(raw[8:], size, codec, asbytes=True)), allow_pickle=False)


def chunks_to_text(chunks: tuple[int, ...]) -> str:
    return ",".join(map(str, chunks))


def chunks_of_text(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split(","))


def expected_ndim(label: bool, stacked: bool) -> int:
    """Axes of a volume: labels and unstacked images have three, stacked images a channel axis too."""
    return 3 if label or not stacked else 4


def ensure_ndim(ndim: int, label: bool, stacked: bool) -> int:
    if ndim != expected_ndim(label, stacked):
        raise ValueError(f"{ndim} axes, not {expected_ndim(label, stacked)}")
    return ndim


def centred(scale: tuple[float, ...], shape: tuple[int, ...]) -> tuple[float, ...]:
    """Where a volume of voxels of that scale starts, so that its middle is at the origin."""
    return tuple((s - n) / 2 for s, n in zip(scale, shape, strict=True))


def viewer_arguments(scale: tuple[float, ...], shape: tuple[int, ...]) -> dict[str, tuple[float, ...]]:
    return {"translate": centred(scale, shape), "scale": tuple(scale)}


class Tee:
    """Writes what it is given to several streams."""

    def __init__(self, *streams: TextIO) -> None:
        self.streams = streams

    def write(self, text: str) -> int:
        for s in self.streams:
            s.write(text)
        return len(text)

    def flush(self) -> None:
        for s in self.streams:
            s.flush()
