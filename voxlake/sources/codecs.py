"""Chunk codecs of Zarr version 2: Blosc frames, zlib, gzip, zstd and lz4."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

#: Fixed values of the Blosc 1 frame: bits of its flags, and its numbers of inner compressors.
BYTE_SHUFFLE, STORED, BIT_SHUFFLE, UNSPLIT = 0x1, 0x2, 0x4, 0x10
INNER = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}
NUMBER_OF = {"lz4": 1, "lz4hc": 1, "snappy": 2, "zlib": 3, "zstd": 4}
_HEAD = struct.Struct("<BBBBIII")


def _inflated(raw: bytes, size: int, codec: str) -> bytes:
    if codec == "zlib":
        return zlib.decompress(raw)
    return pa.decompress(raw, decompressed_size=size, codec=codec, asbytes=True)


def _deflated(raw: bytes, codec: str, level: int) -> bytes:
    if codec == "zlib":
        return zlib.compress(raw, level)
    return pa.Codec(codec, compression_level=level if codec == "zstd" else None).compress(raw, asbytes=True)


def shuffled(raw: bytes, width: int, bits: bool) -> bytes:
    """Bytes (or bits) of equal place in all elements brought together; what is left over stays at the end."""
    n = len(raw) // width
    if bits and n % 8:
        return raw
    body, rest = np.frombuffer(raw[: n * width], np.uint8).reshape(n, width), raw[n * width :]
    if not bits:
        return body.T.tobytes() + rest
    return np.packbits(np.unpackbits(body, axis=1, bitorder="little").T, axis=1, bitorder="little").tobytes() + rest


def unshuffled(raw: bytes, width: int, bits: bool) -> bytes:
    n = len(raw) // width
    if bits and n % 8:
        return raw
    body, rest = np.frombuffer(raw[: n * width], np.uint8), raw[n * width :]
    if not bits:
        return body.reshape(width, n).T.tobytes() + rest
    planes = np.unpackbits(body.reshape(8 * width, n // 8), axis=1, bitorder="little")
    return np.packbits(planes.T, axis=1, bitorder="little").tobytes() + rest


def blosc_decoded(frame: bytes) -> bytes:
    """The content of a Blosc 1 frame; its blocks stand alone, each in one stream or in one for each byte of an element."""
    _, _, flags, width, size, block, _ = _HEAD.unpack_from(frame)
    if flags & STORED:
        return frame[_HEAD.size : _HEAD.size + size]
    if (number := flags >> 5) not in INNER:
        raise ValueError(f"Blosc frames of inner compressor {number} cannot be read")
    codec, out = INNER[number], []
    for k in range(-(-size // block)):
        length = min(block, size - k * block)
        streams = 1 if flags & UNSPLIT or length < block else width
        at, parts = struct.unpack_from("<i", frame, _HEAD.size + 4 * k)[0], []
        for _ in range(streams):
            n = struct.unpack_from("<i", frame, at)[0]
            raw = frame[at + 4 : at + 4 + n]
            parts.append(raw if n == length // streams else _inflated(raw, length // streams, codec))
            at += 4 + n
        raw = b"".join(parts)
        if flags & BIT_SHUFFLE:
            raw = unshuffled(raw, width, True)
        elif flags & BYTE_SHUFFLE and width > 1:
            raw = unshuffled(raw, width, False)
        out.append(raw)
    return b"".join(out)


def blosc_encoded(raw: bytes, width: int, codec: str = "lz4", level: int = 5, shuffle: int = 2, block: int = 1 << 18) -> bytes:
    """A Blosc 1 frame; shuffle is 0 (none), 1 (bytes) or 2 (bits)."""
    block = max(8 * width, block // (8 * width) * (8 * width))
    flags = UNSPLIT | NUMBER_OF[codec] << 5 | (0, BYTE_SHUFFLE, BIT_SHUFFLE)[shuffle]
    starts, body, at = [], [], _HEAD.size + 4 * -(-len(raw) // block)
    for k in range(0, len(raw), block):
        part = raw[k : k + block]
        held = shuffled(part, width, shuffle == 2) if shuffle == 2 or shuffle and width > 1 else part
        packed = _deflated(held, INNER[NUMBER_OF[codec]], level)
        packed = held if len(packed) >= len(held) else packed
        starts.append(at)
        body.append(struct.pack("<i", len(packed)) + packed)
        at += 4 + len(packed)
    if at >= _HEAD.size + len(raw):
        return _HEAD.pack(2, 1, STORED | flags, width, len(raw), block, _HEAD.size + len(raw)) + raw
    return _HEAD.pack(2, 1, flags, width, len(raw), block, at) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(body)


KNOWN = (None, "zlib", "gzip", "zstd", "lz4", "blosc")


def decoded(raw: bytes, compressor: dict | None, size: int) -> bytes:
    """A stored chunk's bytes by the array's compressor; size is that of the chunk."""
    codec = (compressor or {}).get("id")
    if codec is None:
        return raw
    if codec in ("zlib", "gzip"):
        return zlib.decompress(raw, 47)
    if codec == "zstd":
        return _inflated(raw, size, "zstd")
    if codec == "lz4":
        return _inflated(raw[4:], struct.unpack_from("<i", raw)[0], "lz4_raw")
    if codec == "blosc":
        return blosc_decoded(raw)
    raise ValueError(f"chunks compressed with {codec} cannot be read")


def encoded(raw: bytes, compressor: dict | None, width: int) -> bytes:
    codec, level = (compressor or {}).get("id"), (compressor or {}).get("level", 1)
    if codec is None:
        return raw
    if codec == "zlib":
        return zlib.compress(raw, level)
    if codec == "zstd":
        return _deflated(raw, "zstd", level)
    if codec == "lz4":
        return struct.pack("<i", len(raw)) + _deflated(raw, "lz4_raw", level)
    if codec == "blosc":
        return blosc_encoded(raw, width, compressor.get("cname", "lz4"), compressor.get("clevel", 5), compressor.get("shuffle", 1))
    raise ValueError(f"chunks cannot be compressed with {codec}")
