"""Pictures as arrays: PNG files decoded, resampled and digested in numpy, within tasks that hold a file at a time."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: samples a pixel by colour type, and the seven passes of interlacing (x, y, step x, step y).
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
WHOLE = ((0, 0, 1, 1),)
#: Pixels of a picture at most, so that a small file cannot fill a task's memory.
MOST_PIXELS = 1 << 28
#: Bits of the fixed-point weights that resampling uses.
BITS = 22


def _chunks(body: bytes):
    at = 8
    while at + 12 <= len(body):
        size, kind = struct.unpack(">I4s", body[at : at + 8])
        data = body[at + 8 : at + 8 + size]
        if len(data) < size or zlib.crc32(kind + data) != struct.unpack(">I", body[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"broken chunk {kind!r}")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("no end")


def _unfiltered(raw: np.ndarray, rows: int, width: int, step: int) -> np.ndarray:
    """Rows of bytes whose filters are undone; raw has a filter byte before each row, step is a pixel's bytes."""
    lines = raw[: rows * (width + 1)].reshape(rows, width + 1)
    out = np.zeros((rows + 1, width), np.uint8)  # the row above the first is zero
    for y in range(rows):
        kind, line, above = lines[y, 0], lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:  # a sum along the row, for each byte of a pixel
            padded = np.zeros(-(-width // step) * step, np.uint8)
            padded[:width] = line
            out[y + 1] = np.add.accumulate(padded.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:width]
        elif kind == 2:
            out[y + 1] = line + above
        elif kind in (3, 4):
            row, up = bytearray(line.tobytes()), above.tobytes()
            for x in range(width):
                left, upper = (row[x - step], up[x - step]) if x >= step else (0, 0)
                if kind == 3:
                    guess = (left + up[x]) >> 1
                else:
                    near = left + up[x] - upper
                    a, b, c = abs(near - left), abs(near - up[x]), abs(near - upper)
                    guess = left if a <= b and a <= c else up[x] if b <= c else upper
                row[x] = row[x] + guess & 255
            out[y + 1] = np.frombuffer(bytes(row), np.uint8)
        else:
            raise ValueError(f"filter {kind}")
    return out[1:]


def _samples(lines: np.ndarray, width: int, samples: int, depth: int) -> np.ndarray:
    """Rows of bytes as rows, pixels and samples of 8 bits; palette indices and other small samples as they are."""
    if depth == 16:
        lines, depth = lines[:, ::2], 8  # the high bytes
    if depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
        lines = np.packbits(bits, axis=2).reshape(len(lines), -1) >> (8 - depth)
    return lines[:, : width * samples].reshape(len(lines), width, samples)


def decode(body: bytes) -> np.ndarray:
    """The pixels of a PNG file: rows, columns, and red, green, blue. Transparency is left out, as its colours are there."""
    if not body.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    header = palette = None
    data = []
    for kind, chunk in _chunks(body):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(chunk)
    width, height, depth, colour, _, _, interlaced = header
    if not width or not height or width * height > MOST_PIXELS or colour not in SAMPLES or depth not in (1, 2, 4, 8, 16):
        raise ValueError("a header that cannot be read")
    samples = SAMPLES[colour]
    passes = [(x, y, dx, dy, -(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in (PASSES if interlaced else WHOLE) if width > x and height > y]
    size = lambda w: -(-w * samples * depth // 8)
    unpacker = zlib.decompressobj()
    raw = np.frombuffer(unpacker.decompress(b"".join(data), sum(h * (size(w) + 1) for *_, w, h in passes)), np.uint8)
    out, at = np.zeros((height, width, samples), np.uint8), 0
    for x, y, dx, dy, w, h in passes:
        lines = _unfiltered(raw[at:], h, size(w), max(1, samples * depth // 8))
        out[y::dy, x::dx] = _samples(lines, w, samples, depth)
        at += h * (size(w) + 1)
    if colour == 3:
        return palette[out[:, :, 0]]
    if depth < 8:
        out = out * (255 // ((1 << depth) - 1))
    return np.repeat(out[:, :, :1], 3, axis=2) if colour in (0, 4) else out[:, :, :3]


def _weights(size: int, to: int) -> np.ndarray:
    """The weights of size samples in each of to samples, by a cubic of parameter -0.5 that widens when a picture shrinks."""
    scale = size / to
    wide = max(1.0, scale)
    out = np.zeros((to, size))
    for i in range(to):
        center = (i + 0.5) * scale
        first, end = max(0, int(center - 2 * wide + 0.5)), min(size, int(center + 2 * wide + 0.5))
        x = np.abs((np.arange(first, end) - center + 0.5) / wide)
        w = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((x - 5) * x + 8) * x * -0.5 + 2, 0.0))
        out[i, first:end] = w / w.sum()
    return np.trunc(out * (1 << BITS) + np.where(out < 0, -0.5, 0.5))


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels at another size, first along rows and then along columns, rounded to bytes each time; sums are exact."""
    half = float(1 << BITS - 1)

    def along(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
        sums = np.tensordot(weights, values.astype(np.float64), axes=(1, 0)) + half
        return np.clip(np.floor(sums / (1 << BITS)), 0, 255).astype(np.uint8)

    if pixels.shape[1] != width:
        pixels = along(pixels.transpose(1, 0, 2), _weights(pixels.shape[1], width)).transpose(1, 0, 2)
    return along(pixels, _weights(pixels.shape[0], height)) if pixels.shape[0] != height else pixels


def prober(size: int):
    """What probe_images asks for: width, height, mime type, and the pixels whose digest tells pictures apart."""

    def probe(body: bytes) -> tuple[int, int, str, bytes]:
        pixels = decode(body)
        return pixels.shape[1], pixels.shape[0], "image/png", resized(pixels, size, size).tobytes()

    return probe


def cropped(body: bytes, box: tuple[int, int, int, int], size: int) -> bytes:
    """What image_variants asks for: a part of a picture (left, top, width, height) as size by size pixels."""
    left, top, width, height = box
    return resized(decode(body)[top : top + height, left : left + width], size, size).tobytes()
