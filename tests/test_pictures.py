"""Pictures of known pixels through the decoder, the resampler, fingerprints and scores."""

from __future__ import annotations

import hashlib
import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import image, png
from curatrix.operators import model


def packed(samples, depth):
    """Rows of samples as bytes."""
    if depth == 16:
        return [b"".join(struct.pack(">H", int(v) * 257) for v in row) for row in samples]
    if depth == 8:
        return [bytes(row.tolist()) for row in samples]
    return [np.packbits(np.unpackbits(row.astype(np.uint8)[:, None], axis=1)[:, 8 - depth :].reshape(-1)).tobytes() for row in samples]


def filtered(lines, step, kinds):
    out, above = b"", bytes(len(lines[0])) if lines else b""
    for y, line in enumerate(lines):
        kind, row = kinds[y % len(kinds)], bytearray()
        for x, v in enumerate(line):
            a, b, c = line[x - step] if x >= step else 0, above[x], above[x - step] if x >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out, above = out + bytes([kind]) + bytes(row), line
    return out


def written(samples, colour, depth, kinds=(0, 1, 2, 3, 4), interlaced=False, palette=None):
    """samples: rows, columns, samples of a pixel."""
    height, width, n = samples.shape
    raw = b""
    for x, y, dx, dy in png.PASSES if interlaced else png.WHOLE:
        part = samples[y::dy, x::dx]
        if part.size:
            raw += filtered(packed(part.reshape(len(part), -1), depth), max(1, n * depth // 8), kinds)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = zlib.compress(raw)
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", body[:7]) + chunk(b"IDAT", body[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("colour", "depth"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 4), (3, 8), (4, 8), (6, 8), (6, 16)])
def test_what_is_written_is_read(colour, depth, interlaced):
    r = np.random.default_rng(colour * 100 + depth)
    for height, width in ((1, 1), (3, 5), (9, 13), (16, 8)):
        most = 1 << min(depth, 8)
        samples = r.integers(0, most, (height, width, png.SAMPLES[colour])).astype(np.uint8)
        palette = r.integers(0, 256, (most, 3)).astype(np.uint8) if colour == 3 else None
        if colour == 3:
            want = palette[samples[:, :, 0]]
        else:
            full = samples * (255 // (most - 1)) if depth < 8 else samples
            want = full[:, :, :3] if colour in (2, 6) else np.repeat(full[:, :, :1], 3, axis=2)
        assert (png.decode(written(samples, colour, depth, interlaced=interlaced, palette=palette)) == want).all()


def test_broken_files_are_errors():
    whole = written(np.zeros((4, 4, 3), np.uint8), 2, 8)
    for body in (b"", b"GIF89a", whole[:40], whole[:-20], whole.replace(b"IDAT", b"IDAX", 1), whole[:20] + b"\xff" + whole[21:]):
        with pytest.raises(Exception):
            png.decode(body)
    bomb = png.SIGNATURE + whole[8:16] + struct.pack(">IIBBBBB", 1 << 20, 1 << 20, 8, 2, 0, 0, 0)
    with pytest.raises(ValueError):
        png.decode(bomb + struct.pack(">I", zlib.crc32(bomb[12:])) + whole[33:])


def cubic(x):
    x = abs(x)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0


def test_resampling_is_a_cubic():
    r = np.random.default_rng(4)
    pixels = r.integers(0, 256, (11, 17, 3)).astype(np.uint8)
    for width, height in ((17, 11), (5, 4), (40, 23), (17, 4)):
        got, want = png.resized(pixels, width, height).astype(int), pixels.astype(float)
        for axis, to in ((1, width), (0, height)):
            size, rows = want.shape[axis], []
            for i in range(to):
                center, wide = (i + 0.5) * size / to, max(1.0, size / to)
                w = np.array([cubic((j + 0.5 - center) / wide) for j in range(size)])
                rows.append(np.tensordot(w / w.sum(), want, axes=(0, axis)))
            want = np.clip(np.stack(rows, axis=axis), 0, 255).round()
        assert np.abs(got - want).max() <= 1 and (width, height) != (17, 11) or (got == pixels).all()
    assert (png.resized(np.full((9, 9, 3), 200, np.uint8), 4, 30) == 200).all()


def test_fingerprints_of_files(spark, tmp_path):
    r = np.random.default_rng(6)
    pixels = r.integers(0, 256, (10, 12, 3)).astype(np.uint8)
    alpha = np.concatenate([pixels, np.full((10, 12, 1), 7, np.uint8)], axis=2)
    files = {"a.png": written(pixels, 2, 8), "same-pixels.png": written(alpha, 6, 8, (2,)), "other.png": written(255 - pixels, 2, 8), "broken.png": b"no picture"}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    given = spark.read.format("binaryFile").load(str(tmp_path))
    got = {x.path.rsplit("/", 1)[1]: x for x in image.fingerprints(given, 8).collect()}
    for name, body in files.items():
        assert got[name].raw_sha == hashlib.sha256(body).hexdigest() and got[name].file_size == len(body) and got[name].image_size == 8
    assert got["a.png"].pixel_digest == got["same-pixels.png"].pixel_digest == hashlib.sha256(png.resized(pixels, 8, 8).tobytes()).hexdigest() != got["other.png"].pixel_digest
    assert (got["a.png"].width, got["a.png"].height, got["a.png"].readable) == (12, 10, True) and not got["broken.png"].readable and got["broken.png"].pixel_digest == ""


def test_a_model_is_exported_and_scores_a_file_or_an_address(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    from curatrix.plans import commands

    weights, bias = [0.3 if i < 12 else -0.2 for i in range(48)], -0.5  # the red plane and part of the rest, of 4 by 4 pixels
    graph = model.onnx_model(weights, bias)
    pixels = np.random.default_rng(8).integers(0, 256, (6, 6, 3)).astype(np.uint8)
    body = written(pixels, 2, 8)
    (tmp_path / "p.png").write_bytes(body)
    tensor = (png.resized(pixels, 4, 4).transpose(2, 0, 1) / 255.0 - 0.5) / 0.25
    want = 1 / (1 + math.exp(-(float(np.dot(weights, tensor.reshape(-1))) + bias)))
    config = {"input_size": 4, "mean": [0.5] * 3, "std": [0.25] * 3, "positive_index": 1}
    one = commands.check_input(spark, str(tmp_path / "p.png"), graph, 0.2, config)
    assert abs(one["probability"] - want) < 1e-5 and one["matched"] == (want >= 0.2) and one["local_path"].endswith("/p.png")
    asked = []
    get = lambda url: asked.append(url) or (200, "image/png", body)
    other = commands.check_input(spark, "https://a/b_normal.png?x=1", graph, 0.999, config, get)
    assert asked == ["https://a/b_400x400.png"] == [other["normalized_url"]] and abs(other["probability"] - want) < 1e-5 and not other["matched"]
    with pytest.raises(ValueError, match="status 404"):
        commands.check_input(spark, "https://a/b.png", graph, 0.5, config, lambda url: (404, "", b""))
    (tmp_path / "bad.png").write_bytes(b"no picture")
    with pytest.raises(ValueError, match="cannot be read"):
        commands.check_input(spark, str(tmp_path / "bad.png"), graph, 0.5, config)
    assert json.loads(json.dumps(one))["input"].endswith("p.png")


def test_exported_regression_agrees_with_its_model(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    rows = spark.createDataFrame([(f"i{i}", "positive" if i % 2 else "negative", 1.0, [float(i % 2) + (i % 5) / 10, 1.0 - i % 3]) for i in range(40)], "id string, label string, sample_weight double, embedding array<double>")
    fitted = model.train(rows, 5)
    graph = model.onnx_model(*model.coefficients(fitted))
    shape = F.array(F.lit(1), F.lit(2))
    scored = model.score_onnx(rows.select("id", F.col("embedding").cast("array<float>").alias("tensor"), shape.alias("shape")), "id", graph)
    want = {r.id: r.score for r in model.score(fitted, rows, "id").collect()}
    assert all(abs(r.score - want[r.id]) < 1e-5 for r in scored.collect())
