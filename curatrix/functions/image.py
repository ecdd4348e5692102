"""Image geometry and tensors as column functions. PNG files are decoded by functions.png, other kinds by an adapter that is given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import half_up


def crop_variant(source: Column, top_sources: tuple[str, ...]) -> Column:
    """Images of top_sources are cropped from the top, all others around the center."""
    return F.when(source.isin(*top_sources), F.lit("top")).otherwise(F.lit("center"))


def cover_crop(width: Column, height: Column, to_width: Column, to_height: Column, variant: Column) -> Column:
    """The part of an image that covers the target: left, top, width, height."""
    aspect = to_width / to_height
    wide = width / height > aspect
    w = F.when(wide, F.greatest(F.lit(1), F.least(width, half_up(height * aspect)))).otherwise(width)
    h = F.when(wide, height).otherwise(F.greatest(F.lit(1), F.least(height, half_up(width / aspect))))
    left = F.greatest(F.lit(0), half_up((width - w) / 2))
    top = F.when(variant == "top", F.lit(0)).otherwise(F.greatest(F.lit(0), half_up((height - h) / 2)))
    return F.struct(left.cast("int").alias("left"), top.cast("int").alias("top"), w.cast("int").alias("width"), h.cast("int").alias("height"))


def planar_tensor(rgb: Column, mean: Column, std: Column) -> Column:
    """Interleaved bytes to channel planes of (x / 255 - mean) / std."""
    pixels = (F.size(rgb) / 3).cast("int")
    plane = lambda c: F.transform(F.sequence(F.lit(0), pixels - 1), lambda i: (F.element_at(rgb, i * 3 + c + 1) / 255.0 - F.element_at(mean, c + 1)) / F.element_at(std, c + 1))
    return F.concat(plane(0), plane(1), plane(2))


def positive_probability(logits: Column, positive: int = 1) -> Column:
    """Softmax; a single value is a probability already."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.when(F.size(logits) == 1, F.element_at(logits, 1)).otherwise(F.exp(F.element_at(logits, positive + 1) - top) / total)


def probe_images(files: DataFrame, decode: Callable[[bytes], tuple[int, int, str, bytes]]) -> DataFrame:
    """Fingerprints of files (path, content): decode gives width, height, mime and pixels; what it cannot read is marked
    unreadable and never fails the job."""
    import hashlib

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                raw = bytes(content or b"")
                try:
                    width, height, mime, pixels = decode(raw)
                    rows.append((path, hashlib.sha256(raw).hexdigest(), hashlib.sha256(pixels).hexdigest(), width, height, mime, True))
                except Exception:  # noqa: BLE001  any broken file is a row, as the contract says
                    rows.append((path, hashlib.sha256(raw).hexdigest(), "", None, None, None, False))
            yield pd.DataFrame(rows, columns=["path", "raw_sha", "pixel_digest", "width", "height", "mime_type", "readable"])

    return files.select("path", "content").mapInPandas(probe, "path string, raw_sha string, pixel_digest string, width int, height int, mime_type string, readable boolean")


def fingerprints(files: DataFrame, size: int, decode: Callable[[bytes], tuple[int, int, str, bytes]] | None = None) -> DataFrame:
    """Rows of file_fingerprints from files as Spark reads them (path, modificationTime, length, content): the digest is that of
    the picture's pixels at size by size."""
    from curatrix.functions.png import prober

    stat = files.select("path", F.col("length").alias("file_size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.lit(size).alias("image_size"))
    found = probe_images(files, decode or prober(size)).drop("mime_type")
    return stat.join(found, "path").withColumn("updated_at", F.current_timestamp())


def pictures(files: DataFrame, size: int) -> DataFrame:
    """(path, rgb, error) of PNG files (path, content): size by size pixels in an array column, or what is wrong with the file."""
    from curatrix.functions import png

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows.append((path, png.resized(png.decode(bytes(content)), size, size).reshape(-1).astype("int32"), None))
                except Exception as e:  # noqa: BLE001  any broken file is a row
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "rgb", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, rgb array<int>, error string")


def embeddings(files: DataFrame, config: dict) -> DataFrame:
    """(path, embedding) of PNG files that can be read: pixels as a model takes them; config: input_size, mean, std."""
    planes = planar_tensor(F.col("rgb"), F.lit(config["mean"]), F.lit(config["std"]))
    return pictures(files, config["input_size"]).filter("rgb is not null").select("path", planes.cast("array<float>").alias("embedding"))
