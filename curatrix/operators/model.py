"""Training and scoring: a weighted logistic regression on embeddings stands in for the image network, behind the same
metrics, and any ONNX model scores in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.image import cover_crop, crop_variant, planar_tensor
from curatrix.operators.labels import predicted_label
from curatrix.operators.metrics import class_weight


def train(entries: DataFrame, epochs: int = 15):
    """A model of entries (embedding, label, sample_weight); positives weigh as much as negatives in all."""
    weight = class_weight(entries).first()["positive_weight"]
    rows = entries.select(array_to_vector("embedding").alias("features"), (F.col("label") == "positive").cast("double").alias("label"), (F.col("sample_weight") * F.when(F.col("label") == "positive", weight).otherwise(1.0)).alias("weight"))
    return LogisticRegression(maxIter=epochs, regParam=0.01, weightCol="weight").fit(rows)


def score(model, rows: DataFrame, key: str) -> DataFrame:
    out = model.transform(rows.select(key, array_to_vector("embedding").alias("features")))
    return out.select(key, F.element_at(vector_to_array("probability"), 2).alias("score"))


def score_rows(scored: DataFrame, run_id: str, threshold: float, now) -> DataFrame:
    """Rows of model_scores from (image_sha256, score, split)."""
    return scored.select(F.lit(run_id).alias("run_id"), "image_sha256", "score", predicted_label(F.col("score"), threshold).alias("predicted_label"), "split", now.alias("created_at"))


def score_onnx(tensors: DataFrame, key: str, model_bytes: bytes, positive: int = 1, together: int = 256) -> DataFrame:
    """(key, score, error) of tensors (key, tensor, shape: first 1) by an ONNX model, whose session is made once a task.
    Tensors of a shape go to the model together; where that fails, each goes alone, and an input's error is its row's."""
    shared = tensors.sparkSession.sparkContext.broadcast(model_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import onnxruntime

        session = onnxruntime.InferenceSession(shared.value)
        name = session.get_inputs()[0].name

        def scored(rows: list[tuple], shape: tuple) -> list[float]:
            x = np.stack([np.asarray(t, np.float32).reshape(shape[1:]) for t in rows])
            out = np.asarray(session.run(None, {name: x})[0], float).reshape(len(rows), -1)
            odds = np.exp(out - out.max(axis=1, keepdims=True))
            return (out[:, 0] if out.shape[1] == 1 else odds[:, positive] / odds.sum(axis=1)).tolist()

        for batch in batches:
            scores, errors = [None] * len(batch), [None] * len(batch)
            groups: dict[tuple, list[int]] = {}
            for i, shape in enumerate(batch["shape"]):
                groups.setdefault(tuple(int(x) for x in shape) if shape is not None else (), []).append(i)
            for shape, found in groups.items():
                for at in range(0, len(found), together):
                    few = found[at : at + together]
                    for part in (few, *([i] for i in few)):
                        if len(part) == len(few) > 1 or scores[part[0]] is None:
                            try:
                                for i, p in zip(part, scored([batch["tensor"].iloc[i] for i in part], shape)):
                                    scores[i] = p
                            except Exception as e:  # noqa: BLE001
                                if len(part) == 1:
                                    errors[part[0]] = str(e)
            yield pd.DataFrame({key: batch[key], "score": scores, "error": errors})

    return tensors.select(key, "tensor", "shape").mapInPandas(run, f"{key} string, score double, error string")


def image_variants(files: DataFrame, decode: Callable[[bytes, tuple[int, int, int, int], int], bytes], size: int, top_sources: tuple[str, ...]) -> DataFrame:
    """(path, variant, rgb) of files (path, content, source, width, height): the part that covers a square, cropped from where
    the source says, as bytes of size * size pixels in an array column. decode gives them of content, (left, top, width,
    height) and size; a file that it cannot read has a null array."""
    variant = crop_variant(F.col("source"), top_sources)
    region = cover_crop(F.col("width"), F.col("height"), F.lit(size), F.lit(size), variant)
    rows = files.select("path", "content", variant.alias("variant"), region.alias("r")).select("path", "content", "variant", "r.left", "r.top", "r.width", "r.height")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rgb = []
            for r in batch.itertuples():
                try:
                    rgb.append(list(decode(bytes(r.content), (int(r.left), int(r.top), int(r.width), int(r.height)), size)))
                except Exception:  # noqa: BLE001  any broken file is a row
                    rgb.append(None)
            yield pd.DataFrame({"path": batch["path"], "variant": batch["variant"], "rgb": rgb})

    return rows.mapInPandas(run, "path string, variant string, rgb array<int>")


def training_items(entries: DataFrame, variants: DataFrame, top_sources: tuple[str, ...], mean: list[float], std: list[float]) -> DataFrame:
    """(id, tensor, target, weight) of dataset entries: the variant that the entry's source asks for, as channel planes.
    Entries without a picture have a null tensor, so none is lost unseen."""
    wanted = entries.select("id", "path", crop_variant(F.col("source"), top_sources).alias("variant"), (F.col("label") == "positive").cast("int").alias("target"), F.col("sample_weight").alias("weight"))
    planes = planar_tensor(F.col("rgb"), F.lit(mean), F.lit(std))
    return wanted.join(variants, ["path", "variant"], "left").select("id", F.when(F.col("rgb").isNotNull(), planes).alias("tensor"), "target", "weight")


def onnx_metadata(run_id: str, threshold: float, input_size: int = 128) -> dict:
    """What accompanies an exported model."""
    return {"architecture": "logistic_regression", "class_names": ["negative", "positive"], "input_size": input_size, "channels": 3, "mean": [0.5] * 3, "std": [0.5] * 3, "positive_index": 1, "threshold": threshold, "run_id": run_id}


def coefficients(fitted) -> tuple[list[float], float]:
    return [float(x) for x in fitted.coefficients], float(fitted.intercept)


def _field(number: int, value) -> bytes:
    """A field of a protobuf message: an integer, text, bytes, or a message of fields."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    body = value.encode() if isinstance(value, str) else value if isinstance(value, bytes) else b"".join(_field(*f) for f in value)
    return varint(number << 3 | 2) + varint(len(body)) + body


def onnx_model(weights: list[float], bias: float) -> bytes:
    """A regression as an ONNX graph that score_onnx loads: an input of any shape is flattened, and the logits of both classes
    come out."""
    import numpy as np

    both = np.array([[0.0, w] for w in weights], "<f4"), np.array([0.0, bias], "<f4")
    tensors = [(5, [*[(1, n) for n in x.shape], (2, 1), (8, name), (9, x.tobytes())]) for x, name in zip(both, ("weights", "bias"))]
    node = lambda kind, into, out, *more: (1, [*[(1, i) for i in into], (2, out), (4, kind), *more])
    tensor = lambda number, name: (number, [(1, name), (2, [(1, [(1, 1)])])])
    graph = [node("Flatten", ["input"], "flat", (5, [(1, "axis"), (3, 1), (20, 2)])), node("Gemm", ["flat", "weights", "bias"], "logits"), (2, "regression"), *tensors, tensor(11, "input"), tensor(12, "logits")]
    return b"".join(_field(*f) for f in [(1, 7), (7, graph), (8, [(2, 13)])])
