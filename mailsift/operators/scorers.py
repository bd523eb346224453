"""Models chosen by path (UDF-4): a payload file and the manifest beside it.

A model's folder holds ``payload`` (its parameters as bytes) and
``manifest.json``: the loader that makes a predict function from the bytes, the
input columns, the return type and the payload's SHA-256. Spark fetches the
payload to every executor (``addFile``, from any file system that Spark reads);
each Python worker checks its digest and builds the model once, and rows go to
it in Arrow batches. The driver reads the manifest only.

A loader is ``module:function``, taking the payload's bytes and returning
``predict``: one numpy array per input column in, one array (rows first) out.
"""

from __future__ import annotations

import hashlib
import importlib
import json
from collections.abc import Callable, Sequence

from pyspark import SparkFiles
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST, PAYLOAD = "manifest.json", "payload"
CENTROIDS = "mailsift.operators.scorers:centroid_distances"
LINEAR = "mailsift.operators.scorers:linear_probabilities"


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    fs, at = _path(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def save_scorer(spark: SparkSession, folder: str, loader: str, payload: bytes, inputs: Sequence[str],
                shapes: Sequence[Sequence[int]] | None = None, returns: str = "array<double>") -> None:
    """Write a model's folder: the payload first, the manifest (which makes it a model) last.
    The payload has a name of its own digest, so replacing a model never mixes two."""
    digest = hashlib.sha256(payload).hexdigest()
    _write(spark, f"{folder}/{PAYLOAD}-{digest}", payload)
    manifest = {"loader": loader, "inputs": list(inputs), "shapes": shapes and [list(s) for s in shapes], "returns": returns, "sha256": digest}
    _write(spark, f"{folder}/{MANIFEST}", json.dumps(manifest).encode())


def read_manifest(spark: SparkSession, folder: str) -> dict:
    fs, at = _path(spark, f"{folder}/{MANIFEST}")
    if not fs.exists(at):
        raise FileNotFoundError(f"no model at {folder}: {MANIFEST} is missing")
    return json.loads(spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).first()[0])


def _maker(name: str, loader: str, digest: str) -> Callable:
    def make():
        with open(SparkFiles.get(name), "rb") as f:
            data = f.read()
        if hashlib.sha256(data).hexdigest() != digest:
            raise ValueError(f"model payload {name} differs from its manifest's digest")
        module, function = loader.split(":")
        return getattr(importlib.import_module(module), function)(data)
    return make


def scorer_at(spark: SparkSession, folder: str, batch_size: int = 64) -> Column:
    """The scores of the model at ``folder`` as a column of its manifest's input columns."""
    manifest = read_manifest(spark, folder)
    name = f"{PAYLOAD}-{manifest['sha256']}"
    spark.sparkContext.addFile(f"{folder}/{name}")
    score = predict_batch_udf(_maker(name, manifest["loader"], manifest["sha256"]), return_type=T.DataType.fromDDL(manifest["returns"]),
                              batch_size=batch_size, input_tensor_shapes=manifest["shapes"])
    return score(*(F.col(c) for c in manifest["inputs"]))


def centroid_payload(centroids: Sequence[Sequence[float]]) -> bytes:
    return json.dumps([list(map(float, c)) for c in centroids]).encode()


def centroid_distances(payload: bytes) -> Callable:
    """Euclidean distance of each row to every centroid."""
    from mailsift.operators.models import centroid_predict_fn

    return centroid_predict_fn(json.loads(payload))()


def linear_payload(weights: Sequence[Sequence[float]], bias: Sequence[float]) -> bytes:
    return json.dumps({"weights": [list(map(float, w)) for w in weights], "bias": list(map(float, bias))}).encode()


def linear_probabilities(payload: bytes) -> Callable:
    """Softmax of a linear map: one row of weights and one bias a class."""
    import numpy as np

    model = json.loads(payload)
    weights, bias = np.array(model["weights"], np.float64), np.array(model["bias"], np.float64)

    def predict(x):
        z = np.asarray(x, np.float64) @ weights.T + bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    return predict
