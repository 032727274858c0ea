"""Models as batch functions: loaded once per Python worker, fed with Arrow batches of whole texts.

A model is a function without arguments that loads it and returns a function from an array of texts to an array of
rows; predict_batch_udf keeps what was loaded for the life of a worker. The two here read letters only and need no file:
they stand where a trained network would be plugged in.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import types as T

from papertrawl import fixed_values as fv
from papertrawl.session import ship_with_tasks

ship_with_tasks(__name__)

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Texts of one call; a batch of Arrow rows is cut into calls.
BATCH = 256


def class_weights() -> list[list[float]]:
    """Per class, how much more often its keywords have each letter than all keywords do."""
    words = ["".join(fv.CLASS_KEYWORDS[c]) for c in fv.CLASSES]
    share = [[w.count(x) / sum(w.count(y) for y in LETTERS) for x in LETTERS] for w in words]
    mean = [sum(s[i] for s in share) / len(share) for i in range(len(LETTERS))]
    return [[round(s[i] - mean[i], 6) for i in range(len(LETTERS))] for s in share]


def letter_shares(texts: np.ndarray) -> np.ndarray:
    """Per text the share of each letter among its letters a to z in either case; zeros without letters."""
    out = np.zeros((len(texts), len(LETTERS)))
    for k, text in enumerate(texts):
        codes = np.frombuffer((text or "").encode(), np.uint8)
        counts = np.bincount(codes, minlength=256)
        out[k] = counts[97:123] + counts[65:91]
    total = out.sum(axis=1, keepdims=True)
    return out / np.where(total > 0, total, 1)


def letter_classifier(sharpness: float = 50.0, load: Callable[[], list] | None = None) -> Callable[[], Callable]:
    """Scores per class: a softmax over letter shares times the class weights. load: reads the weights, once a worker."""
    weights = class_weights() if load is None else None

    def make() -> Callable[[np.ndarray], np.ndarray]:
        matrix = np.array(weights if load is None else load())

        def predict(texts: np.ndarray) -> np.ndarray:
            margins = sharpness * (letter_shares(texts) @ matrix.T)
            raised = np.exp(margins - margins.max(axis=1, keepdims=True))
            return raised / raised.sum(axis=1, keepdims=True)

        return predict

    return make


def letter_embedder() -> Callable[[], Callable]:
    """Letter shares as vectors of unit length; zeros without letters."""
    def make() -> Callable[[np.ndarray], np.ndarray]:
        def predict(texts: np.ndarray) -> np.ndarray:
            shares = letter_shares(texts)
            length = np.sqrt((shares * shares).sum(axis=1, keepdims=True))
            return (shares / np.where(length > 0, length, 1)).astype(np.float32)

        return predict

    return make


_KINDS = {"double": T.ArrayType(T.DoubleType()), "float": T.ArrayType(T.FloatType())}


def as_scorer(make: Callable[[], Callable], kind: str = "double", batch: int = BATCH) -> Callable[..., Column]:
    """A model as a column function, for score_with_model and embed_chunks."""
    return predict_batch_udf(make, return_type=_KINDS[kind], batch_size=batch)
