"""Text encoders as Arrow UDFs. Real models are plug-ins; the hash encoder needs none."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspan.functions.text import composed


def hash_encoder(dimension: int) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors from the words' hashes: the same text, the same vector."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for k, text in enumerate(texts):
            for word in composed(text).casefold().split():
                seed = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[k] += np.random.default_rng(seed).standard_normal(dimension)
        return out

    return encode


def encoder_udf(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """Text to a unit vector; the model is loaded once in each worker. Null and blank texts have none."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            good = [k for k, t in enumerate(texts) if t and t.strip()]
            out: list = [None] * len(texts)
            if good:
                vectors = np.asarray(model([texts.iloc[k] for k in good]), dtype=np.float64)
                norms = np.linalg.norm(vectors, axis=1)
                if not np.isfinite(norms).all() or (norms == 0).any():
                    raise ValueError("the encoder made a vector that can't be normalised")
                for k, vector, norm in zip(good, vectors, norms, strict=True):
                    out[k] = (vector / norm).astype(np.float32)
            yield pd.Series(out, dtype=object)

    return encode
