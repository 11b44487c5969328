"""Vectors and token numbers of texts from any model, loaded once per worker and fed in batches.

The encoder given is a function that makes a function from a list of texts to a matrix, so that a model
is loaded where it runs. The one here needs no model: sequences of two and three characters, hashed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[], Callable[[list[str]], np.ndarray]]


def hashing_encoder(dim: int = 256) -> Encoder:
    """Counts of character sequences by hash, with a sign by hash, so that collisions even out."""

    def load():
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for i, t in enumerate(texts):
                cp = np.frombuffer("".join(t.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                for n in (2, 3):
                    if len(cp) >= n:
                        h = np.full(len(cp) - n + 1, n, np.uint64)
                        for k in range(n):
                            h = (h ^ cp[k : len(cp) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                            h ^= h >> np.uint64(29)
                        np.add.at(out[i], (h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), np.float32(1), np.float32(-1)))
            return out

        return encode

    return load


def encode_texts(df: DataFrame, id_col: str, text_col: str, encoder: Encoder, dim: int, prefix: str = "", batch: int = 256) -> DataFrame:
    """id, vector (float, length 1; zeros stay zeros) of each row with a text; null texts give none. A
    matrix of another width than `dim` is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for pdf in batches:
            encode = encode or encoder()
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                m = np.asarray(encode([prefix + t for t in part["text"]]), np.float32)
                if m.shape != (len(part), dim):
                    raise ValueError(f"the encoder gave {m.shape}, {dim} columns are due")
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                yield pd.DataFrame({"id": part["id"], "vector": list(m / np.where(norm > 0, norm, 1))})

    src = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, vector array<float>")


def token_numbers(df: DataFrame, id_col: str, text_col: str, tokenizer: Callable[[], Callable[[list[str]], list[int]]]) -> DataFrame:
    """id, n_tokens by any tokenizer given as an encoder is; null texts have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = None
        for pdf in batches:
            count = count or tokenizer()
            yield pd.DataFrame({"id": pdf["id"], "n_tokens": count([t or "" for t in pdf["text"]])})

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, n_tokens int")
