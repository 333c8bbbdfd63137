"""Plug-in models: anything that maps a batch of texts to vectors, scores or spans."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 64) -> Encoder:
    """A deterministic encoder for tests: signed hashed character trigrams, scaled to length 1 (zeros for no text)."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in enumerate(texts):
            padded = f"  {text.lower()}  "
            for i in range(len(padded) - 2):
                h = zlib.crc32(padded[i : i + 3].encode())
                out[row, h % dim] += 1.0 if h & 0x10000 else -1.0
            length = np.linalg.norm(out[row])
            if length:
                out[row] /= length
        return out

    return encode


def encode_mentions(df: DataFrame, make: Callable[[], Encoder], text: str, vector: str = "vector") -> DataFrame:
    """Add a float-array column; the model is made once per Python worker task, texts come in Arrow batches. Null reads as empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            frame[vector] = list(model(frame[text].fillna("").tolist())) if len(frame) else []
            yield frame

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", {vector} array<float>"
    return df.mapInPandas(run, schema)


def rerank(candidates: DataFrame, make: Callable[[], Callable[[list[str], list[str]], np.ndarray]], context: str, title: str) -> DataFrame:
    """Cross scores of (context, title) pairs, and the rank they give within `query` (ties: the earlier rank)."""
    from pyspark.sql import Window

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            frame["cross_score"] = model(frame[context].fillna("").tolist(), frame[title].fillna("").tolist()).astype(float) if len(frame) else []
            yield frame

    schema = ", ".join(f"`{c}` {t}" for c, t in candidates.dtypes) + ", cross_score double"
    order = Window.partitionBy("query").orderBy(F.col("cross_score").desc(), "rank")
    return candidates.mapInPandas(run, schema).withColumn("cross_rank", F.row_number().over(order))


def capitalised_spans(text: str) -> list[tuple[int, int]]:
    """Runs of capitalised words, not at the start of a sentence alone: a rule in place of a tagger."""
    spans = [m.span() for m in re.finditer(r"\b[^\W\d_a-zà-ÿ][\w’'-]*(?:\s+[^\W\d_a-zà-ÿ][\w’'-]*)*", text)]
    return [(a, e) for a, e in spans if " " in text[a:e] or (a > 0 and not re.search(r"[.!?]\s*$", text[:a]))]


def annotate(df: DataFrame, key: str, text: str, tagger: Callable[[str], list[tuple[int, int]]] = capitalised_spans) -> DataFrame:
    """Mention rows of each text: key, start_pos, end_pos, mention, context_left, context_right, lower-cased."""
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (k, a, e, t[a:e].lower(), t[:a].lower(), t[e:].lower())
                for k, t in zip(frame[key], frame[text], strict=True) if isinstance(t, str) for a, e in tagger(t)
            ]
            yield pd.DataFrame(rows, columns=[key, "start_pos", "end_pos", "mention", "context_left", "context_right"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, start_pos int, end_pos int, mention string, context_left string, context_right string")
