"""Encoding of texts with a public byte-level BPE vocabulary, as batched numpy merge rounds."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
# fixed value: the pattern that splits text before merging, as published with the vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: words kept per Python worker with their ids; a full memory is emptied, so it stays bounded
MEMORY_WORDS = 200_000
NO_RANK = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {}, 256
    for b in range(256):
        if b in printable:
            letters[b] = chr(b)
        else:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


def load_merges(path: str) -> dict[str, np.ndarray]:
    """Arrays of a vocabulary file: byte_ids (256), keys (sorted left * 2^32 + right), ranks and made ids of the merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int32)
    order = np.argsort(keys, kind="stable")
    return {
        "byte_ids": np.array([vocab[c] for c in byte_letters()], np.int32),
        "keys": keys[order],
        "ranks": order.astype(np.int32),
        "made": made[order],
    }


def encode_words(words: list[bytes], merges: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, number of ids per word) of non-empty byte strings, all words at once.

    The symbols of all words lie in one array. A round looks every neighbouring pair up by binary
    search among the sorted pair keys, takes the lowest rank of each word, and merges all places of
    that pair (in a run of overlapping places every other one, from the left). A merge can only make
    pairs of higher rank, so this equals merging one place at a time. Words without a pair left leave
    the array, which therefore shrinks quickly.
    """
    keys, ranks, made = merges["keys"], merges["ranks"], merges["made"]
    lengths = np.array([len(w) for w in words], np.int64)
    sym = merges["byte_ids"][np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    done_sym, done_word = [], []
    while len(sym):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        rank = np.full(len(sym), NO_RANK, np.int32)
        slot = np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            pair = (sym[:-1] << 32) | sym[1:]
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            hit = (keys[at] == pair) & (word[1:] == word[:-1])
            rank[:-1] = np.where(hit, ranks[at], NO_RANK)
            slot[:-1] = at
        least = np.minimum.reduceat(rank, starts)
        count = np.diff(np.append(starts, len(sym)))
        lowest = np.repeat(least, count)
        over = lowest == NO_RANK
        if over.any():
            done_sym.append(sym[over])
            done_word.append(word[over])
            live = ~over
            sym, word, rank, slot, lowest = sym[live], word[live], rank[live], slot[live], lowest[live]
            if not len(sym):
                break
        place = np.flatnonzero(rank == lowest)
        # overlapping places (i, i + 1) share a symbol: keep every other one of a run
        run_start = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (word[place[1:]] != word[place[:-1]])])
        first = place[run_start][np.cumsum(run_start) - 1]
        place = place[(place - first) % 2 == 0]
        sym[place] = made[slot[place]]
        keep = np.ones(len(sym), bool)
        keep[place + 1] = False
        sym, word = sym[keep], word[keep]
    ids = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
    of = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
    order = np.argsort(of, kind="stable")
    return ids[order].astype(np.int32), np.bincount(of, minlength=len(words)).astype(np.int64)


class Encoder:
    """Encodes batches of texts and remembers the ids of the words it has seen."""

    def __init__(self, merges: dict[str, np.ndarray]):
        self.merges = merges
        self.split = regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.counts = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and the number of words of each text."""
        if len(self.index) > MEMORY_WORDS:
            self._forget()
        index, new, numbers, sizes = self.index, [], [], []
        for text in texts:
            words = self.split(text) if text else []
            for w in words:
                k = index.get(w)
                if k is None:
                    k = index[w] = len(index)
                    new.append(w)
                numbers.append(k)
            sizes.append(len(words))
        if new:
            # a lone surrogate is no text: it becomes the replacement character
            ids, counts = encode_words([w.encode("utf-8", "replace") for w in new], self.merges)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.ids = np.concatenate([self.ids, ids])
            self.counts = np.concatenate([self.counts, counts])
        return np.array(numbers, np.int64), np.array(sizes, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets): the ids of text i are flat[offsets[i]:offsets[i + 1]]."""
        numbers, sizes = self._words(texts)
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        inside = np.arange(total) - np.repeat(ends - counts, counts)
        flat = self.ids[np.repeat(self.starts[numbers], counts) + inside] if total else np.zeros(0, np.int32)
        word_ends = np.concatenate([[0], np.cumsum(sizes)])
        token_ends = np.concatenate([[0], ends])
        return flat, token_ends[word_ends].astype(np.int64)


def _shared(spark: SparkSession, folder: str | None):
    """The merge arrays as a broadcast: about 0.8 MB whatever the corpus, and only the driver needs the file."""
    path = os.path.join(folder or DEFAULT_FOLDER, VOCABULARY)
    return _broadcast(spark.sparkContext.applicationId, path, spark)


@lru_cache(maxsize=8)
def _broadcast(_application: str, path: str, spark: SparkSession):
    return spark.sparkContext.broadcast(load_merges(path))


def encode_texts(df: DataFrame, key: str, text: str, folder: str | None = None) -> DataFrame:
    """key and ids (array of int) of every row, without special tokens.

    A null or empty text has an empty list. Strings of special tokens in a text are ordinary text.
    The whole text is encoded whatever its length; repeated rows stay. Other columns are ignored.
    No shuffle: a row is encoded where it is read.
    """
    merges = _shared(df.sparkSession, folder)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):  # bounds the flat arrays when texts are long
                part = batch.slice(at, 1024)
                flat, offsets = encoder.encode(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def token_counts(df: DataFrame, text: str, columns: list[str], folder: str | None = None) -> DataFrame:
    """The given columns and `tokens` (long), the number of ids of each text; 0 for null and empty texts."""
    merges = _shared(df.sparkSession, folder)
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                _, offsets = encoder.encode(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(np.diff(offsets))], [*columns, "tokens"])

    return df.select(F.col(text).alias("_text"), *columns).mapInArrow(run, schema)
