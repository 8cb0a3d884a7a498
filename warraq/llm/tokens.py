"""Sizes of documents in tokens of a public tokenizer, and their place on a space-filling curve."""

from __future__ import annotations

import base64
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: A file of ranks for byte-level BPE; a parameter of every operator that needs sizes.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE of this kind cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The curve's dimensions and bits each; the key has their product of bits.
DIMENSIONS, BITS = 4, 8


def encoder(ranks: bytes):
    """The tokenizer of a rank file's bytes."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def hilbert(point: list[int], bits: int = BITS) -> int:
    """The index of a grid point along the Hilbert curve (the transposed form is taken apart and its bits interleaved)."""
    x, n = list(point), len(point)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    q = top
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    key = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> b & 1)
    return key


def projection(size: int, dimensions: int = DIMENSIONS, seed: int = 7) -> np.ndarray:
    """A fixed random direction per token."""
    return np.random.default_rng(seed).standard_normal((size, dimensions)).astype(np.float32)


def grid(total: np.ndarray, n: int) -> list[int]:
    """The grid cell of a document whose n distinct tokens' directions add up to ``total``."""
    return [min((1 << BITS) - 1, int((1 << BITS) * 0.5 * (1 + math.erf(float(v) / math.sqrt(2.0 * max(n, 1)))))) for v in total]


def sized(documents: DataFrame, path: str = TOKENIZER, curve: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, key, *keep): a document's tokens and its key on the curve; null texts have 0 tokens and the key 0.

    Documents aren't deduplicated here: rows of the result are small, texts are not.
    """
    with open(path, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())  # one public tokenizer's file, about a megabyte

    def start():
        tokenizer = encoder(ranks.value)
        encode = tokenizer.encode_to_numpy
        table = projection(tokenizer.n_vocab) if curve else None

        def work(c: dict) -> dict:
            sizes, keys = [], []
            for text in c["text"]:
                ids = encode(text, disallowed_special=()) if text else np.empty(0, np.uint32)
                sizes.append(len(ids))
                if not curve or not len(ids):
                    keys.append(0)
                    continue
                own = np.unique(ids)
                keys.append(hilbert(grid(table[own].sum(0), len(own))))
            return {"doc_id": c["doc_id"], "n_tokens": sizes, "key": keys} | {k: c[k] for k in keep}

        return work

    kinds = "".join(f", {k} {dict(documents.dtypes)[k]}" for k in keep)
    return arrow_map(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep), start, "doc_id long, n_tokens long, key long" + kinds)
