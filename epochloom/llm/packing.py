"""Texts of varying length into containers of fixed capacity, by vector best-fit.

An item asks for three things: tokens, one document slot, and attention cost (the square of its tokens). Items are taken
in order of decreasing size; each goes to the open container that it fits under every capacity and that then has the
smallest weighted residual norm (or the largest weighted dot product of residual and demand), or to a new one. Only a
text that exceeds the capacity is cut, into full pieces and a rest.

Items are spread by hash over shards of about ``per_shard`` items, which are packed side by side; the price is at most
the last, partly filled containers of each shard.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochloom.llm.leaks import slices
from epochloom.runtime import spill

#: How the byte-level vocabulary splits text before its merges.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_LOADED: dict[tuple[str, str], object] = {}


def encoder(path: str = DEFAULT_RANKS, pattern: str = BYTE_PATTERN):
    """The tokenizer of a file of ranks, loaded once a process. Special tokens' strings are ordinary text."""
    if (path, pattern) not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[path, pattern] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path, pattern]


def count_tokens(documents: DataFrame, *, key: str, text: str, ranks: str = DEFAULT_RANKS, pattern: str = BYTE_PATTERN) -> DataFrame:
    """(``key``, ``n_tokens``) of every text that isn't null or blank; ``ranks`` is read on every executor."""
    kind = documents.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern)
        for batch in batches:
            for part in slices(batch, 1, 8_000_000):
                n = [len(enc.encode_ordinary(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["key", "n_tokens"])

    rows = documents.select(documents[key].alias("key"), documents[text].alias("text")).where(F.col("text").rlike(r"(?U)\S"))
    return rows.mapInArrow(count, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)


@dataclass(frozen=True)
class Capacity:
    """What a container holds: ``tokens``, ``documents`` (by default one per 64 tokens) and ``attention`` (by default
    three quarters of ``tokens ** 2``). ``rule`` is ``norm`` or ``dot``.

    Attention over separate texts costs the sum of their squared sizes, which is never above ``tokens ** 2``: only
    a smaller budget says anything. A text that is within ``tokens`` but by itself above the attention budget isn't cut; it
    gets a container of its own.
    """

    tokens: int
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.1, 0.2)
    rule: str = "norm"

    def __post_init__(self):
        if self.tokens < 1 or (self.documents is not None and self.documents < 1) or (self.attention is not None and self.attention < 1) or self.rule not in ("norm", "dot"):
            raise ValueError("capacities must be positive and rule 'norm' or 'dot'")
        object.__setattr__(self, "attention", max(1, 3 * self.tokens**2 // 4) if self.attention is None else self.attention)
        object.__setattr__(self, "documents", max(1, self.tokens // 64) if self.documents is None else self.documents)


def best_fit(sizes: np.ndarray, cap: Capacity) -> np.ndarray:
    """Container number of every item (sizes in tokens, none above ``cap.tokens``)."""
    n = len(sizes)
    out = np.empty(n, np.int64)
    order = np.argsort(-sizes, kind="stable")
    room = np.empty((3, 256))  # tokens, documents and attention cost left, of the open containers
    name = np.empty(256, np.int64)
    used = made = 0
    full = np.array([cap.tokens, cap.documents, cap.attention], float)
    scale = np.array(cap.weights)[:, None] ** 0.5 / full[:, None]
    smallest = float(sizes.min()) if n else 0.0
    for i in order.tolist():
        size = float(sizes[i])
        ask = np.array([[size], [1.0], [size * size]])
        r = room[:, :used]
        fits = np.flatnonzero((r >= ask).all(axis=0))
        if len(fits):
            left = r[:, fits]
            score = (((left - ask) * scale) ** 2).sum(axis=0) if cap.rule == "norm" else -((left * scale) * (ask * scale)).sum(axis=0)
            at = int(fits[np.argmin(score)])
        else:
            if used == room.shape[1]:
                room, name = np.concatenate([room, np.empty_like(room)], axis=1), np.concatenate([name, np.empty_like(name)])
            at, used = used, used + 1
            room[:, at], name[at] = full, made
            made += 1
        room[:, at] -= ask[:, 0]
        out[i] = name[at]
        if room[0, at] < smallest or room[1, at] < 1 or room[2, at] < smallest * smallest:  # nothing fits any more
            used -= 1
            room[:, at], name[at] = room[:, used], name[used]
    return out


def pack(tokens: DataFrame, cap: Capacity, *, key: str, size: str = "n_tokens", per_shard: int = 20_000) -> DataFrame:
    """One row per text or piece: ``key``, ``piece``, ``token_start``, ``token_end``, ``n_tokens``, ``shard``, ``container``.

    A container is named by (``shard``, ``container``). Rows with null or non-positive size hold nothing and are left out; equal
    keys are items of their own. The result depends on keys and sizes only; the number of shards is that of the items by
    ``per_shard``, so which texts share a container depends on how many there are.
    """
    kind = tokens.schema[key].dataType.simpleString()
    rows = tokens.where(F.col(size) > 0).select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("n"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(cap.tokens).cast("bigint"))
    items = rows.select("key", "n", F.posexplode(starts).alias("piece", "a")).withColumn("b", F.least("n", F.col("a") + cap.tokens))
    items = items.select("key", "piece", F.col("a").alias("token_start"), F.col("b").alias("token_end"), (F.col("b") - F.col("a")).alias("n_tokens"))
    shards = max(1, -(-items.count() // per_shard))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "key", "piece"], ascending=[False, True, True], kind="stable")
        return pdf.assign(container=best_fit(pdf["n_tokens"].to_numpy(), cap))

    placed = items.withColumn("shard", F.pmod(F.xxhash64("key", "piece"), F.lit(shards)).cast("int"))
    fields = f"key {kind}, piece int, token_start bigint, token_end bigint, n_tokens bigint, shard int, container bigint"
    # a task a shard: small shards would otherwise be merged into few tasks
    return placed.repartition(shards, "shard").groupBy("shard").applyInPandas(fill, fields).withColumnRenamed("key", key)


def pack_documents(documents: DataFrame, cap: Capacity, *, key: str, text: str, ranks: str = DEFAULT_RANKS, pattern: str = BYTE_PATTERN) -> DataFrame:
    """:func:`count_tokens`, then :func:`pack`; texts are read and tokenised once."""
    return pack(spill(count_tokens(documents, key=key, text=text, ranks=ranks, pattern=pattern)), cap, key=key)
