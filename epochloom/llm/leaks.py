"""Evaluation passages that leak into texts: multi-pattern search by shifting blocks of words.

The test strings are all sequences of ``gram`` words of the passages. The search is Wu and Manber's, over words instead
of bytes: a table over hashed blocks of ``block`` words says how far the window may move on without missing a test
string (a block that is in no test string moves it by ``gram - block + 1`` words); where it says zero, the hash of the
suffix block selects the test strings that may end here, and comparing their words confirms them. Many windows move at
once, one in each piece of a batch of texts, so the steps are vector operations.

Confirmed occurrences of one passage are chained to stretches that tolerate single altered, left out or added words,
and the best two stretches in order decide. It is a map over documents: no shuffle, no candidates left out. Words of
formulas don't count, so occurrences of test strings that are nothing but formula lead to no pair by themselves; they are
looked up again for the pairs that have enough words without them.

The tables of a slice of the passages are built once, on the driver, and shared as flat arrays. Passages of any number
are searched slice by slice; which words are formulas is counted over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochloom.llm.words import flat_words, word_ids
from epochloom.runtime import spill


@dataclass(frozen=True)
class LeakConfig:
    """``gram``: words of a test string; ``block``: words of a block; ``least``: words of a case; ``least_stretch``: words
    of the shorter of two stretches; ``slack``: words that may differ between two occurrences of one stretch;
    ``formula_gram``/``formula_items``: words in a sequence of so many words that stands in so many passages don't count;
    ``slice_bytes``: passages searched at a time (the tables take about 40 times as much memory)."""

    gram: int = 5
    block: int = 3
    least: int = 25
    least_stretch: int = 8
    slack: int = 3
    formula_gram: int = 7
    formula_items: int = 3
    bits: int = 20
    piece: int = 384
    chunk_chars: int = 4_000_000
    slice_bytes: int = 4_000_000
    most_pairs: int = 2_000_000


def _formulas(words: list[str], n: int) -> list[int]:
    """A signed 64-bit number of every sequence of ``n`` words."""
    return [xxhash.xxh3_64_intdigest(" ".join(words[j : j + n])) - 2**63 for j in range(len(words) - n + 1)]


class Index:
    """Shift table, suffix buckets and test strings of a set of passages, as flat arrays.

    ``formulas``: numbers (of :func:`_formulas`) of the sequences that count as formulas; by default those that stand
    in ``formula_items`` of these passages.
    """

    def __init__(self, items: list[tuple[int, str | None]], cfg: LeakConfig = LeakConfig(), formulas: np.ndarray | None = None):
        self.cfg, m, b = cfg, cfg.gram, cfg.block
        items = [(i, p) for i, p in items if i is not None and p]
        words, starts = flat_words(pa.array([p for _, p in items], pa.string()))
        self.vocabulary = words.unique()
        flat = word_ids(words, self.vocabulary)
        rng = np.random.default_rng(7)
        self.codes = rng.integers(1, 2**63 - 1, len(self.vocabulary) + 1, dtype=np.uint64)
        self.ids, self.starts = [i for i, _ in items], starts.astype(np.int64)
        owner = np.repeat(np.arange(len(items)), np.diff(starts))
        self.counts = np.ones(len(flat), bool)  # words that count, of all passages one after the other
        self._mute(words.to_pylist(), owner, formulas)
        self.counted = np.r_[0, np.cumsum(self.counts)]
        at = np.flatnonzero(owner[: len(flat) - m + 1] == owner[m - 1 :]) if len(flat) >= m else np.zeros(0, np.int64)
        grams = np.stack([flat[at + j] for j in range(m)], 1) if len(at) else np.zeros((0, m), np.int32)
        self.patterns, which = np.unique(grams, axis=0, return_inverse=True)
        suffix = self.hash(self.patterns[:, m - b :])
        order = np.argsort(suffix, kind="stable")
        self.patterns = self.patterns[order]
        which = np.argsort(order)[which.reshape(-1)]
        self.suffixes, self.bucket = np.unique(suffix[order], return_index=True)
        self.bucket = np.append(self.bucket, len(self.patterns))
        self.shift = np.full(1 << cfg.bits, m - b + 1, np.int8)
        for off in range(m - b, -1, -1):  # blocks that end nearer to the end of a test string allow smaller shifts
            h = self.hash(self.patterns[:, off : off + b]) >> np.uint64(64 - cfg.bits)
            np.minimum.at(self.shift, h.astype(np.int64), np.int8(m - b - off))
        # where test strings stand: those with a word that counts by test string, those without by passage
        live = self.counted[at + m] > self.counted[at]
        by = np.flatnonzero(live)[np.argsort(which[live], kind="stable")]
        self.where = np.searchsorted(which[by], np.arange(len(self.patterns) + 1))
        self.where_item, self.where_at = owner[at[by]], at[by]
        mute = np.flatnonzero(~live)
        self.mute = np.searchsorted(owner[at[mute]], np.arange(len(items) + 1))
        self.mute_pattern, self.mute_at = which[mute], at[mute]

    def _mute(self, words: list[str], owner: np.ndarray, formulas: np.ndarray | None) -> None:
        n = self.cfg.formula_gram
        number, at = [], []
        for a, e in zip(self.starts[:-1].tolist(), self.starts[1:].tolist()):
            number += _formulas(words[a:e], n)
            at += range(a, max(a, e - n + 1))
        number, at = np.array(number, np.int64), np.array(at, np.int64)
        if formulas is None:
            pairs = np.unique(np.stack([number, owner[at]], 1), axis=0)[:, 0] if len(at) else number
            same, times = np.unique(pairs, return_counts=True)
            formulas = same[times >= self.cfg.formula_items]
        for k in at[np.isin(number, formulas)].tolist():
            self.counts[k : k + n] = False

    def hash(self, blocks: np.ndarray) -> np.ndarray:
        """Hash of rows of word ids; -1 is the last code."""
        h = np.zeros(len(blocks), np.uint64)
        for j in range(blocks.shape[1]):
            h = (h ^ self.codes[blocks[:, j]]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, test string) of every occurrence in a sequence of word ids."""
        cfg, m, b, n = self.cfg, self.cfg.gram, self.cfg.block, len(text)
        none = np.zeros(0, np.int64)
        if n < m or not len(self.patterns):
            return none, none
        # the hash of the block that ends at each position, and the shift it allows
        windows = np.lib.stride_tricks.sliding_window_view(text, b)
        hashes = self.hash(windows)
        shifts = self.shift[(hashes >> np.uint64(64 - cfg.bits)).astype(np.int64)]
        first = np.arange(m - b, n - b + 1, cfg.piece)  # a window's last block starts here
        last = np.minimum(first + cfg.piece, n - b + 1)
        at, found = first.copy(), []
        while len(at):
            s = shifts[at]
            zero = s == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(s, 1)
            live = at < last
            at, last = at[live], last[live]
        if not found:
            return none, none
        ends = np.sort(np.concatenate(found))
        key = hashes[ends]
        slot = np.searchsorted(self.suffixes, key)
        slot[slot == len(self.suffixes)] = 0
        keep = self.suffixes[slot] == key
        ends, slot = ends[keep], slot[keep]
        size = self.bucket[slot + 1] - self.bucket[slot]
        total = int(size.sum())
        if not total:
            return none, none
        pattern = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.bucket[slot], size)
        start = np.repeat(ends, size) - (m - b)
        same = np.ones(total, bool)
        for j in range(m):
            same &= text[start + j] == self.patterns[pattern, j]
        return start[same], pattern[same]

    def decide(self, hits: list[tuple[int, int]], item: int) -> bool:
        """Whether occurrences (word of the text, word of the passage) of one passage make a case."""
        cfg, m = self.cfg, self.cfg.gram
        done, live = [], []  # a stretch: text start, text end, passage start, passage end, passage words seen
        for k, q in hits:
            stay, best = [], None
            for r in live:
                (stay if k - r[1] <= cfg.slack else done).append(r)
            live = stay
            for r in live:
                over_k, over_q = k - r[1], q - r[3]
                if -m < over_q <= cfg.slack and q > r[5] and abs(over_k - over_q) <= 2 and (best is None or abs(over_k - over_q) < best[0]):
                    best = (abs(over_k - over_q), r)
            if best:
                r = best[1]
                r[4].extend(range(max(q, r[3]), q + m))
                r[1], r[3], r[5] = k + m, q + m, q
            else:
                live.append([k, k + m, q, q + m, list(range(q, q + m)), q])
        done += live
        counts = self.counts[self.starts[item] : self.starts[item + 1]]
        scored = sorted(((int(counts[np.array(r[4])].sum()), r) for r in done if len(r[4]) >= cfg.least_stretch), key=lambda x: -x[0])
        if not scored:
            return False
        if scored[0][0] >= cfg.least:
            return True
        for i, (a, r) in enumerate(scored):
            for c, t in scored[i + 1 :]:
                if a + c < cfg.least:
                    break
                lo, hi = (r, t) if r[0] <= t[0] else (t, r)
                if hi[0] >= lo[1] - 1 and hi[2] >= lo[3] - 1:
                    return True
        return False

    def leaks(self, texts: pa.Array) -> list[tuple[int, int]]:
        """(text, item) pairs of a batch that are a case."""
        cfg, m = self.cfg, self.cfg.gram
        words, starts = flat_words(texts)
        ids = word_ids(words, self.vocabulary)
        # texts one after the other, with separators so that nothing matches across
        gap = np.arange(len(starts) - 1).repeat(np.diff(starts))
        text = np.full(len(ids) + m * len(starts), -1, np.int32)
        text[np.arange(len(ids)) + m * gap] = ids
        start, pattern = self.search(text)
        if not len(start):
            return []
        # runs of covered words, of whatever passage, that are too short for even the longer of two stretches go
        spots = np.unique(start)
        run = np.concatenate([[0], np.cumsum(np.diff(spots) > m + cfg.slack)])
        length = spots[np.r_[np.flatnonzero(np.diff(run)), len(run) - 1]] - spots[np.r_[0, np.flatnonzero(np.diff(run)) + 1]] + m
        fit = length[run[np.searchsorted(spots, start)]] >= cfg.least_stretch
        start, pattern = start[fit], pattern[fit]
        begins = starts[:-1] + m * np.arange(len(starts) - 1)
        doc = np.searchsorted(begins, start, side="right") - 1
        ends = np.searchsorted(doc, np.arange(len(starts)))
        found: list[tuple[int, int]] = []
        for a, e in self._portions(pattern, ends):
            found += self._pairs(doc[a:e], start[a:e], pattern[a:e])
        return found

    def _portions(self, pattern: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """Occurrences of some texts at a time, so that not too many pairs with passages are looked at at once."""
        pairs = np.r_[0, np.cumsum(self.where[pattern + 1] - self.where[pattern])][ends] // self.cfg.most_pairs
        cuts = np.r_[0, np.flatnonzero(np.diff(pairs)) + 1, len(ends) - 1]
        for a, e in zip(ends[cuts[:-1]], ends[cuts[1:]]):
            if e > a:
                yield int(a), int(e)

    def _pairs(self, doc: np.ndarray, start: np.ndarray, pattern: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) pairs that are a case, of all occurrences (in order) in some texts."""
        m, items = self.cfg.gram, len(self.ids)
        size = self.where[pattern + 1] - self.where[pattern]
        spot = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - self.where[pattern], size)
        k, q, pair = np.repeat(start, size), self.where_at[spot], np.repeat(doc, size) * items + self.where_item[spot]
        order = np.lexsort((q, pair))
        pair, q, k = pair[order], q[order], k[order]
        # words of the passage that count and are met: a necessary condition
        before = np.where(np.r_[True, pair[1:] != pair[:-1]], q, np.r_[0, q[:-1] + m]) if len(q) else q
        gain = self.counted[q + m] - self.counted[np.clip(before, q, q + m)]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(q) else q
        enough = np.add.reduceat(gain, first) >= self.cfg.least if len(q) else np.zeros(0, bool)
        found, ends = [], np.r_[first, len(q)]
        for i in np.flatnonzero(enough).tolist():
            a, e = ends[i], ends[i + 1]
            d, item = divmod(int(pair[a]), items)
            x, y = np.searchsorted(doc, [d, d + 1])
            # formulas between them keep stretches together
            mutes = slice(self.mute[item], self.mute[item + 1])
            hits = list(zip(k[a:e].tolist(), (q[a:e] - self.starts[item]).tolist()))
            for p, at in zip(self.mute_pattern[mutes].tolist(), self.mute_at[mutes].tolist()):
                hits += [(s, at - int(self.starts[item])) for s in start[x:y][pattern[x:y] == p].tolist()]
            if self.decide(sorted(hits), item):
                found.append((d, self.ids[item]))
        return found


def find_leaks(documents: DataFrame, items: DataFrame, *, key: str, text: str, item: str = "item_id", passage: str = "passage", cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """Distinct (``key``, ``item``): the text holds at least ``least`` words of the item's passage.

    The words must come in the passage's order, in at most two stretches; case, punctuation, spacing, bracketed insertions
    and single altered words don't count, nor do words of formulas that several passages share. Items (whose ids must be unique)
    are searched in slices of about ``slice_bytes`` of passages, each of which every task gets; documents are read once
    a slice. Null and blank texts and passages, and passages shorter than a test string, have no case. Whole
    texts are searched, of any length. Further columns are ignored.
    """
    spark, kind, item_kind = documents.sparkSession, documents.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    wanted = items.select(items[item].alias("i"), items[passage].alias("p")).where("i is not null and p is not null")
    count = max(1, -(-(wanted.agg(F.sum(F.octet_length("p"))).first()[0] or 0) // cfg.slice_bytes))
    wanted = wanted.withColumn("slice", F.pmod(F.xxhash64("i"), F.lit(count)).cast("int"))
    formulas = None
    if count > 1:
        wanted = spill(wanted)
        formulas = spill(_shared_formulas(wanted, cfg))
    rows = documents.select(documents[key].alias("key"), documents[text].alias("text")).where("text is not null and key is not null")
    out = None
    for n in range(count):
        mine = [(r["i"], r["p"]) for r in wanted.where(F.col("slice") == n).select("i", "p").orderBy("i").collect()]
        known = None if formulas is None else np.array([r["f"] for r in formulas.where(F.col("slice") == n).select("f").collect()], np.int64)
        one = rows.mapInArrow(_search(spark.sparkContext.broadcast(Index(mine, cfg, known)), item_kind), f"key {kind}, item {item_kind}")
        out = one if out is None else out.unionByName(one)
    return out.toDF(key, item)


def _search(shared, item_kind: str):
    """The map over documents with the shared tables of one slice."""
    kind = pa.int32() if item_kind == "int" else pa.int64() if item_kind == "bigint" else pa.string()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = shared.value
            for part in slices(batch, 1, index.cfg.chunk_chars):
                found = index.leaks(part.column(1))
                keys = part.column(0).take(pa.array([d for d, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([i for _, i in found], kind)], ["key", "item"])

    return search


def _shared_formulas(wanted: DataFrame, cfg: LeakConfig) -> DataFrame:
    """(``slice``, ``f``): formulas, counted over the passages of all slices, in each slice that has them."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, starts = flat_words(batch.column(1))
            words = words.to_pylist()
            lists = [_formulas(words[a:e], cfg.formula_gram) for a, e in zip(starts[:-1].tolist(), starts[1:].tolist())]
            at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array([f for x in lists for f in x], pa.int64())], ["i", "slice", "f"])

    kind = wanted.schema["i"].dataType.simpleString()
    numbers = wanted.mapInArrow(number, f"i {kind}, slice int, f bigint").distinct()
    shared = numbers.groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") >= cfg.formula_items).select("f")
    return numbers.select("slice", "f").distinct().join(shared, "f", "left_semi")


def slices(batch: pa.RecordBatch, column: int, most_chars: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most_chars`` of text, a text never cut."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
    part = np.cumsum(sizes) // most_chars
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
