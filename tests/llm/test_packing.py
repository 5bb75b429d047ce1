import os

import numpy as np
import pytest

from epochloom.llm.packing import DEFAULT_RANKS, Capacity, best_fit, count_tokens, encoder, pack, pack_documents

needs_ranks = pytest.mark.skipif(not os.path.exists(DEFAULT_RANKS), reason="needs the vocabulary files")


def slow_best_fit(sizes, cap):
    """The same rule, one container after the other."""
    full = np.array([cap.tokens, cap.documents, cap.attention], float)
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        ask, best = np.array([sizes[i], 1, sizes[i] ** 2], float), None
        for k, r in enumerate(bins):
            if (r >= ask).all():
                score = (((r - ask) / full) ** 2 * np.array(cap.weights)).sum()
                best = (score, k) if best is None or score < best[0] - 1e-15 else best
        if best is None:
            bins.append(full - ask)
            out[i] = len(bins) - 1
        else:
            bins[best[1]] -= ask
            out[i] = best[1]
    return out, len(bins)


@pytest.mark.parametrize("cap", [Capacity(100), Capacity(100, documents=3), Capacity(100, attention=4000), Capacity(100, rule="dot")])
def test_best_fit_respects_every_capacity(cap):
    sizes = np.random.default_rng(0).integers(1, cap.tokens + 1, 400)
    at = best_fit(sizes, cap)
    for k in np.unique(at):
        s = sizes[at == k]
        assert s.sum() <= cap.tokens and len(s) <= cap.documents and (len(s) == 1 or (s.astype(float) ** 2).sum() <= cap.attention)
    if cap.rule == "norm":
        assert len(np.unique(at)) <= 1.02 * slow_best_fit(sizes.tolist(), cap)[1] + 1


def test_little_room_is_left():
    sizes = np.random.default_rng(1).lognormal(5, 1, 3000).astype(int).clip(1, 2048)
    at = best_fit(sizes, Capacity(2048, documents=128, attention=2048**2))  # tokens alone decide
    assert sizes.sum() / (2048 * len(np.unique(at))) > 0.99
    speeches = np.random.default_rng(1).lognormal(5.5, 0.8, 10_000).astype(int).clip(1, 2048)
    at = best_fit(speeches, Capacity(2048))
    assert speeches.sum() / (2048 * len(np.unique(at))) > 0.98


def test_every_capacity_of_the_default_binds():
    sizes = np.random.default_rng(1).lognormal(5, 1.2, 3000).astype(int).clip(1, 2048)
    full, free = Capacity(2048), {"documents": 2048, "attention": 2048**2}
    at = best_fit(sizes, full)
    for name in free:
        loose = best_fit(sizes, Capacity(2048, **{name: free[name]}))
        assert not np.array_equal(at, loose)
        count, cost = np.bincount(loose), np.bincount(loose, sizes.astype(float) ** 2)
        assert (count > full.documents).any() if name == "documents" else ((cost > full.attention) & (count > 1)).any()


def test_edges_of_best_fit():
    assert best_fit(np.zeros(0, int), Capacity(5)).size == 0
    assert len(set(best_fit(np.full(4, 5), Capacity(5)).tolist())) == 4
    for bad in ({"tokens": 0}, {"tokens": 5, "documents": 0}, {"tokens": 5, "rule": "x"}, {"tokens": 5, "attention": 0}):
        with pytest.raises(ValueError):
            Capacity(**bad)


@pytest.mark.parametrize("per_shard", [7, 20_000])
def test_pack_covers_every_token_once(spark, per_shard):
    rows = [(k, n) for k, n in enumerate([1, 5, 64, 64, 65, 200, 3, 0, None, -1, 128])] + [(2, 64)]
    out = pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), Capacity(64), key="doc_id", per_shard=per_shard).toPandas()
    for k, n in rows:
        mine = out[out.doc_id == k].sort_values(["piece", "token_start"])
        copies = sum(1 for r in rows if r[0] == k)
        assert mine.n_tokens.sum() == (n if n and n > 0 else 0) * copies
        if copies == 1 and n and n > 0:
            assert mine.token_start.tolist() == list(range(0, n, 64)) and mine.token_end.iloc[-1] == n
    assert (out.groupby(["shard", "container"]).n_tokens.sum() <= 64).all()


def test_nothing_to_pack(spark):
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long"), Capacity(64), key="doc_id").count() == 0


@needs_ranks
def test_texts(spark):
    rows = [(1, "Hello there", "k"), (2, None, "k"), (3, " \n\t", "k"), (4, "", "k"), (5, "word " * 50_000, "k"), (6, "<|endoftext|>", "k"), (7, "Hello there", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    n = {r.doc_id: r.n_tokens for r in count_tokens(df, key="doc_id", text="text").collect()}
    enc = encoder()
    assert n == {k: len(enc.encode_ordinary(t)) for k, t, _ in rows if t and t.strip()}
    out = pack_documents(df, Capacity(512), key="doc_id", text="text").toPandas()
    assert out.n_tokens.sum() == sum(n.values()) and (out[out.doc_id == 5].n_tokens == 512).sum() == n[5] // 512
