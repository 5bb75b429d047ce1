import time

import numpy as np
import pyarrow as pa

from epochloom.llm.leaks import Index, LeakConfig, find_leaks
from epochloom.llm.words import flat_words, word_ids

RNG = np.random.default_rng(0)
WORDS = [f"w{k}" for k in range(400)]


def text(n, rng=RNG):
    return " ".join(rng.choice(WORDS, n))


P = [text(60) for _ in range(6)]
ITEMS = [(k, p) for k, p in enumerate(P)] + [(90, None), (91, ""), (92, "too short"), (None, text(40))]


def cut(p, a, b):
    return " ".join(P[p].split()[a:b])


def altered(t, at):
    w = t.split()
    for k in at:
        w[k] = "other"
    return " ".join(w)


CASES = [
    (1, text(200) + " " + P[0] + " " + text(100), {0}),
    (2, text(50) + " " + cut(1, 10, 36).upper().replace(" ", " ,  ") + "! " + text(50), {1}),
    (3, cut(2, 0, 15) + " " + text(40) + " " + cut(2, 15, 30), {2}),
    (4, cut(2, 15, 30) + " " + text(40) + " " + cut(2, 0, 15), set()),  # wrong order
    (5, cut(3, 0, 20), set()),  # too few words
    (6, altered(cut(3, 0, 40), [9, 20, 31]), {3}),
    (7, cut(4, 0, 14) + " [Interruption.] (Laughter) " + cut(4, 14, 30), {4}),
    (8, cut(4, 0, 30).replace(" ", " — (Interjection by X: \"Never!\") — ", 3), {4}),
    (9, P[0] + " " + P[5], {0, 5}),
    (10, None, set()), (11, "", set()), (12, "  ", set()), (13, text(30_000) + " " + P[1], {1}),
    (14, " ".join(cut(5, k, k + 4) + " " + text(6) for k in range(0, 56, 4)), set()),  # many short phrases
    (15, "w" * 1_000_000, set()), (1, text(20) + " " + P[0], {0}),
]


def test_find_leaks(spark):
    df = spark.createDataFrame([(d, t, 5) for d, t, _ in CASES] + [(None, P[0], 5)], "doc_id long, text string, item int")
    got = {(r.doc_id, r.item_id) for r in find_leaks(df.repartition(3), spark.createDataFrame(ITEMS, "item_id int, passage string"), key="doc_id", text="text").collect()}
    assert got == {(d, i) for d, _, want in CASES for i in want}


def test_search_finds_every_occurrence():
    index = Index(ITEMS)
    words, _ = flat_words(pa.array([text(5_000) + " " + P[0] + " " + P[3] + " " + text(3_000) + " " + P[0]]))
    ids = word_ids(words, index.vocabulary)
    start, pattern = index.search(ids)
    got = sorted((int(s), tuple(index.patterns[p])) for s, p in zip(start, pattern))
    known = {tuple(g) for g in index.patterns.tolist()}
    t = ids.tolist()
    assert got == [(k, tuple(t[k : k + 5])) for k in range(len(t) - 4) if tuple(t[k : k + 5]) in known] and len(got) > 150


def test_formulas_do_not_count():
    formula = text(20)
    items = [(k, formula + " " + text(40)) for k in range(4)]
    index = Index(items)
    assert index.leaks(pa.array([formula + " " + " ".join(items[0][1].split()[20:30]), items[1][1]])) == [(1, 1)]


def test_a_formula_inside_a_stretch_keeps_it_together():
    formula = text(20)
    own = [text(14) + " " + formula + " " + text(14) + " " + text(40) for _ in range(4)]
    words = own[0].split()
    two = " ".join(words[:48]) + " " + text(30) + " " + " ".join(words[60:75])  # with the formula two stretches, without it three
    assert Index(list(enumerate(own))).leaks(pa.array([two, formula])) == [(0, 0)]


def test_a_formula_that_very_many_passages_share_costs_nothing():
    rng = np.random.default_rng(4)
    formula = text(20, rng)
    index = Index([(k, text(10, rng) + " " + formula + " " + text(20, rng)) for k in range(2000)])
    texts = pa.array([text(100, rng) + " " + formula + " " + text(100, rng) for _ in range(300)])
    began = time.process_time()
    assert index.leaks(texts) == []
    assert time.process_time() - began < 1


def test_slices_give_the_same_as_the_whole(spark):
    rng = np.random.default_rng(6)
    formula = text(12, rng)
    passages = [text(20, rng) + " " + (formula if k % 3 == 0 else "") + " " + text(30, rng) for k in range(30)]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id int, passage string")
    docs = [(k, text(80, rng) + " " + " ".join(passages[k % 30].split()[5 : 20 + k]) + " " + formula + " " + text(50, rng)) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole, parts = ({(r.doc_id, r.item_id) for r in find_leaks(df, items, key="doc_id", text="text", cfg=LeakConfig(slice_bytes=b)).collect()} for b in (10**9, 2500))
    assert whole == parts and len(whole) > 15


def test_no_items_and_no_documents(spark):
    df = spark.createDataFrame([(1, P[0])], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id int, passage string")
    assert find_leaks(df, items.limit(0), key="doc_id", text="text").count() == 0
    assert find_leaks(df.limit(0), items, key="doc_id", text="text").count() == 0
