import math
import re
from collections import Counter

import numpy as np
import pytest
from gleaner.llm import tiered_search as T

DOCS, ITEMS = "doc_id long, text string, n int, score string", "item_id long, text string, rank int"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def plain(docs, items, k=50):
    """The contract's formula over every document."""
    own = [(i, d, Counter(words(t)), len(words(t))) for i, (d, t) in enumerate(docs) if words(t)]
    count, total = len(own), sum(x[3] for x in own)
    df = Counter(t for x in own for t in x[2])
    out = []
    for item, text in items:
        hits = []
        for row, d, tf, n in own:
            m = 100 - 50 + (50 * n * count) // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in set(words(text)) if tf[t])
            if s > 0:
                hits.append((-s, d is None, d or 0, row, d))
        out += [(item, r + 1, h[4], -h[0]) for r, h in enumerate(sorted(hits)[:k])]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(9)
    vocabulary = np.array([f"w{i}" for i in range(120)] + ["Ünï", "straße", "日本"])
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=weights / weights.sum()))
    docs = [(i, text(int(n))) for i, n in enumerate(rng.integers(1, 60, 400))]
    docs += [(1000 + i, docs[3][1]) for i in range(150)]  # copies
    docs += [(None, docs[5][1]), (7, docs[5][1]), (7, "W1,w2;W3"), (8, None), (9, ""), (10, "?!"), (11, "w4 " * 20_000), (12, "W0 Ünï\x00w1_w2")]
    items = [(i, text(6)) for i in range(30)] + [(3, "w1 w1 W1"), (40, None), (41, ""), (42, "unknown term"), (None, "straße 日本 w9"), (43, "w0")]
    return docs, items


def found(spark, docs, items, k=50):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS).repartition(3)
    return [tuple(r) for r in T.ranked_search(d, spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS), k).collect()]


@pytest.mark.parametrize("sizes", [{}, {"FIRST": 16, "BLOCK": 64, "ITEMS": 3, "BYTES": 2000}, {"FIRST": 4, "PAIRS": 40}])
@pytest.mark.parametrize("k", [50, 3])
def test_equals_scoring_every_document(spark, corpus, monkeypatch, sizes, k):
    for name, n in sizes.items():
        monkeypatch.setattr(T, name, n)
    assert Counter(found(spark, *corpus, k)) == Counter(plain(*corpus, k))


def test_items_are_proved_in_early_tiers(spark, corpus, monkeypatch):
    """Some items stop before the last tier and some fall through; what they read is no more than they need."""
    monkeypatch.setattr(T, "FIRST", 16)
    read = []
    raised = T._raised
    monkeypatch.setattr(T, "_raised", lambda lists, items, left, *rest: read.append(len(left)) or raised(lists, items, left, *rest))
    assert Counter(found(spark, *corpus, 3)) == Counter(plain(*corpus, 3))
    assert len(read) > 2 and read[0] > read[1] > read[-1] > 0


def test_tiers_hold_every_posting_once_and_bound_the_rest(spark, corpus, monkeypatch):
    monkeypatch.setattr(T, "FIRST", 16)
    docs = spark.createDataFrame([(i, t) for i, t in corpus[0]], "doc_id long, text string")
    vocabulary = [f"w{i}" for i in range(40)]
    forward = T._forward(docs, vocabulary).cache()
    count, total = forward.count(), sum(r.n for r in forward.collect())
    tiers = T.Tiers(T._bins(forward, count, total), len(vocabulary))
    lists = T._lists(forward, tiers, count, total).collect()
    postings = {}
    for r in lists:
        v = np.frombuffer(r.impacts, "<u4")
        assert (np.diff(v.astype(int)) <= 0).all()
        postings.setdefault(r.term, []).extend((r.tier, int(x)) for x in v)
    for r in forward.collect():
        assert set(r.terms) in [{i for i, w in enumerate(vocabulary) if w in words(t)} for d, t in corpus[0] if d == r.doc_id]
    for term, own in postings.items():
        assert len(own) == tiers.df[term]
        for depth in range(tiers.depth):
            below = [v for t, v in own if t > depth]
            assert max(below, default=0) == tiers.residual[depth][term]
            assert min((v for t, v in own if t <= depth), default=1 << 30) >= max(below, default=0) >> T.BIN_BITS << T.BIN_BITS
            assert sum(t <= depth for t, _ in own) >= min(len(own), 16 * 4**depth)


def test_nothing_to_search(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, "?"), (2, None)], [(1, "a")]) == []
    assert found(spark, [(1, "a a")], [(1, "b"), (2, None)]) == []


def test_what_is_broadcast_is_plain(spark, monkeypatch, corpus):
    """Executors need not have this package to read it."""
    import pickle

    from pyspark import SparkContext

    sent, send = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or send(self, value))
    found(spark, *corpus)
    assert sent and not any(b"gleaner" in x for x in sent)
