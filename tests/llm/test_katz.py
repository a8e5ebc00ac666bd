import math
import time
from collections import Counter

import numpy as np
import pytest
from gleaner.llm import katz as M

SCHEMA = "doc_id long, text string, learn boolean, score string"


def good_turing(counts, most=5):
    """Discounts by count from the counts of counts: r* / r, scaled so that counts above the last one keep all."""
    n = Counter(counts)
    for top in range(most, 0, -1):
        if all(n[r] for r in range(1, top + 2)):
            common = (top + 1) * n[top + 1] / n[1]
            star = {r: (r + 1) * n[r + 1] / n[r] for r in range(1, top + 1)}
            d = {r: (star[r] / r - common) / (1 - common) if common != 1 else -1 for r in star}
            if common < 1 and all(0 < x < 1 for x in d.values()):
                return d
    return {r: (r - 0.5) / r for r in range(1, most + 1)}


class Brute:
    """The definition, in dictionaries, for n-grams of any length."""

    def __init__(self, texts, order=3):
        self.order = order
        self.c = [Counter() for _ in range(order + 1)]  # c[k]: k-grams
        for d in map(self.tokens, texts):
            row = ["<s>", *d]
            for k in range(1, order + 1):
                self.c[k].update(tuple(row[i - k + 1 : i + 1]) for i in range(1, len(row)) if i - k + 1 >= 0)
        self.c1 = Counter({w: n for (w,), n in self.c[1].items()})
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        self.d = [None, *(good_turing(self.c[k].values()) for k in range(1, order + 1))]
        self.after = [None, *({} for _ in range(order))]
        for k in range(2, order + 1):
            for g, n in self.c[k].items():
                self.after[k].setdefault(g[:-1], {})[g[-1]] = n
        left = sum(n - self.kept(1, n) for n in self.c1.values())
        self.all = self.n if left > 0 else self.n + 1
        self.unknown = (left or 1) / self.all if self.n else 1.0

    @staticmethod
    def tokens(text):
        return [*(w.decode() for w in (text or "").encode().lower().split()), "</s>"]

    def kept(self, k, n):
        return self.d[k].get(n, 1) * n

    def p(self, h, w):
        if not h:
            return self.kept(1, self.c1[w]) / self.all if self.c1[w] else self.unknown
        after = self.after[len(h) + 1].get(h)
        if after is None:
            return self.p(h[1:], w)
        whole = sum(after.values())
        missing = sum(n - self.kept(len(h) + 1, n) for n in after.values())
        if missing <= 1e-12:
            missing, whole = 1, whole + 1
        if w in after:
            return self.kept(len(h) + 1, after[w]) / whole
        return missing / whole / (1 - sum(self.p(h[1:], x) for x in after)) * self.p(h[1:], w)

    def score(self, text):
        row = ["<s>", *self.tokens(text)]
        return sum(math.log10(self.p(tuple(row[max(0, i - self.order + 1) : i]), row[i])) for i in range(1, len(row)))


def corpus(n):
    rng = np.random.default_rng(9)
    zipf = lambda: f"w{min(int(rng.zipf(1.4)), 400)}"
    texts = [" ".join("Token = x" if rng.random() < 0.05 else zipf() for _ in range(int(rng.integers(0, 60)))) for _ in range(n)]
    return texts + [None, "", "  ", "é É  x", texts[0], texts[0], "new words only here"]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_against_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(M, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(M, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(M, "ROW_BYTES", 1)
    texts = corpus(120)
    rows = [(i, t, i % 4 != 1, "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in M.score(spark.createDataFrame(rows, SCHEMA).repartition(3), order).collect()}
    b = Brute([t for _, t, learn, _ in rows if learn], order)
    assert len(got) == len(rows)
    for i, t, learn, _ in rows:
        tokens = b.tokens(t)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.learn) == (len(tokens), sum(b.c1[w] > 0 for w in tokens), b.n, learn)
        assert math.isclose(r.base_score, sum(math.log10((b.c1[w] + 1) / (b.n + b.v + 1)) for w in tokens), rel_tol=1e-9)
        assert math.isclose(r.score, b.score(t), rel_tol=1e-9, abs_tol=1e-9), i


def test_good_turing_discounts():
    for counts in ([1] * 90 + [2] * 40 + [3] * 20 + [4] * 12 + [5] * 8 + [6] * 5 + [50], [1] * 9 + [2] * 4, [1] * 9 + [2] * 9, [], [7, 7]):
        n = Counter(counts)
        assert np.allclose(M.discounts([n[r] for r in range(1, M.K + 2)])[1 : M.K + 1], [good_turing(counts).get(r, 1) for r in range(1, M.K + 1)])


def test_probabilities_add_up_to_one():
    b = Brute(corpus(120))
    words = list(b.c1)
    for h in [("<s>",), ("w1",), ("no such word",), ("no", "such"), ("<s>", "w1"), ("w1", "w1"), ("w2", "w1"), ("token", "="), *list(b.after[3])[:10]]:
        assert math.isclose(sum(b.p(h, w) for w in words) + b.p(h, "unknown!"), 1, rel_tol=1e-9)


def test_odd_ids_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BYTES", 20000)
    top = (1 << 63) - 1
    rows = [(None, "a b c", True, ""), (top, "a b d", True, ""), (5, "a b c " * 30000, True, ""), (None, None, None, ""), (6, "x" * 300000 + " a b", False, "")]
    got = M.score(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == [(False, 5, 90001), (False, 6, 4), (False, top, 4), (True, 0, 1), (True, 0, 4)]
    b = Brute([t for _, t, learn, _ in rows if learn])
    assert all(math.isclose(r.score, b.score(t), rel_tol=1e-9) for i, t, *_ in rows[1:3] + rows[4:] for r in got if r.doc_id == i)


def test_nothing_to_learn_and_empty(spark):
    out = M.score(spark.createDataFrame([(1, "a b", False, ""), (2, None, None, "")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert M.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_work_of_a_block_is_a_few_sorts():
    """The questions of a block, over both passes, and its n-grams cost no more than a few sorts of its tokens."""
    rng = np.random.default_rng(4)
    words = np.array([f"w{x}" for x in range(60000)])
    rows = [(i, " ".join(words[np.minimum(rng.zipf(1.3, 500), 60000) - 1]).encode(), i % 7 != 2) for i in range(1500)]
    data = M.encode(rows)
    tokens = rng.integers(0, 1 << 63, 500 * 1500)

    def least(work, times=3):
        took = []
        for _ in range(times):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    sort = least(lambda: np.argsort(tokens, kind="stable"))
    for k in (2, 3):
        assert least(lambda k=k: [list(M.ask_counts(k, 8, a, a + 4)(data, [])) for a in (0, 4)]) < 5 * sort


def test_words_are_split_at_the_same_bytes():
    """Blanks of other scripts, control characters and broken UTF-8 are parts of words; empty words are none."""
    rng = np.random.default_rng(5)
    bits = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"a", b"B", "É".encode(), "\xa0".encode(), "\u2003".encode(), b"\x1c", b"\x85", b"\x00", b"\xff"]
    texts = [None, b"", b" ", *(b"".join(bits[i] for i in rng.integers(0, len(bits), rng.integers(0, 20))) for _ in range(500))]
    _, _, sizes, tokens, steps = M.unpack_arrays(M.encode([(i, t, True) for i, t in enumerate(texts)]))
    keys = M.unpack_keys(steps)[tokens]
    want = [[M.xxhash.xxh64_intdigest(w, 42) for w in (t or b"").lower().split()] + [int(M.END_KEY)] for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert keys.tolist() == [x for w in want for x in w]
