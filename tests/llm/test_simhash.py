import numpy as np
import xxhash
from gleaner.llm import simhash as S


def brute_fingerprint(text):
    words = [w for w in text.encode().lower().replace(b"\x0b", b" ").split() if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_groups(fps):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}é" for i in range(60)] + ["THE", "The"]
    texts = [" ".join(rng.choice(vocabulary, 200)) for _ in range(60)]
    for t in list(texts):
        words = t.split()
        for _ in range(3):
            words[int(rng.integers(0, len(words)))] = "changed"
            texts.append("\n".join(words))
    texts += ["", None, " \t\n", "one", "one two", "ONE  two", "one two three", "a b c d", texts[0], texts[0]]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    fps = [brute_fingerprint(t or "") for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i].component_id for i in range(len(texts))] == brute_groups(fps)


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 20)
    rng = np.random.default_rng(6)
    near = {0x1234567890ABCDEF ^ sum(1 << int(k) for k in rng.choice(64, 3)) for _ in range(150)}
    fps = sorted(near | {int(x) for x in rng.integers(0, 1 << 63, 200)})
    frame = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    links = [(r.u, r.v) for r in S.fingerprint_links(frame).collect()]
    index = {S._signed(x): i for i, x in enumerate(fps)}
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in links:
        a, b = find(index[u]), find(index[v])
        up[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == brute_groups(fps)


def test_bit_sliced_links_equal_pairwise():
    rng = np.random.default_rng(1)
    run = np.sort(rng.integers(0, 6, 500))
    base = rng.integers(0, 1 << 63, 6).astype(np.uint64)
    fps = np.array([int(base[r]) ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 5)))) for r in run], np.uint64)
    a, b = S.links(run, fps)
    root = list(range(500))
    for x, y in zip(a, b, strict=True):
        root[x] = y
    want = brute_groups_in(run, fps)
    assert root == want


def brute_groups_in(run, fps):
    out = list(range(len(fps)))
    for r in set(run.tolist()):
        own = np.flatnonzero(run == r)
        for i, g in zip(own, brute_groups([int(fps[k]) for k in own]), strict=True):
            out[i] = int(own[g])
    return out


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_verified_similarity(spark, monkeypatch):
    from gleaner.llm import verified

    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for size in (60, 100, 200, 400) * 8:
        own = rng.choice(vocabulary, size)
        texts.append(" ".join(own))
        for edits in (size // 50, size // 60 or 1, size // 25, size // 12):  # similarity from about 0.8 to 0.9, and below 0.8
            copy = own.copy()
            copy[rng.choice(size, edits, replace=False)] = [f"z{rng.integers(1 << 30)}" for _ in range(edits)]
            texts.append(" ".join(copy))
    texts += ["", None, "one two", "One  two", "one two three"]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i] or "", texts[j] or "") >= 0.8:
                up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    assert sum(x != i for i, x in enumerate(up)) > 50 and len(set(up)) > 60
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (1024, 2):
        monkeypatch.setattr(verified, "PART_ROWS", rows)
        got = {r.doc_id: r.component_id for r in S.near_duplicates(frame, 20, 5, 0.8).collect()}
        assert [got[i] for i in range(len(texts))] == up


def test_join_of_one_large_group():
    from gleaner.llm import verified

    rng = np.random.default_rng(3)
    base = np.arange(100, dtype=np.uint64) << np.uint64(50)
    sets = [np.unique(np.r_[np.delete(base, rng.integers(0, 100, int(rng.integers(1, 25)))), rng.integers(0, 1 << 60, int(rng.integers(0, 8))).astype(np.uint64)]) for _ in range(120)]
    up = list(range(120))
    for i in range(120):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    mine = list(range(120))
    for x, y in verified.join(sets, 0.8):
        mine = [min(mine[x], mine[y]) if z in (mine[x], mine[y]) else z for z in mine]
    assert mine == up


def test_null_ids_and_very_long_texts(spark):
    from gleaner.llm.simhash import near_duplicates

    long = "some words of a long text " * 60_000
    rows = [(None, "a b c d"), (7, "a b c d"), (None, "alone in its group"), (3, long), (9, long), (2, None), (1, " \n")]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (0, 7), (1, 1), (2, 1), (3, 3), (7, 7), (9, 3)]
