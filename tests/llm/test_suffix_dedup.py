import hashlib

import numpy as np
from gleaner.llm import suffix_dedup as S


def brute(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = np.random.default_rng(seed)
    say = lambda n: "".join(rng.choice(list("abcé \n"), n))
    shared = [say(int(n)) for n in (49, 50, 51, 60, 120, 400)]
    texts = []
    for i in range(70):
        parts = [say(int(rng.integers(0, 200)))]
        for _ in range(int(rng.integers(0, 4))):
            s = shared[int(rng.integers(0, 6))]
            cut = int(rng.integers(0, max(1, len(s) // 3)))
            parts += [s[cut:], say(int(rng.integers(0, 60)))]
        texts.append("".join(parts))
    texts += [None, "", "x" * 49, "x" * 50, "x" * 300, "ab" * 200, "ab" * 90, "x" * 51, texts[3], texts[3] + "y", "\0" * 120, "\0" * 60, shared[5] * 3]
    order = rng.permutation(len(texts))
    return [(int(order[i]), t) for i, t in enumerate(texts)] + [(int(order[3]), texts[3])]


def test_against_brute_force(spark, monkeypatch):
    for seed, piece, hot in ((1, 1 << 19, 32), (2, 97, 0), (3, 1 << 19, 1)):
        monkeypatch.setattr(S, "PIECE", piece)
        monkeypatch.setattr(S, "HOT", hot)
        monkeypatch.setattr(S, "BLOCK_BYTES", 800)
        monkeypatch.setattr(S, "ROW_BYTES", 1)
        monkeypatch.setattr(S, "BUCKET_BYTES", 3000)
        monkeypatch.setattr(S, "AT_ONCE", 500)
        rows = corpus(seed)
        frame = spark.createDataFrame([(d, t, "kept", 1) for d, t in rows], "doc_id long, text string, kept string, n_bytes int").repartition(3)
        got = S.digest(S.remove_repeats(frame)).collect()
        assert sorted(tuple(r) for r in got) == brute(rows)


def test_sql_agrees(spark, tmp_path):
    import duckdb
    from gleaner.llm.sql import suffix_dedup_sql

    rows = [r for i, r in enumerate(corpus(4)) if r[0] not in {x for x, _ in corpus(4)[:i]}]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(con.sql(suffix_dedup_sql()).fetchall()) == brute(rows)


def test_suffix_classes():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.tile(rng.integers(97, 99, 60), 5), rng.integers(97, 98, 300), rng.integers(97, 99, 900), np.tile(rng.integers(97, 99, 33), 40)]).astype(np.uint8)
    text = np.concatenate([text, text[200:700], np.zeros(8, np.uint8)])
    base = np.arange(len(text) - 58)
    order, of = S.sort_suffixes(text, base)
    assert sorted(order.tolist()) == base.tolist()
    names = {}
    for i, c in zip(order.tolist(), of.tolist(), strict=True):
        names.setdefault(text[i : i + 50].tobytes(), set()).add((c, i if c < 0 else None))
    assert all(len(v) == 1 for v in names.values())
    classes = [next(iter(v)) for v in names.values()]
    assert len(set(classes)) == len(classes)


def test_empty(spark):
    assert S.digest(S.remove_repeats(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_odd_ids_and_long_texts(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(300_000))
    top = (1 << 63) - 1
    rows = [(top, text[:400]), (None, text[100:300]), (5, text), (None, None), (5, text[:90])]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == [(False, 5, 90, 0), (False, 5, 300_000, 0), (False, top, 400, 400), (True, 0, 0, 0), (True, 0, 200, 200)]


def test_a_hot_anchor_is_spread():
    """Contexts of one anchor that differ beside it go to many buckets, and equal windows to the same."""
    rng = np.random.default_rng(5)
    shared = rng.integers(97, 123, 60).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, 40), shared[18:42], rng.integers(97, 123, 40)]).astype(np.uint8).tobytes() for _ in range(400)]
    data = S.encode([(i, t) for i, t in enumerate(texts)] + [(1000, texts[7])])
    _, _, offsets, text = S.decode(data)
    keys, _ = S._keys_of(S.anchors(offsets, text)[1], np.zeros(len(S.anchors(offsets, text)[1]), np.int64))
    spread = {}
    for flag in (1, 3):
        h, doc, first, last, _ = S._contexts(offsets, text, {0: S.pack_arrays(np.full(len(keys), flag, np.uint8))}, 1)
        spread[flag] = np.unique(h, return_counts=True)[1].max()
        dealt = {}
        for x, a, b in zip(h.tolist(), first.tolist(), last.tolist(), strict=True):
            for i in range(a, b + 1):
                dealt.setdefault(text[i : i + 50].tobytes(), set()).add(x)
        assert all(len(x) == 1 for x in dealt.values())
    assert spread[3] <= 4
