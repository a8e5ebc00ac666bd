import zlib
from collections import Counter, defaultdict

import numpy as np
from gleaner.llm.packing import WordTokenizer, pack, pack_histogram
from gleaner.llm.queries import tokenizer_path
from tokenizers import Tokenizer


def test_patterns_use_every_length_once():
    histogram = {2048: 3, 1500: 4, 700: 5, 548: 9, 3: 50, 1: 7}
    patterns = pack_histogram(histogram, 2048)
    used = Counter()
    for times, lengths in patterns:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += times
    assert used == histogram
    assert pack_histogram({}, 2048) == []


def test_patterns_are_those_of_packing_piece_by_piece():
    rng = np.random.default_rng(7)
    for capacity in (20, 64, 300):
        for _ in range(20):
            histogram = {int(x): int(n) for x, n in zip(rng.integers(1, capacity + 1, 12), rng.integers(1, 40, 12), strict=True)}
            packs: list[list[int]] = []
            for size in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
                shortest = min(packs, key=sum, default=None)
                if shortest is not None and sum(shortest) + size <= capacity:
                    shortest.append(size)
                else:
                    packs.append([size])
            got = [sum(lengths) for times, lengths in pack_histogram(histogram, capacity) for _ in range(times)]
            assert sorted(got) == sorted(map(sum, packs))


def test_ranks_in_two_levels(spark, monkeypatch):
    from gleaner.llm import packing

    monkeypatch.setattr(packing, "BUCKETS", 3)
    rng = np.random.default_rng(8)
    rows = [(k, b, int(rng.integers(1, 9))) for k in (1, 2048) for b in range(20) if rng.random() < 0.8]
    got = {(r.length, r.bucket): r.before for r in packing.counts_before(spark.createDataFrame(rows, "length long, bucket long, n long")).collect()}
    assert got == {(k, b): sum(n for j, c, n in rows if j == k and c < b) for k, b, _ in rows}


def test_words_give_the_ids_of_the_text():
    t, w = Tokenizer.from_file(tokenizer_path()), WordTokenizer(tokenizer_path())
    texts = ["It's  A\ttest, isn't it?\n100% don'T x", "é é ́x ÉCOLE Straße ΑΣ Σ", "a<|endoftext|>b <|startoftext|>", "x\x1cy z", "", "  a　b", "日本語 テスト 😀😀 a😀b", "\x85w\x85"]
    for x in texts:
        assert np.frombuffer(w.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_round_trip(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["alpha", "Beta,", "gamma's", "42", "é"], int(n))) for n in rng.integers(0, 900, 80)] + [None, "", "one " * 5000, "same", "same"]
    rows = [(i, t, 7) for i, t in enumerate(texts)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string, length int"), tokenizer_path()).collect()
    t = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x, _ in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) == len(ids[i])
    assert len(by_doc) == len(rows)
    total = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        total += sum(r.length for r in own)
        assert sum(r.length for r in own) <= 2048
    assert total == sum(map(len, ids.values()))
    assert len(by_sequence) <= total // 2048 + 2


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
