import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pytest
from gleaner.llm import sharding
from gleaner.llm.sharding import Rooms, assign_shards, best_fit, even_fit, write_shards

SCHEMA = "doc_id long, text string, size string, shard int"


def plain_best_fit(sizes, capacity):
    """One group at a time, by looking at every shard."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits)[1]] -= s
        else:
            rooms.append(max(capacity, s) - s)
    return [max(capacity, 0) - r for r in rooms]


def histogram(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


def loads(placements, shards):
    out = [0] * shards
    for weight, _, shard, n in placements:
        out[shard] += weight * n
    return out


def test_tree_finds_the_tightest_room():
    rng = np.random.default_rng(1)
    tree, plain = Rooms(), []
    for shard in range(3000):
        if plain and rng.random() < 0.4:
            key = plain.pop(int(rng.integers(len(plain))))
            tree.remove(*key)
        key = (int(rng.integers(1, 400)), shard)
        insort(plain, key)
        tree.add(*key)
        size = int(rng.integers(1, 420))
        at = bisect_left(plain, (size, -1))
        assert tree.tightest(size) == (plain[at] if at < len(plain) else None)
    depth = lambda t: 1 + max(depth(t.left), depth(t.right)) if t else 0
    assert depth(tree.root) <= 2 * np.log2(len(plain) + 1)


def test_counts_are_placed_as_groups_one_by_one():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = rng.integers(1, 60, int(rng.integers(1, 200))).tolist()
        capacity = int(rng.integers(60, 200))
        out = best_fit(histogram(sizes), capacity)
        shards = max(p[2] for p in out) + 1
        assert sorted(loads(out, shards)) == sorted(plain_best_fit(sizes, capacity))
        placed = {}
        for weight, rank, _, n in out:  # ranks of a weight without gaps
            assert rank == placed.get(weight, 0)
            placed[weight] = rank + n
        assert placed == Counter(sizes)


def test_even_shards():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes = rng.integers(9, 5000, 600).tolist()
        got = loads(even_fit(histogram(sizes), 24), 24)
        assert sum(got) == sum(sizes) and max(got) <= 1.01 * sum(sizes) / 24 and min(got) >= 0.98 * sum(sizes) / 24
    heavy = [100_000, 90_000, *[10] * 4000]  # two groups above any mean get shards of their own
    got = sorted(loads(even_fit(histogram(heavy), 10), 10))
    assert got[-2:] == [90_000, 100_000] and got[0] == got[7] == 5000
    assert loads(even_fit(histogram([5, 4]), 4), 4) == [5, 4, 0, 0]
    assert even_fit([], 4) == []
    assert sorted(loads(even_fit(histogram([7] * 5), 2), 2)) == [14, 21]
    assert loads(even_fit(histogram([3, 2, 1]), 1), 1) == [6]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    return ["w" * int(n) for n in rng.integers(0, 400, 300)] + [f"{i} é" for i in range(300)] + [None, None, "", "hot text"] + ["hot text"] * 200 + ["x" * 3_000_000]


@pytest.mark.parametrize("bucket", [sharding.BUCKET_ROWS, 7])
def test_documents_meet_the_contract(spark, texts, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "s", 3) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(5)
    out = assign_shards(docs, 24).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True))
    slots, of_text, total = {}, {}, Counter()
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        of_text.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        total[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())  # equal texts in one shard
    heavy = max(total, key=total.get)
    rest = [total[s] for s in range(24) if s != heavy]
    assert len(slots[heavy]) == 1 and max(rest) - min(rest) < 1000


def test_fixed_capacity_and_the_whole_loop(spark, texts):
    docs = spark.createDataFrame([(i, t, "s", 3) for i, t in enumerate(texts[:-1])], SCHEMA)
    groups = Counter()
    for t in texts[:-1]:
        groups[t or ""] += len((t or "").encode()) + 8
    want = sorted(plain_best_fit(list(groups.values()), 5000))
    total = Counter()
    for r in assign_shards(docs, capacity=5000).collect():
        total[r.shard] += r.size
    assert sorted(total.values()) == want


def test_empty_table(spark):
    assert assign_shards(spark.createDataFrame([], SCHEMA)).collect() == []


def test_written_shards_hold_whole_rows(spark, texts, tmp_path):
    docs = spark.createDataFrame([(i, t, "s", 3) for i, t in enumerate(texts[:-1])], SCHEMA)
    write_shards(docs, f"{tmp_path}/out", 6, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert [c for c in back.columns if c not in docs.columns] == ["shard_"]
    assert Counter((r.doc_id, r.text, r.size, r.shard) for r in back.collect()) == Counter((i, t, "s", 3) for i, t in enumerate(texts[:-1]))
    total = Counter()
    for r in back.collect():
        total[r["shard_"]] += len((r.text or "").encode()) + 8
    assert len(total) == 6 and max(total.values()) - min(total.values()) < 300


def test_what_is_broadcast_is_plain(spark, monkeypatch, texts):
    """Executors need not have this package to read it."""
    import pickle

    from pyspark import SparkContext

    sent, send = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or send(self, value))
    assign_shards(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")).collect()
    assert sent and not any(b"gleaner" in x for x in sent)
