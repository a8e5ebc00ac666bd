import subprocess
import sys
import textwrap

import numpy as np
import pytest
from gleaner.llm import decontaminate as D

SCHEMA = "doc_id long, text string, item_id string"
ITEM = "item_id long, text string"


def semiglobal(pattern, text):
    """Least edit distance of ``pattern`` to any substring of ``text``, row by row."""
    c, j = np.array([ord(x) for x in text], np.int64), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for p in pattern:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (c != ord(p)))
        row = np.minimum.accumulate(new - j) + j
    return int(row.min())


def plain(text):
    return " ".join(text.lower().split())


def brute(text, item):
    """The definition: a hundred characters, each 25th start and the last, with up to eight edits; short items as whole words."""
    t, p = plain(text or ""), plain(item or "")
    if not p:
        return False
    if len(p) < 24:
        at = t.find(p)
        while at >= 0:
            left = at and t[at - 1].isalnum() and p[0].isalnum()
            right = t[at + len(p) :][:1].isalnum() and p[-1].isalnum()
            if not left and not right:
                return True
            at = t.find(p, at + 1)
        return False
    starts = {*range(0, max(1, len(p) - 99), 25), max(0, len(p) - 100)}
    return any(semiglobal(p[s : s + 100], t) <= min(len(p[s : s + 100]) * 8 // 100, (len(p[s : s + 100]) - 13) // 8) for s in starts)


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdeiorstéü"), int(rng.integers(2, 8)))) for _ in range(n))


def edited(rng, text, k):
    c = list(text)
    for _ in range(k):
        i = int(rng.integers(0, len(c)))
        kind = int(rng.integers(0, 3))
        if kind == 0:
            c[i] = "z"
        elif kind == 1:
            del c[i]
        else:
            c.insert(i, "z")
    return "".join(c)


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    items = [(i, words(rng, int(rng.integers(8, 40)))) for i in range(12)] + [(50, "short"), (51, None), (52, ""), (53, " \n"), (54, "short answer 42"), (55, "?!"), (None, "x y"), (57, "a" * 23), (58, "é" * 24)]
    docs = []
    for i in range(24):
        body = [words(rng, 50), words(rng, 50)]
        if i % 2:
            item = items[i % 12][1]
            body.insert(1, edited(rng, item.upper() if i % 3 else item.replace(" ", "\n  "), i % 14))
        docs.append((i, " ".join(body), "clash"))
    tails = ["a short day", "SHORT  answer\n42", "shorts", "ashort answer 42", "short answer 425", "what?!", "x yz", "x y", "a" * 23, "a" * 24, "É" * 24, "é" * 23]
    docs += [(24 + i, t, "clash") for i, t in enumerate(tails)]
    docs += [(100, None, "x"), (101, "", "x"), (102, words(rng, 30000) + " " + items[0][1], "x"), (103, items[1][1], "x"), (103, items[1][1], "x"), (None, items[2][1], "x")]
    got = D.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEM)).collect()
    want = {(doc, key) for doc, text, _ in docs[:36] for key, item in items if brute(text, item)}
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id is not None and r.doc_id < 36} == want
    assert len(want) >= 14
    rest = sorted((r.doc_id, r.item_id) for r in got if r.doc_id is not None and r.doc_id >= 36)
    assert rest == [(102, 0), (103, 1), (103, 1)] and [r.item_id for r in got if r.doc_id is None] == [2]
    far = next(r for r in got if r.doc_id == 102)
    assert docs[38][1][far.start : far.end] == items[0][1]
    short = next(r for r in got if r.doc_id == 25 and r.item_id == 54)
    assert (short.start, short.end) == (0, len(tails[1]))


def test_windows_and_hot_grams_change_nothing(monkeypatch):
    rng = np.random.default_rng(14)
    opening = words(rng, 6)
    items = [(i, opening + " " + words(rng, 20)) for i in range(90)]
    texts = [" ".join([words(rng, 5), edited(rng, items[i % 90][1], i % 9), opening, opening, words(rng, 5)]) for i in range(120)]
    index = D.SegmentIndex(D.build(items))
    own = [D.normal(t) for t in texts]
    firsts = np.cumsum([0] + [len(c) + D.BETWEEN for c in own])[:-1]
    joined = np.concatenate([x for c in own for x in (c, np.full(D.BETWEEN, D.GAP, np.uint32))])
    want = index.search(joined, firsts)
    assert {(d, i) for d, i, *_ in want} >= {(k, k % 90) for k in range(120)}
    monkeypatch.setattr(D, "AT_ONCE", 700)
    assert index.search(joined, firsts) == want
    monkeypatch.setattr(D, "HOT", 1 << 40)
    assert D.SegmentIndex(D.build(items)).search(joined, firsts) == want


def test_parts_pieces_and_empty(spark, monkeypatch):
    rng = np.random.default_rng(8)
    items = [(i, words(rng, 30)) for i in range(6)]
    docs = [(i, words(rng, 20) + " " + t, "x") for i, t in items]
    bench = spark.createDataFrame(items, ITEM)
    whole = sorted(tuple(r) for r in D.contaminated(spark.createDataFrame(docs, SCHEMA), bench).collect())
    monkeypatch.setattr(D, "PART_CHARS", 4000)
    monkeypatch.setattr(D, "PIECE", 300)
    assert len(D._parts(bench)) > 1
    assert sorted(tuple(r) for r in D.contaminated(spark.createDataFrame(docs, SCHEMA), bench).collect()) == whole
    assert [r[:2] for r in whole] == [(i, i) for i in range(6)]
    long = words(rng, 900)
    monkeypatch.setattr(D, "PART_CHARS", 40000)
    bench = spark.createDataFrame([(1, long)] * 2 + [(2, long)], ITEM)
    cuts = [(k, long[k * 131 : k * 131 + 126], "x") for k in range(len(long) // 131)]
    got = D.contaminated(spark.createDataFrame(cuts, SCHEMA), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted((k, i) for k, *_ in cuts for i in (1, 2))
    assert D.contaminated(spark.createDataFrame([], SCHEMA), bench).count() == 0
    assert D.contaminated(spark.createDataFrame(docs, SCHEMA), bench.limit(0)).count() == 0


def test_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "say short answer 42 now", "a", 1), (1, "clean", "b", 2), (None, "short answer 42", None, 3)], "doc_id long, text string, text_ string, item int")
    found = D.annotate(docs, spark.createDataFrame([("q", "short answer 42")], "item_id string, text string"), "hits")
    assert found.columns == ["doc_id", "text", "text_", "item", "hits"]
    assert {r["item"]: [h.item_id for h in r.hits] for r in found.collect()} == {1: ["q"], 2: [], 3: ["q"]}


def test_items_cut_at_the_start_of_a_document(spark):
    rng = np.random.default_rng(11)
    items = [(i, words(rng, 40)) for i in range(8)]
    bench = spark.createDataFrame(items, ITEM)
    for where in (0, 2, 4):
        docs, want = [], []
        for cut in range(1, 9):
            text = items[cut - 1][1][cut:]
            own = [(10 * cut + i, words(rng, 60), "x") for i in range(5)]
            own[where] = (10 * cut + where, text + " " + own[where][1], "x")
            docs += own
            want.append((10 * cut + where, cut - 1, 0, len(text)))
        got = sorted(D.contaminated(spark.createDataFrame(docs, SCHEMA).coalesce(1), bench).collect())
        assert [(r.doc_id, r.item_id, r.start) for r in got] == [w[:3] for w in want]
        assert all(abs(r.end - w[3]) <= 8 for r, w in zip(got, want, strict=True))


def test_neighbours_do_not_make_a_match(spark):
    rng = np.random.default_rng(12)
    item = words(rng, 40)[:100]
    bench = spark.createDataFrame([(1, item)], ITEM)
    for cut in (50, 92, 46):
        halves = [(1, words(rng, 5) + " " + item[:cut], "x"), (2, item[cut:] + " " + words(rng, 5), "x")]
        alone = {(d, i) for d, t, _ in halves for i in (1,) if brute(t, item)}
        for rows in (halves, halves[::-1]):
            got = D.contaminated(spark.createDataFrame(rows, SCHEMA).coalesce(1), bench).collect()
            assert {(r.doc_id, r.item_id) for r in got} == alone


def test_executors_need_no_package(spark):
    """The function and its data, as they are sent, run in a process that cannot import the package."""
    from pyspark import cloudpickle

    items = [(7, "some words of a benchmark item that are long enough")]
    sent = cloudpickle.dumps((lambda parts, text: D.SegmentIndex(parts).search(D.normal(text), np.array([0])), D.build(items), "x " + items[0][1]))
    code = "import sys, pickle; f, parts, text = pickle.load(sys.stdin.buffer); assert 'gleaner' not in sys.modules; print(parts['ids'][f(parts, text)[0][1]])"
    done = subprocess.run([sys.executable, "-c", code], input=sent, capture_output=True, cwd="/", env={"PATH": "/usr/bin"}, timeout=120)
    assert done.stdout.strip() == b"7", done.stderr.decode()[-500:]


@pytest.mark.parametrize("fill", ["opening", "words"])
def test_memory_with_a_shared_opening(fill):
    """Thousands of items with one opening against a text of a megabyte, in a process of its own."""
    code = f"""
        import resource
        import numpy as np
        from gleaner.llm import decontaminate as D
        rng = np.random.default_rng(1)
        say = lambda n: "".join(rng.choice(list("abcdefghij "), n))
        opening = "answer the next question in full"
        items = [(i, opening + " " + say(200)) for i in range(4000)]
        text = opening * 32000 if {fill!r} == "opening" else say(1_000_000) + opening + items[5][1]
        found = D.SegmentIndex(D.build(items)).search(D.normal(text), np.array([0]))
        print([i for _, i, *_ in found], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, timeout=300, text=True)
    found, mb = done.stdout.rsplit(" ", 1)
    assert found == ("[]" if fill == "opening" else "[5]"), done.stderr[-500:]
    assert int(mb) < 1000
