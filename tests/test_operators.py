import math

import pytest
from gleaner.functions import embed
from gleaner.functions import text as X
from gleaner.operators import graph, maintenance
from gleaner.operators import search as S
from gleaner.operators.index import SearchIndex
from gleaner.operators.index import trigrams as _trigrams
from gleaner.plans import engine
from gleaner.plans.engine import Engine
from gleaner.sources import files
from gleaner.sources.documents import DOCUMENT
from gleaner.streaming.ingest import follow
from pyspark.sql import functions as F

TEXTS = [("/x/alpha_notes.txt", "the quick brown fox\nunique_token_xyz"), ("/x/db_acl.php", "db_acl.php handles access control"), ("/x/model.py", "layer = InputLayer(shape=(784,))")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, p, float(i), len(t), "text", t.count("\n") + 1, t, "utf8", False) for i, (p, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCUMENT).cache()


@pytest.mark.parametrize("query", ["quick", "unique_token_xyz", "db_acl.php", "InputLayer(shape=(784,))"])
def test_identifiers_are_found(docs, query):
    hits, trace = Engine(docs).search(query)
    assert any(r.lexical for r in hits.collect()), trace


def test_nonsense_has_no_lexical_hit(docs):
    hits, trace = Engine(docs).search("zzqqxx")
    assert hits.count() == 0 and trace["broadened"]


def test_pure_filter_leaves_text_out(docs):
    hits, trace = Engine(docs).search("10gb files")
    assert hits.count() == 0 and trace["meta"]["min_bytes"] == 10 * 2**30
    assert [r.path for r in Engine(docs).search("*.php")[0].collect()][0] == "/x/db_acl.php"


def test_bm25_golden(spark):
    d = spark.createDataFrame([(1, "alpha beta beta gamma"), (2, "beta delta"), (3, "alpha alpha alpha omega")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in S.keyword(d, "alpha beta").collect()}
    for k, v in {1: 1.062073, 3: 0.746038, 2: 0.573175}.items():
        assert math.isclose(got[k], v, abs_tol=1e-6)
    more = d.union(spark.createDataFrame([(9, "nothing shared")], "doc_id long, text string"))
    assert {r.doc_id for r in S.keyword(more, "alpha beta").collect()} == {1, 2, 3}


def test_rrf_golden(spark):
    rows = [("a", 1, 0, 1.0), ("a", 2, 1, 1.0), ("b", 2, 0, 1.0), ("b", 3, 1, 1.0)]
    got = {r.doc_id: r.score for r in S.rrf(spark.createDataFrame(rows, "backend string, doc_id long, pos int, weight double")).collect()}
    assert math.isclose(got[2], 0.032522, abs_tol=1e-6) and math.isclose(got[1], 0.016393, abs_tol=1e-6) and math.isclose(got[3], 0.016129, abs_tol=1e-6)


def test_exact_ties_prefer_short_then_low_id(spark):
    d = spark.createDataFrame([(3, "ab ab"), (1, "ab ab"), (2, "abab"), (4, "AB")], "doc_id long, text string")
    assert [(r.doc_id, r.score) for r in S.exact(d, "ab").collect()] == [(2, 2), (1, 2), (3, 2)]
    assert S.exact(d, "a").count() == 0


@pytest.mark.parametrize(("query", "path", "is_dir", "score"), [("project/config.py", "/a/config.py", False, 6.0), ("config", "/a/config.py", False, 6.0), ("screenshots", "/x/Screenshots", True, 12.0), ("screenshot", "/x/Screenshots", True, 3.0), ("fig", "/a/config.py", False, 2.0), ("screenshots", "/x/Screenshots/a.png", False, None)])
def test_path_scores(spark, query, path, is_dir, score):
    got = S.path(spark.createDataFrame([(1, path, is_dir)], "doc_id long, path string, is_dir boolean"), query).collect()
    assert [r.score for r in got] == ([score] if score else [])


def test_chunks_cover_the_text(spark):
    texts = ["", "short", "x" * 5000, ("line of words\n" * 400), "a" * 1399 + "\n" + "b" * 10]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.chunks(F.col("t")).alias("c")).collect()
    for r in rows:
        at = 0
        for c in r.c:
            assert c.off <= at and r.t[c.off : c.off + len(c.chunk)] == c.chunk and len(c.chunk) <= 1400
            at = c.off + len(c.chunk)
        assert at == len(r.t)


def test_chunks_in_one_walk(spark):
    """Two million characters, and what cutting from the start of the rest each time gives."""
    import time

    text = ("some words of a line\n" * 100_000)[:2_000_000]
    start = time.time()
    assert len(X.cuts(text, 1400, 200)) > 1600
    assert time.time() - start < 1
    for t in ("x" * 5000, "line of words\n" * 400, "a" * 1399 + "\n" + "b" * 10, "é😀\n" * 1500, ("y" * 800 + "\n") * 9):
        at, want = 0, []
        while at < len(t):
            rest = t[at : at + 1400]
            last = rest.rfind("\n")
            stop = last if len(rest) == 1400 and last > 700 else len(rest)
            want.append((at, at + stop))
            at = len(t) if at + stop == len(t) else max(at + stop - 200, at + 1)
        assert X.cuts(t, 1400, 200) == want
    rows = spark.createDataFrame([(None,), ("",), ("ab",)], "t string").select(X.chunks(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == [None, [], [(0, "ab")]]


def test_code_graph_attribution():
    symbols, calls = graph.parse("def a():\n    b()\nclass K:\n    def m(self):\n        a()\nb()\n", "python")
    assert [s[0] for s in symbols] == ["a", "K", "m"]
    assert [(None if i is None else symbols[i][0], n, line) for i, n, line in calls] == [("a", "b", 2), ("m", "a", 5), (None, "b", 6)]
    js, calls = graph.parse("/* f(1)\n g(2) */\nfunction run() {\n  go('x(1)'); o.skip(3); // h(4)\n}\n", "js")
    assert [(s[0], s[2]) for s in js] == [("run", 3)] and [(n, line) for _, n, line in calls] == [("go", 4)]


def test_remove_under_does_not_touch_neighbours(spark):
    d = spark.createDataFrame([("/u/Doc/a",), ("/u/Docs/b",), ("/u/Doc",)], "path string")
    kept, report = maintenance.remove_under(d, ["/u/Doc/"])
    assert [r.path for r in kept.collect()] == ["/u/Docs/b"]
    assert report.first().n_removed == 2 and report.first().sample == ["/u/Doc", "/u/Doc/a"]


def test_decode():
    assert files.decode(b"a\r\nb\xff\n") == "a\nb�"
    assert files.decode(b"x" * 5000) == "x" * 4000 + " …[line truncated]"


def test_ingest_of_a_directory(spark, tmp_path):
    root = tmp_path / "venv" / "proj"  # a pruned name above the root does not count
    for name, data in {"aa/n.md": b"hello\nworld", "aa/x.so": b"\0", "b/none": b"plain", "b/bin": b"a\0b", "b/blank.txt": b"  \n", "node_modules/q.js": b"x", "big.txt": b"x" * (2 * 1024 * 1024 + 1), "p.pdf": b"%PDF"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    every, skipped = files.ingest(spark, str(root))
    every = every.cache()
    docs, folders = every.where("not is_dir"), every.where("is_dir")
    assert {(r.path.rsplit("/", 1)[1], r.lang, r.n_lines) for r in docs.collect()} == {("n.md", "markdown", 2), ("none", "text", 1)}
    assert {r.path.rsplit("/", 1)[1] for r in folders.collect()} == {"aa", "b"}
    assert {(r.path.rsplit("/", 1)[1], r.reason) for r in skipped.collect()} == {("x.so", "binary_ext"), ("bin", "unknown_ext"), ("blank.txt", "no_text_content"), ("big.txt", "too_large"), ("p.pdf", "media"), ("node_modules", "dir:node_modules")}
    assert files.pruned(spark, str(root)).first().files == 1
    assert files.ingest(spark, str(root), known=docs)[0].where("not is_dir").count() == 0
    assert [r.path.rsplit("/", 1)[1] for r in S.grep(files.contents(skipped), "A\0B").collect()] == ["bin"]
    named = files.ingest(spark, str(root), media=F.concat(F.lit("seen "), F.length("content")))[0].where("method = 'pdftext'").first()
    assert named.text == "seen 4" and S.path(every, "where is aa").first().score == 12.0


def test_a_refresh_does_not_read_what_is_known(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    docs = files.ingest(spark, str(tmp_path))[0].cache()
    docs.count()

    def refuse(path):
        raise AssertionError(path)

    assert files.ingest(spark, str(tmp_path), known=docs, read=refuse)[0].count() == 0


def test_upsert_of_repeated_paths(spark):
    schema = "doc_id long, path string, mtime double, text string"
    old = spark.createDataFrame([(1, "a", 1.0, "old"), (2, "b", 1.0, "same")], schema)
    new = spark.createDataFrame([(8, "a", 3.0, "newest"), (9, "a", 2.0, "newer"), (7, "c", 1.0, "x"), (6, "c", 1.0, "y")], schema)
    assert sorted(tuple(r) for r in maintenance.upsert(old, new).collect()) == [(1, "a", 3.0, "newest"), (2, "b", 1.0, "same"), (7, "c", 1.0, "x")]


def test_pointer_moves_at_once(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert maintenance.current(spark, folder) is None
    for n in (3, 5):
        maintenance.publish(spark.range(n), folder)
        assert maintenance.current(spark, folder).count() == n
    assert len(maintenance._versions(spark, folder)) == 2


def test_index_finds_what_a_scan_finds(spark, docs, tmp_path):
    index = SearchIndex.write(docs, str(tmp_path / "i"))
    for literal in ("InputLayer(shape=(784,))", "quick", "no such text", "qu", "x", "the q", "_"):
        assert index.exact(literal).collect() == S.exact(docs, literal).collect()
    for variant in ("plain", "weighted"):
        assert [tuple(r) for r in index.keyword("the quick handles fox fox", 10, variant).collect()] == [tuple(r) for r in S.keyword(docs, "the quick handles fox fox", 10, variant).collect()]
    for query in ("quick", "unique_token_xyz", "db_acl.php", "InputLayer(shape=(784,))"):
        hits, trace = Engine(docs, index=index).search(query)
        assert any(r.lexical for r in hits.collect()), trace
        assert hits.drop("sources").collect() == Engine(docs).search(query)[0].drop("sources").collect()


def test_encoded_lists():
    import numpy as np
    from gleaner.operators import index as I

    rng = np.random.default_rng(3)
    lists = [np.sort(rng.choice(I.LOT, n, replace=False)) for n in (0, 1, 7, 4095, 4096, 30_000, I.LOT)]
    for x in lists:
        assert len(I.encode(x)) == min(2 * len(x), I.LOT // 8) and (I.decode(I.encode(x)) == x).all()
    for a in lists[1:]:
        for b in lists[1:]:
            assert (I.intersect([(len(a), I.encode(a)), (len(b), I.encode(b))]) == np.intersect1d(a, b)).all()


def test_lists_are_alike_for_any_ids(spark, tmp_path):
    texts = [f"the text number {i} of many" for i in range(300)]
    rows = [(i, f"p{i}", float(i), len(t), "text", 1, t, "utf8", False) for i, t in enumerate(texts)]
    small = spark.createDataFrame(rows, DOCUMENT).coalesce(1)
    hashed = small.withColumn("doc_id", F.xxhash64("path"))
    sizes = [sorted(r.n for r in SearchIndex.write(d, str(tmp_path / n))._all("grams", "").collect()) for n, d in (("small", small), ("hashed", hashed))]
    assert sizes[0] == sizes[1] and sizes[0][-1] == 300


def test_lists_go_on_in_the_next_batch(spark):
    from gleaner.operators import index

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        pack = lambda x: index.np.array(x, "<u2").tobytes()
        rows = [(1, 0, pack([5, 9])), (1, 0, pack([1])), (1, 0, pack([7])), (1, 1, pack([3])), (2, 0, pack([2])), (2, 0, pack([4])), (2, 0, pack([6])), (2, 0, pack([0]))]
        dealt = spark.createDataFrame(rows, "gram long, lot long, places binary").coalesce(1)
        got = [(r.gram, r.lot, r.n, index.decode(bytes(r.docs)).tolist()) for r in index.gram_lists(dealt).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(1, 0, 4, [1, 5, 7, 9]), (1, 1, 1, [3]), (2, 0, 4, [0, 2, 4, 6])]


def test_a_common_trigram_is_not_read(spark, tmp_path):
    from gleaner.operators import index as I

    texts = ["the same words in all"] * 400 + ["the same words in allqzx"]
    rows = [(i, f"p{i}", 0.0, len(t), "text", 1, t, "utf8", False) for i, t in enumerate(texts)]
    index = SearchIndex.write(spark.createDataFrame(rows, DOCUMENT).coalesce(2), str(tmp_path / "i"))
    read = []
    keep, I.intersect = I.intersect, lambda lists: read.append([n for n, _ in lists]) or keep(lists)
    try:
        assert [r.doc_id for r in index.exact("in allqzx").collect()] == [400]
    finally:
        I.intersect = keep
    assert read == [[1, 1, 1]]  # of seven trigrams those of one document


def test_names_are_read_where_a_trigram_fits(spark, tmp_path):
    names = ["Config.py", "my_config.yaml", "config", "readme.md", "cfg", "x/con.fig", "a/deep/Config.py", None]
    rows = [(i, p and f"/r/{p}", 0.0, 1, "text", 1, "t", "utf8", p == "config") for i, p in enumerate(names)]
    docs = spark.createDataFrame(rows, DOCUMENT)
    index = SearchIndex.write(docs, str(tmp_path / "i"))
    for query in ("config", "config.py", "fig", "cf", "py md", "nothing", "config readme", "con.fig cfg", "a"):
        assert index.path(query).collect() == S.path(docs, query).collect(), query
    s = index.segments[0]
    assert index._read(s, "bases").count() == 6 and len(index._places(s, _trigrams("config").tolist(), "base_grams")) == 3
    assert index._places(s, _trigrams("absent").tolist(), "base_grams") is None


def test_segments_equal_a_rebuild(spark, tmp_path, monkeypatch):
    """Upserts, removals, removed documents that come back, and merges: always what a new index of the same documents has."""
    import random

    from gleaner.operators import index as I

    monkeypatch.setattr(I, "LEAST", 4)
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "rare_one"]
    make = lambda i, n: (i, f"/r/{rng.choice(words)}{i}.md", float(n), 9, "text", 1, " ".join(rng.choices(words, k=rng.randint(1, 9))), "utf8", False)
    state = {i: make(i, 0) for i in range(40)}
    frame = lambda rows: spark.createDataFrame(list(rows), DOCUMENT)
    index = SearchIndex.write(frame(state.values()), str(tmp_path / "i"))
    counts = []
    for step in range(1, 6):
        new = {i: make(i, step) for i in rng.sample(range(60), 3)}
        gone = [i for i in rng.sample(sorted(state), 4) if i not in new]
        before = {s.name for s in index.segments}
        index = index.upsert(frame(new.values()), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        state = {i: r for i, r in (state | new).items() if i not in gone}
        counts.append((len(index.segments), len({s.name for s in index.segments} - before)))
        if step in (2, 5):
            fresh = SearchIndex.write(frame(state.values()), str(tmp_path / f"f{step}"))
            assert (index.n, index.avgdl) == (fresh.n, fresh.avgdl) == (len(state), index.avgdl)
            for query in ("alpha rare_one", "omega"):
                assert index.keyword(query).collect() == fresh.keyword(query).collect() == S.keyword(frame(state.values()), query).collect()
            for literal, few in [(x, n) for x in ("a rare_one", "beta", "nowhere", "ga") for n in (2000, 0)]:
                monkeypatch.setattr(I, "LOOKED_UP", few)
                assert index.exact(literal).collect() == S.exact(frame(state.values()), literal).collect()
            assert index.path("alpha3").collect() == fresh.path("alpha3").collect()
            wanted = list(range(0, 60, 5))
            assert sorted((r.doc_id, r.text) for r in index.documents(wanted).collect()) == sorted((i, state[i][6]) for i in wanted if i in state)
    assert counts[0] == (2, 1) and max(n for n, _ in counts) <= 5 and any(a < b[0] for a, b in zip([n for n, _ in counts][1:], counts, strict=False))
    index.vacuum()
    assert sorted(p.name for p in (tmp_path / "i").iterdir() if p.name[0] not in "._") == sorted([maintenance.current_name(spark, str(tmp_path / "i")), *(s.name for s in index.segments)])
    assert SearchIndex(spark, str(tmp_path / "i")).keyword("omega").collect() == index.keyword("omega").collect()


def test_trace_of_a_search(spark, docs):
    ledger = spark.createDataFrame([("/x/huge.bin", 9_000_000, "holds zzqqxx inside")], "path string, size long, text string")
    code = graph.extract(spark.createDataFrame([(1, "a.py", "def load():\n    open_it()\n")], "doc_id long, path string, text string"))
    own = Engine(docs, ledger_texts=ledger, code=code, recorded={"doc_count": 3, "doc_max_id": 2, "doc_mtime_sum": 3.0})
    hits, trace = own.search("zzqqxx")
    assert hits.count() == 0 and [r.path for r in trace["grep"].collect()] == ["/x/huge.bin"]
    assert trace["vectors"].first().stale is False
    _, trace = own.search("quick open_it() load")
    assert "grep" not in trace and {(r.name, r.relation, r.via) for r in trace["graph"].collect()} == {("load", "definition", None), ("open_it", "caller", "load")}
    assert Engine(docs).search("over 10gb")[1]["explain_empty"]["passes_min_bytes"] == 0


def test_skipped_files_do_not_use_up_places(spark, docs):
    skipped = spark.createDataFrame([(f"/s/{i}.bin", 50, "binary_ext") for i in range(5)], "path string, size long, reason string")
    hits = Engine(docs, skipped=skipped).search("under 1kb", 2)[0].collect()
    assert sum(r.doc_id is not None for r in hits) == 2


def test_stream_upserts_by_path(spark, tmp_path):
    from gleaner.operators.buckets import Buckets

    source, folder, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "doc_id long, path string, mtime double, text string, removed boolean"
    spark.createDataFrame([(1, "a", 1.0, "old", None), (2, "b", 1.0, "same", False), (4, "d", 1.0, "goes", None)], schema).write.parquet(source)
    follow(spark, source, schema, folder, mark, buckets=8).awaitTermination()
    spark.createDataFrame([(9, "a", 2.0, "new", None), (3, "c", 1.0, "more", None), (4, "d", 2.0, "", True), (5, "e", 2.0, "", True), (5, "e", 3.0, "stays", None)], schema).write.mode("append").parquet(source)
    follow(spark, source, schema, folder, mark).awaitTermination()
    got = sorted((r.doc_id, r.path, r.text) for r in Buckets(spark, folder).read().collect())
    assert got == [(1, "a", "new"), (2, "b", "same"), (3, "c", "more"), (5, "e", "stays")]


def test_a_change_writes_its_buckets_only(spark, tmp_path):
    from gleaner.operators.buckets import Buckets

    folder = str(tmp_path / "t")
    rows = {f"p{i}": (i, f"p{i}", 1.0, f"text {i}") for i in range(300)}
    frame = lambda rows: spark.createDataFrame(list(rows), "doc_id long, path string, mtime double, text string")
    own = Buckets.create(frame(rows.values()), folder, 32)
    assert len(own.parts) == 32 and own.read().count() == 300
    reader = own.read()
    before = dict(own.parts)
    new = [(900 + i, f"p{i}", 2.0, "changed") for i in (3, 77)] + [(950, "q", 1.0, "fresh")]
    own = own.apply(frame(new), spark.createDataFrame([("p8",), ("p77",), ("nowhere",)], "path string"))
    changed = {b for b in own.parts if own.parts[b] != before.get(b)}
    assert 0 < len(changed) <= 6
    want = {p: r for p, r in rows.items() if p != "p8"} | {"p3": (3, "p3", 2.0, "changed"), "p77": (77, "p77", 2.0, "changed"), "q": (950, "q", 1.0, "fresh")}
    assert sorted(tuple(r) for r in own.read().collect()) == sorted(want.values())
    assert reader.count() == 300  # an older version is still whole
    again = own.apply(frame(new), spark.createDataFrame([("p8",), ("p77",)], "path string"))
    assert sorted(tuple(r) for r in again.read().collect()) == sorted(want.values())
    assert again.apply(frame([])) is again
    assert again.vacuum() > 0 and sorted(tuple(r) for r in Buckets(spark, folder).read().collect()) == sorted(want.values())
    few = again.rebucket(3)
    assert len(few.parts) == 3 and few.read().count() == len(want)
    emptied = few.apply(frame([]), few.read().select("path"))
    assert emptied.read().count() == 0 and emptied.apply(frame(new)).read().count() == 3


def test_no_document_is_embedded_twice(spark, docs, tmp_path):
    """A run that dies halfway, one that dies between writing and publishing, and the run that resumes."""
    import pandas as pd
    from gleaner.operators.vectors import VectorStore

    seen = str(tmp_path / "seen")
    (tmp_path / "seen").mkdir()
    rows = [(i, f"/x/{i}.md", 1.0, 9, "markdown", 1, f"text number {i}", "utf8", False) for i in range(30)]
    many = spark.createDataFrame(rows, DOCUMENT)

    def counting(texts):
        import os
        import uuid

        for t in texts:
            with open(os.path.join(seen, uuid.uuid4().hex), "w") as f:
                f.write(t)
        return embed.hashing_embedder(texts)

    def embedded():
        found = sorted(p.read_text() for p in (tmp_path / "seen").iterdir())
        for p in (tmp_path / "seen").iterdir():
            p.unlink()
        return found

    folder = str(tmp_path / "v")
    store = VectorStore(spark, folder)
    publish, done = VectorStore._publish, []

    def dying(self, shards):
        if len(done) == 2:
            raise RuntimeError("killed after the third part was written")
        done.append(shards)
        return publish(self, shards)

    VectorStore._publish = dying
    try:
        with pytest.raises(RuntimeError, match="killed"):
            store.refresh(many, counting, parts=5)
    finally:
        VectorStore._publish = publish
    first = embedded()
    assert 0 < len(first) < 30 and len(VectorStore(spark, folder).shards) == 2
    store = VectorStore(spark, folder).refresh(many, counting, parts=5)
    assert sorted(first + embedded()) == sorted(r[6] for r in rows)
    assert tuple(store.status(many).first()) == (30, 0, 0, True)
    key = lambda r: (r.doc_id, r.off, r.embedding)
    assert sorted(map(key, store.rows().collect())) == sorted(map(key, embed.chunk_vectors(many).collect()))
    assert store.search(embed.embed_query("text number 7"), 1).first().doc_id == 7
    now = many.where("doc_id != 4").withColumn("text", F.when(F.col("doc_id") == 9, "other words than before").otherwise(F.col("text")))
    store = store.refresh(now, counting, parts=5)
    assert embedded() == ["other words than before"] and tuple(store.status(now).first()) == (29, 0, 0, True)
    assert store.refresh(now, counting, parts=5).shards == store.shards and embedded() == []
    back = store.refresh(many, counting, parts=5)  # what is gone can come back
    assert embedded() == ["text number 4", "text number 9"] and tuple(back.status(many).first()) == (30, 0, 0, True)
    packed = back.compact()
    assert packed.vacuum() > 0 and sorted(map(key, packed.rows().collect())) == sorted(map(key, embed.chunk_vectors(many).collect()))
    assert isinstance(embed.hashing_embedder(pd.Series(["x"])), pd.Series)


def test_chunks_are_embedded_in_one_step_and_in_pieces(spark):
    import pandas as pd
    from gleaner.functions import text as X

    texts = ["x" * 5000, "", None, "# a comment of the module here\ndef f():\n    'Says what the function does, at length.'\n" + "y = 1\n" * 400, "a\n" * 300_000]
    many = spark.createDataFrame([(i, f"a{i}.{'py' if i == 3 else 'md'}", 1.0, t) for i, t in enumerate(texts)], "doc_id long, path string, mtime double, text string").coalesce(1)

    def embedder(texts: pd.Series) -> pd.Series:
        assert 0 < len(texts) <= embed.CHUNKS
        return embed.hashing_embedder(texts)

    rows = embed.chunk_vectors(many, embedder)
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 0
    want = []
    for i, t in enumerate(texts):
        own = embed.docstrings(t) if i == 3 else t or ""
        want += [(i, a, embed.hashing_embedder(pd.Series([own[a:b]]))[0]) for a, b in X.cuts(own, 1400, 200)] or [(i, -1, None)]
    assert [(r.doc_id, r.off, r.embedding) for r in rows.orderBy("doc_id", "off").collect()] == want


def test_calls_of_many_files_are_given_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    kept = {}
    many = spark.createDataFrame([(0, "a.py", "")], "doc_id long, path string, text string")
    plain = type(many).mapInArrow
    monkeypatch.setattr(type(many), "mapInArrow", lambda df, f, schema: kept.update(run=f) or plain(df, f, schema))
    graph.extract(many)
    code = "def f():\n" + "    g(1)\n" * 1999
    given = list(kept["run"](iter([pa.table({"doc_id": range(8), "path": [f"a{i}.py" for i in range(8)], "text": [code] * 8, "code": ["python"] * 8}).to_batches()[0]])))
    assert sum(b.num_rows for b in given) == 8 * 2000 and max(b.num_rows for b in given) < graph.ROWS + 2000


def test_vectors_resume_by_document(spark, docs):
    stored = embed.chunk_vectors(docs).select("doc_id", "fingerprint", "policy").distinct()
    now = docs.withColumn("text", F.when(F.col("doc_id") == 1, "changed").otherwise(F.col("text")))
    marks = now.select("doc_id", X.fingerprint(F.col("mtime"), F.col("text")).alias("fingerprint"))
    plan = {r.doc_id: r.action for r in maintenance.resume_plan(marks, stored, embed.policy_version()).collect()}
    assert plan == {0: "keep", 1: "embed", 2: "keep"}
    hits, _ = Engine(docs, embed.chunk_vectors(docs).where("off >= 0"), embed.embed_query).search("what is the quick fox")
    assert hits.first().doc_id == 0


def test_rerank_moves_only_the_head(spark):
    hits = spark.createDataFrame([(i, i) for i in range(5)], "doc_id long, pos int")
    scores = spark.createDataFrame([(0, 0.1), (1, 0.9), (2, 0.5)], "doc_id long, rerank_score double")
    again = engine.rerank(hits, scores, 3)
    assert [r.doc_id for r in again.collect()] == [1, 2, 0, 3, 4]
    after = spark.createDataFrame([(k, i) for i, k in enumerate([1, 2, 0, 3, 4])], "doc_id long, pos int")
    assert tuple(engine.moved(hits, after).first()) == (5, 3, 2)


def test_scorers(spark):
    texts = ["short", "a much longer passage", "token = abcdefgh", "mid length"]
    hits = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, pos int, text string")
    scores = engine.scored(hits, lambda passages: [len(p) for p in passages], 3)
    assert {r.doc_id: r.rerank_score for r in scores.collect()} == {0: 5.0, 1: 21.0, 2: 16.0}
    assert [r.rerank_score for r in engine.scored(hits, lambda passages: [][0], 2).collect()] == [None, None]
    shown, order = engine.ordered(hits, [3, 1])
    assert [r.doc_id for r in shown.collect()] == [0, 1, 3] and [r.doc_id for r in order.collect()] == [3, 1, 0, 2]


def test_token_windows(spark):
    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 435, 436, 810, 811, 2000)], "ids array<long>").select("ids", X.token_chunks(F.col("ids")).alias("c")).collect()
    for r in rows:
        assert sorted({i for c in r.c for i in c.ids}) == r.ids and all(len(c.ids) <= 435 and c.off % 375 == 0 and c.ids == r.ids[c.off : c.off + 435] for c in r.c)
    assert [len(r.c) for r in rows] == [0, 1, 1, 2, 2, 3, 6]


def test_vector_upkeep(spark):
    schema = "doc_id long, fingerprint string, policy string"
    stored = spark.createDataFrame([(1, "a", "p"), (1, "a", "p"), (2, "b", "p"), (3, "c", "old"), (4, "d", "p")], schema)
    now = spark.createDataFrame([(1, "a"), (2, "changed"), (3, "c"), (5, "e")], "doc_id long, fingerprint string")
    assert tuple(maintenance.index_status(now, stored.distinct(), "p").first()) == (1, 3, 1, False)
    kept = maintenance.drop_documents(stored, maintenance.resume_plan(now, stored.distinct(), "p"))
    assert [r.doc_id for r in kept.collect()] == [1, 1]
    assert sorted(r.doc_id for r in maintenance.prune_orphans(stored, now).collect()) == [1, 1, 2, 3]


def test_definitions_by_language():
    cases = {
        "python": {"async def f(x):": ("f", "function"), "class A[T](B):": ("A", "class"), "  def g[T](x): pass": ("g", "function"), "@wraps(f)": None, "x = f(1)": None, "classes(1)": None, "class Z:": ("Z", "class")},
        "php": {"public static function &foo($a) {": ("foo", "function"), "abstract class Foo extends Bar": ("Foo", "class"), "INTERFACE I {": ("I", "class"), "$f = function($x) {": None},
        "js": {"export default async function* gen(a) {": ("gen", "function"), "const f = async (x) => {": ("f", "function"), "let v = 3": None, "export class K extends L {": ("K", "class"), "var g = function(a) {": ("g", "function"), "function(a) {": None},
        "java": {"public static <T> List<Map<String, T>> run(int a) throws X {": ("run", "function"), "if (a) {": None, "return foo(a) {": None, "} else if (a) {": None, "final class A {": ("A", "class"), "int x = f(3);": None, "void go(int[] a) {": ("go", "function")},
        "go": {"func (r *T) Name[K any](x int) {": ("Name", "function"), "type T[K any] struct {": ("T", "class"), "type F func(int)": None, "func main() {": ("main", "function")},
        "rust": {"pub(crate) async fn go<T>(x: T) {": ("go", "function"), "const X: i32 = 3;": None, "pub trait Tr {": ("Tr", "class"), "impl Tr for X {": None},
    }
    for lang, lines in cases.items():
        for line, want in lines.items():
            assert graph.definition(line, lang) == want, line


def test_nested_and_repeated_definitions():
    symbols, calls = graph.parse("def outer():\n    def inner():\n        a()\n    b()\ndef outer():\n    c()\n", "python")
    assert [(s[0], s[2]) for s in symbols] == [("outer", 1), ("inner", 2), ("outer", 5)]
    assert [(i, n) for i, n, _ in calls] == [(1, "a"), (1, "b"), (2, "c")]


def test_code_of_changed_files(spark):
    schema = "doc_id long, path string, text string"
    rows = graph.extract(spark.createDataFrame([(1, "a.py", "def old():\n    x()\n"), (2, "b.py", "y()\n")], schema))
    new = graph.replace_files(rows, spark.createDataFrame([(1, "a.py", "def fresh():\n    z()\n")], schema))
    assert sorted((r.path, r.name) for r in new.collect()) == [("a.py", "fresh"), ("a.py", "z"), ("b.py", "y")]


def test_calls_of_names_defined_nowhere(spark):
    rows = graph.extract(spark.createDataFrame([(1, "a.py", "lib_call()\n")], "doc_id long, path string, text string"))
    found = graph.graph_search(graph.edges_of(rows), graph.symbols_of(rows), "who uses lib_call()").collect()
    assert [(r.path, r.line, r.relation, r.via) for r in found] == [("a.py", 1, "caller", None)]


def test_identifiers_of_six_characters_are_split(spark):
    rows = spark.createDataFrame([("aB getUserName my_var a.b os.path.join (x_y) é_éé fooBar",), ("",), ("  ",)], "t string").select(X.split_identifiers(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == ["aB get User Name my var a.b os path join (x_y) é_éé foo Bar", "", "  "]


def test_functions_need_no_package_where_they_run(spark):
    import subprocess
    import sys

    from pyspark import cloudpickle

    for module in (graph, files, embed, X, S, maintenance, engine):  # also functions that name a module of the package
        cloudpickle.dumps(lambda module=module: module)
    sent = cloudpickle.dumps((graph.parse, files.decode, embed.docstrings))
    code = "import sys, pickle; p, d, s = pickle.load(sys.stdin.buffer); assert 'gleaner' not in sys.modules; print(p('def a():\\n  b()\\n', 'python')[1], d(b'x'), s('\"\"\"doc\"\"\"'))"
    done = subprocess.run([sys.executable, "-c", code], input=sent, capture_output=True, cwd="/", env={"PATH": "/usr/bin"}, timeout=120)
    assert done.stdout.split() == [b"[(0,", b"'b',", b"2)]", b"x", b"doc"], done.stderr.decode()[-500:]


def test_lines_of_text_and_paraphrases(spark):
    from gleaner.operators import evaluate

    hits = spark.createDataFrame([(1, "b", 7, "two"), (0, "a", None, "one")], "pos int, path string, line_no int, snippet string")
    assert [r.value for r in files.written(hits).collect()] == ["  1  a  one", "  2  b:7  two"]
    pairs = spark.createDataFrame([("which words matter", "words matter here"), ("entirely different question", "words matter here"), ("of", "x")], "query string, text string")
    assert [round(r.overlap, 2) for r in evaluate.paraphrases(pairs, ["which"]).collect()] == [0.0, 0.0]
