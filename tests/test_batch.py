"""Batched search against single searches, phrases, and evaluation cases."""

import math
import re

import pytest
from gleaner.functions import text as X
from gleaner.operators import evaluate, fulltext
from gleaner.operators import search as S
from gleaner.operators.index import SearchIndex
from gleaner.plans import batch
from gleaner.plans.engine import Engine
from gleaner.sources.documents import DOCUMENT
from pyspark.sql import functions as F

QUERIES = [
    "quick", "unique_token_xyz", "db_acl.php", "InputLayer(shape=(784,))", '"fox jumps"', "how does the fox jump", "zzqqxx", "10gb files", "*.php", "notes under 1kb", "fox over 20 bytes", "",
    "layer layer fox", "screens", "a", "'qu'", "model.py", "under 1 kb", "Fox quick the",
]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [
        ("/x/alpha_notes.txt", "the quick brown fox\nunique_token_xyz"), ("/x/db_acl.php", "db_acl.php handles access control"), ("/x/model.py", "layer = InputLayer(shape=(784,))"), ("/y/fox.md", "the fox jumps over the lazy fox\nquick!"),
        ("/y/screens", ""), ("/y/long.txt", "fox " * 500), ("/z/acl.txt", "the quick layer"), ("/z/empty.md", ""),
    ]
    rows = [(i, p, float(i), len(t), "text", t.count("\n") + 1, t, "utf8", p.endswith("screens")) for i, (p, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENT).repartition(3).cache()


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return SearchIndex.write(docs, str(tmp_path_factory.mktemp("index") / "i"))


@pytest.mark.parametrize("indexed", [False, True])
def test_batch_equals_single_searches(spark, docs, index, indexed):
    chunks = spark.createDataFrame([(i % 5, [math.cos(i), math.sin(i)]) for i in range(12)], "doc_id long, embedding array<double>")
    skipped = spark.createDataFrame([("/s/big.bin", 20 << 30, "too_large"), ("/s/a.php", 10, "x")], "path string, size long, reason string")
    engine = Engine(docs, chunks, lambda q: [math.cos(len(q)), math.sin(len(q))], skipped=skipped, index=index if indexed else None)
    asked = spark.createDataFrame([*enumerate(QUERIES), (99, None)], "query_id long, query string")
    got = {}
    for r in batch.search_many(engine, asked, 5).collect():
        got.setdefault(r.query_id, []).append(tuple(r)[1:])
    columns = ("pos", "doc_id", "path", "lang", "n_lines", "line_no", "snippet", "rrf_score", "sources", "lexical")
    for i, q in enumerate(QUERIES):
        want = [tuple(r[c] for c in columns) for r in engine.search(q, 5)[0].collect()]
        assert [(*x[:7], round(x[7], 9), *x[8:]) for x in sorted(got.get(i, []))] == [(*x[:7], round(x[7], 9), *x[8:]) for x in want], q
    assert 99 not in got and len(got) > 10


def test_parts_of_queries_change_nothing(spark, docs, monkeypatch):
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    one = sorted(map(str, batch.search_many(Engine(docs), asked).collect()))
    monkeypatch.setattr(batch, "CHARS", 60)
    assert sorted(map(str, batch.search_many(Engine(docs), asked).collect())) == one
    assert batch.search_many(Engine(docs), asked.limit(0)).collect() == []


def test_jobs_do_not_grow_with_queries(spark, docs, index):
    """A hundred queries take the jobs of ten."""
    tracker, counts = spark.sparkContext.statusTracker(), []
    for n in (10, 100):
        spark.sparkContext.setJobGroup(f"batch{n}", "")
        asked = spark.createDataFrame([(i, f"fox quick {i % 10}") for i in range(n)], "query_id long, query string")
        batch.search_many(Engine(docs, index=index), asked).collect()
        counts.append(len(tracker.getJobIdsForGroup(f"batch{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(counts[0] - counts[1]) <= 3, counts


def plain_phrases(rows, query, limit):
    """Every document, phrase by phrase."""
    fold = lambda t: re.findall(r"[^\W_]+", "".join(c for c in __import__("unicodedata").normalize("NFD", t.lower()) if __import__("unicodedata").category(c) != "Mn"))
    docs = [(i, fold(t or "")) for i, t in rows]
    mean = sum(len(t) for _, t in docs) / len(docs)
    wanted = [fold(w) for w in re.findall(r"\w+", query)]
    total = dict.fromkeys((i for i, _ in docs), 0.0)
    for p in filter(None, wanted):
        tf = {i: sum(t[a : a + len(p)] == p for a in range(len(t))) for i, t in docs}
        df = sum(n > 0 for n in tf.values())
        idf = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 0) or 1e-6
        for i, t in docs:
            f = 1.5 * tf[i]
            total[i] += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / mean))
    return sorted(((i, round(s, 9)) for i, s in total.items() if s > 0), key=lambda x: (-x[1], x[0]))[:limit]


def test_phrases_and_diacritics(spark, tmp_path):
    rows = [(1, "a foo_bar here"), (2, "bar foo"), (3, "foo bar foo.bar"), (4, "Café crème"), (5, "café noir"), (6, "Ναί ΝΑΊ ναι"), (7, "ёлка Елка"), (8, None), (9, ""), (10, "foofoo foo foo foo bar"), (11, "x1 2y"), (12, "日本語 テスト")]
    docs = spark.createDataFrame([(i, f"p{i}", 0.0, 0, "text", 1, t, "utf8", False) for i, t in rows], DOCUMENT)
    index = SearchIndex.write(docs, str(tmp_path / "i"))
    for query in ("foo_bar", "foo bar", "café", "cafe foo_bar foo_bar", "ναι", "елка", "x1", "日本語", "foo_foo_foo", "nothing_here", "_ !", "bar_foo"):
        got = [(r.doc_id, round(r.score, 9)) for r in index.phrases(query).collect()]
        assert got == plain_phrases(rows, query, 40), query
    assert {r.doc_id for r in index.phrases("foo_bar").collect()} == {1, 3, 10} and {r.doc_id for r in index.phrases("CAFÉ").collect()} == {4, 5}
    more = index.upsert(docs.where("doc_id = 2").withColumn("text", F.lit("foo_bar")), spark.createDataFrame([(1,)], "doc_id long"))
    assert {r.doc_id for r in more.phrases("foo_bar").collect()} == {2, 3, 10}


@pytest.mark.parametrize("piece", [1, 5, 1 << 20])
def test_postings_are_made_without_an_exchange(spark, docs, piece):
    more = docs.select(F.col("doc_id"), "text").unionByName(spark.createDataFrame([(70, None), (71, "  "), (None, "fox fox")], "doc_id long, text string")).repartition(2).cache()
    texts = {r.doc_id: r.text or "" for r in more.collect()}
    parts = fulltext.posting_parts(more, X.tokens(F.col("text")), piece=piece)
    assert "Exchange" not in parts._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).split("InMemoryTableScan")[0]
    words = {i: [w.lower() for w in re.findall(X.fixed.TOKEN, t)] for i, t in texts.items()}
    assert sorted(map(tuple, fulltext.postings_of(parts).collect()), key=repr) == sorted(((w, i, own.count(w), len(own)) for i, own in words.items() for w in set(own)), key=repr)
    parts = fulltext.posting_parts(more, fulltext.terms_of(F.col("text")), True, piece)
    words = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in texts.items()}
    want = [(w, i, len(own), [n for n, x in enumerate(own) if x == w]) for i, own in words.items() for w in set(own)]
    assert sorted(map(tuple, fulltext.positions_of(parts).collect()), key=repr) == sorted(want, key=repr)


def test_written_postings_share_rows(spark, docs, tmp_path):
    own = SearchIndex.write(docs.coalesce(1), f"file://{tmp_path}/x")
    for table, terms in (("postings", S.postings(docs)), ("positions", fulltext.positions_of(fulltext.posting_parts(docs, fulltext.terms_of(F.col("text")), True)))):
        rows = own._read(own.segments[0], table)
        assert rows.count() == rows.select("term").distinct().count() == terms.select("term").distinct().count() < terms.count()
        assert [r.term for r in rows.collect()] == sorted(r.term for r in rows.collect())


def test_cases_equal_brute_force(spark):
    """Sentences of exactly one document, where copies and longer sentences hold others."""
    import hashlib
    import random

    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "of", "thing", "word", "small", "large"]
    sentence = lambda: " ".join(rng.choices(words, k=15)).capitalize() + "."
    pool = [sentence() for _ in range(60)]
    texts = ["\n".join([*rng.sample(pool, 3), "x", "y"]) for _ in range(80)]
    texts += [f"{texts[0]}\nA {pool[0][:-1].lower()} and more.", "no sentence\n" * 9]
    docs = spark.createDataFrame([(i, t, t.count("\n") + 1) for i, t in enumerate(texts)] + [(900, None, 30)], "doc_id long, text string, n_lines int")
    mark = lambda *x: hashlib.md5(":".join(map(str, x)).encode()).hexdigest()
    want = []
    for i, t in sorted(enumerate(texts), key=lambda x: mark(x[0], 7)):
        if not 4 <= t.count("\n") + 1 <= 9:
            continue
        for m in re.finditer(evaluate.SENTENCE, t):
            phrase = m.group(0).strip()
            if len(re.findall(evaluate.WORD, phrase)) >= 8 and sum(phrase in u for u in texts) == 1:
                want.append((i, phrase))
                break
    for n in (3, 500):
        got = evaluate.cases(docs, n, least=4, most=9)
        assert [(r.wanted, r.phrase) for r in got.orderBy("case_id").collect()] == want[:n]
    for r in evaluate.with_query(got).collect():
        tail = r.words[3:]
        assert r["query"].split() == [w for _, w in sorted((mark(r.wanted, 11, i), w) for i, w in enumerate(tail))][: max(3, len(tail) // 2)]
    assert evaluate.cases(docs.limit(0)).collect() == []


def test_sentences_in_one_walk(spark):
    """What the pattern finds, at the edges of its lengths; no sentence is exchanged to count it."""
    import random

    rng = random.Random(3)
    run = lambda n: "".join(rng.choice("aeiou" * 4 + "   \t\r\u00e9\U0001f600") for _ in range(n))
    texts = ["".join(run(rng.choice([0, 3, 69, 70, 71, 139, 140, 141, 142, 300])) + rng.choice(".!?\n") for _ in range(12)) + run(200) for _ in range(60)]
    texts += ["", "\n", ".", run(5000), run(70) + ".", run(69) + "!", (run(140) + "?") * 2]
    docs = spark.createDataFrame([(i, t, 30) for i, t in enumerate(texts)] + [(900, None, 30)], "doc_id long, text string, n_lines int")
    want = [(i, p, x.strip(" ")) for i, t in enumerate(texts) for p, x in enumerate(re.findall(evaluate.SENTENCE, t)) if len(re.findall(evaluate.WORD, x)) >= evaluate.WORDS]
    assert len(want) > 100
    assert sorted((r.doc_id, r.place, r.phrase) for r in evaluate.sentences(docs.select("doc_id", "text")).collect()) == want
    plan = evaluate.single(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_cases_where_few_sentences_are_single(spark, monkeypatch):
    """Sentences within longer ones of another document: looked for in few walks of the texts, not a few documents at a time."""
    import hashlib

    last = max(range(300), key=lambda i: hashlib.md5(f"{i}:7".encode()).hexdigest())
    sentence = lambda i: f"Number {i:04} has many words that stand together in one single sentence of some length."
    rows = [(i, sentence(i) + "\nx" * 5, 6) for i in range(300)] + [(900, "\n".join("But " + sentence(i) for i in range(300) if i != last), 300)]
    asked, holders = [], evaluate.holders
    monkeypatch.setattr(evaluate, "holders", lambda docs, phrases: asked.append(len(phrases)) or holders(docs, phrases))
    got = evaluate.cases(spark.createDataFrame(rows, "doc_id long, text string, n_lines int"), 1, least=5, most=50).collect()
    assert [(r.wanted, r.phrase) for r in got] == [(last, sentence(last))]
    assert sum(asked) == 300 and len(asked) <= 5


def test_keyword_batch_by_terms(spark, docs):
    postings = S.postings(docs)
    n, avgdl = docs.select(F.size(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*|[0-9]+"), F.lit(0))).alias("d")).agg(F.count("*"), F.avg("d")).first()
    terms = spark.createDataFrame([(1, "fox"), (1, "quick"), (1, "fox"), (2, "layer"), (3, "none")], "query_id long, term string")
    got = batch.keyword_many(postings, n, avgdl, terms, 3).collect()
    for i, q in ((1, "fox quick"), (2, "layer"), (3, "none")):
        assert [(r.doc_id, round(r.score, 9)) for r in sorted(got, key=lambda r: r.pos) if r.query_id == i] == [(r.doc_id, round(r.score, 9)) for r in S.keyword(docs, q, 3).collect()]


def test_keyword_batch_in_pieces(spark, monkeypatch):
    """Documents across batches, and more queries than a part has; no row for each query and posting is exchanged."""
    texts = {i: " ".join(["fox"] * (i % 5) + ["the", "quick"] * (i % 3) + [f"w{i % 11}"]) for i in range(300)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    postings, avgdl = S.postings(docs), sum(len(t.split()) for t in texts.values()) / 300
    terms = spark.createDataFrame([(q, w) for q in range(40) for w in ("fox", "the", f"w{q}")], "query_id long, term string")
    key = lambda df: sorted((r.query_id, r.pos, r.doc_id, round(r.score, 9)) for r in df.collect())
    whole = key(batch.keyword_many(postings, 300, avgdl, terms, 7))
    for q in (0, 5, 39):
        assert [x[2:] for x in whole if x[0] == q] == [(r.doc_id, round(r.score, 9)) for r in S.keyword(docs, f"fox the w{q}", 7).collect()]
    monkeypatch.setattr(batch, "PAIRS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert key(batch.keyword_many(postings, 300, avgdl, terms, 7)) == whole
        assert batch.keyword_many(postings, 300, avgdl, terms.limit(0), 7).collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = batch.keyword_many(postings, 300, avgdl, terms, 7)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id#" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id#", plan)


def test_answers(spark):
    from gleaner.functions import fixed
    from gleaner.plans import answers

    hits = [(1, i, 10 + i, f"p{i}", t, i % 2 == 1) for i, t in enumerate(["one", " ", "password = hunter2hunter2", None, "two", "three"])] + [(2, 0, 20, "q", "token = 0123456789abcdef", True)]
    found = spark.createDataFrame(hits, "query_id long, pos int, doc_id long, path string, text string, lexical boolean")
    own = answers.sources(found, 2)
    assert sorted(tuple(r) for r in own.collect()) == [(1, 1, 10, "p0", "one"), (1, 2, 14, "p4", "two")]
    told = {r.query_id: (r.sent, r.blocked) for r in answers.withheld(found, 2).collect()}
    assert told[1] == (2, 1) and told[2] == (0, 1)
    asked = spark.createDataFrame([(1, "which?"), (2, "what?"), (3, "none")], "query_id long, query string")
    prompt = answers.prompts(asked, own).collect()
    assert [r.query_id for r in prompt] == [1] and "[1] p0\none\n\n[2] p4\ntwo" in prompt[0].prompt
    said = {r.query_id: (r.answer, r.error) for r in answers.ask(asked, own, lambda prompts: [f" {len(prompts)} [2] [7]. " for _ in prompts]).collect()}
    assert said == {1: ("1 [2] [7].", None), 2: (fixed.REFUSAL, None), 3: (fixed.REFUSAL, None)}
    assert {r.error for r in answers.ask(asked, own, lambda prompts: prompts[9]).where("query_id = 1").collect()} == {"IndexError: list index out of range"}
    assert {r.error for r in answers.ask(asked, own, lambda prompts: [None for _ in prompts]).where("query_id = 1").collect()} == {"no content"}
    given = spark.createDataFrame([(1, "x [2] [7] [2]"), (1, "plain"), (1, f'"{fixed.REFUSAL}"'), (3, "[1]"), (1, None)], "query_id long, answer string")
    got = [(r.answer, [tuple(c) for c in r.citations], r.invented, r.refused, r.uncited) for r in answers.cited(given, own).collect()]
    assert sorted(got, key=str) == sorted([("x [2] [7] [2]", [(2, "p4")], [7], False, False), ("plain", [], [], False, True), (f'"{fixed.REFUSAL}"', [], [], True, False), ("[1]", [], [1], False, True), (None, [], [], False, True)], key=str)
    assert [(r.doc_id, r.group, r.place, r.total, r.left) for r in answers.page(found.where("query_id = 1"), 2, 4).orderBy("place").collect()] == [(12, "meaning", 5, 6, 0), (14, "meaning", 6, 6, 0)]
    first = answers.page(found, 1, 4).where("query_id = 1").orderBy("place").collect()
    assert [r.doc_id for r in first] == [11, 13, 15, 10] and {r.left for r in first} == {2}


def test_what_is_broadcast_is_plain(spark, monkeypatch, docs):
    """Executors need not have this package to read it."""
    import pickle

    from pyspark import SparkContext

    sent, send = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or send(self, value))
    batch.search_many(Engine(docs), spark.createDataFrame([(1, "fox under 1kb"), (2, "'qu'")], "query_id long, query string")).collect()
    evaluate.holders(docs, ["fox"])
    assert sent and not any(b"gleaner" in x for x in sent)
