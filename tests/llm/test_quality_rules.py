import duckdb
import numpy as np
from gleaner.llm.quality_rules import document_metrics, quality_rules
from gleaner.llm.sql import quality_rules_sql

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept int"


def corpus():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdeéñst"), int(rng.integers(2, 9))))
    rows = []
    for i in range(160):
        text = "\n".join(" ".join(word() for _ in range(int(rng.integers(5, 15)))) for _ in range(6))
        if i % 9 == 0:
            text = text.replace(" ", "### ")
        if i % 11 == 0:
            text = " ".join(w for x in text.split()[:15] for w in [x] * 7)
        if i % 13 == 0:
            text = "\n".join([text.split("\n")[0]] * 9)
        rows.append((i, text, ["en", "fr", None][i % 3], ["hot", "hot", None, f"s{i % 50}"][i % 4], "clash", 1))
    odd = [None, "", " \t\r\n\x0b\x0c", "one", "a b c d e f g h", "a b c d e f g h i", "x " * 20000, "a b c d e f g h " * 3, "no\x1cbreak\x85here a b c d e f g h i j k l m n o p q r s t", "\r\n".join(["same line here"] * 30)]
    rows += [(1000 + i, t, "en", "hot", "clash", 1) for i, t in enumerate(odd)]
    return rows


def brute(text):
    words = [w.decode() for w in (text or "").encode().split()]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    repeated = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)} if len(words) < 3000 else set(range(len(words)))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_counts_match_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r for r in document_metrics(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), i


def test_verdicts_match_sql(spark, tmp_path):
    frame = spark.createDataFrame(corpus(), SCHEMA)
    path = str(tmp_path / "d")
    frame.write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT doc_id, text, lang, source FROM '{path}/*.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, base_failed, kept FROM ({quality_rules_sql()})").fetchall()}
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules(frame).collect()}
    assert got == want
    assert sum(k for _, k in got.values()) > 80 and sum(not b and not k for b, k in got.values()) > 5


def test_repeated_rows_and_empty(spark):
    rows = [(1, "a b", None, None, "", 0)] * 3
    assert [r.kept for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()] == [False] * 3
    assert quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
