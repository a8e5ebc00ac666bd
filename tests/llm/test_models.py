"""The two learned operators: held-out accuracy on made-up text, gradients, and odd rows."""

import math
from collections import Counter

import numpy as np
from gleaner.llm import language_id, quality_model

DOCS = "doc_id long, text string, lang string, score string"
ODD = [(9000, None, "en", "x"), (9001, "", "en", "x"), (9002, "123 !?", None, "x"), (9003, "é" * 300000, "fr", "x"), (9004, "日本語", None, "x"), (9004, "日本語", None, "x")]


def sentence(rng, parts, n):
    return " ".join("".join(rng.choice(parts, int(rng.integers(1, 4)))) for _ in range(n))


def test_language_held_out(spark):
    rng = np.random.default_rng(2)
    parts = {"aa": ["tion", "the", "ing", "er"], "bb": ["sch", "ung", "ein", "er"], "cc": ["eau", "que", "ment", "er"]}
    rows = [(i, sentence(rng, parts[k], int(rng.integers(3, 60))), k, "x") for i in range(300) for k in [list(parts)[i % 3]]]
    frame = spark.createDataFrame(rows + ODD, DOCS)
    model = language_id.fit(frame.where("doc_id < 200"))
    got = {r.doc_id: r for r in language_id.identify(frame, model).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k, _ in rows[200:]]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3 and got[9004].lang_pred in parts
    assert language_id.identify(frame, model).count() == len(rows) + len(ODD)
    none = language_id.fit(frame.limit(0))
    assert {r.lang_pred for r in language_id.identify(frame, none).collect()} == {"und"}
    assert language_id.identify(frame.limit(0), model).count() == 0


def language_brute(training, texts, apart=0.5):
    """The model from its description: dense counts in dictionaries over all training rows."""
    import regex

    langs = sorted({k for _, k in training})
    tables = []
    words = {k: Counter(w for t, own in training if own == k for w in regex.findall(r"\p{L}+", t.lower())) for k in langs}
    grams = {k: Counter(f"^{w}$"[i : i + n] for w in words[k] for n in range(1, 6) for i in range(len(w) + 3 - n)) for k in langs}
    for of in (words, grams):
        every = sum(of.values(), Counter())
        tables.append({x: [math.log((of[k][x] + apart) / (sum(of[k].values()) + apart * len(every) + 1)) for k in langs] for x, n in every.items() if n > 1})
    out = []
    for t in texts:
        found = regex.findall(r"\p{L}+", (t or "").lower())
        if not found:
            out.append(("und", 0.0))
            continue
        total, n = [0.0] * len(langs), 0
        for w in found:
            rows = [tables[0][w]] if w in tables[0] else next((r for m in range(5, 0, -1) if (r := [tables[1][x] for i in range(len(w) + 3 - m) if (x := f"^{w}$"[i : i + m]) in tables[1]])), [])
            if rows:
                n += 1
                total = [a + sum(r[j] for r in rows) / len(rows) for j, a in enumerate(total)]
        sizes = [sum(k == own for _, own in training) for k in langs]
        x = [a * min(1, 20 / max(n, 1)) + math.log(s / sum(sizes)) for a, s in zip(total, sizes, strict=True)]
        best = max(range(len(langs)), key=lambda j: (x[j], -j))
        out.append((langs[best], 1 / sum(math.exp(y - x[best]) for y in x)))
    return out


def test_language_against_brute_force(spark):
    rng = np.random.default_rng(3)
    parts = {"aa": ["tion", "the", "ing", "er"], "bb": ["sch", "ung", "ein", "er"], "cc": ["eau", "que", "ment", "er"], "dd": ["ß", "é", "ö"]}
    rows = [(i, sentence(rng, parts[k], int(rng.integers(3, 30))), k, "x") for i in range(120) for k in [list(parts)[(i * i) % 4]]]
    texts = [sentence(rng, [*parts["aa"], *parts["bb"], "xq", "zz"], n) for n in (1, 2, 5, 40, 400)] + ["x²y tion", "a_b er3ing", "日本", None, "12", "ER the", "²"]
    model = language_id.fit(spark.createDataFrame(rows, DOCS))
    got = language_id.identify(spark.createDataFrame([(i, t, None, "") for i, t in enumerate(texts)], DOCS), model).collect()
    want = language_brute([(t, k) for _, t, k, _ in rows], texts)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-9, texts[r.doc_id]


def test_many_languages_and_bounds(spark):
    rows = [(i, f"lang{i % 700:03d}".translate(str.maketrans("0123456789", "abcdefghij")) + " common", f"l{i % 700}", "x") for i in range(1400)]
    frame = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(frame)
    assert len(model.langs) == 700
    got = language_id.identify(frame, model).collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id % 700}" for r in got]) > 0.99
    small = language_id.fit(frame, max_bytes=8000)
    assert len(small.langs) == 700 and len(small.words) < len(model.words)


def test_gradients_match_differences():
    net = quality_model.ByteConvNet(3)
    texts = [b"some words of text " * 20, b"", b"zz", b"other " * 70]
    y, w = np.array([1.0, 0, 0, 1]), np.array([1.0, 2, 1, 1])

    def loss():
        codes, first = quality_model._chunks(b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        full = np.zeros((first[-1], quality_model.FILTERS))
        x = sum(np.einsum("be,ef->bf", net.p["embed"], net.p["filters"][k])[codes[k : len(codes) - quality_model.WIDTH + k]] for k in range(quality_model.WIDTH))
        full = np.maximum(x.reshape(-1, quality_model.STRIDE, quality_model.FILTERS).max(axis=1) + net.p["bias"], 0)
        p = net._head(net._joined(full, first)[-1])[1]
        return -np.mean(w * (y * np.log(p) + (1 - y) * np.log(1 - p)))

    g = net._gradients(texts, y, w)
    rng = np.random.default_rng(0)
    for k, v in net.p.items():
        for _ in range(4):
            i = tuple(int(rng.integers(0, n)) for n in v.shape)
            keep, e = v[i], 1e-5
            v[i] = keep + e
            up = loss()
            v[i] = keep - e
            down = loss()
            v[i] = keep
            assert abs((up - down) / (2 * e) - g[k][i]) < 1e-4, k


def quality_brute(net, text):
    """The score of one text byte by byte."""
    p, codes = net.p, [0] * (quality_model.WIDTH - 1) + list(text)
    n = max(2, -(-len(codes) // quality_model.STRIDE)) * quality_model.STRIDE
    codes += [0] * (n + quality_model.WIDTH - len(codes))
    responses = [[max(0.0, p["bias"][f] + sum(float(p["embed"][codes[i + k]] @ p["filters"][k][:, f]) for k in range(quality_model.WIDTH))) for f in range(quality_model.FILTERS)] for i in range(n)]
    chunks = [np.max(responses[a : a + 2 * quality_model.STRIDE], axis=0) for a in range(0, n - quality_model.STRIDE, quality_model.STRIDE)]
    z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0), np.min(chunks, axis=0)])
    return 1 / (1 + math.exp(-float(np.tanh(z @ p["dense"] + p["dense_bias"]) @ p["out"] + p["out_bias"][0])))


def test_quality_against_brute_force():
    net = quality_model.ByteConvNet(5)
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 4, 124, 125, 251, 252, 253, 500)]
    assert np.allclose(net.score(texts), [quality_brute(net, t) for t in texts], atol=1e-5)


def test_quality_sample_is_bounded_and_repeatable(spark):
    rows = [(i % 50, f"text number {i % 7} " * (1 + i % 5), "en", "x") for i in range(200)] + [(60, "z" * 100_000, "en", "x")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(70)], "doc_id long, quality int")
    one = quality_model.fit(spark.createDataFrame(rows, DOCS), labels, max_bytes=20_000)
    two = quality_model.fit(spark.createDataFrame(rows[::-1], DOCS).repartition(3), labels, max_bytes=20_000)
    assert all((one.p[k] == two.p[k]).all() for k in one.p)


def test_quality_keeps_columns_whatever_their_names(spark):
    frame = spark.createDataFrame([(1, "a", "b", 2.0)], "doc_id long, text string, bytes_ string, _bytes double")
    out = quality_model.with_score(frame, quality_model.ByteConvNet(1), "s")
    assert out.columns == [*frame.columns, "s"] and tuple(out.first())[:4] == (1, "a", "b", 2.0)


def test_quality_held_out(spark):
    rng = np.random.default_rng(4)
    parts = ["tion", "the", "ing", "er", "an", "so"]
    rows = []
    for i in range(240):
        text = sentence(rng, parts, int(rng.integers(30, 200)))
        rows.append((i, text if i % 4 else text.replace(" ", "### "), "en", "x"))
    frame = spark.createDataFrame(rows + ODD, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), "x") for i in range(160)] + [(None, 1, "x"), (5000, None, "x"), (3, 0, "x"), (3, 0, "x")], "doc_id long, quality int, text string")
    net = quality_model.fit(frame, labels.where("doc_id != 3 or doc_id is null"))
    got = quality_model.score(frame, net).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    assert np.mean([(score[i] >= 0.5) == (i % 4 > 0) for i in range(160, 240)]) > 0.95
    assert quality_model.with_score(frame, net, "s").columns == [*frame.columns, "s"]
    assert quality_model.score(frame.limit(0), net).count() == 0
    assert {r.score for r in quality_model.score(frame, quality_model.fit(frame, labels.limit(0))).collect()} == {0.5}


def test_long_texts_score_alike_in_parts(monkeypatch):
    net = quality_model.ByteConvNet(5)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(32, 120, n).astype(np.uint8)) for n in (0, 1, 127, 128, 129, 700, 5000)]
    whole = net.score(texts)
    monkeypatch.setattr(quality_model, "BLOCK", 512)
    assert np.allclose(whole, net.score(texts)) and np.allclose(whole, [net.score([t])[0] for t in texts])


def test_what_is_broadcast_names_no_package(spark):
    import pickle

    rows = spark.createDataFrame([(1, "some words here", "en", ""), (2, "autres mots ici", "fr", "")], DOCS)
    for plain in (quality_model.ByteConvNet(1).plain(), vars(language_id.fit(rows))):
        assert b"gleaner" not in pickle.dumps(plain)
