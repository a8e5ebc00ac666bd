"""The tree source and the ingest that reads from it."""

import os

import pytest
from gleaner.functions import text as X
from gleaner.sources import files
from gleaner.sources.tree import TreeReader, tree
from pyspark.sql import functions as F

FILES = ["a.py", "Makefile", "pkg/b.md", "pkg/__init__.py", "pkg/_private.py", ".env", ".gitignore", "_site/x.md", "pkg/.github/ci.yml", "node_modules/q.js", "deep/1/2/3/4/end.txt"]


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "venv" / "tree"
    for name in FILES:
        p = base / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"text of {name}")
    (base / "link").symlink_to(base / "pkg")
    (base / "pkg" / "loop").symlink_to(base)
    (base / "file_link.md").symlink_to(base / "a.py")
    (base / "broken").symlink_to(base / "nowhere")
    os.mkfifo(base / "pipe")
    return str(base)


def names(df, root):
    return sorted(r.path.removeprefix(root + "/") for r in df.collect())


@pytest.mark.parametrize("subtrees", [1, 2, 5, 256])
def test_every_entry_comes_once(spark, root, subtrees):
    rows = tree(spark, root, subtrees=subtrees).collect()
    got = {r.path.removeprefix(root + "/"): (r.kind, r.reason) for r in rows}
    assert len(got) == len(rows)
    assert {k for k, v in got.items() if v[0] == "file"} == set(FILES) - {"node_modules/q.js"} | {"file_link.md"}
    assert {k: v[1] for k, v in got.items() if v[0] == "skipped"} == {
        "node_modules": "dir:node_modules", "link": "symlink_dir", "pkg/loop": "symlink_dir", "broken": "stat_failed", "pipe": "not_regular_file",
    }
    assert {k for k, v in got.items() if v[0] == "dir"} == {"pkg", "_site", "pkg/.github", "deep", "deep/1", "deep/1/2", "deep/1/2/3", "deep/1/2/3/4"}


def test_the_driver_plans_directories_only(root):
    for subtrees in (1, 3, 6, 256):
        reader = TreeReader(root, {"node_modules"}, subtrees)
        parts = reader.partitions()
        assert len(parts) <= max(subtrees, 1) and all(os.path.isdir(p.folder) for p in parts)
        rows = [r[0] for p in parts for r in reader.rows(p)]
        assert len(rows) == len(set(rows)) == len(FILES) - 1 + 1 + 5 + 8


def test_a_wide_directory_is_dealt_by_name(tmp_path):
    for i in range(40):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "f.txt").write_text("x")
    reader = TreeReader(str(tmp_path), set(), 8)
    parts = reader.partitions()
    assert len(parts) == 8 and max(sum(1 for _ in reader.rows(p)) for p in parts) < 40
    assert len({r[0] for p in parts for r in reader.rows(p)}) == 80


def test_a_wide_directory_is_listed_once(spark, tmp_path, monkeypatch):
    from gleaner.sources.tree import Disk, batches

    for i in range(40):
        (tmp_path / f"d{i}" / "in").mkdir(parents=True)
        (tmp_path / f"d{i}" / "in" / "f.txt").write_text("x")
    listed, entries = [], Disk.entries
    monkeypatch.setattr(Disk, "entries", lambda self, folder: listed.append(folder) or entries(self, folder))
    reader = TreeReader(str(tmp_path), set(), 8, later=True)
    parts = reader.partitions()
    assert len(parts) == 1
    listed.clear()
    found = [r for b in reader.walk(batches(reader.rows(parts[0]))) for r in b.to_pylist()]
    assert len(listed) == len(set(listed)) == 81  # the root, and two below each of its directories
    assert len({r["path"] for r in found}) == len(found) == 120 and {r["kind"] for r in found} == {"dir", "file"}
    assert {tuple(r) for r in tree(spark, str(tmp_path), subtrees=8).collect()} == {tuple(r.values()) for r in found}


def test_files_are_read_and_decoded_in_one_step(spark, tmp_path):
    held = {"a.md": b"a\r\nb", "nul": b"x\0y", "late": b"x" * 9000 + b"\0", "blank.md": b"   ", "lines.md": b"\n\n ", "empty.md": b"", "bad.md": b"\xff ok", ".pdf": b"text", "p.png": b"pixels", "none.md": b"gone"}
    for name, content in held.items():
        (tmp_path / name).write_bytes(content)

    def read(path):
        if path.endswith("none.md"):
            raise OSError(path)
        return files.opened(path)

    def told(**how):
        docs, ledger = files.ingest(spark, str(tmp_path), read=read, **how)
        assert docs._jdf.queryExecution().executedPlan().toString().count("Python") == ledger._jdf.queryExecution().executedPlan().toString().count("Python") == 0
        return {os.path.basename(r.path): r.text for r in docs.collect()}, {os.path.basename(r.path): r.reason for r in ledger.collect()}

    text = {"a.md": "a\nb", "late": "x" * 4000 + " …[line truncated]", "lines.md": "\n\n ", "bad.md": "\ufffd ok"}
    why = {"nul": "unknown_ext", "blank.md": "no_text_content", "empty.md": "no_text_content", "none.md": "unreadable"}
    assert told() == (text, why | {".pdf": "no_text_content", "p.png": "media"})
    assert told(media=F.concat(F.lit("of "), F.col("content").cast("string"))) == (text | {".pdf": "of text", "p.png": "of pixels"}, why)


def test_odd_roots(spark, tmp_path):
    assert [(r.kind, r.reason) for r in tree(spark, f"{tmp_path}/none").collect()] == [("skipped", "root_missing")]
    assert tree(spark, str(tmp_path)).count() == 0
    (tmp_path / "x.md").write_text("x")
    assert [r.path for r in tree(spark, f"file://{tmp_path}/").collect()] == [f"{tmp_path}/x.md"]
    with open(os.fsencode(str(tmp_path)) + b"/bad\xff.md", "w"):
        pass
    assert {r.reason for r in tree(spark, str(tmp_path)).collect()} == {None, "bad_name"}


def test_ingest_loses_nothing(spark, root):
    docs, ledger = files.ingest(spark, root)
    every = tree(spark, root)
    found = {r.path: r for r in docs.collect()}
    skipped = {r.path: r.reason for r in ledger.collect()}
    assert {r.path for r in every.collect()} == set(found) | set(skipped) and not set(found) & set(skipped)
    lang = {k.removeprefix(root + "/"): r.lang for k, r in found.items() if not r.is_dir}
    assert lang == {
        "a.py": "python", "Makefile": "make", "pkg/b.md": "markdown", "pkg/__init__.py": "python", "pkg/_private.py": "python", ".env": "env", "_site/x.md": "markdown", "pkg/.github/ci.yml": "yaml",
        "file_link.md": "markdown", "deep/1/2/3/4/end.txt": "text", ".gitignore": "text",
    }
    again, _ = files.ingest(spark, root, known=docs)
    assert again.where("not is_dir").count() == 0


def test_include_deps_prunes_dotted_names_only(spark, root):
    os.makedirs(f"{root}/.git")
    with open(f"{root}/.git/HEAD", "w") as f:
        f.write("ref")
    got = names(tree(spark, root, include_deps=True).where("kind = 'file'"), root)
    assert "node_modules/q.js" in got and ".git/HEAD" not in got
    assert files.pruned(spark, root).first().files == 2 and files.pruned(spark, root, include_deps=True).first().files == 1


def test_languages(spark):
    want = {"Makefile": "make", "x/Dockerfile": "docker", ".env.json": "json", ".env": "env", ".env.local": "env", "CMakeLists.txt": "text", "a.PY": "python", "none": "text", "x.unknown": "text", "d.py/none": "text"}
    rows = spark.createDataFrame([(k,) for k in want], "p string").select("p", X.language_of(F.col("p")).alias("l")).collect()
    assert {r.p: r.l for r in rows} == want


def test_grep_with_a_budget(spark, tmp_path):
    import time

    sizes = {"a": 10, "b": 70_000, "c": 2_000_000, "d": 20}
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(b"x" * size + (b"" if name == "d" else b" NeedLe"))
    ledger = spark.createDataFrame([(f"{tmp_path}/{n}", s) for n, s in sizes.items()] + [(f"{tmp_path}/gone", 15)], "path string, size long")
    shown = lambda df: [(r.path and r.path[-1], r.timed_out, r.checked, r.total) for r in df.collect()]
    assert shown(files.grep_within(spark, ledger, "needle", budget=60)) == [(n, None, None, None) for n in "abc"]
    assert shown(files.grep_within(spark, ledger, "needle", limit=2, budget=60)) == [(n, None, None, None) for n in "ab"]
    assert shown(files.grep_within(spark, ledger, "needle", budget=0)) == [(None, True, 0, 5)]
    assert shown(files.grep_within(spark, ledger, "  ")) == []

    def slow(path):
        if path.endswith("c"):
            time.sleep(60)
        return files.opened(path)

    start = time.time()
    *hits, last = shown(files.grep_within(spark, ledger, "needle", budget=8, read=slow))
    assert time.time() - start < 40 and hits == [("a", None, None, None), ("b", None, None, None)] and last == (None, True, 4, 5)
