"""The driver's module with and without the parts that may be missing."""

import subprocess
import sys

CODE = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name in {gone!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert set(s) <= set(q)
print(len(q), sum(n.startswith("op") for n in q), "pipeline" in q)
"""


def listed(*gone):
    out = subprocess.run([sys.executable, "-c", CODE.format(gone=gone)], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-800:]
    return out.stdout.split()


def test_queries_without_the_optional_parts():
    plain = listed("gleaner.llm", "corpus_pipeline")
    assert int(plain[0]) > 60 and plain[1:] == ["0", "False"]
    assert listed("xxhash", "zstandard", "tokenizers")[0] == plain[0]
