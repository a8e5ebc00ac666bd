from datetime import datetime

import pytest
from gleaner.plans import router as R

NOW = datetime(2024, 3, 15, 12, 0)


@pytest.mark.parametrize(
    ("query", "kind"),
    [('"foo bar"', "literal"), ("config.py", "filename"), ("db_acl.php", "code"), ("InputLayer(shape=(784,))", "code"), ("find config.py", "code"), ("how do I check video smoothness", "question"), ("whatsapp backup", "question"), ("screenshot", "prose")],
)
def test_kinds(query, kind):
    assert R.classify(query)["kind"] == kind


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("screenshot", {}), ("10gb files", {"min_bytes": 10737418240, "max_bytes": 11811160063}), ("2mb files", {"min_bytes": 2097152, "max_bytes": 3145727}),
        ("files over 100 mb", {"min_bytes": 104857600}), ("over 1.5 kb", {"min_bytes": 1536}), ("under 5mb notes", {"max_bytes": 5242880}), ("*.php", {"ext": ".php"}),
        ("recent php files about authentication", {}), ("> 100mb", {"min_bytes": 104857600}), ("over 5 tb", {"min_bytes": 5 * 1024**4}), ("over 10 minutes", {}),
    ],
)
def test_filters(query, want):
    got = R.parse(query, NOW)
    assert {k: v for k, v in got.items() if k != "leftover"} == want


def test_leftover_decides_whether_text_is_searched():
    assert not R.has_text(R.parse("10gb files")) and not R.has_text(R.parse("*.php"))
    assert R.has_text(R.parse("under 5mb notes"))


def test_times():
    day = 86400
    today = datetime(2024, 3, 15).timestamp()
    assert R.parse("today", NOW)["since"] == today
    assert (R.parse("yesterday", NOW)["since"], R.parse("yesterday", NOW)["until"]) == (today - day, today)
    assert R.parse("last month", NOW)["since"] == datetime(2024, 2, 1).timestamp()
    assert R.parse("last month", NOW, compat=True)["since"] == datetime(2024, 2, 2).timestamp()
    assert R.parse("in the last 2 days", NOW)["since"] == NOW.timestamp() - 2 * day


def test_gate_and_quotes():
    assert R.exact_applies("f(x)") and R.exact_applies('"two words"') and not R.exact_applies("screenshot") and not R.exact_applies("db_acl.php")
    assert R.literal("'a b'") == "a b"


def test_interleave():
    lists = {"keyword": [1, 2, 3], "path": [3, 4], "meta": [5, 1, 6], "semantic": []}
    assert R.interleave(lists, "keyword") == [1, 2, 3, 4, 5, 6]
    assert R.primary("prose", lists, 0.0, False) == "keyword"
    assert R.primary("prose", lists, 6.0, False) == "path"
    assert R.primary("code", lists, 0.0, False) == "path"  # exact found nothing: the weightiest other list leads
