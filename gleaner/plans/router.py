"""Reading a query: its kind, its filters, and how the backends' lists become one.

Plain functions of strings and short lists; nothing here touches a table.
"""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import datetime, timedelta

from gleaner.functions import fixed

LIMIT, SEMANTIC_LIMIT = 400, 5
_FILENAME = re.compile(fixed.FILENAME, re.I)
_SHAPE = re.compile(fixed.CALL_OR_ATTRIBUTE)
_UNITS = {"": 0, "b": 0, "k": 1, "m": 2, "g": 3, "t": 4}
_SIZE = r"\s*(\d+(?:\.\d+)?)(?![\d.])(?!\s*(?:sec|min|hour|day|week|month|year))(?:\s*([kmgt]i?b|[kmgtb])\b)?"
_OVER = re.compile(r"(?:\b(?:over|larger than|bigger than|greater than|above)|>)" + _SIZE)
_UNDER = re.compile(r"(?:\b(?:under|smaller than|less than|below)|<)" + _SIZE)
_ABOUT = re.compile(r"\b(\d+(?:\.\d+)?)\s*(tb|gb|mb|kb)\b")
_WHEN = re.compile(fixed.MOMENT)
_EXT = re.compile(fixed.SUFFIX)


def classify(query: str) -> dict:
    """kind, backends in order, reasons; the first rule that fits."""
    q = query.strip()
    if len(q) > 1 and q[0] == q[-1] and q[0] in "\"'":
        return {"kind": "literal", "backends": ["exact"], "reasons": ["quoted: the text itself"]}
    if " " not in q and _FILENAME.match(q):
        return {"kind": "filename", "backends": ["path", "keyword"], "reasons": ["a name with a known extension"]}
    if set(q) & set(fixed.CODE_CHARS) or _SHAPE.search(q):
        return {"kind": "code", "backends": ["exact", "keyword", "path"], "reasons": ["code punctuation, or a call or attribute"]}
    if q.lower().startswith(fixed.QUESTION_STARTS):
        return {"kind": "question", "backends": ["semantic", "keyword", "path"], "reasons": ["worded as a question"]}
    return {"kind": "prose", "backends": ["semantic", "keyword", "exact", "path"], "reasons": ["plain words: everything is tried"]}


def literal(query: str) -> str:
    """What exact search looks for: the query without enclosing quotes."""
    q = query.strip()
    return q[1:-1] if len(q) > 1 and q[0] == q[-1] and q[0] in "\"'" else query


def exact_applies(query: str) -> bool:
    """Exact search is for fragments: quoted text, or punctuation that is not just a file name's."""
    q = query.strip()
    if classify(q)["kind"] == "literal":
        return True
    return bool(re.search(r"[^\w\s.]", q)) and not re.fullmatch(r"[\w\-]+\.[A-Za-z0-9]{1,6}", q)


def _bytes(number: str, unit: str) -> int:
    return int(float(number) * 1024 ** _UNITS[(unit or "")[:1]])


def _moment(word: str, number: str | None, unit: str | None, now: datetime, compat: bool) -> tuple[float, float | None]:
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    day = timedelta(days=1)
    week = midnight - day * midnight.weekday()
    month = midnight.replace(day=1)
    if number:
        return (now - int(number) * {"hour": timedelta(hours=1), "day": day, "week": 7 * day, "month": 30 * day}[unit]).timestamp(), None
    if word == "last month":
        if compat:
            return (midnight - (now.day + 27) * day).timestamp(), month.timestamp()
        before = month - day
        return (month - monthrange(before.year, before.month)[1] * day).timestamp(), month.timestamp()
    span = {"today": (midnight, None), "yesterday": (midnight - day, midnight), "this week": (week, None), "last week": (week - 7 * day, week), "this month": (month, None)}
    a, b = span[word]
    return a.timestamp(), b.timestamp() if b else None


def parse(query: str, now: datetime | None = None, compat: bool = False) -> dict:
    """Filters min_bytes, max_bytes, since, until, ext, and ``leftover``: the words they did not use. Empty without a filter."""
    q = query.lower()
    out: dict = {}
    used: list[tuple[int, int]] = []

    def take(m: re.Match) -> re.Match:
        used.append(m.span())
        return m

    if m := _OVER.search(q):
        out["min_bytes"] = _bytes(*take(m).groups())
    if m := _UNDER.search(q):
        out["max_bytes"] = _bytes(*take(m).groups())
    if not out and (m := _ABOUT.search(q)):
        number, unit = take(m).groups()
        one = 1024 ** _UNITS[unit[0]]
        out["min_bytes"], out["max_bytes"] = int(float(number) * one), int((float(number) + 1) * one) - 1
    if m := _WHEN.search(q):
        word, number, unit = take(m).groups()
        out["since"], until = _moment(word, number, unit, now or datetime.now(), compat)
        if until is not None:
            out["until"] = until
    if m := _EXT.search(q):
        out["ext"] = take(m).group(1)
    if not out:
        return {}
    for a, b in sorted(used, reverse=True):
        q = q[:a] + " " + q[b:]
    return out | {"leftover": " ".join(q.split())}


def has_text(filters: dict) -> bool:
    """Whether the filters left words to search for."""
    return any(len(w) > 1 and w not in fixed.FILLER for w in filters.get("leftover", "").split())


def describe(filters: dict) -> str:
    """The filters in words."""
    part = {"min_bytes": "at least {} bytes", "max_bytes": "at most {} bytes", "since": "changed since {}", "until": "changed before {}", "ext": "named *{}"}
    return ", ".join(words.format(filters[k]) for k, words in part.items() if k in filters)


def weight(backend: str, pure_filter: bool) -> float:
    return 4.0 if backend == "path" else (6.0 if pure_filter else 2.5) if backend == "meta" else 1.0


def primary(kind: str, lists: dict[str, list], best_path: float, pure_filter: bool) -> str | None:
    """The backend whose list leads; an empty one gives way to the weightiest that is not."""
    lead = "meta" if pure_filter else "path" if best_path >= 3 or kind == "filename" else "exact" if kind == "code" else "keyword"
    if lists.get(lead):
        return lead
    full = [b for b in lists if lists[b]]
    return max(full, key=lambda b: weight(b, pure_filter)) if full else None


def interleave(lists: dict[str, list], lead: str | None, pure_filter: bool = False) -> list:
    """The leading list, then the others in turn, weightier first, each giving its next key not seen yet."""
    if lead is None:
        return []
    order = list(dict.fromkeys(lists[lead]))
    seen = set(order)
    rest = [iter(lists[b]) for b in sorted((b for b in lists if b != lead), key=lambda b: -weight(b, pure_filter))]
    while rest:
        for turn in list(rest):
            key = next((k for k in turn if k not in seen), None)
            if key is None:
                rest.remove(turn)
            else:
                seen.add(key)
                order.append(key)
    return order
