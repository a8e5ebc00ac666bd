"""Removal of repeated byte strings by deep-shallow suffix sorting.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in
a document with a smaller doc_id. Every window of LENGTH bytes has an anchor: the
GRAM-byte string in it with the least hash (the first of equals), which depends
on the window's bytes alone. So equal windows have equal anchors at equal places.

1. Blocks of documents ask which of their anchors occur in two documents at all
   (an exact filter: a window that repeats has an anchor that repeats).
2. For anchors that do, blocks send the text around them, once for each distinct
   text, with the smallest doc_id that has it. Texts with one anchor meet in one
   task, which sorts all their suffixes: multikey quicksort by eight bytes at a
   time to a shallow depth and on while a group is large, then blind tries, for
   all small groups at once, order what is left: a search looks only at branching
   bytes and one full comparison with the leaf it ends at. Equal suffixes meet in
   a leaf, which has the smallest doc_id of its window.
3. Blocks learn which windows occur earlier, and cut the covered bytes.

A string that a third of all documents share is sent once per block. An anchor
that more than ``HOT`` blocks have does not bring all its contexts to one bucket:
its windows are dealt by further bytes that they all hold, those behind the anchor
for windows that reach far behind it and those before it for the others. A block
and a task hold bounded amounts, and the text moves in compressed blocks. Blocks
and buckets grow with the square root of very large inputs, so the rows of an
exchange stay in proportion to the text.

Defined cases: null and empty texts have zero bytes; rows with equal doc_id do
not remove from each other; a null doc_id counts as the largest number and stays
null; texts shorter than LENGTH keep everything; a very long text has a block of
its own; doc_id is a whole number; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, bucket_count, exchange, make_blocks, pack_arrays, pack_keys, per_block, scaled, squeeze, unpack_arrays, unpack_keys, unsqueeze

LENGTH, GRAM = 50, 24
SPREAD = LENGTH - GRAM + 1  # grams in a window
CONTEXT = LENGTH + SPREAD - 1  # bytes that windows with one anchor can reach
SHALLOW, TRIE = 16, 32  # depth in bytes before tries, and suffixes in a trie at most
#: Positions scanned at a time, and text bytes for which there is one bucket.
PIECE, BUCKET_BYTES = 1 << 18, 8 << 20
#: Blocks that have an anchor before its windows are dealt by more bytes; windows that start at NEAR or later reach so many bytes behind the anchor.
HOT, NEAR = 32, 13
#: Bytes of text for which there are fifty anchors, about.
ROW_BYTES = 700
RECORD = CONTEXT + 3  # then the first and last window's start, and 0, or which half of a hot anchor's windows: 1 those from NEAR on, 2 the others
#: Suffixes sorted at a time, and suffixes in tries that grow together.
AT_ONCE, TOGETHER = 300_000, 16_384
NO_ID = (1 << 63) - 1
U = np.uint64
_MIX = U(0x9E3779B97F4A7C15)
_PLACE = U((1 << 24) - 1)


def encode(rows: list[tuple]) -> bytes:
    ids = np.array([NO_ID if d is None else d for d, _ in rows], "<i8")
    nulls = np.array([d is None for d, _ in rows], np.uint8)
    texts = [t or b"" for _, t in rows]
    sizes = np.array([len(t) for t in texts], "<i8")
    return squeeze(np.array([len(rows)], "<i8").tobytes() + ids.tobytes() + sizes.tobytes() + nulls.tobytes() + b"".join(texts), 5)


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, which are null, offsets, bytes (with CONTEXT zero bytes on either side)."""
    raw = unsqueeze(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ids, sizes = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
    text = np.zeros(len(raw) - 8 - 17 * n + 2 * CONTEXT, np.uint8)
    text[CONTEXT:-CONTEXT] = np.frombuffer(raw, np.uint8, -1, 8 + 17 * n)
    return ids, np.frombuffer(raw, np.uint8, n, 8 + 16 * n) > 0, np.concatenate([[0], np.cumsum(sizes)]) + CONTEXT, text


def words_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, the first one lowest."""
    return np.ndarray((len(text) - 7,), "<u8", text.data, 0, (1,))[at]


def gram_hashes(text: np.ndarray) -> np.ndarray:
    w = np.ndarray((len(text) - 7,), "<u8", text.data, 0, (1,))
    n = len(text) - GRAM + 1
    h = w[:n] * _MIX
    for k in range(8, GRAM, 8):
        h ^= h >> U(29)
        h ^= w[k : k + n]
        h *= _MIX
    h ^= h >> U(32)
    return h


def _spread(h: np.ndarray) -> np.ndarray:
    """One to one, and even: anchors are least hashes, which crowd the low end."""
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def anchors(offsets: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """place, hash, first and last window start of each anchor, over windows inside one document, by place."""
    places, hashes, firsts, lasts = [], [], [], []
    for begin in range(offsets[0], max(offsets[0], offsets[-1] - LENGTH + 1), PIECE):
        end = min(begin + PIECE, offsets[-1] - LENGTH + 1)  # window starts begin .. end - 1
        h = gram_hashes(text[begin : end + LENGTH - 1])
        key = (h & ~_PLACE) | np.arange(len(h), dtype=U)
        least, span = key, 1
        while span * 2 <= SPREAD:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: end - begin], least[SPREAD - span : SPREAD - span + end - begin])
        at = (least & _PLACE).astype(np.int64)
        start = np.arange(begin, end)
        inside = np.ones(end - begin, bool)
        for c in (offsets[np.searchsorted(offsets, begin, "right") : np.searchsorted(offsets, end + LENGTH - 1)] - begin).tolist():
            inside[max(0, c - LENGTH + 1) : max(0, c)] = False  # windows that would cross into the next text
        kept = np.flatnonzero(inside)
        if not len(kept):
            continue
        at, start = at[kept], start[kept]
        head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
        tail = np.r_[head[1:], len(at)] - 1
        places.append(at[head] + begin)
        hashes.append(_spread(h[at[head]]))
        firsts.append(start[head])
        lasts.append(start[tail])
    if not places:
        return (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(map(np.concatenate, (places, hashes, firsts, lasts)))


def _bucket_slices(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) over sorted keys, dealt by range of the hash."""
    if not len(keys):
        return
    of = (keys >> U(32)).astype(np.int64) * buckets >> 32
    edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    for a, b in zip(edges, np.r_[edges[1:], len(of)], strict=True):
        yield int(of[a]), int(a), int(b)


def _keys_of(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a block, sorted, and whether two of its documents have them."""
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], doc[order]
    head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    if not len(h):
        return h, np.zeros(0, np.uint8)
    return h[head], (np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)).astype(np.uint8)


def ask_anchors(buckets: int):
    def ask(data: bytes, known: list) -> Iterator[tuple[int, bytes]]:
        _, _, offsets, text = decode(data)
        place, h, _, _ = anchors(offsets, text)
        keys, many = _keys_of(h, np.searchsorted(offsets, place, "right"))
        for bucket, a, b in _bucket_slices(keys, buckets):
            yield bucket, pack_arrays(pack_keys(keys[a:b]), np.packbits(many[a:b]))

    return ask


def answer_anchors(asked: list[bytes]) -> list[bytes]:
    """For each key of each block: does it occur in two documents (1), and in more than HOT blocks (2)?"""
    keys, many = [], []
    for data in asked:
        steps, bits = unpack_arrays(data)
        keys.append(unpack_keys(steps))
        many.append(np.unpackbits(bits, count=len(steps)))
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    s = every[order]
    head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    n = np.diff(np.r_[head, len(s)])
    shared = (n > 1) | (np.maximum.reduceat(np.concatenate(many)[order], head) > 0)
    out = np.empty(len(every), np.uint8)
    out[order] = np.repeat(shared + 2 * (n > HOT), n)
    return [pack_arrays(x) for x in np.split(out, np.cumsum([len(k) for k in keys])[:-1])]


def _contexts(offsets: np.ndarray, text: np.ndarray, shared_by_bucket: dict[int, bytes], buckets: int) -> tuple[np.ndarray, ...]:
    """Windows of a block by shared anchor (a hot one's in two halves), in order of what they are dealt by: that hash, document, first and last window, record."""
    place, h, first, last = anchors(offsets, text)
    keys, _ = _keys_of(h, np.zeros(len(h), np.int64))
    flags = np.zeros(len(keys), np.uint8)
    for bucket, a, b in _bucket_slices(keys, buckets):
        flags[a:b] = unpack_arrays(shared_by_bucket[bucket])[0]
    flag = flags[np.searchsorted(keys, h)] if len(keys) else np.zeros(0, np.uint8)
    use = np.flatnonzero(flag & 1)
    place, h, first, last, hot = place[use], h[use], first[use], last[use], flag[use] > 1
    middle = place - (SPREAD - 1) + NEAR
    late, early = np.flatnonzero(hot & (last >= middle)), np.flatnonzero(hot & (first < middle))
    plain = np.flatnonzero(~hot)
    half = np.repeat(np.array([0, 1, 2], np.uint8), [len(plain), len(late), len(early)])
    row = np.concatenate([plain, late, early])
    first, last = np.where(half == 1, np.maximum(first, middle)[row], first[row]), np.where(half == 2, np.minimum(last, middle - 1)[row], last[row])
    place, h = place[row], h[row]
    origin = place - (SPREAD - 1)  # a record's byte 0: where a window ending in the anchor would start
    lo, hi = (first - origin).astype(np.uint8), (last - origin).astype(np.uint8)
    j = np.arange(CONTEXT)
    records = np.empty((len(row), RECORD), np.uint8)
    for a in range(0, len(row), 1 << 16):
        b = slice(a, a + (1 << 16))
        part = text[origin[b, None] + j]
        part[(j < lo[b, None]) | (j >= hi[b, None].astype(np.int64) + LENGTH)] = 0
        records[b, :CONTEXT] = part
    records[:, CONTEXT], records[:, CONTEXT + 1], records[:, CONTEXT + 2] = lo, hi, half
    h = np.where(half > 0, _spread(h + _further(records)), h)
    order = np.lexsort((place, h))
    return h[order], (np.searchsorted(offsets, place, "right") - 1)[order], first[order], last[order], records[order]


def _further(records: np.ndarray) -> np.ndarray:
    """Hash of the bytes beside the anchor that all windows of a half hold: NEAR behind it, or as many before it; 0 for no half."""
    half = records[:, CONTEXT + 2]
    padded = np.zeros((len(records), 16), np.uint8)
    padded[:, :NEAR] = np.where(half[:, None] == 1, records[:, SPREAD - 1 + GRAM : SPREAD - 1 + GRAM + NEAR], records[:, SPREAD - 1 - NEAR : SPREAD - 1])
    x, y = padded.view("<u8").T
    return np.where(half > 0, _spread(_spread(x + half) ^ y), U(0))


def _distinct(h: np.ndarray, doc_id: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of a first row, group of each row, least doc_id of each group) of rows with equal records, grouped in order of hash."""
    name = np.zeros(len(h), U)
    padded = np.zeros((len(h), -(-records.shape[1] // 8) * 8), np.uint8)
    padded[:, : records.shape[1]] = records
    columns = padded.view("<u8")
    for k in range(columns.shape[1]):
        name = (name ^ columns[:, k]) * _MIX
        name ^= name >> U(29)
    order = np.lexsort((name, h))
    same = np.ones(len(h), bool)
    if len(h):
        same[1:] = (columns[order[1:]] == columns[order[:-1]]).all(axis=1)
        same[0] = False
    head = np.flatnonzero(~same)
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(~same) - 1
    least = np.minimum.reduceat(doc_id[order], head) if len(h) else doc_id
    return order[head], group, least


def ask_windows(buckets: int):
    def ask(data: bytes, known: list[dict[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        ids, _, offsets, text = decode(data)
        h, doc, _, _, records = _contexts(offsets, text, known[0], buckets)
        one, _, least = _distinct(h, ids[doc], records)
        for bucket, a, b in _bucket_slices(h[one], buckets):
            yield bucket, pack_arrays(least[a:b], records[one[a:b]].reshape(-1))

    return ask


def sort_suffixes(text: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the LENGTH-byte suffixes that start at ``base``, and their class (equal numbers: equal bytes); suffixes that are alone at the shallow depth come first, with class -1."""
    order = np.argsort(words_at(text, base).byteswap(), kind="quicksort")
    group = np.cumsum(np.r_[True, (w := words_at(text, base[order]))[1:] != w[:-1]]) - 1 if len(base) else order
    alone: list[np.ndarray] = []
    done: list[tuple[np.ndarray, np.ndarray]] = []
    classes, depth = 0, 8
    while len(order):
        size = np.bincount(group)[group]
        alone.append(order[size == 1])
        tries = (size > 1) & (size <= TRIE) & (depth >= SHALLOW)
        low = 1
        for width in (TRIE // 8, TRIE // 4, TRIE):  # tries of about one size share a table
            own = np.flatnonzero(tries & (size > low) & (size <= width))
            low = width
            for part in _whole_groups(group[own]):
                picked = order[own[part]]
                leaf = _blind_tries(text, base[picked], group[own[part]], depth, width)
                done.append((picked, leaf + classes))
                classes += int(leaf.max()) + 1
        rest = (size > 1) & ~tries
        order, group = order[rest], group[rest]
        if not len(order):
            break
        if depth >= LENGTH:
            group = np.cumsum(np.r_[False, group[1:] != group[:-1]])
            done.append((order, group + classes))
            break
        step = min(depth, LENGTH - 8)  # the last eight bytes overlap those before
        w = words_at(text, base[order] + step)
        again = np.lexsort((w.byteswap(), group))
        order, group, w = order[again], group[again], w[again]
        group = np.cumsum(np.r_[False, (group[1:] != group[:-1]) | (w[1:] != w[:-1])])
        depth = step + 8
    single = np.concatenate(alone) if alone else np.zeros(0, np.int64)
    return np.concatenate([single, *(o for o, _ in done)]), np.concatenate([np.full(len(single), -1), *(c for _, c in done)])


def _whole_groups(group: np.ndarray) -> Iterator[slice]:
    """Runs of about TOGETHER rows that end where a group does."""
    at = 0
    while at < len(group):
        end = min(at + TOGETHER, len(group))
        end = int(np.searchsorted(group, group[end - 1], "right"))
        yield slice(at, end)
        at = end


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of suffixes known to share ``depth`` bytes."""
    lcp = np.full(len(a), LENGTH)
    open_ = np.arange(len(a))
    at = depth
    while at < LENGTH and len(open_):
        step = min(at, LENGTH - 8)
        x = words_at(text, a[open_] + step) ^ words_at(text, b[open_] + step)
        differs = x != 0
        y = x[differs]
        lcp[open_[differs]] = step + (np.bitwise_count((y & (~y + U(1))) - U(1)) >> 3).astype(np.int64)
        open_ = open_[~differs]
        at = step + 8
    return lcp


def _blind_tries(text: np.ndarray, base: np.ndarray, group: np.ndarray, depth: int, width: int) -> np.ndarray:
    """Leaf number of each suffix: tries of all groups grow together, a leaf a round.

    A trie is its leaves in order and the depths at which neighbours part. The
    search for a suffix reads its bytes at those depths only.
    """
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    trie = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(group)]))
    leaves = np.zeros((len(head), width), np.int64)
    parts = np.zeros((len(head), width), np.int64)
    number = np.zeros((len(head), width), np.int64)
    used = np.ones(len(head), np.int64)
    leaves[:, 0] = base[head]
    number[:, 0] = np.arange(len(head))
    total = len(head)
    out = np.full(len(base), -1)
    out[head] = number[:, 0]
    left = np.flatnonzero(out < 0)
    while len(left):
        t, x = trie[left], base[left]
        best, bar = np.zeros(len(left), np.int64), np.full(len(left), LENGTH)  # bar: skip deeper branches until one this shallow
        for i in range(1, int(used[t].max())):
            d = parts[t, i]
            look = (i < used[t]) & (d < bar)
            bar = np.where(look, LENGTH, bar)
            right = look & (text[x + np.minimum(d, LENGTH - 1)] >= text[leaves[t, i] + np.minimum(d, LENGTH - 1)])
            best = np.where(right, i, best)
            bar = np.where(look & ~right, d, bar)
        lcp = _common(text, x, leaves[t, best], depth)
        equal = lcp == LENGTH
        out[left[equal]] = number[t[equal], best[equal]]
        left, t, x, best, lcp = left[~equal], t[~equal], x[~equal], best[~equal], lcp[~equal]
        if not len(left):
            break
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])  # one new leaf for each trie that needs one
        g, y, j, depth_at = t[first], x[first], best[first], lcp[first]
        column = np.arange(width)
        within = column < used[g, None]
        apart = (parts[g] < depth_at[:, None]) & within  # neighbours that part above the new leaf's branch
        low = np.where(apart & (column <= j[:, None]) & (column > 0), column, 0).max(axis=1)
        high = np.where(apart & (column > j[:, None]), column, used[g, None]).min(axis=1)
        byte = text[y + depth_at]
        own = text[leaves[g] + depth_at[:, None]]
        larger = (column >= low[:, None]) & (column < high[:, None]) & (own > byte[:, None])
        spot = np.where(larger, column, high[:, None]).min(axis=1)
        before = parts[g, np.minimum(spot, width - 1)]
        moved = np.where(column > spot[:, None], column - 1, column)
        rows = g[:, None]
        leaves[g], parts[g], number[g] = leaves[rows, moved], parts[rows, moved], number[rows, moved]
        leaves[g, spot] = y
        number[g, spot] = np.arange(total, total + len(g))
        parts[g, spot] = np.where(spot == low, before, depth_at)
        inside = (spot < high) & (spot + 1 < width)
        parts[g[inside], spot[inside] + 1] = depth_at[inside]
        used[g] += 1
        out[left[first]] = number[g, spot]
        total += len(g)
        left = left[out[left] < 0]
    return out


def answer_windows(asked: list[bytes]) -> list[bytes]:
    """For each record: a bit for each window in turn that a document before the record's own has.

    Records are taken in turns of about AT_ONCE windows; those with one anchor, or one half of a hot anchor and the same bytes beside it, share a turn.
    """
    ids, records = [], []
    for data in asked:
        a, r = unpack_arrays(data)
        ids.append(a)
        records.append(r.reshape(-1, RECORD))
    doc, rec = np.concatenate(ids), np.concatenate(records)
    del records
    lo, n = rec[:, CONTEXT].astype(np.int64), rec[:, CONTEXT + 1].astype(np.int64) - rec[:, CONTEXT] + 1
    start = np.cumsum(n) - n
    hit = np.zeros(int(n.sum()), np.uint8)
    anchor = (np.ascontiguousarray(rec[:, SPREAD - 1 : SPREAD + 7]).view("<u8").reshape(-1) + _further(rec)) * _MIX
    turns = -(-len(hit) // AT_ONCE)
    turn = ((anchor >> U(40)).astype(np.int64) * turns) >> 24
    for k in range(turns):
        own = np.flatnonzero(turn == k)
        if len(own):
            m = n[own]
            place = np.repeat(start[own] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            hit[place] = _repeats(rec[own, :CONTEXT], doc[own], lo[own], m)
    ends = np.cumsum([int(n[a:b].sum()) for a, b in _spans(ids)])[:-1]
    return [pack_arrays(np.packbits(x)) for x in np.split(hit, ends)]


def _repeats(rec: np.ndarray, doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    text = np.zeros(rec.size + 8, np.uint8)
    text[:-8] = rec.reshape(-1)
    own = np.repeat(np.arange(len(rec)), n)
    base = own * CONTEXT + np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    order, of = sort_suffixes(text, base)
    hit = np.zeros(len(base), np.uint8)
    met = of >= 0
    if met.any():
        order, of = order[met], of[met]
        ids_of = doc[own[order]]
        least = np.full(int(of.max()) + 1, NO_ID)
        np.minimum.at(least, of, ids_of)
        hit[order] = least[of] < ids_of
    return hit


def _spans(parts: list[np.ndarray]) -> list[tuple[int, int]]:
    ends = np.cumsum([len(p) for p in parts]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def cut(buckets: int):
    def make(block: int, data: bytes, known: list[dict[int, bytes]]) -> Iterator[tuple]:
        ids, nulls, offsets, text = decode(data)
        h, doc, first, last, records = _contexts(offsets, text, known[0], buckets)
        one, group, least = _distinct(h, ids[doc], records)
        size = (last - first + 1)[one]
        bits = np.zeros(int(size.sum()), np.uint8)
        begin = np.cumsum(size) - size
        for bucket, a, b in _bucket_slices(h[one], buckets):
            n = int(size[a:b].sum())
            bits[begin[a] : begin[a] + n] = np.unpackbits(unpack_arrays(known[1][bucket])[0], count=n)
        n = last - first + 1
        row = np.repeat(np.arange(len(h)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        earlier = (bits[begin[group[row]] + step] > 0) | (ids[doc] > least[group])[row]
        starts = (first[row] + step)[earlier]
        cover = np.zeros(len(text) + 1, np.int32)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + LENGTH, -1)
        gone = np.cumsum(cover[:-1]) > 0
        for k, key in enumerate(ids.tolist()):
            a, b = int(offsets[k]), int(offsets[k + 1])
            g = gone[a:b]
            runs = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(g[0]) if b > a else 0
            yield None if nulls[k] else key, b - a, int(np.count_nonzero(g)), runs, text[a:b][~g].tobytes()

    return make


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    more = scaled(total, BLOCK_BYTES, BUCKET_BYTES, ROW_BYTES)
    buckets = bucket_count(total, int(BUCKET_BYTES * more))
    blocks = make_blocks(rows, encode, ["doc_id", "text"], lambda r: len(r[1] or b"") + 8, "text_blocks", int(BLOCK_BYTES * more))
    groups = max(buckets, bucket_count(total, int(BLOCK_BYTES * more)))
    shared = exchange(blocks, [], ask_anchors(buckets), answer_anchors, "shared_anchors", groups)
    repeated = exchange(blocks, [shared], ask_windows(buckets), answer_windows, "repeated_windows", groups)
    return per_block(blocks, [shared, repeated], cut(buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", groups)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
