"""Katz backoff language model over words, and the log probability it gives every document.

Counts of n-grams up to ``ORDER`` words are taken over all learning documents.
With d_k,r the Good-Turing discount of a count r of k-grams (1 above ``K``), N
tokens, h a history of k - 1 words, h' the same without its first word, and c(h)
the occurrences of h:

    P(w | h) = d c(h, w) / (c(h) + m(h))  if c(h, w) > 0
             = a(h) P(w | h')             if not, and c(h) > 0
             = P(w | h')                  if h is unknown
    P(w)     = d c(w) / N                 if c(w) > 0, and what is left for one unknown word
    a(h)     = (1 - sum of seen P(w | h)) / (1 - sum of their P(w | h'))

m(h) is 0, or 1 where no count after h is discounted: h then takes one more unseen
occurrence, so that a(h) > 0. The probabilities of all known words and the unknown
one add up to 1 for every history. Documents begin with one start mark (the first
word's history is the mark alone) and end with an end token. Where the counts of
counts give no proper Good-Turing discounts (tiny corpora), fewer are used, and at
last (r - 1/2) / r.

Tables: (1) blocks of token numbers; (2) counts of words, word pairs and so on,
dealt to buckets by hash and stored by (bucket, block) in the order in which the
block asked; (3) what each block contributes to the sums in a(h), each n-gram by
one owner, as whole numbers, so that sums are exact; (4) the sums. An n-gram is
looked up once per block and bucket, and frequent ones arrive once per block;
n-grams are dealt by all their words, so no history has a task of its own. Sums go
out for histories that can be asked for: those of documents that were not learned
from, and those of more than K occurrences. The keys of pairs and longer n-grams
are exchanged in ``PASSES`` passes over the hash, and blocks are evaluated in
``GROUPS`` groups, which bounds what lies on disk at a time. Blocks and buckets
grow with the square root of very large inputs, so the rows of an exchange stay
in proportion to the text. Words and n-grams are told apart by 64-bit hashes.

Defined cases: null and empty texts are the end token alone; a null ``learn``
counts as false; with no learning document every word is the unknown one, of
probability 1; repeated rows count each; null doc_ids stay null; a very long text
has a block of its own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import bucket_count, exchange, make_blocks, pack_arrays, pack_keys, per_block, release, scaled, unpack_arrays, unpack_keys
from .common import discard, materialize

#: Words of the longest n-gram; counts up to K are discounted.
ORDER, K = 3, 5
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 24 << 20
PASSES, GROUPS = 2, 4
#: Bytes of text in a word, about: an exchange row should hold a hundred keys.
ROW_BYTES = 650
U = np.uint64
END_KEY, START_KEY = U(0xE17A1465B1CE5D1B), U(0x5BD1E9955BD1E995)
_MIX = U(0x9E3779B97F4A7C15)


def encode(rows: list[tuple]) -> bytes:
    """Token numbers index the block's sorted word keys."""
    texts = pa.array([t or b"" for _, t, _ in rows], pa.large_binary()).view(pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # byte by byte, like bytes.split(), but for empty words at the ends
    words = split.values.view(pa.large_binary())
    real = pc.not_equal(words, pa.scalar(b"", pa.large_binary()))
    coded = words.filter(real).dictionary_encode()
    sizes = np.diff(np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][split.offsets.to_numpy()]) + 1  # and the end token
    tokens = np.zeros(sizes.sum(), np.uint32)
    at = np.ones(len(tokens), bool)
    at[np.cumsum(sizes) - 1] = False
    tokens[at] = coded.indices.to_numpy() + 1
    keys = np.array([END_KEY, *(xxhash.xxh64_intdigest(w, 42) for w in coded.dictionary.to_numpy(zero_copy_only=False))], U)
    order = np.argsort(keys)
    place = np.empty(len(keys), np.uint32)
    place[order] = np.arange(len(keys))
    ids = np.array([d or 0 for d, _, _ in rows], np.int64)
    marks = np.array([bool(x) + 2 * (d is None) for d, _, x in rows], np.uint8)  # 1: learn, 2: no doc_id
    del texts, split, words, real, coded
    pa.default_memory_pool().release_unused()
    return pack_arrays(ids, marks, sizes.astype(np.int64), place[tokens], pack_keys(keys[order]))


class Level:
    """The distinct n-grams of one length in a block, in order of their key.

    ``gram``: that of each token (-1: the token stands too near the start).
    ``history`` and ``lower``: numbers, one level below, of the n-gram without its
    last and without its first word.
    """

    def __init__(self, key: np.ndarray, gram: np.ndarray, history: np.ndarray, lower: np.ndarray):
        self.key, self.gram, self.history, self.lower = key, gram, history, lower


class Block:
    def __init__(self, data: bytes):
        self.ids, self.marks, self.sizes, tokens, steps = unpack_arrays(data)
        self.words, self.tokens = unpack_keys(steps), tokens.astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.learning = np.repeat(self.marks & 1 > 0, self.sizes)

    def keyed(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length from 2 the tokens at which n-grams end, and their keys: each made from the key of the history and the last word's."""
        place = np.arange(len(self.tokens)) - np.repeat(self.first, self.sizes)
        word = self.words[self.tokens]
        low, times = word >> U(7), word * U(0xC2B2AE3D27D4EB4F)
        key = word
        for k in range(2, order + 1):
            before = np.zeros_like(key)
            before[1:] = key[:-1]
            if k == 2:
                before[self.first] = START_KEY
            key = before * _MIX
            key ^= low
            key ^= key >> U(31)
            key *= _MIX
            key += times
            key ^= key >> U(29)
            at = np.flatnonzero(place >= k - 2)
            yield at, key[at]

    def levels(self, order: int) -> list[Level]:
        none = np.zeros(0, np.int64)
        out = [Level(self.words, self.tokens, none, none)]
        for k, (at, key) in enumerate(self.keyed(order), 2):
            below = out[-1].gram
            sort = np.argsort(key)
            key, at = key[sort], at[sort]
            new = changes(key)
            gram = np.full(len(self.tokens), -1)
            gram[at] = np.cumsum(new) - 1
            one = at[new]  # a token at which the n-gram ends
            before = np.empty_like(below)
            before[1:] = below[:-1]
            if k == 2:
                before[self.first] = len(self.words)  # the start mark is the number behind the last word
            out.append(Level(key[new], gram, before[one], below[one]))
        return out


def named(levels: list[Level], k: int) -> np.ndarray:
    """Keys of the n-grams of k words, with the start mark for k = 1."""
    return np.append(levels[0].key, START_KEY) if k == 1 else levels[k - 1].key


def changes(keys: np.ndarray) -> np.ndarray:
    """Which of the sorted keys differ from the one before."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return new


def starts(buckets: int) -> np.ndarray:
    """The least key of each bucket, a range of the hash each."""
    return (-(-(np.arange(buckets) << 32) // buckets)).astype(U) << U(32)


def slices(keys: np.ndarray, buckets: int) -> dict[int, slice]:
    """Rows of sorted keys by bucket."""
    edges = np.append(np.searchsorted(keys, starts(buckets)), len(keys)).tolist()
    return {i: slice(a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b}


def ask_counts(k: int, buckets: int, low: int, high: int):
    """The block's n-grams of k words in the buckets low .. high - 1: keys, and twice the counts, and 1 for those in documents not learned from."""

    def counted(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, occurrences, and those learned from."""
        if k == 1:
            return b.words, np.bincount(b.tokens, minlength=len(b.words)), np.bincount(b.tokens[b.learning], minlength=len(b.words))
        for at, key in b.keyed(k):  # noqa: B007  the last ones
            pass
        if high - low < buckets:
            edges = starts(buckets)
            here = key >= edges[low]
            if high < buckets:
                here &= key < edges[high]
            at, key = at[here], key[here]
        sort = np.argsort(key)
        key = key[sort]
        head = np.flatnonzero(changes(key))
        learned = np.r_[0, np.cumsum(b.learning[at[sort]])]
        ends = np.append(head[1:], len(key))[: len(head)]
        return key[head], ends - head, learned[ends] - learned[head]

    def ask(data: bytes, known: list) -> Iterator[tuple[int, bytes]]:
        key, size, n = counted(Block(data))
        code = (2 * n + (size > n)).astype(np.uint32 if len(n) and n.max() < 1 << 31 else np.int64)
        for bucket, s in slices(key, buckets).items():
            if low <= bucket < high:
                yield bucket, pack_arrays(pack_keys(key[s]), code[s])

    return ask


def answer_counts(asked: list[bytes]) -> list[bytes]:
    """For each key asked for four times its count over all blocks, 2 if this block owns it (one that counted it) and 1 if sums after it are wanted.

    Before that, once per bucket, [tokens, keys, keys counted 1 .. K + 1 times], and the number of these bytes.
    """
    steps, codes = zip(*map(unpack_arrays, asked), strict=True)
    sizes = [len(x) for x in steps]
    keys = np.concatenate([unpack_keys(x) for x in steps])
    del steps
    order = np.argsort(keys)
    keys = keys[order]
    head = np.flatnonzero(changes(keys))
    del keys
    code = np.concatenate(codes)[order]
    del codes
    apart = np.bitwise_or.reduceat(code & 1, head) > 0
    code >>= 1
    total = np.add.reduceat(code, head, dtype=np.int64)
    owner = np.minimum.reduceat(np.where(code > 0, np.arange(len(code)), len(code)), head)
    found = 4 * total + (apart | (total > K))
    del code
    out = np.empty(len(order) + 1, np.uint32 if found.max() < (1 << 32) - 2 else np.int64)
    out[:-1] = np.repeat(found, np.diff(np.append(head, len(order))))
    out[owner] += 2
    back = np.empty(len(order), out.dtype)
    back[order] = out[:-1]
    stats = np.array([total.sum(), np.count_nonzero(total), *(np.count_nonzero(total == r) for r in range(1, K + 2))], "<i8").tobytes()
    ends = np.cumsum(sizes).tolist()
    return [(bytes([len(stats)]) + stats if i == 0 else b"\0") + pack_arrays(back[end - n : end]) for i, (n, end) in enumerate(zip(sizes, ends, strict=True))]


def totals(answers: DataFrame) -> list[int]:
    """The buckets' statistics, added up."""
    width = K + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = sum((np.frombuffer(x, "<i8") for x in batch.column("stats").to_pylist()), np.zeros(width, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(total[i : i + 1]) for i in range(width)], [f"x{i}" for i in range(width)])

    names = [f"x{i}" for i in range(width)]
    with_stats = answers.where(F.substring("data", 1, 1) != F.lit(b"\0")).select(F.substring("data", 2, 8 * width).alias("stats"))
    row = with_stats.mapInArrow(run, ", ".join(f"{x} long" for x in names)).agg(*(F.sum(x).alias(x) for x in names)).first()
    return [x or 0 for x in row]


def discounts(n: list[int]) -> np.ndarray:
    """d_0 .. d_K+1 from the numbers of keys counted 1 .. K + 1 times; counts above take the last."""
    d = np.ones(K + 2)
    for k in range(K, 0, -1):
        if min(n[: k + 1]) > 0 and (rest := (k + 1) * n[k] / n[0]) < 1:
            own = [((r + 1) * n[r] / n[r - 1] / r - rest) / (1 - rest) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in own):
                d[1 : k + 1] = own
                return d
    d[1 : K + 1] = [(r - 0.5) / r for r in range(1, K + 1)]
    return d


class Model:
    """What scoring needs besides the counts: discounts of each length and totals."""

    def __init__(self, stats: list[list[int]]):
        words = stats[0]
        self.n, self.v = words[0], words[1]
        self.d = [discounts(x[2:]) for x in stats]
        left = sum(words[1 + r] * (1 - self.d[0][r]) * r for r in range(1, K + 1))
        self.all = self.n if left > 0 else self.n + 1
        self.unknown = (left or 1) / self.all if self.n else 1.0

    def kept(self, k: int, c: np.ndarray) -> np.ndarray:
        """Discounted counts of n-grams of k words."""
        return self.d[k - 1][np.minimum(c, K + 1)] * c


def _read(known: dict[int, bytes], keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = np.zeros(len(keys), np.int64)
    for bucket, s in slices(keys, buckets).items():
        data = known[bucket]
        (found[s],) = unpack_arrays(memoryview(data)[1 + data[0] :])
    return found >> 2, found & 2 > 0, found & 1 > 0


def evaluate(model: Model, buckets: list[int]):
    """Everything but the sums after histories: documents with what they wait for, and the block's part of the sums.

    ``waiting``: documents, then for each length from 2 the histories asked for
    (sorted keys, counts, place of their own lower history in the length below)
    and (document, history, kind, times); kind 1: seen, kind 0: backed off.
    """
    order = len(buckets)

    def make(block: int, data: bytes, known: list[dict[int, bytes]]) -> Iterator[tuple]:
        b = Block(data)
        levels = b.levels(order)
        tokens = b.tokens
        counts, own, wanted = map(list, zip(*(_read(known[k], levels[k].key, buckets[k]) for k in range(order)), strict=True))
        counts[0] = np.append(counts[0], counts[0][np.searchsorted(b.words, END_KEY)])  # every document starts and ends once
        wanted[0] = np.append(wanted[0], True)
        c1 = counts[0][:-1]
        value = np.log10(np.where(c1 > 0, model.kept(1, c1) / max(model.all, 1), model.unknown))
        waits = np.zeros((len(c1), 0), np.int64)
        top, top_waits = value[tokens], np.full((len(tokens), order - 1), -1)
        sums = []
        for k in range(2, order + 1):
            level, c, history = levels[k - 1], counts[k - 1], counts[k - 2]
            h, seen = level.history, c > 0
            sure = np.zeros(len(history), bool)  # histories of which a discounted n-gram is seen here
            sure[h[seen & (c <= K)]] = True
            value = np.where(seen, np.log10(np.where(seen, model.kept(k, c), 1) / np.maximum(history[h], 1)), value[level.lower])
            waits = np.where(seen[:, None], -1, waits[level.lower])
            mine = np.where(seen, np.where(sure[h], -1, 2 * h + 1), np.where(history[h] > 0, 2 * h, -1))
            waits = np.concatenate([waits, mine[:, None]], axis=1)
            at = np.flatnonzero(level.gram >= 0)
            top[at] = value[level.gram[at]]
            top_waits[at, : k - 1] = waits[level.gram[at]]
            sums += block_sums(levels, k, counts, np.flatnonzero(own[k - 1] & seen & wanted[k - 2][h]))
        part = np.add.reduceat(top, b.first)
        base = np.add.reduceat(np.log10((c1[tokens] + 1) / (model.n + model.v + 1)), b.first)
        n_known = np.add.reduceat((c1[tokens] > 0).astype(np.int64), b.first)
        doc = np.repeat(np.arange(len(b.ids)), b.sizes)
        lists: dict[int, list[np.ndarray]] = {}
        above: np.ndarray | None = None
        for k in range(order, 1, -1):  # a(h) needs m of h's own lower history: so that is asked for too
            names, n = named(levels, k - 1), len(counts[k - 2])
            late = np.flatnonzero(top_waits[:, k - 2] >= 0)
            what, times = np.unique(doc[late] * (2 * n) + top_waits[late, k - 2], return_counts=True)
            d, h, kind = what // (2 * n), what % (2 * n) // 2, what % 2
            below = h[:0] if above is None else levels[k - 1].lower[above]
            need = np.unique(np.concatenate([h, below]))
            need = need[np.argsort(names[need])]
            place = np.zeros(n, np.int64)
            place[need] = np.arange(len(need))
            if above is not None:
                lists[k + 1][2] = place[below].astype(np.uint32)
            lists[k] = [pack_keys(names[need]), counts[k - 2][need], np.zeros(0, np.uint32), d.astype(np.uint32), place[h].astype(np.uint32), kind.astype(np.uint8), times.astype(np.uint32)]
            above = need
        waiting = [x for k in range(2, order + 1) for x in lists[k]]
        yield block, pack_arrays(b.ids, b.marks, b.sizes, n_known, base, part, *waiting), pack_arrays(*sums)

    return make


def block_sums(levels: list[Level], k: int, counts: list[np.ndarray], mine: np.ndarray) -> list[np.ndarray]:
    """By history (sorted keys): lower counts above K added up, and, one after the other, how many n-grams, and lower n-grams, have the counts 1 .. K."""
    level, names = levels[k - 1], named(levels, k - 1)
    hs, slot = np.unique(level.history[mine], return_inverse=True)
    order = np.argsort(names[hs])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    slot = place[slot]
    c, low = counts[k - 1][mine], counts[k - 2][level.lower[mine]]
    per = [np.bincount(slot[x == r], minlength=len(hs)).astype(np.uint32) for x in (c, low) for r in range(1, K + 1)]
    large = np.zeros(len(hs), np.int64)
    np.add.at(large, slot, np.where(low > K, low, 0))
    return [pack_keys(names[hs][order]), large, np.concatenate(per)]


#: Arrays of a length in what evaluate hands on: in ``waiting`` behind the documents' own, and in the sums.
OWN, WAITING, SUMS = 6, 7, 3


def ask_sums(order: int, buckets: list[int]):
    """A block's part of the sums, and the histories it waits for; buckets of one length follow those of the other."""

    def ask(data: bytes, known: list) -> Iterator[tuple[int, bytes]]:
        waiting, sums = map(unpack_arrays, split_two(data))
        none = slice(0, 0)
        for k, n, before in placed(buckets):
            wanted = unpack_keys(waiting[OWN + (k - 2) * WAITING])
            steps, large, per = sums[(k - 2) * SUMS : (k - 1) * SUMS]
            keys, per = unpack_keys(steps), per.reshape(2 * K, -1)
            have, want = slices(keys, n), slices(wanted, n)
            for bucket in sorted({*have, *want}):
                s, t = have.get(bucket, none), want.get(bucket, none)
                yield before + bucket, pack_arrays(np.array([k]), pack_keys(wanted[t]), pack_keys(keys[s]), large[s], per[:, s].ravel())

    return ask


def placed(buckets: list[int]) -> list[tuple[int, int, int]]:
    """Each length from 2, the buckets of its sums and how many go before."""
    return [(k, n, sum(buckets[: k - 2])) for k, n in enumerate(buckets, 2)]


def answer_sums(model: Model):
    """For each history asked for: its missing mass times its count, and the discounted lower counts of what was seen after it."""

    def answer(asked: list[bytes]) -> list[bytes]:
        parts = [unpack_arrays(x) for x in asked]
        k = int(parts[0][0][0])
        keys = np.concatenate([unpack_keys(p[2]) for p in parts])
        if not len(keys):
            return [pack_arrays(np.zeros(len(p[1])), np.zeros(len(p[1]))) for p in parts]
        order = np.argsort(keys)
        s = keys[order]
        head = np.flatnonzero(changes(s))
        large = np.add.reduceat(np.concatenate([p[3] for p in parts])[order], head)
        split = [p[4].reshape(2 * K, -1) for p in parts]
        per = [np.add.reduceat(np.concatenate([x[r] for x in split])[order], head, dtype=np.int64) for r in range(2 * K)]
        missing = sum(per[r - 1] * ((1 - model.d[k - 1][r]) * r) for r in range(1, K + 1))
        lower = large + sum(per[K + r - 1] * (model.d[k - 2][r] * r) for r in range(1, K + 1))
        known, out = s[head], []
        for p in parts:
            wanted = unpack_keys(p[1])
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            met = known[at] == wanted
            out.append(pack_arrays(np.where(met, missing[at], 0.0), np.where(met, lower[at], 0.0)))
        return out

    return answer


def split_two(data: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(data[:8], "little")
    return data[8 : 8 + n], data[8 + n :]


def finish(model: Model, buckets: list[int]):
    def make(block: int, data: bytes, known: list[dict[int, bytes]]) -> Iterator[tuple]:
        every = unpack_arrays(data)
        ids, marks, sizes, n_known, base, score = every[:OWN]
        denominator = np.zeros(0)
        for k, n, before in placed(buckets):
            steps, c, lower, doc, at, kind, times = every[OWN + (k - 2) * WAITING : OWN + (k - 1) * WAITING]
            keys = unpack_keys(steps)
            missing, seen = np.zeros(len(keys)), np.zeros(len(keys))
            for bucket, s in slices(keys, n).items():
                missing[s], seen[s] = unpack_arrays(known[0][before + bucket])
            whole = c + (missing <= 0)
            left = 1 - seen / (max(model.all, 1) if k == 2 else denominator[lower])
            backed = np.log10(np.where(missing > 0, missing, 1.0) / whole / np.maximum(left, 1e-300))
            late = times * np.where(kind == 1, np.log10(np.maximum(c, 1) / whole)[at], backed[at])
            score = score + np.bincount(doc, late, len(ids))
            denominator = whole.astype(float)
        for i, mark, *row in zip(ids.tolist(), marks.tolist(), sizes.tolist(), n_known.tolist(), base.tolist(), score.tolist(), strict=True):
            yield (None if mark & 2 else i, bool(mark & 1), *row)

    return make


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score, score for every row (doc_id a whole number); learns from rows with ``learn``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.col("learn").cast("boolean").alias("learn"))
    size = (rows.agg(F.sum(F.length("text"))).first()[0] or 0) + 1
    more = scaled(size, BLOCK_BYTES, BUCKET_BYTES, ROW_BYTES)
    few, many, most = (bucket_count(size, int(n * BUCKET_BYTES * more)) for n in (2, 1, 0.5))
    blocks = make_blocks(rows, encode, ["doc_id", "text", "learn"], lambda r: len(r[1] or b"") + 8, "token_blocks", int(BLOCK_BYTES * more))
    groups = max(most, bucket_count(size, int(BLOCK_BYTES * more)))
    buckets, tables = [few, many] + [2 * many] * (order - 2), []  # there are more distinct n-grams of three words and more
    buckets, sum_buckets = buckets[:order], [many] + [most] * (order - 2)
    for k in range(1, order + 1):
        cuts = np.linspace(0, buckets[k - 1], 1 + (1 if k == 1 else min(PASSES, buckets[k - 1]))).astype(int).tolist()
        tables.append([exchange(blocks, [], ask_counts(k, buckets[k - 1], a, b), answer_counts, f"counts_{k}", groups) for a, b in zip(cuts, cuts[1:], strict=False)])
    joined = [reduce(DataFrame.unionByName, t) for t in tables]
    model = Model([totals(t) for t in joined])
    schema, own = "block long, waiting binary, sums binary", []
    for g in range(GROUPS):
        part = lambda t, g=g: t.where(F.pmod("block", F.lit(GROUPS)) == g)
        own.append(materialize(per_block(part(blocks), [part(t) for t in joined], evaluate(model, buckets), schema, groups), "open_scores"))
        release(docs.sparkSession)
    for t in (blocks, *(x for t in tables for x in t)):
        discard(t)
    open_ = reduce(DataFrame.unionByName, own)
    sized = lambda c: F.unhex(F.concat(*(F.substring(F.lpad(F.hex(F.length(c)), 16, "0"), i, 2) for i in range(15, 0, -2))))
    both = open_.select("block", F.concat(sized("waiting"), "waiting", "sums").alias("data"))
    sums = exchange(both, [], ask_sums(order, sum_buckets), answer_sums(model), "sums", groups)
    out = per_block(open_.select("block", F.col("waiting").alias("data")), [sums], finish(model, sum_buckets), "doc_id long, learn boolean, n_tokens long, n_known long, base_score double, score double", groups)
    return out.withColumn("train_tokens", F.lit(model.n).cast("long"))
