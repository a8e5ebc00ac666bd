"""Groups of documents by verified Jaccard similarity of their word shingles.

1. Texts of the same words are one node. Each node has a SimHash of its set of
   shingles and ``BANDS`` keys, each of ``ROWS`` min-hashes.
2. Nodes that share a key are compared by the bit-sliced method within a wide
   radius. The components of these links only say which texts are looked at
   together, so a forest of unverified links loses nothing.
3. Texts of a component of several nodes are shuffled once and joined by prefix
   filter: every pair in the component that can reach the similarity is verified
   on its sets of shingles, unless verified links connect it already. A large
   component is cut into parts and each pair of parts is joined in a group of its own.

Two texts of similarity s share a key with probability 1 - (1 - s ** ROWS) ** BANDS:
0.9996 at 0.8, more above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import release
from .common import join_groups, materialize, shuffle_partitions
from .components import connected_components
from .simhash import bucket_links, components, majority, salted, shingles

BANDS, ROWS = 20, 5
#: Rows and bytes of a part of a component.
PART_ROWS, PART_BYTES = 1024, 8 << 20
_draw = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, (3, BANDS * ROWS)).astype(np.uint64)
_XOR, _TIMES, _MIX = _draw[0], _draw[1] * np.uint64(2) + np.uint64(1), _draw[2][:ROWS] * np.uint64(2) + np.uint64(1)
_CHAINS = 4


def keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set of hashes, one for each band of min-hashes."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for a in range(0, len(hashes), 256):
        np.minimum(least, ((hashes[a : a + 256, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    return ((least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)).view(np.int64)


def nodes(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, node (hash of the words), fp, keys (none without words), words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, key, words = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = text.lower().split() if text else []
                words.append(b" ".join(own))
                node.append(xxhash.xxh3_64_intdigest(words[-1]))
                hashes = np.unique(shingles(own, shingle))
                fp.append(majority(hashes))
                key.append(keys(hashes) if own else None)
            unsigned = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *unsigned, pa.array(key, pa.list_(pa.int64())), pa.array(words, pa.binary())], ["doc_id", "node", "fp", "keys", "words"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, f"doc_id {ids}, node long, fp long, keys array<long>, words binary")


def join(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning links of the sets (sorted, not empty) with at least that Jaccard similarity."""
    n, out = len(sets), []
    root = list(range(n))
    tried = np.zeros((n, n), bool)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def compare(x: int, y: int) -> None:
        a, b = find(x), find(y)
        if a == b or tried[x, y]:
            return
        tried[x, y] = tried[y, x] = True
        p, q = len(sets[x]), len(sets[y])
        if min(p, q) < similarity * max(p, q) - 1e-9:
            return
        both = np.sort(np.concatenate([sets[x], sets[y]]), kind="stable")
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        if common >= similarity * (p + q - common) - 1e-9:
            root[max(a, b)] = min(a, b)
            out.append((x, y))

    # Neighbours by min-hash connect most of what is alike with few comparisons.
    for k in range(_CHAINS if n > 2 else 1):
        order = np.argsort([int(((s ^ _XOR[k]) * _TIMES[k]).min()) for s in sets], kind="stable").tolist()
        for x, y in zip(order, order[1:], strict=False):
            compare(x, y)
    if n == 2 or len(out) == n - 1:
        return out
    # Two sets that reach the similarity share one of their rarest hashes, so many of each.
    sizes = np.array([len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    ends = np.cumsum(sizes)
    which, who = [], []
    for i in range(n):
        first = np.sort(rank[place[ends[i] - sizes[i] : ends[i]]])[: sizes[i] - int(np.ceil(similarity * sizes[i] - 1e-9)) + 1]
        which.append(first)
        who.append(np.full(len(first), i))
    which, who = np.concatenate(which), np.concatenate(who)
    order = np.lexsort((who, which))
    which, who = which[order], who[order]
    cuts = np.flatnonzero(np.r_[True, which[1:] != which[:-1], True])
    label = np.array([find(i) for i in range(n)])
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = label[who[a:b]]
        if b - a > 1 and (own != own[0]).any():
            members = who[a:b]
            for i, x in enumerate(members.tolist()):
                rest = members[i + 1 :]
                for y in rest[(label[rest] != label[x]) & ~tried[x, rest]].tolist():
                    before = len(out)
                    compare(x, y)
                    if len(out) > before:
                        label = np.array([find(k) for k in range(n)])
    return out


def verified_links(members: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (u, v) between nodes of the same (component, part) with at least that similarity."""

    def close(group: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        if len(group) < 2:
            return []
        return [(group[x][0], group[y][0]) for x, y in join([np.unique(shingles(w.split(), shingle)) for _, w in group], similarity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        pack = lambda found: pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])
        for batch in batches:
            found = []
            for component, part, node, words in zip(*(batch.column(c).to_pylist() for c in ("component", "part", "node", "words")), strict=True):
                if at != (component, part):
                    found += close(group)
                    at, group = (component, part), []
                group.append((node, words))
            yield pack(found)
        yield pack(close(group))

    n = shuffle_partitions(members.sparkSession)
    return members.repartition(n, "component", "part").sortWithinPartitions("component", "part").mapInArrow(run, "u long, v long")


def known_groups(docs: DataFrame, radius: int, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, fp of every row; node, component_id)."""
    prints = materialize(nodes(docs, shingle), "near_nodes")
    single = prints.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first(F.octet_length("words")).alias("bytes"))
    classes = materialize(single, "near_classes")
    # Nodes of the same fingerprint are together in any case; the keys of all of them count.
    dealt = prints.dropDuplicates(["node"]).select("fp", F.posexplode("keys").alias("choice", "bucket"))
    found = materialize(bucket_links(dealt, radius).where("u != v"), "near_candidates")
    coarse = materialize(connected_components(found), "near_components")
    placed = classes.where("bytes > 0").join(coarse.withColumnRenamed("node", "fp"), "fp", "left").select("node", "bytes", F.coalesce("component", "fp").alias("component"))
    placed = materialize(placed, "near_placed")
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"), F.sum("bytes").alias("size")).where("n > 1")
    sized = join_groups(placed, sizes, "component", placed.count())
    wanted = materialize(sized.select("node", "component", F.ceil(F.greatest(F.col("n") / PART_ROWS, F.col("size") / PART_BYTES)).alias("wide")), "near_wanted")
    # Of the copies of a node each task sends one. The nodes wanted grow with the input, so they are never broadcast: one exchange of the texts, at every size.
    texts = prints.select("node", "words").dropDuplicates(["node"]).join(wanted.hint("merge"), "node")
    members = salted(texts, F.xxhash64("node"), F.col("wide")).select("component", "part", "node", "words")
    links = materialize(verified_links(members, shingle, similarity), "near_links")
    rows = materialize(prints.select("doc_id", "node", "fp"), "near_rows", keep=True)  # what follows needs no words
    release(docs.sparkSession)
    return rows, components(classes.select("node", "first_id", "n"), links, "node")
