"""Near-duplicates by SimHash: fingerprints within a Hamming distance, found by a trie joined with itself.

The binary trie of all different fingerprints is traversed in pairs of nodes of
equal depth.  A pair carries the bits in which its prefixes differ and is given
up once they exceed the budget.  The upper levels are a Spark job: a fingerprint
is sent to every pair of nodes that its prefix and the allowed differences name.
Pairs with few fingerprints go on inside one task, bit by bit over sorted
numbers; pairs with many descend further in Spark first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import written
from .components import connected_components
from .words import word_bounds

SEED = 42
BITS = 64
_UPPER = bytes(range(256)).lower()
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_PLACE = np.arange(8, dtype=np.int64) * 256
#: Shingles hashed at once; longer texts go in parts.
PART = 1 << 16


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash of the ``size``-word shingles of a text; 0 without words.

    A-Z are lower-cased, shingles count as often as they occur, a shorter text is
    one shingle.  A bit is set if more than half of the shingles' hashes have it.
    """
    data = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER)
    starts, ends = word_bounds(data)
    if not len(starts):
        return 0
    words = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    joined = b" ".join(words)
    sizes = (ends - starts) + 1
    last = np.cumsum(sizes) - 1
    first = last - sizes + 1
    if len(words) > size:
        first, last = first[:len(words) - size + 1], last[size - 1:]
    else:
        first, last = first[:1], last[-1:]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(first[at:at + PART].tolist(), last[at:at + PART].tolist(), strict=True)],
                             np.uint64) for at in range(0, len(first), PART))


def majority(parts: Iterator[np.ndarray]) -> int:
    """The bits that more than half of all numbers have."""
    counts, n = np.zeros(BITS, np.int64), 0
    for part in parts:
        own = part.astype("<u8").view(np.uint8).reshape(-1, 8) + _BYTE_PLACE
        counts += (np.bincount(own.ravel(), minlength=2048).reshape(8, 256) @ _BIT_OF_BYTE).ravel()
        n += len(part)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """Columns doc_id and fp (the fingerprint as a signed long) of every row; one pass, no shuffle."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int64())], names=["doc_id", "fp"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(measure, "doc_id bigint, fp bigint")


def masks(bits: int, most: int) -> list[int]:
    """All numbers of ``bits`` bits with at most ``most`` set."""
    return [sum(1 << i for i in chosen) for k in range(min(bits, most) + 1) for chosen in combinations(range(bits), k)]


def _descend(rows: DataFrame, depth: int, by: int, budget: int) -> DataFrame:
    """Send every fingerprint of node pairs at ``depth`` to the pairs ``by`` bits further down that it belongs to.

    A row holds a pair of prefixes u and v, the side that its fingerprint is on
    (0: u, 1: v, 2: both, when they are one node), and the fingerprint.
    """
    deeper = depth + by
    own = F.shiftrightunsigned("fp", BITS - deeper)
    other = F.when(F.col("side") == 0, F.col("v")).otherwise(F.col("u"))
    place = F.col("_own").bitwiseAND(F.lit((1 << by) - 1).cast("long"))
    partner = F.shiftleft(F.col("_other"), by).bitwiseOR(place.bitwiseXOR(F.col("_mask")))
    spent = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    options = F.explode(F.array(*[F.lit(m).cast("long") for m in masks(by, budget)]))
    grown = (rows.withColumn("_own", own).withColumn("_other", other).withColumn("_spent", spent).withColumn("_mask", options)
             .where(F.col("_spent") + F.bit_count("_mask") <= budget).withColumn("_partner", partner))
    mine, theirs = F.col("_own"), F.col("_partner")
    side = (F.when(F.col("side") < 2, F.col("side")).when(mine < theirs, 0).when(mine > theirs, 1).otherwise(2)).cast("int")
    return grown.select(F.when(side == 1, theirs).otherwise(mine).alias("u"), F.when(side == 1, mine).otherwise(theirs).alias("v"),
                        side.alias("side"), "fp", "node")


def _pairs(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of each pair of ranges."""
    width = b1 - b0
    sizes = (a1 - a0) * width
    of = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return a0[of] + step // width[of], b0[of] + step % width[of]


def trie_pairs(left: np.ndarray, right: np.ndarray | None, budget: int, depth: int = 0, spent: int = 0,
               most_nodes: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two sorted arrays of different uint64 (or of one with itself) within ``budget`` bits.

    All of an array share its first ``depth`` bits, in which the two differ in
    ``spent`` places.  Pairs of nodes go down together, one bit a level; of more
    than ``most_nodes`` pairs, parts go first, so memory stays bounded.
    """
    alone = right is None
    right = left if alone else right
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ones: dict[tuple[bool, int], np.ndarray] = {}

    def split(side: bool, bit: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the ranges' numbers begin to have the bit."""
        if (side, bit) not in ones:
            has = ((left, right)[side] >> np.uint64(bit)) & np.uint64(1)
            ones[side, bit] = np.concatenate([[0], np.cumsum(has)]).astype(np.int64)
        count = ones[side, bit]
        return end - (count[end] - count[start])

    def one(x):
        return np.array([x], np.int64)

    found_a, found_b = [], []
    stack = [(BITS - 1 - depth, one(0), one(len(left)), one(0), one(len(right)), one(spent), np.array([alone]))]
    while stack:
        bit, a0, a1, b0, b1, diff, same = stack.pop()
        if len(a0) > most_nodes:
            for at in range(0, len(a0), most_nodes):
                stack.append((bit, *(x[at:at + most_nodes] for x in (a0, a1, b0, b1, diff, same))))
            continue
        small = ((a1 - a0) * (b1 - b0) <= 16) | (bit < 0)
        if small.any():
            i, j = _pairs(a0[small], a1[small], b0[small], b1[small])
            near = np.bitwise_count(left[i] ^ right[j]) <= budget
            if alone:
                near &= i < j
            found_a.append(i[near])
            found_b.append(j[near])
            a0, a1, b0, b1, diff, same = (x[~small] for x in (a0, a1, b0, b1, diff, same))
        if not len(a0):
            continue
        am, bm = split(False, bit, a0, a1), split(True, bit, b0, b1)
        parts = [(a0, am, b0, bm, diff, same), (am, a1, bm, b1, diff, same),
                 (a0, am, bm, b1, diff + 1, np.zeros_like(same)),
                 tuple(x[~same] for x in (am, a1, b0, bm, diff + 1, np.zeros_like(same)))]
        merged = [np.concatenate(x) for x in zip(*parts, strict=True)]
        live = (merged[1] > merged[0]) & (merged[3] > merged[2]) & (merged[4] <= budget)
        stack.append((bit - 1, *(x[live] for x in merged)))
    return (np.concatenate(found_a) if found_a else np.zeros(0, np.int64),
            np.concatenate(found_b) if found_b else np.zeros(0, np.int64))


def near_pairs(classes: DataFrame, *, max_bits: int = 2, leaf_rows: int = 4096) -> DataFrame:
    """Links a, b, bits between the nodes of different fingerprints at most ``max_bits`` apart.

    ``classes`` has one row per fingerprint: fp and node.  The first descent goes
    as deep as the count of fingerprints asks for; node pairs that still have over
    four times ``leaf_rows`` fingerprints (a common beginning) descend six more
    bits each round, the others are solved in tasks that hold one pair.  Nothing
    is capped: at the last bit a node is one fingerprint.
    """
    rows = classes.select(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"), F.lit(2).alias("side"), "fp", "node")
    depth, step = 0, max(1, min(BITS - 6, math.ceil(math.log2(max(2, classes.count() / leaf_rows)))))
    solved = None
    while True:
        rows = _descend(rows, depth, step, max_bits)
        depth += step
        heavy = None
        if depth < BITS:
            sizes = rows.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * leaf_rows)
            heavy = written(sizes.select("u", "v"), "heavy-pairs")
            heavy = None if heavy.isEmpty() else heavy
        light = rows if heavy is None else rows.join(heavy, ["u", "v"], "left_anti")
        links = _solved(light, depth, max_bits)
        solved = links if solved is None else solved.unionByName(links)
        if heavy is None:
            return solved
        rows = written(rows.join(heavy, ["u", "v"], "left_semi"), "descending")
        step = min(6, BITS - depth)


def _solved(rows: DataFrame, depth: int, budget: int) -> DataFrame:
    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(_code=part["fp"].to_numpy(np.int64).view(np.uint64)).sort_values("_code")
        second = part["side"].to_numpy() == 1
        code, node = part["_code"].to_numpy(np.uint64), part["node"].to_numpy(np.int64)
        spent = int(np.bitwise_count(np.uint64(int(key[0]) & (2**64 - 1)) ^ np.uint64(int(key[1]) & (2**64 - 1))))
        if key[0] == key[1]:
            i, j = trie_pairs(code, None, budget, depth)
            other, other_node = code, node
        else:
            other, other_node = code[second], node[second]
            code, node = code[~second], node[~second]
            i, j = trie_pairs(code, other, budget, depth, spent)
        return pd.DataFrame({"a": node[i], "b": other_node[j], "bits": np.bitwise_count(code[i] ^ other[j]).astype(np.int32)})

    return rows.groupBy("u", "v").applyInPandas(solve, "a bigint, b bigint, bits int")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 3, max_bits: int = 2,
                    leaf_rows: int = 4096) -> DataFrame:
    """Columns doc_id, fp and component_id (the smallest id reachable over links) of every row.

    Fingerprints at most ``max_bits`` apart link; equal ones, that of texts without
    words among them, are one class.  Rows with a NULL id have a fingerprint, take
    part in no link and get a NULL component; rows that share an id are one node.
    Copies are one row from the first aggregation on, which is partial, so a third
    of all documents may be alike.  Other columns are not read.
    """
    marked = written(fingerprints(docs, doc_id=doc_id, text=text, size=size), "fingerprints")
    classes = written(marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    links = written(near_pairs(classes, max_bits=max_bits, leaf_rows=leaf_rows), "near-pairs")
    # Rows of one id with several fingerprints tie their classes together.
    twice = (marked.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")
             .select("doc_id"))
    ties = marked.join(twice, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    groups = connected_components(links.select("a", "b").unionByName(ties))
    of = classes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(of, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
