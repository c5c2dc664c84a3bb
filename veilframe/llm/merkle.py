"""A Merkle manifest of a table: one root digest for all rows, and a short proof for every row.

Rows are leaves, in order inside of their group; consecutive pairs of nodes become their
digest, level by level, up to the group's root, and the groups' roots, in order, become
the root in the same way.  What is stored is a directed graph by content: records from a
digest to the digests of its children.  Records lie in pages: a page holds the records
of ``PAGE_LEVELS`` levels below one digest, so a page is bounded (1,024 leaves) whatever
the group's size, and a proof needs one page per ten levels.

Proofs come from descending: a request names a leaf by its rank; from the root's record
on, the next binary digit of the rank chooses a child, the other one is collected, and
the collected segments, reversed, lead from the leaf to the root.  Requests for leaves
below one page share the page's own way down, so each page is asked for once per level
of pages, never once per leaf below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import written
from .words import names

#: Levels of the tree whose records are in one page.
PAGE_LEVELS = 10
_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])
PATH = "array<struct<before: string, after: string>>"


def digest_of(values: Sequence[Column]) -> Column:
    """SHA-256 in lower-case hex of values one after the other, each ``-`` if NULL, else its UTF-8 byte count, ``:`` and itself."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*map(part, values)), 256)


def parent(children: Sequence[bytes]) -> bytes:
    """The digest of nodes, by their digests as hex text."""
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def folded(level: list[bytes], levels: int) -> tuple[bytes, list[tuple[bytes, list[bytes]]]]:
    """The top of a run of nodes after so many levels, and the records on the way."""
    records = []
    for _ in range(levels):
        runs = [level[i:i + 2] for i in range(0, len(level), 2)]
        level = [parent(run) for run in runs]
        records += zip(level, runs, strict=True)
    return level[0], records


def descended(top: bytes, records: dict[bytes, list[bytes]], rank: int, levels: int) -> tuple[bytes, list[dict]]:
    """The node that a rank's binary digits lead to, and what was not chosen on the way, from the top."""
    segment = []
    for level in range(levels - 1, -1, -1):
        children = records[top]
        at = rank >> level & 1
        segment.append({"before": "".join(c.hex() for c in children[:at]), "after": "".join(c.hex() for c in children[at + 1:])})
        top = children[at]
    return top, segment


def _levels(n: Column) -> Column:
    """How often n nodes are paired until one remains."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def ranked(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Leaves with rank (from 0) and levels in their key, counted per range of rows, so no key is one task.

    ``leaves`` has the columns key, node (binary) and carried; ``order`` are expressions on carried.
    """
    by = [F.col("key"), *map(F.expr, order), F.col("node")]
    placed = written(leaves.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
                     .withColumn("range", F.shiftright("place", 33)), "leaves")
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (placed.groupBy("key", "range").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
              .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
              .withColumn("levels", _levels(F.sum("n").over(Window.partitionBy("key")))).select("key", "range", "offset", "levels"))
    return placed.join(ranges, ["key", "range"]).select("key", "levels", (F.col("offset") + F.col("place")).alias("rank"), "node", "carried")


@dataclass(frozen=True)
class Tree:
    """Pages of all levels, lowest first: key, levels (left at the page's leaves), page, top, digests, children, items; and each key's top."""
    pages: list[DataFrame]
    tops: DataFrame


def tree(nodes: DataFrame) -> Tree:
    """Pair nodes (of ``ranked``) up to one per key, a page of levels at a time."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(3)
            flat, ends = items.flatten().field("node").to_pylist(), [0]
            for n in items.value_lengths().to_pylist():
                ends.append(ends[-1] + n)
            tops, digests, children = [], [], []
            for a, b, levels in zip(ends[:-1], ends[1:], batch.column(1).to_pylist(), strict=True):
                top, records = folded(flat[a:b], min(levels, PAGE_LEVELS))
                tops.append(top)
                digests.append([d for d, _ in records])
                children.append([c for _, c in records])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tops, pa.binary()), pa.array(digests, pa.list_(pa.binary())), pa.array(children, pa.list_(pa.list_(pa.binary())))],
                names=[*batch.schema.names, "top", "digests", "children"])

    pages, finished = [], None
    while True:
        grouped = nodes.groupBy("key", "levels", F.shiftright("rank", PAGE_LEVELS).alias("page")).agg(
            F.sort_array(F.collect_list(F.struct("rank", "node", "carried"))).alias("items"))
        shape = StructType.fromDDL("top binary, digests array<binary>, children array<array<binary>>")
        page = written(grouped.mapInArrow(fold, StructType([*grouped.schema.fields, *shape.fields])), "pages")
        pages.append(page)
        # The round in which a key has one node left is where its way down begins.
        done = page.where(F.col("levels") <= PAGE_LEVELS).select("key", "top", F.lit(len(pages)).alias("rounds"))
        finished = done if finished is None else finished.unionByName(done)
        nodes = page.where(F.col("levels") > PAGE_LEVELS).select(
            "key", (F.col("levels") - PAGE_LEVELS).alias("levels"), F.col("page").alias("rank"), F.col("top").alias("node"),
            F.lit(None).cast(page.schema["items"].dataType.elementType["carried"].dataType).alias("carried"))
        if nodes.isEmpty():
            return Tree(pages, finished)


def descend(built: Tree, starts: DataFrame) -> DataFrame:
    """Columns key, top, carried, node and path (from the root down) of every leaf.

    ``starts`` has the way from the root to each key's top: key, above.  A page whose
    records don't lead to the nodes it was made from raises.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            items, sizes = column["items"].flatten(), column["items"].value_lengths().to_pylist()
            ranks, nodes = items.field("rank").to_pylist(), items.field("node").to_pylist()
            paths, at = [], 0
            rows = zip(*(column[c].to_pylist() for c in ("levels", "page_top", "digests", "children", "above")), sizes, strict=True)
            for levels, top, digests, children, above, n in rows:
                records = dict(zip(digests, children, strict=True))
                for rank, node in zip(ranks[at:at + n], nodes[at:at + n], strict=True):
                    found, segment = descended(top, records, rank & (1 << PAGE_LEVELS) - 1, min(levels, PAGE_LEVELS))
                    if found != node:
                        raise ValueError(f"records below {top.hex()} lead to {found.hex()}, not to {node.hex()}")
                    paths.append(above + segment)
                at += n
            of = pa.array([i for i, n in enumerate(sizes) for _ in range(n)], pa.int64())
            yield pa.RecordBatch.from_arrays([column["key"].take(of), column["top"].take(of), pa.array(ranks, pa.int64()), pa.array(nodes, pa.binary()),
                                              items.field("carried"), pa.array(paths, pa.list_(_STEP))],
                                             names=["key", "top", "rank", "node", "carried", "above"])

    tops = written(built.tops.join(starts, "key").select("key", "top", F.lit(0).cast("long").alias("page"), "above", "rounds"), "ways-to-tops")
    lower = None
    for number in range(len(built.pages), 0, -1):
        page = built.pages[number - 1].withColumnRenamed("top", "page_top")
        asked = tops.where(F.col("rounds") == number).select("key", "top", "page", "above")
        if lower is not None:
            asked = asked.unionByName(lower)
        schema = StructType.fromDDL(f"key string, top binary, rank bigint, node binary, carried int, above {PATH}")
        schema["carried"].dataType = page.schema["items"].dataType.elementType["carried"].dataType
        found = page.join(asked, ["key", "page"]).mapInArrow(walk, schema)
        if number > 1:
            lower = written(found.select("key", "top", F.col("rank").alias("page"), "above"), "ways-to-pages")
    return found.select("key", "top", "node", "carried", F.col("above").alias("path"))


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) gives with the siblings of a path, nearest first."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def siblings_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, nearest first, from left to right in a level."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def prove_rows(rows: DataFrame, leaf: Column, *, group: str = "lang", order: str = "doc_id") -> DataFrame:
    """Columns row (a struct of all input columns), leaf, subroot, root (hex) and path (array of {before, after}, nearest first).

    ``leaf`` is the digest of a row, in hex; the rows travel with their proofs, so leave out
    long columns that only the digest needs.  Rows stand by ``order`` in each ``group``, NULL
    first, rows of one number by their digests; groups stand by UTF-8 bytes, NULL first.
    Repeated rows are leaves of their own, a group of one row is its own subroot, an empty
    table gives no rows.  The input's columns travel in one struct: names don't clash.
    """
    own = F.col(f"`{group}`").cast("string")
    # NULL becomes the least key, any other value keeps its place.
    key = F.coalesce(F.concat(F.lit("="), own), F.lit(""))
    leaves = written(rows.select(key.alias("key"), F.unhex(leaf).alias("node"), F.struct(*names(rows)).alias("carried")), "rows")
    groups = tree(ranked(leaves, [f"carried.`{order}`"]))
    upper = groups.tops.select(F.lit("").alias("key"), F.col("top").alias("node"), F.struct(F.col("key").alias("group")).alias("carried"))
    whole = tree(ranked(upper, ["carried.group"]))
    root = whole.tops.first()  # one row, none for an empty table
    starts = descend(whole, whole.tops.select("key", F.array().cast(PATH).alias("above")))
    found = descend(groups, starts.select(F.col("carried.group").alias("key"), F.col("path").alias("above")))
    return found.select(F.col("carried").alias("row"), F.lower(F.hex("node")).alias("leaf"), F.lower(F.hex("top")).alias("subroot"),
                        F.lit(root["top"].hex() if root else None).cast("string").alias("root"), F.reverse("path").alias("path"))
