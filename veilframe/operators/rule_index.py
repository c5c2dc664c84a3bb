"""Rules as data: large rule tables held against texts through an index of their literals.

``rules.rule_hits`` compiles every pattern into the plan, which is best for a policy of
some dozens of rules.  Here the plan stays the same whatever the number of rules, and the
rules stay a table.  Of a rule one kind of criteria is indexed by the plain texts that every
match must contain; of such a literal one gram (a run of 1, 2, 4, ... 32 bytes) stands in the
index, the one that fewest literals have.  One pass over a file's text and path finds the
grams of the index, with the bytes around them; a join proposes the rules whose literal is
there; proposed pairs meet the rule's patterns by its number, and the regexes decide.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.match import glob_to_regex, required_literals
from ..sources.scratch import written

#: Bytes of the longest gram; of a literal less than twice as many are looked at.
LONGEST = 32
#: Bits of the filter of grams that the driver hands to all tasks: per gram, and in all at most.
FILTER_BITS, MOST_FILTER_BITS, PROBES = 32, 1 << 27, 4
#: Rules without a literal up to which they are sent to all tasks.
BROADCAST_RULES = 10_000
#: Bytes of text that are hashed at a time.
_SLICE = 1 << 18
_PAIR = np.uint64(0xD1B54A32D192ED03)

_PREPARED = pa.schema([("rule_ord", pa.int32()), ("rule_id", pa.string()), ("action", pa.string()), ("globs", pa.list_(pa.string())),
                       ("path_regex", pa.list_(pa.string())), ("content_regex", pa.list_(pa.string())), ("symbols", pa.bool_()),
                       ("place", pa.string()), ("literals", pa.list_(pa.string())), ("error", pa.string())])
_PREPARED_TYPE = ("rule_ord int, rule_id string, action string, globs array<string>, path_regex array<string>, content_regex array<string>, "
                  "symbols boolean, place string, literals array<string>, error string")


def _indexed(path_regex: Sequence[str], content_regex: Sequence[str]) -> tuple[str, list[str]] | None:
    """Which column a rule is looked up by, and by which literals; None if neither will do."""
    for column, patterns in (("text", content_regex), ("path", path_regex)):
        literals = [required_literals(p) for p in patterns]
        if literals and all(literals):
            return column, sorted({x for own in literals for x in own})
    return None


def _prepared(rules: DataFrame) -> DataFrame:
    """Rules with criteria: patterns as regexes, and where and by which literals they are looked up."""
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                globs, path_regex, content_regex = (r[c] or [] for c in ("paths", "path_regex", "content_regex"))
                r |= {"path_regex": path_regex, "content_regex": content_regex, "globs": [], "place": None, "literals": [], "error": None}
                if not r["symbols"]:
                    try:
                        r["globs"] = [glob_to_regex(g) for g in globs]
                    except ValueError as error:
                        r["error"] = str(error)
                    r["place"], r["literals"] = _indexed(path_regex, content_regex) or (None, [])
                rows.append(r)
            yield pa.RecordBatch.from_pylist([{f.name: r[f.name] for f in _PREPARED} for r in rows], schema=_PREPARED)

    criteria = ["paths", "path_regex", "content_regex"]
    some = " OR ".join(f"coalesce(size({c}), 0) > 0" for c in criteria)
    known = rules.select(F.col("rule_ord").cast("int").alias("rule_ord"), "rule_id", "action", *criteria, F.col("kotlin").isNotNull().alias("symbols"))
    return known.where(f"symbols OR {some}").mapInArrow(prepare, _PREPARED_TYPE)  # a rule without criteria never matches


def _mixed(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ (codes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    codes = (codes ^ (codes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return codes ^ (codes >> np.uint64(31))


def gram_codes(data: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sizes 1, 2, 4, ... up to the longest, and the codes of all grams of that size in bytes."""
    size, codes = 1, _mixed(data.astype(np.uint64) + _PAIR)
    while size <= longest and len(codes):
        yield size, codes
        codes = _mixed(codes[:-size] * _PAIR + codes[size:])
        size *= 2


def _with_grams(links: DataFrame) -> DataFrame:
    """All grams of each link's literal of the largest size that it has."""
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).cast(pa.large_binary())
            ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
            own = np.minimum(1 << (np.frexp(np.diff(ends))[1] - 1), LONGEST)
            for size, codes in gram_codes(np.frombuffer(values.buffers()[2], np.uint8)[ends[0]:ends[-1]], LONGEST):
                at = np.flatnonzero(own == size)
                many = np.diff(ends)[at] - size + 1
                first = np.repeat(ends[at] - ends[0] - np.cumsum(many) + many, many)
                cuts = pa.array(np.append(0, np.cumsum(many)), pa.int32())
                found = pa.ListArray.from_arrays(cuts, pa.array(codes[first + np.arange(many.sum())].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(np.full(len(at), size), pa.int32()), found],
                                                 names=["place", "literal", "rule_ord", "size", "grams"])

    return links.mapInArrow(grams, "place string, literal binary, rule_ord int, size int, grams array<bigint>").select(
        "place", "literal", "rule_ord", "size", F.explode(F.array_distinct("grams")).alias("gram"))


def _index(prepared: DataFrame) -> DataFrame:
    """place, gram, size, literal, rule_ord: every literal of a rule (its first bytes, if long) under its rarest gram."""
    literal = F.substring(F.col("literal").cast("binary"), 1, 2 * LONGEST - 1)
    links = prepared.select("place", "rule_ord", F.explode("literals").alias("literal")).select("place", literal.alias("literal"), "rule_ord")
    grams = _with_grams(links)
    counted = grams.join(grams.groupBy("place", "gram").agg(F.count("*").alias("n")), ["place", "gram"])
    rarest = counted.groupBy("place", "literal", "rule_ord").agg(F.min(F.struct("n", "gram", "size")).alias("best"))
    return rarest.select("place", "best.gram", "best.size", "literal", "rule_ord")


def _filter(index: DataFrame, place: str, grams: int) -> np.ndarray:
    """Bytes of a Bloom filter of the grams of a place."""
    bits = 1 << min(max(FILTER_BITS * grams - 1, 1 << 15).bit_length(), MOST_FILTER_BITS.bit_length() - 1)
    own = index.where(F.col("place") == place).select("gram").distinct()
    first, step = F.col("gram").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1))
    probes = F.array(*((first + k * step).bitwiseAND(F.lit(bits - 1)) + 1 for k in range(PROBES)))
    pages = own.select(F.explode(probes).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("page")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("set")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for row in pages:
        out[(row.page - 1) * 4096:row.page * 4096] = np.frombuffer(row.set, np.uint8)
    return out


def _known(codes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of the codes that may be in the filter."""
    mask = np.uint64(8 * len(bits) - 1)
    found = np.arange(len(codes))
    for k in range(PROBES):
        own = codes if k == 0 else codes[found]
        at = (own if k == 0 else own + np.uint64(k) * (own >> np.uint64(32) | np.uint64(1))) & mask
        found = found[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).view(bool)]
    return found


def _gram_hits(values: pa.Array, sizes: Sequence[int], bits: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Row, code and surrounding bytes of the grams in a column of texts that the filter knows."""
    values = values.cast(pa.large_binary())
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    for a in range(int(ends[0]), int(ends[-1]), _SLICE):
        b = min(a + _SLICE, int(ends[-1]))
        for size, codes in gram_codes(data[a:min(b + sizes[-1] - 1, int(ends[-1]))], sizes[-1]):
            if size in sizes:
                codes = codes[:b - a]
                found = _known(codes, bits)
                row = np.searchsorted(ends, found + a, "right") - 1
                inside = found + a + size <= ends[row + 1]
                found, row = found[inside], row[inside]
                left, right = np.maximum(found + a - size, ends[row]), np.minimum(found + a + 2 * size, ends[row + 1])
                for i, code, x, y in zip(row.tolist(), codes[found].view(np.int64).tolist(), left.tolist(), right.tolist(), strict=True):
                    yield i, code, data[x:y].tobytes()


def _candidates(slim: DataFrame, filters: dict[str, tuple[list[int], np.ndarray]]) -> DataFrame:
    """key, place, gram and the bytes around it, for each gram of the index that a file has."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for place, (sizes, bits) in filters.items():
                found = sorted(set(_gram_hits(batch.column(1 if place == "path" else 2), sizes, bits)))
                if found:
                    rows, codes, around = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[list(rows)], pa.int64()), pa.array([place] * len(rows), pa.string()), pa.array(codes, pa.int64()), pa.array(around, pa.binary())],
                        names=["key", "place", "gram", "around"])

    return slim.select("key", "path", "text").mapInArrow(scan, "key bigint, place string, gram bigint, around binary")


def indexed_rule_hits(files: DataFrame, rules: DataFrame, *, path: str = "path", text: str = "text", carry: Sequence[str] = ("path",)) -> DataFrame:
    """Which rule matches which original text: ``carry``, rule_ord, rule_id, action; one row per (file, matching rule).

    ``rules`` is a table like that of ``sources.tables.rules_frame``; rule_ord is its key.
    Rules, literals and grams stay tables; the driver has a filter of bounded size.  Rules
    without a usable literal are proposed for every file.  Files are read twice: for grams, and
    by the hash of path and text for the patterns; files of one hash are only checked more
    often.  Symbol criteria have no place here and raise.
    """
    prepared = written(_prepared(rules), "rules")
    by_number = prepared.groupBy("rule_ord").agg(F.count("*").alias("n"), F.max("symbols").alias("symbols"), F.max("error").alias("error"),
                                                 F.count_if(F.col("place").isNull()).alias("always"))
    seen = by_number.agg(F.max("n").alias("n"), F.max("symbols").alias("symbols"), F.max("error").alias("error"), F.sum("always").alias("always")).first()
    if seen.symbols:
        raise ValueError("rules with symbol criteria: use rules.rule_hits")
    if (seen.n or 0) > 1:
        raise ValueError("rule_ord is not unique")
    if seen.error:
        raise ValueError(seen.error)
    index = written(_index(prepared), "rule-index")
    filters = {r.place: (sorted(r.sizes), _filter(index, r.place, r.grams)) for r in index.groupBy("place").agg(
        F.collect_set("size").alias("sizes"), F.count_distinct("gram").alias("grams")).collect()}
    row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    slim = files.select(row.alias("row"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text")) \
        .withColumn("key", F.xxhash64("path", "text"))
    checks = prepared.select("rule_ord", "rule_id", "action", "globs", "path_regex", "content_regex")
    proposed = _candidates(slim, filters).join(index, ["place", "gram"]).where(F.contains("around", "literal")).select("key", "rule_ord").distinct()
    pairs = proposed.join(checks, "rule_ord").join(slim, "key").select("row", "path", "text", *checks.columns)
    if seen.always:
        always = prepared.where("place IS NULL").select(checks.columns)
        everywhere = slim.drop("key").crossJoin(F.broadcast(always) if seen.always <= BROADCAST_RULES else always)
        pairs = pairs.unionByName(everywhere)

    def holds(value: str, patterns: str) -> Column:
        some = F.exists(patterns, lambda p: F.rlike(F.col(value), p))
        return (F.size(patterns) == 0) | F.coalesce(some, F.lit(False))

    hits = pairs.where(holds("path", "globs") & holds("path", "path_regex") & holds("text", "content_regex"))
    return hits.select(*(F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(carry)), "rule_ord", "rule_id", "action")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
