"""Words as all operators of this folder count them, and tables of a test or cluster folder."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The six separators; a word is a run of anything else.
SEPARATORS = " \t\n\x0b\x0c\r"
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[[ord(c) for c in SEPARATORS]] = True
#: One random number per byte value, from a fixed seed.
_BYTE_CODES = np.random.default_rng(20_240).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PAIR = np.uint64(0xD1B54A32D192ED03)
#: Bytes of short texts that are looked at together; a longer text is looked at alone.
CHUNK = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col(f"`{name.replace('`', '``')}`")


def names(df: DataFrame) -> list[Column]:
    """All columns of a frame, whatever characters their names have."""
    return [column(c) for c in df.columns]


def beside(docs: DataFrame, text: str) -> DataFrame:
    """Columns ``row`` (all columns of the input, by place) and ``text``: whatever is added to them meets no name of the input."""
    row = F.struct(*(c.alias(f"c{i}") for i, c in enumerate(names(docs))))
    return docs.select(row.alias("row"), column(text).cast("string").alias("text"))


def unpacked(out: DataFrame, docs: DataFrame, added: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` out of ``row``, and ``added`` by name; an input column of such a name, in any case, gives its place."""
    of = {a.lower(): a for a in added}
    left, columns = dict(added), []
    for i, c in enumerate(docs.columns):
        name = of.get(c.lower())
        if name is None:
            columns.append(F.col("row").getField(f"c{i}").alias(c))
        elif name in left:
            columns.append(left.pop(name).alias(name))
    return out.select(*columns, *(v.alias(n) for n, v in left.items()))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one if the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_array(text: Column) -> Column:
    """The words of a text, none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in UTF-8 bytes."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _IS_SEPARATOR[np.frombuffer(data, np.uint8)]
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    return turns[::2], turns[1::2]


def runs_within(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of true flags, and the place of each part's first run (and one past the last).

    Parts lie one after another, between ``offsets``; a run ends where its part does.
    """
    first, last = flags.copy(), flags.copy()
    first[1:] &= ~flags[:-1]
    last[:-1] &= ~flags[1:]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(flags))]
    first[cuts] = flags[cuts]
    last[cuts - 1] = flags[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, UTF-8 bytes and the rows' offsets in them, about ``CHUNK`` bytes at a time; NULL is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def words_within(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of texts between ``offsets``, and the place of each text's first word (and one past the last)."""
    return runs_within(~_IS_SEPARATOR[data], offsets)


def blanked(data: np.ndarray) -> np.ndarray:
    """The bytes with a blank for every separator."""
    return np.where(_IS_SEPARATOR[data], np.uint8(32), data)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all others."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the 0, 1, ... n-1, modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


@cache
def _known_powers(base: np.uint64) -> np.ndarray:
    return powers(base, CHUNK + 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    known = _known_powers(base)
    return known[:n] if n <= len(known) else powers(base, n)


def word_codes(data: bytes | np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit number per word, equal for equal words: a polynomial of its bytes and its length."""
    codes = _BYTE_CODES[np.frombuffer(data, np.uint8)] * _powers(_BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes, out=sums[1:])
    inner = (sums[ends] - sums[starts]) * _powers(_UNBASE, len(data) + 1)[starts]
    return mixed(inner + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pair_codes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The numbers of windows, from those of their first and last parts."""
    return mixed(first * _PAIR + second)


def joined_codes(codes: np.ndarray, step: int) -> np.ndarray:
    """From the numbers of all windows of a length, those of the windows that are ``step`` longer, by their first and last such window."""
    if len(codes) <= step:
        return np.zeros(0, np.uint64)
    return pair_codes(codes[:len(codes) - step], codes[step:])


def window_codes(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit number for every run of ``length`` words, by its first position: of 1, 2, 4, ... words, joined."""
    codes, reach = words, 1
    while reach < length:
        step = min(reach, length - reach)
        codes, reach = joined_codes(codes, step), reach + step
    return codes


def window_checks(words: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    """A second 64-bit number for the runs of ``length`` words that start ``at`` these places: a polynomial of the words' numbers."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(_BASE, len(words)), out=sums[1:])
    return mixed((sums[at + length] - sums[at]) * _powers(_UNBASE, len(words) + 1)[at])
