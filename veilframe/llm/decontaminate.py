"""Benchmark decontamination: test items inside documents, up to a number of edits.

By the pigeonhole principle an item with at most k edits still holds one of its
k + 1 pieces unchanged.  All pieces are looked for in one pass (Aho-Corasick), and
where one is found, the item's edit distance to the text around it is computed
with Myers' bit-parallel algorithm.  Short items are looked for exactly, between blanks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import beside, column, unpacked

HITS_TYPE = "array<struct<item_id:bigint,edits:int,start_word:bigint,end_word:bigint>>"
_ARROW_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start_word", pa.int64()), ("end_word", pa.int64())]))


def normal(text: str | None) -> str:
    """Lower case, words joined by one blank."""
    return " ".join((text or "").lower().split())


def pieces(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and end of ``parts`` pieces of nearly equal length."""
    edges = [length * i // parts for i in range(parts + 1)]
    return list(zip(edges, edges[1:], strict=False))


def myers(pattern_bits: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """The least edit distance of a pattern to any part of ``text``, and the end of the first such part.

    One column of the distance table is held as two numbers of ``length`` bits: where
    it steps up, and where it steps down.
    """
    whole, top = (1 << length) - 1, 1 << (length - 1)
    up, down, distance = whole, 0, length
    best, end = length, 0
    for i, c in enumerate(text, 1):
        eq = pattern_bits.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up = down | ~(diagonal | up) & whole
        right_down = up & diagonal
        if right_up & top:
            distance += 1
        elif right_down & top:
            distance -= 1
            if distance < best:
                best, end = distance, i
        right_up, right_down = right_up << 1, right_down << 1  # the first row stays 0: a match may begin anywhere
        up = (right_down | ~(diagonal | right_up)) & whole
        down = right_up & diagonal & whole
    return best, end


class Finder:
    """Test items prepared for search."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, least_chars: int = 32):
        import ahocorasick

        self.least_chars = least_chars

        self.items = []
        own: dict[str, list[tuple[int, int]]] = {}
        for number, text in items:
            budget = int(error_rate * len(text)) if len(text) >= least_chars else 0
            for start, end in pieces(len(text), budget + 1):
                own.setdefault(text[start:end], []).append((len(self.items), start))
            bits: dict[str, int] = {}
            for i, c in enumerate(text):
                bits[c] = bits.get(c, 0) | 1 << i
            self.items.append((number, len(text), budget, bits, Counter(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in own.items():
            self.automaton.add_word(piece, (len(piece), places))
        if own:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """Item, edits, first and last word plus one of every item within its budget; the best place of each item."""
        plain = normal(text)
        if not plain or not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(plain):
            for item, offset in places:
                starts.setdefault(item, set()).add(end - size + 1 - offset)
        out = []
        for item, guesses in starts.items():
            number, length, budget, bits, letters = self.items[item]
            best, at = budget + 1, 0
            if length < self.least_chars:
                # The piece is the whole item; it counts as words of its own only.
                places = [g for g in guesses if (g == 0 or plain[g - 1] == " ") and plain[g + length:g + length + 1] in ("", " ")]
                if places:
                    out.append((number, 0, plain.count(" ", 0, min(places)), plain.count(" ", 0, min(places) + length) + 1))
                continue
            low = high = None
            for guess in [*sorted(guesses), None]:
                if low is not None and (guess is None or guess > high + 2 * budget):
                    # One stretch of text for guesses that lie together.
                    first = max(0, low - budget)
                    stretch = plain[first:high + length + budget]
                    # Every letter that the stretch has too few of costs an edit.
                    if (letters - Counter(stretch)).total() < best:
                        edits, end = myers(bits, length, stretch)
                        if edits < best:
                            best, at = edits, first + end
                    low = None
                if guess is not None:
                    low, high = (guess if low is None else low), guess
            if best <= budget:
                begin = max(0, at - length)
                out.append((number, best, plain.count(" ", 0, begin + (plain[begin:begin + 1] == " ")), plain.count(" ", 0, at) + 1))
        return sorted(out)


def find_items(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
               into: str = "leaks", error_rate: float = 0.08, least_chars: int = 32, block_chars: int = 4_000_000) -> DataFrame:
    """Adds ``into``: the test items that a document holds, with their edits and place in words.

    Texts and items are compared in lower case with single blanks.  An item of n
    characters may differ by ``error_rate`` times n edits, rounded down; one of fewer
    than ``least_chars`` characters has to be there unchanged, with no letter or mark
    next to it.  Items without a word and items without an id are none.  NULL texts hold nothing.

    Items go to the tasks in blocks of about ``block_chars`` characters, one pass over
    the documents per block; the driver holds them all, so the benchmark (not the
    documents) has to fit there.  Documents are not shuffled.  A column ``into`` of the input
    (in any case) is replaced, others pass through.
    """
    usable = items.where(column(item_id).isNotNull()).select(column(item_id).cast("long").alias("id"), column(item_text).cast("string").alias("text"))
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    out = beside(docs, text).withColumn("found", F.expr(f"cast(array() as {HITS_TYPE})"))
    for block in range(blocks):
        some = usable.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()  # about block_chars characters
        listed = sorted({(r["id"], t) for r in some if (t := normal(r["text"]))})

        def search(batches: Iterator[pa.RecordBatch], listed=listed) -> Iterator[pa.RecordBatch]:
            finder = Finder(listed, error_rate, least_chars)
            for batch in batches:
                found = [[*old, *({"item_id": i, "edits": e, "start_word": s, "end_word": x} for i, e, s, x in finder.find(t))]
                         for old, t in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, _ARROW_HITS)], names=["row", "text", "found"])

        out = out.mapInArrow(search, out.schema)
    return unpacked(out, docs, {into: F.col("found")})


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document and test item that it holds: doc_id, item_id, edits, start_word, end_word."""
    slim = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    return find_items(slim, items, into="leaks", **options).select("doc_id", F.inline("leaks"))
