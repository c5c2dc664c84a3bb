"""Language-model scores from the lattice of all ways to spell a text with a subword vocabulary.

The vocabulary is a public tokenizer's and stays as it is.  A text is its words, each
begun by a space, and an end; its probability is the sum, over all sequences of pieces
that spell it, of the product of the pieces' probabilities.  The sum comes from a forward
recursion in log space over the bytes of a word.  No piece holds a space but at its
beginning, so words are scored one by one, and each different word once for the corpus.

Piece probabilities start from the vocabulary's scores and are estimated from all
training words: expected counts by forward and backward recursion.  Single bytes are
pieces, so every text has a probability, and those of all texts sum to one.

Texts are read once.  Each task turns a few megabytes of documents into a chunk: the
chunk's different words, and per document the numbers of its words among them.  Words
meet by hash once, get their training counts and scores there, and go back to their
chunks.  What travels is words per chunk, not per document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import new_folder, written

_LOWER = bytes(range(256)).lower()
#: Weight of the vocabulary's own scores against counts, in pieces.
PRIOR_PIECES = 1000.0
#: Expected counts travel as whole numbers of this part of a piece, so sums do not depend on their order.
COUNT_UNIT = 1 << 20
#: Bytes of text in a chunk; a longer document is one of its own.
CHUNK_BYTES = 1 << 24
_NOTHING = -np.inf


@dataclass(frozen=True)
class Pieces:
    """Byte strings with probabilities, and that of the end of a text; all sum to one."""
    strings: tuple[bytes, ...]
    weights: tuple[float, ...]
    end: float

    @cached_property
    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Next node by node and byte (node 1 is the root, 0 none), log weight and number of the piece that ends at a node, longest piece."""
        children: list[dict[int, int]] = [{}, {}]
        ends = {}
        for number, string in enumerate(self.strings):
            node = 1
            for byte in string:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                node = children[node][byte]
            ends[node] = number
        table = np.zeros((len(children), 256), np.int32)
        for node, own in enumerate(children):
            for byte, child in own.items():
                table[node, byte] = child
        log, of = np.full(len(children), _NOTHING), np.full(len(children), -1, np.int64)
        for node, number in ends.items():
            log[node], of[node] = math.log(self.weights[number]), number
        return table.ravel(), log, of, max(map(len, self.strings))


def vocabulary(path: str, *, scores: str = "ranks") -> Pieces:
    """The pieces of a sentencepiece model, by its scores: their exponentials, or for ``ranks`` (a merge order) one over the rank.

    Pieces of white space only and those with an A-Z are never used, as texts are
    lower-cased words.  Byte pieces come last in a merge order.
    """
    from sentencepiece import SentencePieceProcessor

    model, mass = SentencePieceProcessor(model_file=path), Counter()
    last = model.vocab_size()
    for number in range(last):
        piece, score = model.id_to_piece(number), model.get_score(number)
        if model.is_byte(number):
            mass[bytes([int(piece[3:5], 16)])] += 1 / last if scores == "ranks" else math.exp(score)
            continue
        if model.is_control(number) or model.is_unknown(number) or model.is_unused(number) or piece.strip("▁") == "" and piece != "▁":
            continue
        string = piece.replace("▁", " ")
        if " " not in string[1:] and string.lower() == string:
            mass[string.encode()] += 1 / (2 - score) if scores == "ranks" else math.exp(score)
    for byte in range(256):
        mass[bytes([byte])] += 1 / last
    total = sum(mass.values()) * (1 + 1e-3)
    return Pieces(tuple(mass), tuple(m / total for m in mass.values()), 1e-3 / (1 + 1e-3))


def _spelled(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words by length: their places, and their bytes after a space, one row each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
        # Long words in few rows, so that the arrays of a group stay small.
        rows = max(1, (1 << 21) // (int(lengths[part[0]]) + 1))
        for at in range(0, len(part), rows):
            own = part[at:at + rows]
            yield own, np.frombuffer(b"".join(b" " + words[i] for i in own), np.uint8).reshape(len(own), -1)


def _nodes(text: np.ndarray, pieces: Pieces) -> list[np.ndarray]:
    """For each length from 1: the trie node that the bytes from each place on lead to, 0 if none; ends when all are."""
    table, _, _, longest = pieces.trie
    n, found = text.shape[1], []
    node = np.ones(text.shape, np.int32)
    for length in range(1, min(longest, n) + 1):
        node = table[node[:, :n - length + 1].astype(np.int64) * 256 + text[:, length - 1:]]
        if not node.any():
            break
        found.append(node)
    return found


def _forward(weights: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Log of the summed weight of all ways to each place: alpha[:, t] over alpha[:, t - l] and the pieces of length l from there."""
    alpha = np.full((shape[1] + 1, shape[0]), _NOTHING)
    alpha[0] = 0
    for t in range(1, shape[1] + 1):
        ways = np.stack([alpha[t - l] + weights[l - 1][:, t - l] for l in range(1, min(t, len(weights)) + 1)])
        top = ways.max(axis=0)
        alpha[t] = top + np.log(np.exp(ways - top).sum(axis=0))
    return alpha


def _backward(weights: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    n = shape[1]
    beta = np.full((n + 1, shape[0]), _NOTHING)
    beta[n] = 0
    for t in range(n - 1, -1, -1):
        ways = np.stack([beta[t + l] + weights[l - 1][:, t] for l in range(1, min(n - t, len(weights)) + 1)])
        top = ways.max(axis=0)
        beta[t] = top + np.log(np.exp(ways - top).sum(axis=0))
    return beta


def log_probabilities(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """Natural log of the marginal probability of each word (a space and its bytes) over all segmentations."""
    log, out = pieces.trie[1], np.zeros(len(words))
    for own, text in _spelled(words):
        weights = [log[node] for node in _nodes(text, pieces)]
        out[own] = _forward(weights, text.shape)[-1]
    return out


def expected_counts(words: list[bytes], times: np.ndarray, pieces: Pieces) -> np.ndarray:
    """How often each piece is expected in words that occur so often."""
    _, log, of, _ = pieces.trie
    out = np.zeros(len(pieces.strings))
    for own, text in _spelled(words):
        nodes = _nodes(text, pieces)
        weights = [log[node] for node in nodes]
        alpha, beta = _forward(weights, text.shape), _backward(weights, text.shape)
        scale = np.log(times[own]) - alpha[-1]
        for length, (node, weight) in enumerate(zip(nodes, weights, strict=True), 1):
            n = text.shape[1] - length + 1
            share = np.exp(alpha[:n].T + weight + beta[length:length + n].T + scale[:, None])
            used = of[node] >= 0
            out += np.bincount(of[node][used], share[used], len(out))
    return out


#: A chunk's rows: its documents (number -1) as one Arrow message, then its words by number.
_CHUNK = pa.schema([("chunk", pa.int64()), ("number", pa.int32()), ("word", pa.binary()), ("seen", pa.int64()), ("docs", pa.binary())])
_CHUNK_DDL = "chunk bigint, number int, word binary, seen bigint, docs binary"
_DOCS = pa.schema([("id", pa.int64()), ("held", pa.bool_()), ("words", pa.int64()), ("steps", pa.list_(pa.uint32())), ("times", pa.list_(pa.uint32()))])


def _message(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


class _Chunk:
    """Documents in one task until they are ``CHUNK_BYTES``."""

    def __init__(self) -> None:
        self.numbers, self.seen = {}, []
        self.ids, self.held, self.words, self.steps, self.times, self.bytes = [], [], [], [], [], 0

    def add(self, doc_id: int | None, held: bool, text: str | None) -> None:
        data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
        own = Counter(data.split())  # the six separators, as for bytes
        numbers, seen = self.numbers, self.seen
        of = np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), np.int64, len(own))
        times = np.fromiter(own.values(), np.int64, len(own))
        order = np.argsort(of)
        seen.extend([0] * (len(numbers) - len(seen)))
        if not held:
            for number, n in zip(of.tolist(), times.tolist(), strict=True):
                seen[number] += n
        self.ids.append(doc_id)
        self.held.append(held)
        self.words.append(int(times.sum()))
        self.steps.append(np.diff(of[order], prepend=0).astype(np.uint32))
        self.times.append(times[order].astype(np.uint32))
        self.bytes += len(data) + 64

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        """The documents under number -1, then the words by number."""
        docs = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((self.ids, self.held, self.words, self.steps, self.times), _DOCS)], schema=_DOCS)
        yield pa.RecordBatch.from_pylist([{"chunk": chunk, "number": -1, "word": None, "seen": self.held.count(False), "docs": _message(docs)}], _CHUNK)
        words = list(self.numbers)
        for at in range(0, len(words), 50_000):
            own = words[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), chunk)), pa.array(np.arange(at, at + len(own), dtype=np.int32)), pa.array(own, pa.binary()),
                                              pa.array(self.seen[at:at + len(own)], pa.int64()), pa.nulls(len(own), pa.binary())], schema=_CHUNK)


def _chunks(docs: DataFrame) -> DataFrame:
    """doc_id, held, text as rows chunk, number, word, seen (in training documents), docs; a document's row has number -1 and no word."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        first, done, chunk = TaskContext.get().partitionId() << 32, 0, _Chunk()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunk.add(*row)
                if chunk.bytes >= CHUNK_BYTES:
                    yield from chunk.rows(first + done)
                    done, chunk = done + 1, _Chunk()
        if chunk.ids:
            yield from chunk.rows(first + done)

    return docs.mapInArrow(cut, _CHUNK_DDL)


def _expected(words: DataFrame, pieces: Pieces) -> dict[int, float]:
    """Expected counts of pieces in all training words; as many numbers as there are pieces come to the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pieces.strings))
        for batch in batches:
            total += expected_counts(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float), pieces)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.round(total[used] * COUNT_UNIT).astype(np.int64))], names=["piece", "n"])

    rows = words.mapInArrow(count, "piece int, n bigint").groupBy("piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    return {r.piece: float(r.n) / COUNT_UNIT for r in rows}


def score_texts(docs: DataFrame, vocab: Pieces, *, held_out: Column, rounds: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows for which ``held_out`` holds are not learned from.  Tokens are words, A-Z
    lower-cased, and one end per text; a NULL or empty text is its end alone.
    ``base_score`` is by words with add-one counts, ``score`` by the lattice, both log10.
    Rows are not joined by id: NULL and repeated ids are scored like all others.  Other
    columns are not read.  A word of any length is scored whole, in time that grows with
    its length.  Without any training text the pieces keep the vocabulary's weights.
    """
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "chunks")
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(f"`{text}`").cast("string").alias("text"))
    _chunks(slim).write.option("compression", "zstd").parquet(folder)
    chunks = spark.read.schema(_CHUNK_DDL).parquet(folder)
    by_word = Window.partitionBy("word")
    counted = written(chunks.where("number >= 0").select("chunk", "number", "word", F.sum("seen").over(by_word).alias("c"),
                                                         (F.row_number().over(by_word.orderBy("chunk")) == 1).alias("is_first")), "words")
    known = counted.where("is_first AND c > 0")
    total = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    texts = chunks.where("number = -1").agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("n")).first().n
    n, v = total.n + texts, total.v + (texts > 0)
    pieces = vocab
    for _ in range(rounds if total.n else 0):
        found = _expected(known.select("word", "c"), pieces)
        whole = sum(found.values()) + texts + PRIOR_PIECES
        pieces = Pieces(vocab.strings, tuple((found.get(i, 0.0) + PRIOR_PIECES * w) / whole for i, w in enumerate(vocab.weights)),
                        (texts + PRIOR_PIECES * vocab.end) / whole)

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            own = log_probabilities(coded.dictionary.to_pylist(), pieces)[coded.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(own)], names=["chunk", "number", "c", "log"])

    scored = counted.select("chunk", "number", "word", "c").mapInArrow(score_words, "chunk bigint, number int, c bigint, log double")
    back = scored.withColumn("docs", F.lit(None).cast("binary")).unionByName(chunks.where("number = -1").select(
        "chunk", "number", F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("log"), "docs"))
    end = ((texts + 1) / (n + v + 1), pieces.end, texts > 0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, counts, logs = None, [], []

        def solved() -> pa.RecordBatch:
            c, log = (np.concatenate(x) if x else np.zeros(0) for x in (counts, logs))
            base = np.log10((c + 1) / (n + v + 1))
            own = pa.ipc.open_stream(docs).read_next_batch()
            different = own.column(3).value_lengths().to_numpy().astype(np.int64)
            of, times = np.repeat(np.arange(len(different)), different), own.column(4).flatten().to_numpy()
            # Numbers of a document's words are running sums of its steps.
            sums = np.cumsum(own.column(3).flatten().to_numpy().astype(np.int64))
            number = sums - np.repeat(np.concatenate([[0], sums])[np.cumsum(different) - different], different)

            def summed(values: np.ndarray) -> np.ndarray:
                return np.bincount(of, times * values[number], len(different)) if len(of) else np.zeros(len(different))

            words = own.column(2).to_numpy()
            return pa.RecordBatch.from_arrays([
                own.column(0), own.column(1), pa.array(words + 1),
                pa.array(np.round(summed((c > 0).astype(float))).astype(np.int64) + int(end[2])), pa.array(np.full(len(words), n, np.int64)),
                pa.array(summed(base) + math.log10(end[0])), pa.array((summed(log) + math.log(end[1])) / math.log(10))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for batch in batches:
            head = batch.column(1).to_numpy() == -1
            starts = sorted({0, *np.flatnonzero(head).tolist()}) if len(head) else []
            for a, b in zip(starts, [*starts[1:], len(head)][:len(starts)], strict=True):
                if head[a]:
                    if docs is not None:
                        yield solved()
                    docs, counts, logs = batch.column(4)[a].as_py(), [], []
                    a += 1
                counts.append(batch.column(2).slice(a, b - a).to_numpy())
                logs.append(batch.column(3).slice(a, b - a).to_numpy())
        if docs is not None:
            yield solved()

    return back.repartition("chunk").sortWithinPartitions("chunk", "number").select("chunk", "number", "c", "log", "docs").mapInArrow(
        score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
