"""Text quality by a small convolutional network over bytes, in numpy.

A text's UTF-8 bytes are cut into overlapping chunks.  Every position has two
channels: its byte, and how far back the four bytes ending there were seen last.
Learned filters of a few positions run over each chunk, the strongest response of
each filter is kept (max-pooling), and mean and maximum over the chunks give one
logistic probability.  All chunks of a text are read.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .words import beside, unpacked

CHUNK, STRIDE = 512, 448
WIDTH, FILTERS = 6, 16
#: Steps of the second channel: not seen within the last 256 bytes, or seen up to so many bytes back.
LAGS = np.array([4, 8, 12, 20, 36, 80, 256])
N_LAGS = len(LAGS) + 1
PAD = 256 * N_LAGS
#: Chunks that are computed together.
TOGETHER = 64
_LAG_STEP = np.full(258, 0, np.uint8)
_LAG_STEP[1:257] = 1 + np.searchsorted(LAGS, np.arange(1, 257))


def lag_steps(data: np.ndarray) -> np.ndarray:
    """The second channel of bytes: 0, or the step of the distance to the last equal four bytes."""
    n = len(data)
    if n < 4:
        return np.zeros(n, np.uint8)
    wide = data.astype(np.uint32)
    grams = wide[3:] | wide[2:-1] << 8 | wide[1:-2] << 16 | wide[:-3] << 24
    grams = ((grams * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)
    order = np.argsort(grams, kind="stable")
    back = np.full(len(grams), 257)
    same = grams[order[1:]] == grams[order[:-1]]
    back[order[1:][same]] = np.minimum(order[1:][same] - order[:-1][same], 257)
    out = np.zeros(n, np.uint8)
    out[3:] = _LAG_STEP[back]
    return out


def chunks(data: bytes) -> Iterator[np.ndarray]:
    """Codes (byte and lag step) of all chunks, up to ``TOGETHER`` rows at a time, the last one padded."""
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(data), STRIDE * TOGETHER):
        lead = min(at, 260)
        part = whole[at - lead:at + STRIDE * (TOGETHER - 1) + CHUNK]
        codes = (part.astype(np.int32) * N_LAGS + lag_steps(part))[lead:]
        n = min(TOGETHER, max(1, -(-max(0, len(codes) - (CHUNK - STRIDE)) // STRIDE)))
        padded = np.full(STRIDE * (n - 1) + CHUNK, PAD, np.int32)
        padded[:min(len(codes), len(padded))] = codes[:len(padded)]
        yield np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]


@dataclass
class Network:
    """Filters per offset for both channels, their offsets, and the weights of mean and maximum."""

    byte: np.ndarray  # WIDTH x 256 x FILTERS
    lag: np.ndarray  # WIDTH x N_LAGS x FILTERS
    bias: np.ndarray  # FILTERS
    mean: np.ndarray  # FILTERS
    peak: np.ndarray  # FILTERS
    level: np.ndarray  # 1

    @staticmethod
    def new(seed: int = 5) -> "Network":
        rng = np.random.default_rng(seed)

        def small(*shape):
            return rng.normal(0, 0.15, shape).astype(np.float32)

        return Network(small(WIDTH, 256, FILTERS), small(WIDTH, N_LAGS, FILTERS), np.zeros(FILTERS, np.float32),
                       small(FILTERS), small(FILTERS), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.byte, self.lag, self.bias, self.mean, self.peak, self.level]

    def tables(self) -> np.ndarray:
        """Responses per offset for every pair of byte and lag step, and one for padding that no window survives."""
        both = (self.byte[:, :, None, :] + self.lag[:, None, :, :]).reshape(WIDTH, PAD, FILTERS)
        return np.concatenate([both, np.full((WIDTH, 1, FILTERS), -1000, np.float32)], axis=1)

    def pooled(self, codes: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strongest response of each filter in each chunk, and where."""
        n = CHUNK - WIDTH + 1
        total = np.take(tables[0], codes[:, :n], axis=0)
        buffer = np.empty_like(total)
        for j in range(1, WIDTH):
            np.take(tables[j], codes[:, j:j + n], axis=0, out=buffer, mode="clip")
            total += buffer
        where = total.argmax(axis=1)
        return np.take_along_axis(total, where[:, None, :], axis=1)[:, 0, :] + self.bias, where

    def score(self, text: str | None, tables: np.ndarray) -> float:
        """The probability that a text is good; that of no chunk at all for NULL and empty texts."""
        data = (text or "").encode("utf-8", "surrogatepass")
        total, peak, n = np.zeros(FILTERS), np.zeros(FILTERS), 0
        for codes in chunks(data):
            found = np.maximum(self.fast(codes, tables), 0)
            total += found.sum(axis=0)
            peak = np.maximum(peak, found.max(axis=0))
            n += len(found)
        x = float(total / max(1, n) @ self.mean + peak @ self.peak + self.level[0])
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))

    def fast(self, codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """As ``pooled`` without the places, a few chunks at a time so that responses stay in the cache."""
        n = CHUNK - WIDTH + 1
        out = np.empty((len(codes), FILTERS), np.float32)
        total, buffer = np.empty((2, n, FILTERS), np.float32)
        for i, row in enumerate(codes):
            used = min(n, max(1, int(np.searchsorted(row == PAD, True)) - WIDTH + 1)) if row[-1] == PAD else n
            np.take(tables[0], row[:used], axis=0, out=total[:used], mode="clip")
            for j in range(1, WIDTH):
                np.take(tables[j], row[j:j + used], axis=0, out=buffer[:used], mode="clip")
                total[:used] += buffer[:used]
            out[i] = total[:used].max(axis=0)
        return out + self.bias

    def to_json(self) -> str:
        return json.dumps([[base64.b64encode(p.astype("<f4").tobytes()).decode(), p.shape] for p in self.parameters()])

    @staticmethod
    def from_json(text: str) -> "Network":
        return Network(*(np.frombuffer(base64.b64decode(b), "<f4").reshape(s).copy() for b, s in json.loads(text)))


def fit(documents: list[tuple[np.ndarray, int]], *, rounds: int = 12, batch: int = 32, rate: float = 0.02, seed: int = 5) -> Network:
    """Fit to documents (their chunks' codes, and 1 if good), both classes weighing the same.

    Adam steps on the logistic loss; through the pooling, a gradient reaches the six
    positions of the strongest response only.
    """
    net, rng = Network.new(seed), np.random.default_rng(seed)
    params = net.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    good = sum(y for _, y in documents)
    if not documents or good in (0, len(documents)):
        net.mean[:], net.peak[:], net.level[:] = 0, 0, 3 if good else -3 if documents else 0
        return net
    weight = {1: len(documents) / (2 * good), 0: len(documents) / (2 * (len(documents) - good))}
    step = 0
    for turn in range(rounds):
        for at in range(0, len(documents), batch):
            if at == 0:
                order = rng.permutation(len(documents))
            some = [documents[i] for i in order[at:at + batch]]
            codes = np.concatenate([c for c, _ in some])
            of = np.repeat(np.arange(len(some)), [len(c) for c, _ in some])
            sizes = np.bincount(of, minlength=len(some))[:, None]
            response, where = net.pooled(codes, net.tables())
            h = np.maximum(response, 0)
            edges = np.append(0, np.cumsum(sizes[:, 0]))[:-1]
            mean, peak = np.add.reduceat(h, edges) / sizes, np.maximum.reduceat(h, edges)
            x = np.clip(mean @ net.mean + peak @ net.peak + net.level[0], -30, 30)
            y = np.array([y for _, y in some])
            g = (1 / (1 + np.exp(-x)) - y) * np.array([weight[v] for v in y]) / len(some)
            dh = (g[:, None] * net.mean / sizes)[of]
            top = h == peak[of]
            dh = dh + top * (g[:, None] * net.peak)[of] / np.maximum(1, np.add.reduceat(top, edges))[of]
            dh = (dh * (response > 0)).astype(np.float32)
            grads = [np.zeros_like(p) for p in params]
            chunk, filt = np.nonzero(dh)
            place, value = where[chunk, filt], dh[chunk, filt]
            for j in range(WIDTH):
                code = codes[chunk, place + j]
                real = code != PAD
                np.add.at(grads[0][j], (code[real] // N_LAGS, filt[real]), value[real])
                np.add.at(grads[1][j], (code[real] % N_LAGS, filt[real]), value[real])
            grads[2] += dh.sum(axis=0)
            grads[3] += g @ mean
            grads[4] += g @ peak
            grads[5] += g.sum()
            step += 1
            for p, d, m, v in zip(params, grads, first, second, strict=True):
                d += 1e-4 * p
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                pace = rate * (1 - turn / rounds) + 1e-3
                p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def learn_network(labelled: DataFrame, *, text: str = "text", label: str = "label", most_chunks: int = 40_000, rounds: int = 12) -> Network:
    """Fit on the driver to a bounded table of labelled texts (see ``labels.labelled_sample``), each with all its chunks.

    ``most_chunks`` bounds what the driver holds: texts are taken whole, in the order of
    their hashes, as long as their chunks fit; one that does not is left out of the sample.
    NULL labels are left out, empty texts teach nothing.
    """
    rows = labelled.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(
        F.col(text).alias("text"), F.col(label).alias("label"), F.xxhash64(text, label).alias("hash"))
    sizes = rows.groupBy("hash").agg(F.sum(F.ceil(F.octet_length("text") / STRIDE)).alias("n"))  # a number per sampled row
    chosen, held = set(), 0
    for r in sorted(sizes.collect()):
        if held + r.n <= most_chunks:
            chosen.add(r.hash)
            held += r.n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(np.concatenate(list(chunks(t.encode("utf-8", "surrogatepass")))).astype("<i2").tobytes(), int(y > 0))
                   for t, y, h in zip(*(c.to_pylist() for c in batch.columns), strict=True) if h in chosen]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in own], pa.binary()), pa.array([y for _, y in own], pa.int32())], names=["codes", "label"])

    sent = rows.mapInArrow(cut, "codes binary, label int").orderBy(F.xxhash64("codes"), "codes").collect()  # bounded by most_chunks
    return fit([(np.frombuffer(r["codes"], "<i2").astype(np.int32).reshape(-1, CHUNK), r["label"]) for r in sent], rounds=rounds)


def score_quality(docs: DataFrame, network: Network, *, text: str = "text", into: str = "score") -> DataFrame:
    """Adds ``into``, 0 to 1, for every whole text, in one pass without a shuffle.

    NULL and empty texts get the score of a text without chunks.  The network (0.1 MB)
    goes with the task.  A column of the name ``into`` (in any case) is replaced, others pass through.
    """
    slim = beside(docs, text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables()
        for batch in batches:
            scores = [network.score(t, tables) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    out = slim.mapInArrow(score, StructType([slim.schema["row"], StructField("score", DoubleType())]))
    return unpacked(out, docs, {into: F.col("score")})
