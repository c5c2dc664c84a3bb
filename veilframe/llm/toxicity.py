"""Toxicity by a weighted lexicon, learned from labelled texts.

Texts are folded (case, look-alike letters, digits for letters), the lexicon's
terms are found in one pass by an Aho-Corasick automaton, terms inside exception
phrases do not count, and the summed weights are set against the length of the
text.  Terms are whole words, or beginnings of words where a stem takes many
endings.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.scratch import written
from .words import beside, unpacked

# Look-alikes (Cyrillic and Greek letters, then digits) and the letters they stand for: fixed values.
LOOK_ALIKES = str.maketrans(
    "авеікмнорстухѕјԁɡαβεικνορτυχ013457",
    "abeikmhopctyxsjdgabeiknoptuxoieast")
# Signs stand for letters only before a letter; elsewhere they are punctuation.
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
SIGN = re.compile(r"[@$!|](?=[^\W\d_])")
NO_LETTERS = re.compile(r"[\W\d_]+")
STEM_LENGTHS = (4, 5, 6)


def folded(text: str | None) -> str:
    """Lower case, look-alikes as the letters they stand for, letters only, one blank around every word."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = SIGN.sub(lambda m: SIGNS[m[0]], text.lower()).translate(LOOK_ALIKES)
    return " " + NO_LETTERS.sub(" ", text).strip() + " "


@dataclass(frozen=True)
class Lexicon:
    """Weights of terms (`` word `` whole, `` stem`` as a beginning), phrases that do not count, and the scale of a score."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = ()
    scale: float = 1.0
    middle: float = 0.0

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "Lexicon":
        raw = json.loads(text)
        return Lexicon(raw["terms"], tuple(raw["exceptions"]), raw["scale"], raw["middle"])


class Matcher:
    """Finds a lexicon in texts; built once per task."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.terms.items():
            self.automaton.add_word(term, (len(term), weight, False))
        for phrase in lexicon.exceptions:
            phrase = f" {phrase.strip()} "
            self.automaton.add_word(phrase, (len(phrase), 0.0, True))
        if len(self.automaton):
            self.automaton.make_automaton()

    def measure(self, text: str | None) -> tuple[float, int]:
        """The summed weights of all hits outside exceptions, each word counted once by its heaviest term, and the words."""
        plain = folded(text)
        n = max(1, plain.count(" ") - 1)
        if not len(self.automaton):
            return 0.0, n
        heaviest: dict[int, float] = {}
        safe: list[tuple[int, int]] = []
        for end, (size, weight, excepted) in self.automaton.iter(plain):
            start = end - size + 1
            if excepted:
                safe.append((start, end))
            else:
                heaviest[start] = max(weight, heaviest.get(start, 0.0))
        if not safe:
            return sum(heaviest.values()), n
        total, i = 0.0, 0
        safe.sort()
        reach = -1
        for start in sorted(heaviest):
            while i < len(safe) and safe[i][0] <= start:
                reach = max(reach, safe[i][1])
                i += 1
            if reach <= start:  # not inside any phrase that began before
                total += heaviest[start]
        return total, n

    def density(self, text: str | None) -> float:
        """Weight per square root of the length: a long text needs more hits, not in proportion."""
        total, n = self.measure(text)
        return total / math.sqrt(n)

    def score(self, text: str | None) -> float:
        x = self.lexicon.scale * (self.density(text) - self.lexicon.middle)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _grams(plain: str) -> set[str]:
    """Whole words and beginnings of words of a folded text."""
    words = set(plain.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEM_LENGTHS if len(w) > n}


def learn_lexicon(labelled: DataFrame, *, text: str = "text", label: str = "label", rounds: int = 3, max_terms: int = 2_000,
                  least_ratio: float = 8.0, evidence: float = 8.5, least_share: float = 0.02, unexplained: float = 0.1,
                  exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn terms, weights, exceptions and the scale from labelled rows (see ``labels.labelled_sample``).

    A term's weight is the logarithm of how much likelier it is in toxic texts, which
    has to be ``least_ratio`` times.  Weight times the toxic texts that have it is its
    evidence; that has to exceed the logarithm of the number of terms looked at by
    ``evidence``, so that no term gets in by the many chances, and ``least_share`` of the
    round's best, as copies of texts repeat chance finds.  Of a word and its beginnings the
    one with the most evidence stays.  Each further round learns from toxic texts that no
    term so far is in, while they are more than a share of ``unexplained``.  Two-word phrases around a term that only clean texts have become
    exceptions beside the given ones.  NULL labels are left out, NULL texts are
    empty.  Without toxic rows the lexicon is empty and scores every text below one half.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(
        F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(label) > 0).cast("int").alias("label"))
    terms: dict[str, float] = {}
    everything = 0
    for _ in range(rounds):
        counts = written(_gram_counts(rows, Lexicon(terms)), "grams")
        total = {r["gram"]: r for r in counts.where("gram = ''").collect()}.get("")
        everything = everything or total and total["toxic"]
        if not total or not total["toxic"] or total["toxic"] < unexplained * everything:
            break
        looked_at = counts.count()
        weight = F.log((F.col("toxic") / total["toxic"]) / ((F.col("clean") + 0.5) / (total["clean"] + 1)))
        proof = weight * F.col("toxic")
        best = (counts.where("gram <> ''").select("gram", weight.alias("weight"), proof.alias("proof"))
                .where((F.col("weight") >= math.log(least_ratio)) & (F.col("proof") >= math.log(looked_at) + evidence))
                .orderBy(F.desc("proof"), F.length("gram"), "gram").limit(max_terms).collect())  # at most max_terms rows
        new = 0
        for row in best:
            gram = row["gram"]
            if row["proof"] >= least_share * best[0]["proof"] and not any(gram.startswith(t) or t.startswith(gram.rstrip()) for t in terms):
                terms[gram] = round(row["weight"], 4)
                new += 1
        if not new:
            break
    lexicon = Lexicon(terms, tuple(exceptions))
    if not terms:
        return Lexicon({}, tuple(exceptions), 1.0, 1.0)
    return _scaled(rows, Lexicon(terms, (*exceptions, *_learned_exceptions(rows, lexicon))))


def _gram_counts(rows: DataFrame, known: Lexicon) -> DataFrame:
    """Toxic texts without a known term, and clean texts, that have each gram of such a toxic text; the gram '' counts all."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, seen = Matcher(known), {0: Counter(), 1: Counter()}

        def out() -> pa.RecordBatch:
            grams = list(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_arrays([
                pa.array(grams, pa.string()), pa.array([seen[1][g] for g in grams], pa.int64()),
                pa.array([seen[0][g] for g in grams], pa.int64())], names=["gram", "toxic", "clean"])

        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if y and matcher.measure(t)[0] > 0:
                    continue
                grams = _grams(folded(t))
                grams.add("")
                seen[y].update(grams)
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield out()
                seen = {0: Counter(), 1: Counter()}
        yield out()

    return rows.mapInArrow(count, "gram string, toxic bigint, clean bigint").groupBy("gram").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic > 0 OR gram = ''")


def _learned_exceptions(rows: DataFrame, lexicon: Lexicon, least: int = 3, most: int = 500) -> list[str]:
    """Two-word phrases with a term that ``least`` clean texts and no toxic one have."""
    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            found, labels = [], []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plain = folded(t)
                own = set()
                for end, (size, _, _) in (matcher.automaton.iter(plain) if lexicon.terms else ()):
                    start = end - size + 1
                    stop = plain.find(" ", start + 1)
                    before, after = plain.rfind(" ", 0, start), plain.find(" ", stop + 1)
                    if before >= 0:
                        own.add(plain[before + 1:stop])
                    if after >= 0:
                        own.add(plain[start + 1:after])
                found += own
                labels += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(labels, pa.int32())], names=["phrase", "label"])

    found = rows.mapInArrow(phrases, "phrase string, label int").groupBy("phrase").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    best = found.where((F.col("toxic") == 0) & (F.col("clean") >= least)).orderBy(F.desc("clean"), "phrase").limit(most)
    return [r["phrase"] for r in best.collect()]


def _scaled(rows: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Sets the middle where most labelled texts fall on their side: over 200 steps of the density, of which only counts come back.

    Of the borders that do equally well it is the one a quarter up, as fewer hits than the
    labelled texts have are still hits.
    """
    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            at = [min(200, math.ceil(matcher.density(t) * 20)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(1)], names=["at", "label"])

    steps = rows.mapInArrow(densities, "at int, label int").groupBy("at").agg(
        F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).collect()  # at most 201 rows
    toxic = Counter({r["at"]: r["toxic"] for r in steps})
    clean = Counter({r["at"]: r["n"] - r["toxic"] for r in steps})
    # Errors with the border just under each step, each class weighing the same; the best run of borders.
    n_toxic, n_clean = max(1, toxic.total()), max(1, clean.total())
    errors = [sum(v for k, v in toxic.items() if k < b) / n_toxic + sum(v for k, v in clean.items() if k >= b) / n_clean
              for b in range(1, 201)]
    first = errors.index(min(errors))
    last = first
    while last + 1 < len(errors) and errors[last + 1] == errors[first]:
        last += 1
    middle = (first + 0.5 + (last - first) / 4) / 20
    return Lexicon(lexicon.terms, lexicon.exceptions, 4.0 / max(0.05, middle), middle)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", into: str = "score") -> DataFrame:
    """Adds ``into``, 0 to 1, for every whole text; NULL and empty texts score as texts without a hit.

    One pass without a shuffle.  The lexicon (at most a few thousand terms) goes
    with the task.  A column of the name ``into`` (in any case) is replaced, others pass through.
    """
    slim = beside(docs, text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            scores = [matcher.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    out = slim.mapInArrow(score, StructType([slim.schema["row"], StructField("score", DoubleType())]))
    return unpacked(out, docs, {into: F.col("score")})
