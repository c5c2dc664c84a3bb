"""Output of external detectors, and pluggable detectors for the policy fold."""

from __future__ import annotations

import signal
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import extract_spans, is_blank, redact_values, summary_of_detector
from ..policy import ALLOW, REDACT, SUMMARIZE, Policy

# Detector ids and the JSON each of them writes.
PRIVACY_FILTER, GITLEAKS = "privacy-filter", "gitleaks"
PRIVACY_SCHEMA = ("redacted_text string, summary string, warning string, "
                  "detected_spans array<struct<start:int,end:int>>, _corrupt_record string")
LEAKS_SCHEMA = "array<struct<Secret:string>>"

RESULT_TYPE = "struct<redacted_text:string,matched_values:array<string>,summary:string,status:string>"

#: ``stale``: the output belongs to another text than the one it is applied to.
OK, NOTHING, MISSING, UNPARSABLE, STALE, TIMEOUT = "ok", "nothing", "missing", "unparsable", "stale", "timeout"


def _result(redacted: Column, values: Column, summary: Column, status: Column) -> Column:
    return F.struct(redacted.alias("redacted_text"), values.alias("matched_values"),
                    summary.alias("summary"), status.alias("status")).cast(RESULT_TYPE)


def privacy_result(json: Column, text: Column, seen: Column | None = None) -> Column:
    """Result of the privacy filter's JSON for ``text``.

    ``seen`` is the text it was run on, ``text`` itself if not given.  Where they
    differ, neither its redacted text nor its offsets fit: values are taken from the
    text that it saw, to be redacted by value, and the status is ``stale``.
    """
    seen = text if seen is None else seen
    stale = ~seen.eqNullSafe(text)
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    parsed = F.from_json(F.trim(json), PRIVACY_SCHEMA)
    broken = parsed.isNull() | parsed["_corrupt_record"].isNotNull()
    values = extract_spans(seen, parsed["detected_spans"])
    signal = parsed["redacted_text"].isNotNull() | (F.size(values) > 0)
    summary = F.coalesce(parsed["summary"], parsed["warning"],
                         F.lit("Detected sensitive text via privacy-filter"))
    return (F.when(json.isNull(), _result(none, empty, none, F.lit(MISSING)))
            .when(broken, _result(none, empty, none, F.lit(UNPARSABLE)))
            .when(signal & stale, _result(none, values, summary, F.lit(STALE)))
            .when(signal, _result(parsed["redacted_text"], values, summary, F.lit(OK)))
            .otherwise(_result(none, empty, none, F.lit(NOTHING))))


def leaks_result(json: Column, text: Column, seen: Column | None = None) -> Column:
    """Result of the leak scanner's JSON list; masked values name no text.

    Its values are redacted by value, also in another text than the one ``seen``;
    the status is ``stale`` then.
    """
    stale = ~(text if seen is None else seen).eqNullSafe(text)
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    body = F.trim(json)
    parsed = F.from_json(body, LEAKS_SCHEMA)
    secrets = F.filter(F.transform(parsed, lambda s: s["Secret"]),
                       lambda v: v.isNotNull() & ~is_blank(v) & (v != "REDACTED"))
    summary = F.concat(F.lit("Detected "), F.size(parsed).cast("string"),
                       F.lit(" secret-like value(s) via gitleaks"))
    return (F.when(json.isNull(), _result(none, empty, none, F.lit(MISSING)))
            .when((body == "") | (body == "[]"), _result(none, empty, none, F.lit(NOTHING)))
            .when(parsed.isNull(), _result(none, empty, none, F.lit(UNPARSABLE)))
            .when(F.size(parsed) == 0, _result(none, empty, none, F.lit(NOTHING)))
            .otherwise(_result(none, secrets, summary, F.when(stale, STALE).otherwise(OK))))


def read_detector_output(df: DataFrame, json_col: str, kind: str, text_col: str = "text") -> DataFrame:
    """Adds redacted_text, matched_values, summary and detector_status."""
    reader = {PRIVACY_FILTER: privacy_result, GITLEAKS: leaks_result}[kind]
    return df.withColumn("_result", reader(F.col(json_col), F.col(text_col))).select(
        *df.columns, "_result.redacted_text", "_result.matched_values", "_result.summary",
        F.col("_result.status").alias("detector_status"))


@dataclass(frozen=True)
class Detector:
    """A detector for the policy fold: ``result`` maps the text to RESULT_TYPE.

    ``version`` is for the manifest: a detector or output that has changed needs
    another one, or earlier decisions are replayed.
    """

    id: str
    action: str
    result: Callable[[Column], Column]
    toggle: str | None = None
    version: str = "1"

    def enabled(self, policy: Policy) -> bool:
        return self.toggle is None or getattr(policy.detectors, self.toggle).enabled


def gitleaks_detector(policy: Policy, json_col: str, seen_col: str = "text", version: str = "1") -> Detector:
    """The leak scanner's output in ``json_col``, of a run on the text in ``seen_col``."""
    return Detector(GITLEAKS, policy.detectors.gitleaks.action,
                    lambda text: leaks_result(F.col(json_col), text, F.col(seen_col)), "gitleaks", version)


def privacy_filter_detector(policy: Policy, json_col: str, seen_col: str = "text", version: str = "1") -> Detector:
    """The privacy filter's output in ``json_col``, of a run on the text in ``seen_col`` (see ``rules.text_for_detectors``)."""
    return Detector(PRIVACY_FILTER, policy.detectors.privacy_filter.action,
                    lambda text: privacy_result(F.col(json_col), text, F.col(seen_col)), "privacy_filter", version)


def in_stage_order(detectors: Sequence[Detector]) -> list[Detector]:
    """The leak scanner, the privacy filter, then plugged detectors as given."""
    known = {GITLEAKS: 0, PRIVACY_FILTER: 1}
    return sorted(detectors, key=lambda d: known.get(d.id, len(known)))


class _TooLong(Exception):
    """A detector did not answer in time."""


def _in_time(fn: Callable[[pd.Series], pd.DataFrame], texts: pd.Series, seconds: float) -> tuple[pd.DataFrame, pd.Series]:
    """The answers of ``fn``, and which texts it did not finish in time; these have rows of nulls.

    A batch that takes longer than the limit is halved until single texts are left, so
    one text that hangs costs the limit a few times and the others keep their answers.
    """
    def stop(signal_number, frame):
        raise _TooLong

    before = signal.signal(signal.SIGALRM, stop)
    try:
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            got = fn(texts)
            signal.setitimer(signal.ITIMER_REAL, 0)
            got.index = texts.index
            return got, pd.Series(False, index=texts.index)
        except _TooLong:
            pass
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
    finally:
        signal.signal(signal.SIGALRM, before)
    if len(texts) == 1:
        return pd.DataFrame({c: [None] for c in ("redacted_text", "matched_values", "summary")}, index=texts.index), pd.Series(True, index=texts.index)
    middle = len(texts) // 2
    halves = [_in_time(fn, part, seconds) for part in (texts.iloc[:middle], texts.iloc[middle:])]
    return pd.concat([h[0].astype(object) for h in halves]), pd.concat([h[1] for h in halves])


def register_detector(detector_id: str, fn: Callable[[pd.Series], pd.DataFrame], action: str = REDACT,
                      toggle: str | None = None, version: str = "1", seconds: float | None = 5.0) -> Detector:
    """Plug in a Python detector, run on Arrow batches of texts.

    ``fn`` gets a Series without nulls and returns a DataFrame of the same
    length with the columns redacted_text, matched_values (list or None) and
    summary; a row of nulls means that nothing was found.  A text that it works on for
    longer than ``seconds`` (None: no limit) has the status ``timeout``, and the batch goes on.
    """
    def batch(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"redacted_text": None, "matched_values": None, "summary": None, "status": MISSING},
                           index=texts.index, dtype=object)
        known = texts[texts.notna()]
        if len(known):
            got, late = (fn(known), None) if seconds is None else _in_time(fn, known, seconds)
            got.index = known.index
            for name in ("redacted_text", "matched_values", "summary"):
                out.loc[known.index, name] = got[name]
            found = got["redacted_text"].notna() | got["matched_values"].map(
                lambda v: v is not None and not (isinstance(v, float)) and len(v) > 0)
            out.loc[known.index, "status"] = found.map({True: OK, False: NOTHING})
            if late is not None:
                out.loc[known.index[late], "status"] = TIMEOUT
        out["matched_values"] = out["matched_values"].map(lambda v: [] if v is None or isinstance(v, float) else list(v))
        return out

    udf = F.pandas_udf(batch, RESULT_TYPE)
    return Detector(detector_id, action, lambda text: udf(text), toggle, version)


def apply_detector(df: DataFrame, detector: Detector, replacement: str = "<redacted>", *,
                   text: str = "text", target: str = "CAST(NULL AS STRING)") -> DataFrame:
    """One detector stage on its own: adds sanitized_text, detector_finding, detector_status.

    ``target`` is SQL.  ``detector_finding`` is NULL where nothing was found or
    changed.  A missing or unreadable detector output shows in
    ``detector_status``; it never looks like a clean text.
    """
    from .rules import FINDING_TYPE, TEXT_SANITIZER_BACKEND, detector_message, finding

    result, source = F.col("_result"), F.col(text)
    present = F.coalesce(source.isNotNull() & (result["redacted_text"].isNotNull()
                                               | (F.size(result["matched_values"]) > 0)), F.lit(False))
    changed = {REDACT: F.coalesce(result["redacted_text"], redact_values(source, result["matched_values"], replacement)),
               SUMMARIZE: summary_of_detector(detector.id)}.get(detector.action, source)
    staged = df.withColumn("_result", detector.result(source)).withColumn("_found", present).withColumn(
        "sanitized_text", F.when(F.col("_found"), changed).otherwise(source))
    reported = F.col("_found") & F.lit(detector.action != ALLOW)
    if detector.action == REDACT:
        reported = reported & (F.col("sanitized_text") != source)
    entry = finding(target, detector.action, TEXT_SANITIZER_BACKEND, detector_message("_result", detector), detector.id)
    return staged.withColumn("detector_finding", F.when(reported, F.expr(entry)).cast(FINDING_TYPE)) \
        .withColumn("detector_status", result["status"]).drop("_result", "_found")


# Detector functions run in Python workers that may not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
