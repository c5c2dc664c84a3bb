"""Policy evaluation as an ordered fold of projections over a table of texts.

Every rule adds a hit flag and, if it changes texts, one new text column; the
findings array is put together from the flags at the end.  There is no shuffle,
except for Kotlin files under symbol rules (see ``operators.symbols``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import secrets as S
from ..functions.match import path_condition, rule_matches
from ..functions.text import (redact_content, redact_values, replace_ranges, sql_string, summary_of_detector,
                              summary_of_rule)
from ..policy import ALLOW, BLOCK, CONFIRM, REDACT, SUMMARIZE, Policy, Rule
from .symbols import symbol_ranges

FINDING_TYPE = "struct<target:string,action:string,source:string,message:string,rule_id:string>"
FINDINGS_TYPE = f"array<{FINDING_TYPE}>"
#: Status of each detector that ran, by its id.
STATUS_TYPE = "map<string,string>"

POLICY_RULE = "POLICY_RULE"
SECRET_DETECTOR = "SECRET_DETECTOR"
TEXT_SANITIZER_BACKEND = "TEXT_SANITIZER_BACKEND"

COPY_ORIGINAL = "COPY_ORIGINAL"
WRITE_SANITIZED_TEXT = "WRITE_SANITIZED_TEXT"
BLOCKED = "BLOCKED"

_P = "_vf_"


def finding(target: str, action: str, source: str, message: str, rule_id: str | None) -> str:
    """SQL of a finding; target and message are SQL expressions.

    A policy has many findings with five fields each: SQL text is parsed by
    Spark in one step, where Column calls would cost ten round trips.
    """
    rule = "CAST(NULL AS STRING)" if rule_id is None else sql_string(rule_id)
    return (f"named_struct('target', {target}, 'action', {sql_string(action)}, 'source', {sql_string(source)}, "
            f"'message', {message}, 'rule_id', {rule})")


def rule_message(rule: Rule) -> str:
    verb = {REDACT: "Redacted content using", SUMMARIZE: "Summarized content using"}.get(rule.action, "Matched")
    return sql_string(f"{verb} rule {rule.id}")


def _findings(items: Sequence[tuple[str, str]]) -> Column:
    """Array of the findings whose condition (a column name) holds, in order."""
    if not items:
        return F.array().cast(FINDINGS_TYPE)
    cases = ", ".join(f"CASE WHEN `{hit}` THEN {entry} END" for hit, entry in items)
    return F.expr(f"CAST(array_compact(array({cases})) AS {FINDINGS_TYPE})")


def path_findings(path: Column, target: str, policy: Policy) -> Column:
    """BLOCK and CONFIRM findings of the rules that look at paths only; target is SQL."""
    items = [F.when(path_condition(rule.match, path),
                    F.expr(finding(target, rule.action, POLICY_RULE, rule_message(rule), rule.id)))
             for rule in policy.rules if rule.match.path_only and rule.action in (BLOCK, CONFIRM)]
    return (F.array_compact(F.array(*items)) if items else F.array()).cast(FINDINGS_TYPE)


def has_action(findings: Column, action: str) -> Column:
    return F.exists(findings, lambda f: f["action"] == action)


class _TextPass:
    """The fold over one frame: rules, then secrets, then plugged detectors.

    Flags are collected until a text changes, so a policy costs one projection
    per text version, and rules that change nothing cost none of their own.
    """

    def __init__(self, df: DataFrame, policy: Policy, path: Column | None, target: str, first_text: Column):
        self.df = df.withColumn(_P + "text0", first_text)
        self.policy, self.path, self.target = policy, path, target
        self.text, self.pending, self.items, self.version = F.col(_P + "text0"), {}, [], 0
        self.statuses: list[Column] = []

    def _name(self, kind: str) -> str:
        self.version += 1
        return f"{_P}{kind}{self.version}"

    def _flush(self):
        if self.pending:
            self.df = self.df.withColumns(self.pending)
            self.pending = {}

    def flag(self, condition: Column) -> str:
        """Remember a condition on the current text; evaluated with the next flush."""
        name = self._name("hit")
        self.pending[name] = F.coalesce(condition, F.lit(False))
        return name

    def extend(self, kind: str, value: Column) -> str:
        """Add a column that later conditions of this pass refer to."""
        self._flush()
        name = self._name(kind)
        self.df = self.df.withColumn(name, value)
        return name

    def replace(self, hit: str, changed: Column) -> Column:
        """Move to the next text version; returns the previous text."""
        before = self.text
        self.text = F.col(self.extend("text", F.when(F.col(hit), changed).otherwise(before)))
        return before

    def report(self, hit: str, action: str, source: str, message: str, rule_id: str | None):
        self.items.append((hit, finding(self.target, action, source, message, rule_id)))

    def rule(self, rule: Rule, ranges: Column | None):
        found = None if ranges is None else F.size(ranges) > 0
        hit = self.flag(self.text.isNotNull() & rule_matches(rule.match, self.path, self.text, found))
        if rule.action == SUMMARIZE:
            self.replace(hit, summary_of_rule(rule.id))
        elif rule.action == REDACT:
            replacement = self.policy.replacement_of(rule)
            if ranges is not None:
                changed = replace_ranges(self.text, described_ranges(ranges, replacement))
            elif rule.match.content_regex:
                changed = redact_content(self.text, rule.match.content_regex, replacement)
            else:
                changed = F.lit(replacement)
            before = self.replace(hit, changed)
            hit = self.flag(F.col(hit) & (self.text != before))
        self.report(hit, rule.action, POLICY_RULE, rule_message(rule), rule.id)

    def rules(self):
        for rule in self.policy.rules:
            if rule.action == ALLOW:
                continue  # neither a finding nor a change
            ranges = None
            if rule.match.kotlin is not None:
                if self.path is None:
                    continue  # never matches outside Kotlin files
                ranges = F.col(self.extend("ranges", symbol_ranges(self.path, self.text, rule.match.kotlin)))
            self.rule(rule, ranges)

    def secrets(self):
        toggle = self.policy.detectors.secrets
        if not toggle.enabled or toggle.action == ALLOW:
            return
        count = self.extend("secrets", S.count_secrets(self.text))
        hit = self.flag(F.col(count) > 0)
        if toggle.action in (REDACT, SUMMARIZE):
            self.replace(hit, S.redact_secrets(self.text, F.col(count), toggle.action, self.policy.redact_replacement))
        self.report(hit, toggle.action, SECRET_DETECTOR, S.secret_message(f"`{count}`", toggle.action), None)

    def detector(self, detector):
        """A plugged detector; its result refers to the text as it is now."""
        if detector.action == ALLOW:
            return
        name = self.extend("detected", detector.result(self.text))
        result = F.col(name)
        self.statuses += [F.lit(detector.id), result["status"]]
        hit = self.flag(self.text.isNotNull() & (
            result["redacted_text"].isNotNull() | (F.size(result["matched_values"]) > 0)))
        if detector.action == REDACT:
            before = self.replace(hit, F.coalesce(result["redacted_text"], redact_values(
                self.text, result["matched_values"], self.policy.redact_replacement)))
            hit = self.flag(F.col(hit) & (self.text != before))
        elif detector.action == SUMMARIZE:
            self.replace(hit, summary_of_detector(detector.id))
        self.report(hit, detector.action, TEXT_SANITIZER_BACKEND, detector_message(name, detector), detector.id)

    def finish(self) -> tuple[DataFrame, Column, Column, Column]:
        self._flush()
        status = F.create_map(*self.statuses) if self.statuses else F.create_map()
        return self.df, self.text, _findings(self.items), status.cast(STATUS_TYPE)


def described_ranges(ranges: Column, replacement: str) -> Column:
    """Symbol ranges with their replacement, which names what was there."""
    return F.transform(ranges, lambda r: F.struct(
        r["start"].alias("start"), r["end"].alias("end"),
        F.concat(F.lit(replacement + " // "), r["description"]).alias("replacement")))


def detector_message(result: str, detector) -> str:
    """SQL of a detector finding's message: its summary, else a default per action."""
    verb = {REDACT: "Redacted sensitive text via", SUMMARIZE: "Summarized content via"}.get(
        detector.action, "Detected sensitive text via")
    return f"coalesce(`{result}`.summary, {sql_string(f'{verb} {detector.id}')})"


def _settled(df: DataFrame, keep: Sequence[str], **results: Column) -> DataFrame:
    """The kept columns and the results of a fold, closed against filter pushdown.

    A filter on a result would be pushed through every projection of the fold,
    and each would copy its expression several times: exponential in the number
    of rules.  A one-element ``inline`` stops that and still lets filters on the
    kept columns through to the scan.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in results.items())))))


def evaluate_texts(df: DataFrame, policy: Policy, *, path: Column | None, text: Column, target: str,
                   detectors: Sequence = ()):
    """Run the text pass; gives (frame, final text, findings, detector status). NULL texts are skipped."""
    from .detectors import in_stage_order

    run = _TextPass(df, policy, path, target, text)
    run.rules()
    run.secrets()
    for detector in in_stage_order(detectors):
        if detector.enabled(policy):
            run.detector(detector)
    return run.finish()


def apply_policy(files: DataFrame, policy: Policy, *, path: str = "path", text: str = "text",
                 detectors: Sequence = (), target: Column | None = None) -> DataFrame:
    """Evaluate a policy over a table of files.

    ``path`` is relative to the root, ``text`` is NULL for binary files.  Adds ``disposition``, ``sanitized_text`` (only
    where it differs from the original), ``findings`` and ``detector_status`` (by
    detector id, so output that is missing, unreadable or of another text never looks
    like a clean text).
    """
    target = F.col(path) if target is None else target
    # The dispositions of path rules come first: a blocked path ends the
    # evaluation, its text is not looked at.
    staged = files.withColumn(_P + "target", target).withColumn(
        _P + "path_findings", path_findings(F.col(path), _P + "target", policy))
    blocked = has_action(F.col(_P + "path_findings"), BLOCK)

    df, final, found, status = evaluate_texts(
        staged, policy, path=F.col(path), text=F.when(~blocked, F.col(text)), target=_P + "target", detectors=detectors)
    df = df.withColumn("findings", F.concat(F.col(_P + "path_findings"), found))
    df = df.withColumn("disposition", F.when(has_action(F.col("findings"), BLOCK), BLOCKED)
                       .when(final != F.col(text), WRITE_SANITIZED_TEXT).otherwise(COPY_ORIGINAL))
    return _settled(df, files.columns, disposition=F.col("disposition"), sanitized_text=F.when(
        F.col("disposition") == WRITE_SANITIZED_TEXT, final), findings=F.col("findings"), detector_status=status)


def evaluate_prompts(prompts: DataFrame, policy: Policy, *, text: str = "text",
                     label: str = "source_label", detectors: Sequence = ()) -> DataFrame:
    """Evaluate prompts: no path, so rules with path or symbol criteria never match.

    Adds ``sanitized_text`` (always set), ``was_redacted``, ``findings`` and ``detector_status``.
    """
    target = F.concat(F.lit("prompt:"), F.col(label))
    df, final, found, status = evaluate_texts(prompts.withColumn(_P + "target", target), policy, path=None, text=F.col(text),
                                      target=_P + "target", detectors=detectors)
    return _settled(df, prompts.columns, sanitized_text=final, was_redacted=final != F.col(text), findings=found,
                    detector_status=status)


def text_for_detectors(files: DataFrame, policy: Policy, *, path: str = "path", text: str = "text",
                       into: str = "detector_text") -> DataFrame:
    """Adds the text that the detector stage sees: after all rules and secrets, NULL for blocked and binary files.

    Outside detectors have to be run on this text; name the column in ``seen_col`` of
    their readers.
    """
    done = apply_policy(files, policy, path=path, text=text)
    return done.select(*files.columns, F.when(F.col("disposition") != BLOCKED, F.coalesce("sanitized_text", text)).alias(into))


def all_findings(prompts: DataFrame, files: DataFrame, *, request: str = "request_id") -> DataFrame:
    """Findings of prompts and files as rows, order and duplicates kept.

    ``part_ord`` is 0 for the prompt and 1 for files; within a target,
    ``finding_ord`` counts from 0.
    """
    def rows(df: DataFrame, part: int) -> DataFrame:
        return df.select(F.col(request), F.lit(part).alias("part_ord"), F.posexplode("findings")) \
            .select(request, "part_ord", F.col("pos").alias("finding_ord"), "col.*")

    return rows(prompts, 0).unionByName(rows(files, 1))


def explode_findings(items: DataFrame, *carry: str) -> DataFrame:
    """One row per finding with the given columns of its item."""
    return items.select(*carry, F.posexplode("findings").alias("finding_ord", "f")) \
        .select(*carry, "finding_ord", "f.*")


def rule_hits(files: DataFrame, policy: Policy, *, path: str = "path", text: str = "text",
              carry: Sequence[str] = ("path",)) -> DataFrame:
    """Which rule matches which original text: one row per (file, matching rule).

    Patterns are compiled into the scan as literals and only hits are exploded,
    so the cost is one pass and no pair of file and rule is ever formed.
    """
    def entry(i: int, rule: Rule, found: Column | None) -> Column:
        holds = F.coalesce(rule_matches(rule.match, F.col(path), F.col(text), found), F.lit(False))
        return F.when(holds, F.struct(F.lit(i).alias("rule_ord"), F.lit(rule.id).alias("rule_id"), F.lit(rule.action).alias("action")))

    def exploded(df: DataFrame, entries: Sequence[Column]) -> DataFrame:
        return df.select(*carry, F.explode(F.array_compact(F.array(*entries))).alias("hit")).select(*carry, "hit.*")

    def ranges(rule: Rule) -> Column | None:
        return None if rule.match.kotlin is None else F.size(symbol_ranges(F.col(path), F.col(text), rule.match.kotlin)) > 0

    entries = [entry(i, r, ranges(r)) for i, r in enumerate(policy.rules)]
    return exploded(files, entries) if entries else files.select(*carry).limit(0).select("*", F.lit(0).alias("rule_ord"), F.lit("").alias("rule_id"), F.lit("").alias("action"))
