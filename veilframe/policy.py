"""Sharing policies: ordered rules, detector switches, validation, fingerprint.

A policy is configuration and stays on the driver; the operators turn it into
Column expressions.  ``sources.tables.rules_frame`` gives it as a table.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

ALLOW, BLOCK, REDACT, CONFIRM, SUMMARIZE = ACTIONS = (
    "ALLOW", "BLOCK", "REDACT", "CONFIRM", "SUMMARIZE")

#: Version of the built-in secret patterns; part of the fingerprint, so that a
#: changed pattern pack invalidates stored decisions.
SECRET_PACK_VERSION = 1

SUPPORTED_VERSION = 1


class PolicyError(ValueError):
    """The policy cannot be used."""


def parse_action(raw: str) -> str:
    name = str(raw).strip().upper()
    if name not in ACTIONS:
        raise PolicyError(f"unknown action {raw!r}")
    return name


@dataclass(frozen=True)
class SymbolCriteria:
    """Kotlin declarations to look for; packages gate the other three."""

    packages: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    functions: tuple[str, ...] = ()
    annotations: tuple[str, ...] = ()

    @property
    def whole_file(self) -> bool:
        return not (self.classes or self.functions or self.annotations)


@dataclass(frozen=True)
class Match:
    paths: tuple[str, ...] = ()
    path_regex: tuple[str, ...] = ()
    content_regex: tuple[str, ...] = ()
    kotlin: SymbolCriteria | None = None

    @property
    def is_empty(self) -> bool:
        return not (self.paths or self.path_regex or self.content_regex or self.kotlin is not None)

    @property
    def has_path(self) -> bool:
        return bool(self.paths or self.path_regex)

    @property
    def path_only(self) -> bool:
        return self.has_path and not self.content_regex and self.kotlin is None


@dataclass(frozen=True)
class Rule:
    id: str
    match: Match
    action: str
    replacement: str | None = None
    description: str | None = None


@dataclass(frozen=True)
class Toggle:
    enabled: bool = True
    action: str = REDACT


@dataclass(frozen=True)
class Detectors:
    secrets: Toggle = Toggle()
    kotlin_symbols: Toggle = Toggle(enabled=False)
    privacy_filter: Toggle = Toggle(enabled=False)
    gitleaks: Toggle = Toggle(enabled=False, action=BLOCK)


@dataclass(frozen=True)
class Policy:
    rules: tuple[Rule, ...] = ()
    version: int = SUPPORTED_VERSION
    on_unmatched: str = ALLOW
    redact_replacement: str = "<redacted>"
    detectors: Detectors = field(default_factory=Detectors)

    def replacement_of(self, rule: Rule) -> str:
        return self.redact_replacement if rule.replacement is None else rule.replacement


def _strings(value) -> tuple[str, ...]:
    return tuple(str(item) for item in (value or ()))


def _rule(raw: dict) -> Rule:
    match, action = raw.get("match") or {}, raw.get("action") or {}
    kotlin = None
    if match.get("kotlin") is not None:
        symbols = match["kotlin"]
        kotlin = SymbolCriteria(*(_strings(symbols.get(name)) for name in
                                  ("packages", "classes", "functions", "annotations")))
    if "type" not in action:
        raise PolicyError(f"rule {raw.get('id')!r} has no action type")
    return Rule(
        id=str(raw.get("id", "")),
        description=raw.get("description"),
        match=Match(_strings(match.get("paths")), _strings(match.get("path_regex")),
                    _strings(match.get("content_regex")), kotlin),
        action=parse_action(action["type"]),
        replacement=action.get("replacement"),
    )


def _toggle(raw: dict | None, absent: Toggle) -> Toggle:
    """A toggle that is written out starts from the general toggle defaults
    (enabled, REDACT); only an absent one takes its detector's own default."""
    if raw is None:
        return absent
    return Toggle(bool(raw.get("enabled", True)), parse_action(raw.get("action", REDACT)))


def policy_from_dict(raw: dict) -> Policy:
    """Build and validate a policy; unknown fields are ignored."""
    defaults, detectors = raw.get("defaults") or {}, raw.get("detectors") or {}
    base = Detectors()

    policy = Policy(
        version=int(raw.get("version", 0)),
        on_unmatched=parse_action(defaults.get("on_unmatched", ALLOW)),
        redact_replacement=defaults.get("redact_replacement", "<redacted>"),
        detectors=Detectors(*(_toggle(detectors.get(name), getattr(base, name)) for name in
                              ("secrets", "kotlin_symbols", "privacy_filter", "gitleaks"))),
        rules=tuple(_rule(item) for item in raw.get("rules") or ()),
    )
    return validated(policy)


def load_policy(source: str | Path | dict) -> Policy:
    """Load a policy from a dict, or from a YAML or JSON file."""
    if isinstance(source, dict):
        return policy_from_dict(source)
    path = Path(source)
    if not path.exists():
        raise PolicyError(f"no policy at {path}")
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return policy_from_dict(json.loads(text))
    try:
        import yaml
    except ImportError as error:
        raise PolicyError("PyYAML is needed for YAML policies; pass a dict or JSON") from error
    return policy_from_dict(yaml.safe_load(text))


def validated(policy: Policy) -> Policy:
    """Raise PolicyError for the first violated requirement, else return the policy.

    ``operators.audit.validate_policies`` checks the same requirements over a
    table of many policies.
    """
    if policy.version != SUPPORTED_VERSION:
        raise PolicyError(f"policy version {policy.version} is not {SUPPORTED_VERSION}")
    seen: set[str] = set()
    for rule in policy.rules:
        if rule.id in seen:
            raise PolicyError(f"duplicate rule id {rule.id!r}")
        seen.add(rule.id)
        if not rule.id.strip():
            raise PolicyError("blank rule id")
        if rule.match.is_empty:
            raise PolicyError(f"rule {rule.id} has no matcher")
        if rule.action == REDACT and not policy.replacement_of(rule).strip():
            raise PolicyError(f"rule {rule.id} redacts with a blank replacement")
    return policy


def policy_fingerprint(policy: Policy, detectors=()) -> str:
    """SHA-256 of the canonical policy, the secret pack version, and ids, actions and versions of plugged detectors."""
    plugged = [[[d.id, d.action, d.version] for d in detectors]] if detectors else []
    canonical = json.dumps([asdict(policy), SECRET_PACK_VERSION, *plugged], sort_keys=True,
                           ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(canonical.encode("utf-8")).hexdigest()
