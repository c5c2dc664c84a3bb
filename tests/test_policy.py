import json

import pytest

from veilframe.policy import (BLOCK, REDACT, Detectors, PolicyError, Toggle, load_policy, policy_fingerprint)

RULE = {"id": "r", "match": {"paths": ["**/*.pem"]}, "action": {"type": " Block "}}


def policy(**parts):
    return load_policy({"version": 1, **parts})


def test_defaults_and_unknown_fields():
    p = policy(rules=[RULE | {"severity": "high"}], owner="x")
    assert p.rules[0].action == BLOCK
    assert p.redact_replacement == "<redacted>"
    assert p.detectors == Detectors()
    assert not p.detectors.gitleaks.enabled and p.detectors.gitleaks.action == BLOCK


def test_a_written_toggle_starts_from_the_general_defaults():
    p = policy(detectors={"gitleaks": {"enabled": True}, "privacy_filter": {}, "secrets": {"enabled": False}})
    assert p.detectors.gitleaks == Toggle(True, REDACT)
    assert p.detectors.privacy_filter == Toggle(True, REDACT)
    assert p.detectors.secrets == Toggle(False, REDACT)


@pytest.mark.parametrize("raw, message", [
    ({"version": 2}, "version"),
    ({"version": 1, "rules": [RULE, RULE]}, "duplicate"),
    ({"version": 1, "rules": [RULE | {"id": " "}]}, "blank rule id"),
    ({"version": 1, "rules": [RULE | {"match": {}}]}, "no matcher"),
    ({"version": 1, "rules": [RULE | {"action": {"type": "redact", "replacement": " "}}]}, "blank replacement"),
    ({"version": 1, "defaults": {"redact_replacement": ""}, "rules": [RULE | {"action": {"type": "redact"}}]}, "blank"),
    ({"version": 1, "rules": [RULE | {"action": {"type": "delete"}}]}, "unknown action"),
])
def test_invalid_policies(raw, message):
    with pytest.raises(PolicyError, match=message):
        load_policy(raw)


def test_an_empty_symbol_criterion_is_a_matcher():
    assert policy(rules=[RULE | {"match": {"kotlin": {}}}]).rules[0].match.kotlin.whole_file


def test_files(tmp_path):
    raw = {"version": 1, "rules": [RULE]}
    (tmp_path / "p.json").write_text(json.dumps(raw))
    (tmp_path / "p.yaml").write_text("version: 1\nrules:\n  - id: r\n    match: {paths: ['**/*.pem']}\n    action: {type: block}\n")
    assert load_policy(tmp_path / "p.json") == load_policy(tmp_path / "p.yaml")
    with pytest.raises(PolicyError):
        load_policy(tmp_path / "missing.yaml")


def test_fingerprint_follows_content_and_order():
    second = RULE | {"id": "s"}
    one, two = policy(rules=[RULE, second]), policy(rules=[second, RULE])
    assert policy_fingerprint(one) == policy_fingerprint(policy(rules=[RULE, second]))
    assert policy_fingerprint(one) != policy_fingerprint(two)
