"""Sharing policies for tables and streams of text, on Spark."""

from .operators.audit import validate_policies
from .operators.context import assemble_context, context_lines, sanitize_turns
from .operators.detectors import (apply_detector, gitleaks_detector, privacy_filter_detector,
                                  read_detector_output, register_detector)
from .operators.mapping import external_files, map_paths, nearest_policy, number_externals
from .operators.reuse import invalidate_prefix, removed_paths, reuse_decisions
from .operators.rollups import (directory_rollup, disposition_counts, findings_summary, gate,
                                request_decision, request_result, safe_subtrees, stage_stats, top_findings)
from .operators.rule_index import indexed_rule_hits
from .operators.rules import (all_findings, apply_policy, evaluate_prompts, explode_findings,
                              path_findings, rule_hits)
from .operators.symbols import kotlin_symbols, merge_ranges, redact_kotlin
from .plans.flows import evaluate_requests, evaluate_workspace, run_tree, run_workspace
from .policy import Policy, PolicyError, load_policy, policy_fingerprint
from .sources.manifest import current_manifest, read_manifest, read_staged, staged_items, write_manifest, write_staged
from .sources.tables import files_from_table, rules_frame, spread
from .sources.workspace import list_workspace, read_contents, read_workspace
from .streaming.lines import run_lines, sanitize_stream
from .streaming.state import sync_state_stream
from .streaming.sync import collapse_changes, current_state, read_staged_log, sync_batch, sync_stream

__all__ = [name for name in dir() if not name.startswith("_")]
