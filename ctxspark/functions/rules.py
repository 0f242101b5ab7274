"""Classification rules as CASE expressions.  All word lists are fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark skill material.
SKILL_CUES = ("use this skill", "available skills", "when to use", "invoke it via skill", "<skill", "# skill", "skill tool")
# Phrases of constraints that are always kept.
SAFETY_CUES = (
    "must not", "must never", "never drop", "do not delete", "do not remove", "do not modify", "acceptance criteria", "acceptance test",
    "safety", "must keep", "you must", "required:", "constraint", "forbidden", "policy",
)
# Phrases of short task hints.
TASK_CUES = ("todo", "next step", "error:", "traceback", "failed", "fixme", "task:", "goal:", "implement", "reproduce")
# Block types by how surely they are kept, and the router's labels.
KEEP_PRIORITY = {"user_prompt": 5, "system_prompt": 4, "skill_prompt": 4, "assistant_context": 2, "tool_result": 1, "unknown": 0}
ROUTABLE = ("summarizable_candidate", "likely_drop_candidate")
PARENT_SOURCES = ("assistant_context", "tool_result")


def has_any(text: Column, cues: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(c) for c in cues))


def system_prompt_type(text: Column) -> Column:
    low = F.lower(text)
    front = F.ltrim(F.regexp_replace(low, r"^\s+", "")).startswith("---") & F.substring(low, 1, 300).contains("name:")
    return F.when(front | has_any(low, SKILL_CUES), "skill_prompt").otherwise("system_prompt")


def message_type(role: Column, tool_name: Column) -> Column:
    return (
        F.when((role == "tool") | tool_name.isNotNull(), "tool_result")
        .when(role == "user", "user_prompt")
        .when(role == "assistant", "assistant_context")
        .when(role == "system", "system_prompt")
        .otherwise("unknown")
    )


def router_decision(block_type: Column, text: Column, occurrences: Column, large_chars: int = 8000, min_repeat: int = 3) -> Column:
    """"label|reason" of a block: kept by origin, kept by constraint, task hint, candidate, or kept by default."""
    low = F.lower(text)
    large, repeated = F.length(text) >= large_chars, occurrences >= min_repeat
    hint = has_any(low, TASK_CUES)
    tool_like = block_type.isin("tool_result", "assistant_context", "unknown")
    return (
        F.when(block_type == "user_prompt", "policy_must_keep|user_prompt_never_drop")
        .when(block_type.isin("system_prompt", "skill_prompt"), "policy_must_keep|system_or_skill_constraint_never_drop")
        .when(has_any(low, SAFETY_CUES), "policy_must_keep|safety_or_acceptance_constraint")
        .when(hint & ~large, "direct_task_hint|actionable_task_signal")
        .when(tool_like & hint, "summarizable_candidate|large_actionable_tool_block")
        .when(tool_like & large & repeated, "likely_drop_candidate|large_repeated_tool_block")
        .when(tool_like & repeated, "likely_drop_candidate|repeated_tool_block")
        .when(tool_like & large, "summarizable_candidate|large_single_tool_block")
        .otherwise("likely_relevant|default_keep")
    )


#: Artifact kinds in the order of their rules.  Each rule: phrases of the lower-cased text,
#: of the text itself, starts of the left-stripped text, and pairs that count only together (lower-cased / as is).
ARTIFACT_RULES: tuple[tuple[str, dict[str, tuple]], ...] = (
    ("diff", {"start": ("diff --git", "--- a/", "@@ "), "text": ("\n@@ ",), "text_pairs": (("\n--- ", "\n+++ "),)}),
    ("test_log", {"low": ("pytest", "test session starts", " passed in ", " failed in "), "text": ("=== ",), "low_pairs": (("passed", "failed"),)}),
    ("error_trace", {"low": ("traceback (most recent call last)", "stack trace"), "text": ("\n  at ",), "low_pairs": (("exception", "error"),)}),
    ("benchmark_result", {"low": ("benchmark", "ops/sec", "ops/s", "req/sec", "throughput", "latency", "iterations/sec")}),
    ("review_findings", {"low": ("code review", "review findings", "severity:", "vulnerab", "## findings")}),
    ("file_content", {"text": ("\n     1\t", "\n   1\t", "def ", "class ", "\nimport ", "#include", "function ")}),
    ("worker_summary", {"low": ("## summary", "in summary", "summary:", "tl;dr", "aggregat", "worker")}),
    ("terminal_output", {"text": ("\n$ ", "\n# "), "start": ("$ ",), "low": ("user@", "bash-", "exit code")}),
)


def artifact_kind(text: Column) -> Column:
    low, start = F.lower(text), F.regexp_replace(text, r"^\s+", "")
    kind = None
    for name, rule in ARTIFACT_RULES:
        tests = [low.contains(c) for c in rule.get("low", ())] + [text.contains(c) for c in rule.get("text", ())] + [start.startswith(c) for c in rule.get("start", ())]
        tests += [low.contains(a) & low.contains(b) for a, b in rule.get("low_pairs", ())] + [text.contains(a) & text.contains(b) for a, b in rule.get("text_pairs", ())]
        test = reduce(lambda a, b: a | b, tests)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return kind.otherwise("unknown_large_block")
