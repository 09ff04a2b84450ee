"""Which search to run first for an objective in words.

Two ordered tables decide: ``INTENTS`` names what is wanted, ``SOURCES`` says
where the needle or pattern of the first search comes from, and why.  The first
row whose value is there holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from textsieve.plans.query_plan import explain

# How quoted values, identifiers and hints are recognised.
QUOTED = re.compile(r"`([^`]+)`|\"([^\"\n]+)\"|'([^'\n]+)'")
IDENTIFIER = re.compile(r"\b[A-Za-z_][A-Za-z0-9_./:-]{2,}\b", re.A)
EXACT_HINT = re.compile(r"\b(exact|literal|string|identifier|constant|token|env|occurrence|find where)\b", re.I | re.A)
REGEX_HINT = re.compile(r"\b(regex|pattern|matches|matching|wildcard|character class|alternation)\b", re.I | re.A)
IGNORE_CASE_HINT = re.compile(r"\b(ignore[- ]case|case[- ]insensitive)\b", re.I | re.A)
REGEX_LIKE = re.compile(r"\\[dDsSwWbB]|[\[\]()|+*?{}]")
STOP_WORDS = frozenset("find where this that with from into repo code search regex pattern match matches string exact literal token path paths file files".split())

ENSURE, LITERAL, REGEX, EXPLAIN = "index.ensure", "search.literal", "search.regex", "query.explain"


def quoted_values(objective: str) -> list[str]:
    """What stands in quotes, without blanks and repetitions."""
    inside = (next(filter(None, m.groups())) for m in QUOTED.finditer(objective))
    return list(dict.fromkeys(x for x in inside if not x.isspace()))


def identifiers(objective: str) -> list[str]:
    """Words that look like names in code: with a capital, an underscore or punctuation inside."""
    words = dict.fromkeys(IDENTIFIER.findall(objective))
    return [w for w in words if w.lower() not in STOP_WORDS and (w != w.lower() or set(w) & set("_./:-"))]


def regex_like(value: str | None) -> bool:
    return bool(value) and REGEX_LIKE.search(value) is not None


@dataclass
class Clues:
    """What the caller gave, and what the words of the objective say."""

    objective: str
    pattern: str | None = None
    exact: str | None = None

    @cached_property
    def quoted(self) -> list[str]:
        return quoted_values(self.objective)

    @cached_property
    def named(self) -> str | None:
        """The first quoted string that is no pattern, else the longest identifier."""
        plain = (v for v in self.quoted if not regex_like(v))
        return next(plain, None) or max(identifiers(self.objective), key=len, default=None)

    @cached_property
    def suspected(self) -> str | None:
        """The first quoted pattern; if the words speak of patterns, whatever is named first."""
        hinted = [*self.quoted, *identifiers(self.objective)] if self.hints(REGEX_HINT) else []
        return next((v for v in [*filter(regex_like, self.quoted), *hinted]), None)

    @cached_property
    def first_word(self) -> str:
        words = (w for w in self.objective.split() if w.lower() not in STOP_WORDS)
        return next(words, self.objective.strip())

    def hints(self, words: re.Pattern) -> bool:
        return words.search(self.objective) is not None


INTENTS: tuple[tuple[str, Callable[[Clues], object]], ...] = (
    ("exact-string", lambda c: c.exact or (c.pattern and not regex_like(c.pattern))),
    ("regex", lambda c: c.pattern or c.hints(REGEX_HINT)),
    ("exact-string", lambda c: c.named or c.hints(EXACT_HINT)),
    ("unknown", lambda c: True),
)
SOURCES: tuple[tuple[str, Callable[[Clues], str | None], str], ...] = (
    (LITERAL, lambda c: c.exact, "The exact string is given: {}."),
    (LITERAL, lambda c: None if regex_like(c.pattern) else c.pattern, "The pattern has no operators, so it is searched as the string {}."),
    (LITERAL, lambda c: c.named, "The objective names {}."),
    (REGEX, lambda c: c.pattern, "The pattern {} is given."),
    (REGEX, lambda c: c.suspected, "The objective quotes the pattern {}."),
    (LITERAL, lambda c: c.first_word, "Nothing is named; the first telling word, {}, is tried."),
)


@dataclass
class SearchPlan:
    must_ensure_index: bool
    sequence: list[str]
    intent: str
    literal_args: dict | None = None
    regex_args: dict | None = None
    explain_args: dict | None = None
    reasoning: list[str] = field(default_factory=list)
    fallback: list[str] = field(default_factory=list)

    @property
    def first(self) -> str:
        return self.sequence[0]


def weak(pattern: str) -> bool:
    """Whether the index can hardly help: no anchor has three characters, or all documents are read anyway."""
    plan = explain(pattern)
    return plan.requires_full_scan or max(map(len, plan.extractable_anchors), default=0) < 3


def advice(globs: list[str] | None) -> list[str]:
    """What to do with this engine when the first search does not answer."""
    scope = [f"Stay within {', '.join(globs)}; drop path_globs when nothing is found there."] if globs else []
    return [
        *scope,
        "result.stats() tells how many documents were candidates; explain(pattern).pruning tells why.",
        "Count the rows of result.matches by path with max_results=None before reading them.",
        "index.status() lists the paths that no longer are what was indexed.",
    ]


def plan_search(objective: str, status: dict, pattern: str | None = None, exact: str | None = None, path_hints: list[str] | None = None) -> SearchPlan:
    """Recommend a sequence of operations; ``status`` is that of the index."""
    clues, stale = Clues(objective, pattern, exact), len(status["stale_paths"])
    globs = [h for h in dict.fromkeys(path_hints or []) if h.strip()] or None
    intent = next(name for name, holds in INTENTS if holds(clues))
    tool, value, why = next((tool, value, why) for tool, find, why in SOURCES if (value := find(clues)) or find is SOURCES[-1][1])
    plan = SearchPlan(not status["ready"] or stale > 0, [], intent, reasoning=[why.format(repr(value))], fallback=advice(globs))
    if plan.must_ensure_index:
        plan.reasoning.insert(0, f"{stale} paths changed since the index was built." if status["ready"] else "There is no index yet.")
    checked = tool == REGEX and (intent == "unknown" or weak(value))
    if checked:
        plan.reasoning.append("The index may not narrow it down, so it is explained first.")
    plan.sequence = [ENSURE] * plan.must_ensure_index + [EXPLAIN] * checked + [tool]
    if tool == REGEX:
        plan.regex_args, plan.explain_args = {"pattern": value, "path_globs": globs}, {"pattern": value}
    else:
        plan.literal_args = {"needle": value, "path_globs": globs, "case_sensitive": False if clues.hints(IGNORE_CASE_HINT) else None}
    return plan
