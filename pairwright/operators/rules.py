"""Rules as data: what classify and score go by, for any two sides.

Patterns are of ASCII words and tried without regard to case. A rule set is compiled to columns by the
operators. A search over all patterns at once before the single ones took more than twice as long (score_parts
at scale 0.1: 77 s instead of 29), as most texts hold some, so each is tried by itself where its side is asked for.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column

from pairwright.functions.text import has

#: A pattern, its points, and why.
Rule = tuple[str, float, str]


@dataclass(frozen=True)
class RuleSet:
    """side_a and side_b: terms of a title; interventional: those that mean side b in a narrower sense.

    A title of another specialty counts only with ours_after_all; one that names none goes by its body, if
    it is a physician's. The others find settings, work models and flags; see classify and score.
    """

    side_a: list[str]
    side_b: list[str]
    interventional: str
    other_specialty: str
    ours_after_all: str
    not_attending: list[str]
    physician: str
    leadership: str
    academic: str
    private: str
    government: str
    locum: str
    remote_title: str
    onsite_title: str
    hybrid_title: str
    remote_place: str
    remote_phrase: str
    hybrid_phrase: str
    reasons: Mapping[str, str]
    positive: Mapping[str, list[Rule]]
    negative: list[Rule]
    diagnostic: str
    entry: str
    trauma: str
    ranked: str
    settings: Mapping[str, tuple[float, str]]
    licences: Mapping[str, str]
    preferred: tuple[str, ...]
    rubric: Mapping[str, tuple[int, ...]]
    tiers: tuple[tuple[int, str], ...]


@cache
def default() -> RuleSet:
    """The fixed values of classify and score."""
    from pairwright.operators import classify, score

    found = {}
    for name in RuleSet.__dataclass_fields__:
        found[name] = getattr(classify, name.upper(), None) or getattr(score, name.upper())
    return RuleSet(**found)


def guarded(text: Column, rules: list[Rule], where: Column | None = None) -> list[Column]:
    """Whether each rule's pattern is found; texts are only searched where it is asked for."""
    return [has(text, p) if where is None else where & has(text, p) for p, *_ in rules]
