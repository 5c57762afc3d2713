"""A second rule set, for two other sides: those who run the machines, and those who assist or learn."""

from __future__ import annotations

from dataclasses import replace

from pairwright.operators.rules import RuleSet, default


def other_rules() -> RuleSet:
    return replace(
        default(),
        side_a=[r"\btechnologists?\b", r"\btechnicians?\b", r"\bsonographers?\b"], side_b=[r"\bassistants?\b", r"\bfellows?\b"], interventional=r"\binterventional\b", other_specialty=r"\bspine\b|\borthop", ours_after_all=r"\btechnologist\b",
        not_attending=[r"\bchief\b", r"\bteleradiolog"], physician=r"\bsurgeon\b|\bphysician\b|\bconsultant\b", leadership=r"\b(lead|faculty|head)\b", academic=r"\b(university|school)\b", private=r"\b(group|partners)\b", government=r"\bVA\b",
        positive={"a": [(r"\bhybrid\b", 1.0, "hybrid rooms"), (r"\bvacation\b", 0.5, "vacation stated")], "b": [(r"\bno call\b", 0.9, "no call"), (r"\bteam\b|\bcolleagues\b", 0.4, "a team"), (r"\bresearch\b", 0.3, "research")]},
        negative=[(r"\bsolo\b", -1.0, "alone"), (r"\bcall\b", -0.2, "on call")], diagnostic=r"\bdiagnostic\b", settings={"academic": (0.9, "academic setting"), "private": (0.4, "private practice"), "government": (0.7, "government")},
        rubric={"a": (30, 20, 15, 15, 10, 10), "b": (40, 10, 20, 10, 10, 10)}, tiers=((60, "strong"), (45, "worth-a-look"), (30, "stretch")), preferred=("QA",),
    )
