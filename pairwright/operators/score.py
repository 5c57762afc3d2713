"""Explainable scores of roles: six parts, each with reasons and concerns, after one rubric per side.

roles: title, description, specialty (a or b), is_interventional, is_leadership, is_locum, setting,
work_model, country, precision, date_posted (date).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.geo import half_up
from pairwright.functions.scratch import for_each_different
from pairwright.functions.text import age_days, ascii_words, has, once
from pairwright.operators.rules import RuleSet, default, guarded

#: Weights of the parts per side, tiers, and what counts for and against a posting.
PARTS = ("specialty_fit", "seniority", "practice_quality", "location", "recency", "signal")
RUBRIC = {"a": (34, 16, 18, 14, 10, 8), "b": (34, 14, 20, 14, 10, 8)}
CEILING = {"specialty_fit": 34, "seniority": 16, "practice_quality": 20, "location": 14, "recency": 10, "signal": 8}
TIERS = ((72, "strong"), (56, "worth-a-look"), (40, "stretch"))
POSITIVE = {
    "a": [
        (r"\bopen (?:and |& )?endovascular\b", 1.0, "open + endovascular case mix"),
        (r"\baort(?:ic|a)\b|\bEVAR\b|\bTEVAR\b|\bfenestrated\b", 0.9, "complex aortic work"),
        (r"\blimb salvage\b|\bcritical limb\b|\bCLTI\b|\bPAD\b", 0.7, "limb salvage / PAD volume"),
        (r"\bdialysis access\b|\bAV fistula\b", 0.4, "dialysis access volume"),
        (r"\bhybrid (?:or|operating room|suite)\b", 0.6, "hybrid OR available"),
        (r"\bvein\b|\bvenous\b|\bvaricose\b", 0.3, "venous practice component"),
        (r"\bcall (?:is )?(?:1:[4-9]|1:1[0-9])\b|\bfavorable call\b|\blight call\b", 0.7, "favorable call ratio"),
    ],
    "b": [
        (r"\bgeneral (?:diagnostic )?radiolog", 1.0, "general diagnostic scope"),
        (r"\bbody imaging\b|\bcross[- ]sectional\b|\bCT\b.*\bMR", 0.8, "body / cross-sectional emphasis"),
        (r"\bno (?:overnight |night )?call\b|\bnight ?hawk covered\b|\bcall covered\b", 0.9, "call covered or none"),
        (r"\b(?:\d+|ten|twelve|thirteen|fourteen)\s*(?:\+)?\s*weeks? (?:of )?vacation\b", 0.7, "stated vacation weeks"),
        (r"\bpartnership track\b|\bpartner(?:ship)? in \d\b", 0.9, "partnership track"),
        (r"\bsubspecialt(?:y|ies) (?:supported|protected)\b|\bfellowship[- ]trained welcome\b", 0.5, "subspecialty support"),
        (r"\bhome workstation\b|\bremote reading\b|\bhybrid reading\b", 0.6, "home workstation / hybrid reading"),
    ],
}
NEGATIVE = [
    (r"\bsolo (?:coverage|practice|radiologist|surgeon)\b", -1.0, "solo coverage"),
    (r"\b1:2\b|\bq2 call\b|\bevery other (?:night|weekend)\b", -1.2, "heavy call (q2)"),
    (r"\bno partnership\b|\bemployed model only\b", -0.4, "no partnership path"),
    (r"\bJ-?1 (?:only|required)\b", -0.5, "J-1 restricted"),
    (r"\bmust (?:also )?cover (?:pediatric|peds) (?:trauma|call)\b", -0.3, "added pediatric call burden"),
]
DIAGNOSTIC = r"\bIR\/DR\b|\bdiagnostic\b"
ENTRY, TRAUMA, RANKED = r"\bentry[- ]level\b|\bjunior\b|\bnew grad", r"\blevel (?:i|1|one) trauma\b", r"\bmagnet\b|\btop \d+ hospital\b|\bnationally ranked\b"
SETTINGS = {"academic": (0.75, "academic setting"), "private": (0.72, "private / group practice"), "government": (0.6, "government / VA employment")}
AGES = ((14, 1.0), (45, 0.75), (90, 0.45), (180, 0.25))
LICENCES = {
    "QA": "QCHP licensure (Qatar Council for Healthcare Practitioners)", "AE": "DOH Abu Dhabi / DHA Dubai / MOHAP licensure", "SA": "SCFHS classification + registration",
    "KW": "Kuwait MOH licensure", "BH": "NHRA licensure", "OM": "Oman Medical Specialty Board / MOH licensure",
}
PREFERRED = ("US", "QA", "AE", "SA", "KW", "BH", "OM")


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def score_roles(roles: DataFrame, today: Column, preferred: tuple[str, ...] | None = None, rules: RuleSet | None = None) -> DataFrame:
    """After a rule set, the default one if none is given: roles with score, tier, subscores (struct), age_days, score_reasons and concerns, both in order and distinct."""
    rules = rules or default()
    preferred = preferred or rules.preferred
    text, body = F.col("_a.text"), F.coalesce("description", F.lit(""))
    is_side = lambda side: F.coalesce(F.col("specialty") == side, F.lit(False))
    speaking = {f"{side}{k}": (hit, *rule[1:]) for side in ("a", "b") for k, (rule, hit) in enumerate(zip(rules.positive[side], guarded(text, rules.positive[side], is_side(side)), strict=True))}
    against = {f"n{k}": (hit, *rule[1:]) for k, (rule, hit) in enumerate(zip(rules.negative, guarded(text, rules.negative), strict=True))}
    ir_only = F.coalesce((F.col("specialty") == "b") & F.col("is_interventional"), F.lit(False)) & ~has(text, rules.diagnostic)
    found = {n: c for n, (c, _, _) in (speaking | against).items()} | {"ir_only": ir_only, "entry": has(text, rules.entry), "trauma": has(text, rules.trauma), "ranked": has(text, rules.ranked)}
    words = {"text": ascii_words(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))}
    roles = for_each_different(roles, ["title", "description", "specialty", "is_interventional"], lambda texts: once(once(texts, "_a", words), "_m", found).drop("_a"))
    good, bad = ([(F.col(f"_m.{n}"), pts, why) for n, (_, pts, why) in x.items()] for x in (speaking, against))
    ir_only = F.col("_m.ir_only")
    fit = F.lit(0.55)
    for hit, pts, _ in good:
        fit = fit + F.when(hit, F.lit(pts * 0.12)).otherwise(0.0)
    fit = fit - F.when(ir_only, F.lit(0.3)).otherwise(0.0)
    for hit, pts, _ in bad:
        fit = fit + F.when(hit, F.lit(pts * 0.12)).otherwise(0.0)
    entry = F.col("_m.entry")
    seniority = F.when(F.col("is_locum"), 0.25).when(entry, 0.35).when(F.col("is_leadership"), 0.95).otherwise(0.6)
    quality = F.lit(0.55)
    for name, (value, _) in rules.settings.items():
        quality = F.when(F.col("setting") == name, F.lit(value)).otherwise(quality)
    trauma = F.col("_m.trauma")
    quality = _unit(quality + F.when(trauma, 0.1).otherwise(0.0) + F.when(F.col("_m.ranked"), 0.05).otherwise(0.0))
    pinned = F.coalesce(F.col("precision") == "city", F.lit(False))
    place = _unit(F.when(F.col("country").isin(*preferred), 0.7).otherwise(0.3) + F.when(pinned, 0.15).otherwise(0.0))
    age = age_days(F.col("date_posted"), today)
    recency = F.when(age.isNull(), 0.5)
    for upto, value in AGES:
        recency = recency.when(age <= upto, value)
    recency = recency.otherwise(0.08)
    signal = F.greatest(F.lit(0.15), F.least(F.lit(1.0), F.length(body) / 1800.0))
    licence = F.element_at(F.create_map(*(F.lit(x) for kv in rules.licences.items() for x in kv)), F.col("country"))
    reasons = [
        *(F.when(h, w) for h, _, w in good), F.when(F.col("is_leadership"), "leadership scope (chief / director / division head)"),
        *(F.when(F.col("setting") == n, w) for n, (_, w) in rules.settings.items()), F.when(trauma, "Level I trauma centre"),
        F.when(F.col("work_model") == "remote", "remote / teleradiology"), F.when(age <= 14, "posted within two weeks"),
    ]
    concerns = [
        F.when(ir_only, "interventional-only — outside a diagnostic/general practice"), *(F.when(h, w) for h, _, w in bad), F.when(entry, "pitched at entry level"),
        F.when(F.col("is_locum"), "locum / temporary, not a permanent post"), F.when(~pinned, "location is vague — resolved only to a state or country"),
        F.when(licence.isNotNull(), F.concat(F.lit("Requires "), licence)),
        F.when(age > 180, F.concat(F.lit("posting is about "), half_up(age / 30).cast("string"), F.lit(" months old — likely filled"))),
        F.when(F.length(body) < 300, "thin posting — little detail to evaluate"),
    ]
    df = roles.withColumns(dict(zip((f"_{p}" for p in PARTS), (_unit(fit), seniority, quality, place, recency, signal), strict=True)))
    weight = {p: F.when(F.col("specialty") == "a", rules.rubric["a"][k]).otherwise(rules.rubric["b"][k]) for k, p in enumerate(PARTS)}
    weighted = {p: F.col(f"_{p}") * weight[p] for p in PARTS}
    total = F.lit(0.0)
    for p in PARTS:
        total = total + weighted[p]
    score = half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))).cast("long")
    df = df.withColumns({"score": score, "subscores": F.struct(*(half_up(weighted[p]).cast("long").alias(p) for p in PARTS)), "age_days": age, "score_reasons": F.array_distinct(F.array_compact(F.array(*reasons))), "concerns": F.array_distinct(F.array_compact(F.array(*concerns)))})
    return df.withColumn("tier", tier(F.col("score"), rules)).drop("_m", *(f"_{p}" for p in PARTS))


def tier(score: Column, rules: RuleSet | None = None) -> Column:
    rules = rules or default()
    out = F.when(score >= rules.tiers[0][0], rules.tiers[0][1])
    for least, name in rules.tiers[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("low")


def shares(subscores: Column) -> Column:
    """Each part as a percentage of its shared ceiling, 0 to 100."""
    return F.struct(*(F.greatest(F.lit(0.0), F.least(F.lit(100.0), subscores[p] / c * 100)).alias(p) for p, c in CEILING.items()))
