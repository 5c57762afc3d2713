"""Classification of postings by rules: specialty, attending level, setting and work model.

postings: title, department, org, description, location. Rules are data: patterns of ASCII words, tried
without regard to case; `rules` in SQL-style form serve the queries' counterparts too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.scratch import for_each_different
from pairwright.functions.text import ascii_words, has, once
from pairwright.operators.rules import RuleSet, default

#: The default vocabularies.
SIDE_A = [r"\bvascular surgeon\b", r"\bvascular surgery\b", r"\bendovascular\b", r"\bvascular (?:and |& )?endovascular\b", r"\bcardiothoracic (?:and |& )?vascular surg"]
SIDE_B = [
    r"\bdiagnostic radiolog(?:y|ist)\b", r"\bradiologist\b", r"\bgeneral radiolog(?:y|ist)\b", r"\bbody imaging\b", r"\bneuroradiolog(?:y|ist)\b",
    r"\bmusculoskeletal (?:radiolog|imaging)", r"\bbreast imaging\b", r"\bteleradiolog(?:y|ist)\b", r"\bcross[- ]sectional imaging\b", r"\bnuclear medicine physician\b",
]
INTERVENTIONAL = r"\binterventional radiolog(?:y|ist)\b|\bIR\/DR\b|\bvascular (?:and |& )?interventional radiolog"
OTHER_SPECIALTY = (
    r"\b(anesthesiolog|orthopa?edic|neurosurg|podiatr|urolog|plastic surg|cardiolog|vascular medicine|radiation oncolog|dermatolog|ophthalmolog|otolaryngolog|psychiatr|hospitalist"
    r"|pediatric(?!\s+(?:vascular|radiolog))|obstetric|gynecolog|family (?:medicine|physician)|internal medicine|emergency medicine physician)\b"
)
OURS_AFTER_ALL = r"\bvascular surg|radiolog"
NOT_ATTENDING = [
    r"\b(resident|residency|fellow(?:ship)?|intern|medical student|observer|elective)\b",
    r"\b(nurse|nursing|\bRN\b|\bLPN\b|\bNP\b|nurse practitioner|physician assistant|\bPA-C\b)\b",
    r"\b(?:medical|technical|surgical|nursing|patient care|physician office|clinic) assistant\b(?!\s*\/?\s*(?:professor|prof\b))",
    r"\b(?:radiologist|radiology|vascular|surgeon)s?\s+assistant\b",
    r"\b(?:practice|office|imaging|radiology|clinic|department|operations|business) (?:manager|supervisor)\b",
    r"\b(technologist|technician|\btech\b|sonographer|ultrasonographer|radiographer|\bRT\b\(?R?\)?)\b",
    r"\b(scheduler|coordinator|registrar|receptionist|clerk|transcription|biller|coder|coding)\b",
    r"\b(assistant professor of nursing|research assistant|research coordinator|study coordinator)\b",
    r"\b(sales|account executive|marketing|recruiter|territory manager|field service)\b",
    r"\b(engineer|developer|analyst|data scientist|architect)\b",
    r"\b(volunteer|intern(?:ship)?|per diem tech|housekeep|transport|dietary|security)\b",
]
PHYSICIAN = r"\b(physician|surgeon|md\b|do\b|consultant)\b"
LEADERSHIP = r"\b(chief|chair(?:man|person)?|director|division head|section head|medical director|program director|vice president|\bVP\b)\b"
ACADEMIC = r"\b(professor|faculty|academic|university|school of medicine|college of medicine|tenure|research|fellowship program|residency program|\bNIH\b)\b"
PRIVATE = (
    r"\b(private practice|private group|partnership track|partner track|group practice|\bLLC\b|\bLLP\b|associates|physician[- ]owned|physician[- ]led|independent (?:practice|group)|democratic group"
    r"|single[- ]specialty group|office[- ]based lab|\bOBL\b|(?:vein|vascular|surgical|radiology|imaging)[\w ]{0,14}(?:group|specialists|partners)\b)"
)
GOVERNMENT = r"\b(veterans affairs|\bVA\b medical|veterans health|department of defense|\bDoD\b|army|navy|air force|indian health|public health service|ministry of health)\b"
LOCUM = r"\b(locum|locums|temporary|per diem|prn\b|moonlight)\b"
REMOTE_PHRASE = r"\b(?:fully remote|100% remote|remote (?:position|role|work|opportunity|reading|reads)|work(?:ing)? remotely|work from home|telecommut\w*|teleradiolog\w*|home[- ]based|virtual reads?)\b"
HYBRID_PHRASE = r"\b(?:hybrid (?:schedule|model|work|arrangement|reading|rota)|partially remote|flexible onsite|mix of (?:on|in)[- ]site)\b"
REMOTE_PLACE = r"^\s*(?:remote|fully remote|remote[ -]us|anywhere)\s*$"
REMOTE_TITLE, ONSITE_TITLE = r"\bremote\b|\bteleradiolog", r"\bon-?\s?site\b"
HYBRID_TITLE = r"\bhybrid\b(?!\s*(?:or\b|operating|suite|theatre|room|lab))"

REASONS = {
    "not_attending": "title is not an attending-level physician role",
    "a_title": "vascular surgery term in title",
    "b_title": "radiology term in title",
    "ir_title": "interventional radiology term in title",
    "a_body": "generic physician title, vascular-only body text",
    "b_body": "generic physician title, radiology-only body text",
    "both": "body mentions both specialties — ambiguous, dropped",
}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: What the rules search, but for the place.
TEXTS = ["title", "department", "org", "description"]


def _searched(texts: DataFrame, rules: RuleSet) -> DataFrame:
    """Adds _t, what the rules say of title, department and employer, and _f, what they say of the whole text.

    Bodies are only searched for what titles leave open; where they do, the answer is null.
    """
    df = once(texts, "_a", {"titleish": ascii_words(F.concat_ws(" ", _text("title"), _text("department"))), "body": ascii_words(_text("description")), "org": ascii_words(_text("org"))})
    t, body, org = F.col("_a.titleish"), F.col("_a.body"), F.col("_a.org")
    full = F.concat_ws(" ", t, body)
    df = once(df, "_t", {
        "attending": ~has(t, rules.not_attending), "other": has(t, rules.other_specialty), "ours": has(t, rules.ours_after_all), "a": has(t, rules.side_a), "b": has(t, rules.side_b), "ir": has(t, rules.interventional), "md": has(t, rules.physician),
        "private_org": has(org, rules.private), "academic": has(F.concat_ws(" ", org, t), rules.academic), "locum": has(t, rules.locum), "leadership": has(t, rules.leadership),
        "remote": has(t, rules.remote_title), "onsite": has(t, rules.onsite_title), "hybrid": has(t, rules.hybrid_title),
    })
    titled = F.col("_t.a") | F.col("_t.b") | F.col("_t.ir")
    generic = F.col("_t.attending") & F.col("_t.md") & ~F.col("_t.other") & ~titled
    by_body = ~(F.col("_t.remote") | F.col("_t.onsite") | F.col("_t.hybrid"))
    found = once(df, "_f", {
        "a": F.when(generic, has(full, rules.side_a)), "b": F.when(generic, has(full, rules.side_b)), "ir": F.when(~F.col("_t.ir"), has(full, rules.interventional)),
        "government": has(F.concat_ws(" ", org, full), rules.government), "private": F.when(~F.col("_t.private_org") & ~F.col("_t.academic"), has(full, rules.private)), "academic": F.when(~F.col("_t.private_org") & ~F.col("_t.academic"), has(body, rules.academic)),
        "remote": F.when(by_body, has(full, rules.remote_phrase)), "hybrid": F.when(by_body, has(full, rules.hybrid_phrase)),
    })
    return found.drop("_a")


def with_matches(postings: DataFrame, rules: RuleSet) -> DataFrame:
    """postings with _t and _f, which are found once for each different text."""
    return for_each_different(postings, TEXTS, lambda texts: _searched(texts, rules))


def _route() -> Column:
    """Which rule settles the specialty: a key of the rules' reasons, or null."""
    a, b = F.col("_f.a"), F.col("_f.b")  # null unless an attending physician's title names no specialty
    return (
        F.when(F.col("_t.other") & ~F.col("_t.ours"), F.lit(None).cast("string"))
        .when(F.col("_t.a"), "a_title").when(F.col("_t.b"), "b_title").when(F.col("_t.ir"), "ir_title")
        .when(a & ~b, "a_body").when(b & ~a, "b_body").when(a & b, "both")
    )


def setting() -> Column:
    """By strength of evidence; the employer's name outranks its prose."""
    return (
        F.when(F.col("_f.government"), "government").when(F.col("_t.private_org"), "private").when(F.col("_t.academic"), "academic")
        .when(F.col("_f.private"), "private").when(F.col("_f.academic"), "academic").when(_text("org") != "", "hospital-employed").otherwise("unknown")
    )


def work_model() -> Column:
    """The title outranks the location, which outranks prose."""
    return (
        F.when(F.col("_t.remote"), "remote").when(F.col("_t.onsite"), "onsite").when(F.col("_t.hybrid"), "hybrid")
        .when(F.col("_remote_place") | F.col("_f.remote"), "remote").when(F.col("_f.hybrid"), "hybrid").otherwise("onsite")
    )


def classify(postings: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """After a rule set, the default one if none is given: postings with specialty (a, b or null), is_attending, is_interventional, is_locum, is_leadership, setting, work_model and reasons."""
    rules = rules or default()
    return classified(with_matches(postings, rules), rules)


def classified(matched: DataFrame, rules: RuleSet) -> DataFrame:
    """classify of postings that have _t and _f."""
    df = once(matched, "_p", {"remote_place": has(ascii_words(_text("location")), rules.remote_place)})
    df = df.withColumns({"_route": _route(), "_remote_place": F.col("_p.remote_place")})
    specialty = F.when(F.col("_route").isin("a_title", "a_body"), "a").when(F.col("_route").isin("b_title", "ir_title", "b_body"), "b")
    df = df.withColumn("specialty", specialty)
    why = F.element_at(F.create_map(*(F.lit(x) for kv in rules.reasons.items() for x in kv)), F.col("_route"))
    attending = F.col("_t.attending")
    df = df.withColumns({
        "is_attending": attending, "is_interventional": F.col("_t.ir") | (F.coalesce(F.col("specialty") == "b", F.lit(False)) & F.col("_f.ir")),
        "is_locum": F.col("_t.locum"), "is_leadership": attending & F.col("specialty").isNotNull() & F.col("_t.leadership"),
        "setting": setting(), "work_model": work_model(),
        "reasons": F.array_compact(F.array(F.when(~attending, rules.reasons["not_attending"]), why)),
    })
    return df.drop("_t", "_f", "_p", "_route", "_remote_place")


def is_relevant() -> Column:
    return F.col("is_attending") & F.col("specialty").isNotNull()
