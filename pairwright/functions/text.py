"""Text and identity scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that employer keys leave out, for merging and, fewer, for pairs.
PAIR_ORG_WORDS = ("the", "inc", "llc", "ltd", "corp", "co", "company", "health", "healthcare", "system", "systems", "medical", "center", "centre", "group", "hospital", "university")
MERGE_ORG_WORDS = (*PAIR_ORG_WORDS, "clinic", "associates", "partners")
#: A word boundary of ASCII words, on any JVM.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def java(pattern: str, ignore_case: bool = True) -> str:
    """A pattern written with \\b for ASCII words, as Java's regex reads it the same way."""
    return ("(?i)" if ignore_case else "") + pattern.replace(r"\b", EDGE)


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(java(pattern))


def any_match(text: Column, patterns: list[str]) -> Column:
    return matches(text, "|".join(f"(?:{p})" for p in patterns))


def ascii_words(text: Column) -> Column:
    """The text with a ~ for every character outside ASCII, so that \\b of any JVM goes by ASCII words; '' for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F]", "~")


def has(ascii_text: Column, patterns: str | list[str]) -> Column:
    """Whether one of the patterns is found in a text of ascii_words()."""
    patterns = [patterns] if isinstance(patterns, str) else patterns
    if len(patterns) > 1 and all(p.startswith(r"\b") and "|" not in p for p in patterns):  # one look for a word's edge
        return ascii_text.rlike(r"(?i)\b(?:" + "|".join(p[2:] for p in patterns) + ")")
    return ascii_text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def once(df: DataFrame, name: str, columns: dict[str, Column]) -> DataFrame:
    """df and a struct of columns, each computed once: a generator, through which no filter or projection copies them."""
    return df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias(name))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def norm(text: Column) -> Column:
    """Lower case, everything but a-z and 0-9 to one blank, trimmed; '' for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def _org_key(text: Column, words: tuple[str, ...]) -> Column:
    return squeeze(F.regexp_replace(norm(text), java(rf"\b({'|'.join(words)})\b", False), " "))


def merge_org_key(text: Column) -> Column:
    return _org_key(text, MERGE_ORG_WORDS)


def pair_org_key(text: Column) -> Column:
    return _org_key(text, PAIR_ORG_WORDS)


def fingerprint(org: Column, title: Column, city: Column, url: Column) -> Column:
    """Identity of a role; without an employer its URL stands in."""
    owner = F.when(F.coalesce(org, F.lit("")) != "", org).otherwise(F.concat(F.lit("url:"), F.coalesce(url, F.lit(""))))
    return F.concat_ws("::", merge_org_key(owner), norm(title), norm(city))


def html_to_text(html: Column) -> Column:
    """Scripts and styles go, line breaks and ends of blocks become new lines, other tags blanks."""
    plain = F.coalesce(html, F.lit(""))
    codes = [(r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " ")]
    tags = [(r"(?i)<(?:br\s*/?|/(?:p|div|li|h[1-6]|tr))>", "\n"), (r"<[^>]+>", " ")]
    names = [("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"')]

    def replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
        for pattern, by in steps:
            text = F.regexp_replace(text, pattern, by)
        return text

    coded = plain.rlike("(?i)<s(?:cript|tyle)")
    untagged = F.when(~plain.contains("<"), plain).otherwise(replaced(F.when(coded, replaced(plain, codes)).otherwise(plain), tags))
    # decimal references, only where there are any
    point = r"^(\d{1,7});"
    decoded = F.transform(F.split(replaced(untagged, names), "&#"), lambda p, i: F.when(i == 0, p).when(p.rlike(point), F.concat(_character(F.regexp_extract(p, point, 1)), F.regexp_replace(p, point, ""))).otherwise(F.concat(F.lit("&#"), p)))
    text = F.when(~plain.contains("&"), untagged).when(plain.contains("&#") | plain.rlike("(?i)&amp;#"), F.array_join(decoded, "")).otherwise(replaced(untagged, names))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}|\t", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    # texts that none of this would change are most
    return F.when(plain.rlike(r"[<&\t]|  |\n{3}|^\s|\s$"), text).otherwise(plain)


def _character(digits: Column) -> Column:
    """The character of the lower sixteen bits of a number."""
    code = digits.cast("int").bitwiseAND(0xFFFF)
    return F.when(code > 0, F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")).otherwise("")


#: Letters with accents and their plain forms, as far as place names need them.
_ACCENTS = ("àáâãäåāăąçćčďèéêëēĕėęěìíîïĩīĭįñńňòóôõöøōŏőŕřśšşťţùúûüũūŭůűýÿźżžğĝģķĺļľḥṣṭẓ", "aaaaaaaaacccdeeeeeeeeeiiiiiiiinnnooooooooorrssstt" + "uuuuuuuuu" + "yyzzzggg" + "klll" + "hstz")


def plain_letters(text: Column) -> Column:
    low, plain = _ACCENTS
    text = F.regexp_replace(text, "[\\u0300-\\u036f]", "")
    return F.translate(text, low + low.upper(), plain + plain.upper())


def place_key(text: Column) -> Column:
    """Canonical form of a place name: plain lower-case words, with saint, mount and fort written out."""
    text = F.lower(plain_letters(F.coalesce(text, F.lit(""))))
    text = F.regexp_replace(F.regexp_replace(text, "[.'`‘’]", ""), "[^a-z0-9]+", " ")
    for short, full in (("st", "saint"), ("mt", "mount"), ("ft", "fort")):
        text = F.regexp_replace(text, java(rf"\b{short}\b", False), full)
    return squeeze(text)


#: Other spellings of cities, by place_key.
CITY_ALIASES = {
    "nyc": "new york city", "manhattan": "new york city", "brooklyn": "new york city", "the bronx": "new york city",
    "queens": "new york city", "staten island": "new york city", "washington dc": "washington", "washington d c": "washington",
    "dc": "washington", "philly": "philadelphia", "the woodlands": "houston", "makkah": "mecca", "madinah": "medina",
    "al madinah": "medina", "jiddah": "jeddah", "ad dammam": "dammam", "al hasa": "hofuf", "al ahsa": "hofuf",
    "umm al quwain": "umm al qaywayn", "sharjah city": "sharjah", "al kuwait": "kuwait city", "kuwait": "kuwait city",
}
_ARTICLE = r"^(al|ar|as|ad|at|az|an|el)\s+"


def with_key_variants(df: DataFrame, name: str, text: Column) -> DataFrame:
    """Adds every key that a place goes by, best first: with and without " city" and the Arabic article, then its alias."""
    aliases = F.create_map(*(F.lit(x) for kv in CITY_ALIASES.items() for x in kv))
    df = df.withColumn("_base", place_key(text)).withColumn("_alias", F.element_at(aliases, F.col("_base")))

    def spread(c: str) -> list[Column]:
        return [F.col(c), F.regexp_replace(c, r"\s+city$", ""), F.regexp_replace(c, _ARTICLE, ""), F.regexp_replace(F.regexp_replace(c, _ARTICLE, ""), r"\s+city$", "")]

    keys = F.array_distinct(F.array_compact(F.array(*spread("_base"), *spread("_alias"))))
    return df.withColumn(name, F.filter(keys, lambda k: k != "")).drop("_base", "_alias")


def clean_place(text: Column) -> Column:
    """Letters, digits, blanks and , ; / & ( ) - of a location."""
    return squeeze(F.regexp_replace(plain_letters(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s,;/&()\-]", " "))


#: A place at the end of a title: after a dash, or in brackets.
TITLE_PLACE = r"[–—-]\s*([A-Z][A-Za-z.'\- ]+,\s*(?:[A-Z]{2}|[A-Z][a-z]+(?: [A-Z][a-z]+)*))\s*$|\(([^)]+,\s*[^)]+)\)\s*$"


def clean_title(title: Column) -> Column:
    title = F.regexp_replace(F.coalesce(title, F.lit("")), TITLE_PLACE, "")
    return F.trim(F.regexp_replace(F.regexp_replace(title, r"\s{2,}", " "), r"[\s–—-]+$", ""))


def to_date(text: Column) -> Column:
    """ISO dates and times, and RFC 822 ones; null for anything else."""
    text = F.trim(text)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.to_date(text.try_cast("timestamp")))
    bare = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    mail = F.when(bare.rlike(r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} (GMT|UTC|[+-]\d{4})$"), F.to_date(F.try_to_timestamp(F.regexp_replace(bare, " (GMT|UTC)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))))
    return F.coalesce(iso, mail)


def age_days(posted: Column, today: Column) -> Column:
    """Days since posting, 0 at least; null without a date."""
    return F.when(posted.isNotNull(), F.greatest(F.lit(0), F.datediff(today, posted)))


def gap_days(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(F.datediff(a, b)), F.lit(0))


#: Addresses and numbers, and addresses that are never a person's.
NOISE_EMAIL = r"(noreply|no-reply|donotreply|webmaster|postmaster|privacy|legal|unsubscribe|support@|example\.|sentry\.|\.png|\.jpg)"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}\b|\+\d{3}[\s-]?\d{3,4}[\s-]?\d{4}\b"


def emails(text: Column, noise: str | None = NOISE_EMAIL, most: int = 4) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java(EMAIL, False)), F.lit(0)))
    return F.slice(F.filter(found, lambda e: ~F.lower(e).rlike(noise)) if noise else found, 1, most)


def phones(text: Column, most: int = 3) -> Column:
    """Distinct phone numbers that are written with a separator."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java(PHONE, False)), F.lit(0)), lambda p: F.trim(p))
    return F.slice(F.array_distinct(F.filter(found, lambda p: p.rlike(r"[()\s.+-]"))), 1, most)


def dial(phone: Column) -> Column:
    return F.regexp_replace(phone, r"[^\d+]", "")


def url_component(text: Column) -> Column:
    """As encodeURIComponent: blanks as %20, and !'()*~ as they are."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, c in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(c))
    return out


def excerpt(text: Column, most: int = 220) -> Column:
    """The first words that fit, with an ellipsis where some are left out."""
    flat = squeeze(F.coalesce(text, F.lit("")))
    cut = F.regexp_replace(F.substring(flat, 1, most), r"\s+\S*$", "")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(cut, F.lit("…")))
