"""Scalar text rules as Column builders: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words whose presence marks a negation, as sought in memories and in merges.
NEGATIONS = ("not", "no", "never", "false", "wrong", "instead")
MERGE_NEGATIONS = ("not ", "no ", "never ", "false", "wrong", "instead", "switched", "changed")
# Temporal classes of facts and their half-lives in days.
TEMPORAL_DAYS = {"permanent": 3650.0, "long_term": 90.0, "short_term": 30.0, "ephemeral": 7.0}
# Half-lives in days by entity type; any other type has 30.
TYPE_DAYS = {
    "person": 90.0, "user": 90.0, "preference": 90.0, "like": 90.0, "dislike": 90.0, "location": 90.0, "place": 90.0,
    "organization": 90.0, "company": 90.0, "technology": 3650.0, "language": 3650.0, "framework": 3650.0,
    "project": 30.0, "task": 30.0, "event": 7.0, "meeting": 7.0,
}


def tokens(text: Column) -> Column:
    """Index terms: lower case, letters, digits and white space only, split, at least two bytes."""
    plain = F.regexp_replace(F.lower(text), r"(?U)[^\p{IsAlphabetic}\p{N}\s]", "")
    return F.filter(F.split(plain, r"(?U)\s+"), lambda x: F.octet_length(x) >= 2)


def words(text: Column) -> Column:
    """White-space words, as they stand."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def snippet(text: Column, most: int = 100) -> Column:
    """The trimmed text, or its first ``most`` characters cut back to the last space, and dots."""
    t = F.trim(text)
    head = F.substring(t, 1, most)
    whole = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.when(whole == "", head).otherwise(whole), F.lit("...")))


def configured_tokens(text: Column, factor: float = 1.3, overhead: int = 3) -> Column:
    return (F.size(words(text)) * F.lit(factor)).cast("long") + overhead


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def has_any(text: Column, marks: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds any of the literal marks."""
    low = F.lower(text)
    out = F.lit(False)
    for mark in marks:
        out = out | low.contains(mark)
    return out


def negated(text: Column) -> Column:
    return has_any(text, NEGATIONS)


def provenance_penalty(source: Column) -> Column:
    return F.when(source.contains("import") | source.contains("external"), 0.1).otherwise(0.0)


def sanitize(text: Column, most: int = 50_000) -> Column:
    """Bounded prompt text without NUL, line ends as line feeds."""
    return F.regexp_replace(F.replace(F.substring(text, 1, most), F.lit("\0"), F.lit("")), r"\r\n?", "\n")


def json_span(text: Column) -> Column:
    """The span from the first opening to the last closing brace; empty if there is none."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def render(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), value.cast("string"))
    return out


def slugify(text: Column) -> Column:
    """ASCII-lower alphanumerics, anything else a dash, double dashes folded once, trimmed."""
    dashed = F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"(?U)[^\p{IsAlphabetic}\p{N}]", "-")
    return F.regexp_replace(F.replace(dashed, F.lit("--"), F.lit("-")), r"^-+|-+$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(text: Column) -> Column:
    return F.substring(content_hash(text), 1, 7)


def op_type(kind: Column, name: Column) -> Column:
    return F.concat_ws(":", kind, name)


def temporal_class(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low.isin(*TEMPORAL_DAYS), low).otherwise("short_term")


def temporal_days(value: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TEMPORAL_DAYS.items() for x in pair])
    return table[temporal_class(value)]


def type_half_life(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TYPE_DAYS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(kind)), F.lit(30.0))


def capitalized(text: Column, most: int = 5) -> Column:
    """The first capitalized phrases that are not mere pronouns or articles."""
    found = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), F.lit(1))
    return F.slice(F.filter(found, lambda x: ~x.isin(*NO_ENTITIES)), 1, most)


# Capitalized words that name nothing; months and days in time expressions.
NO_ENTITIES = ("I", "The", "A", "An", "This", "That", "It", "He", "She", "We", "They")
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
TIME_PATTERNS = {
    "date": rf"(?i)\b((?:{MONTHS})[\s,]+\d{{1,2}}(?:[\s,]+\d{{4}})?)\b",
    "year": r"(?i)\b((?:in\s+)?(?:19|20)\d{2})\b",
    "relative": rf"(?i)\b((?:last|next|this)\s+(?:week|month|year|{DAYS}))\b",
    "day": rf"(?i)\b({DAYS})\b",
}


def time_expressions(text: Column) -> Column:
    """Structs (kind, value): dates, then years, relative times, and weekdays."""
    def found(kind, pattern):
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.concat(*[found(k, p) for k, p in TIME_PATTERNS.items()])


# What makes a message worth keeping, what makes it noise, and what raises its importance.
IMPORTANT = (
    r"(?:remember|note|important|don't forget|make sure to)",
    r"(?:my name is|i am|i'm)\s+\w+",
    r"(?:i prefer|i like|i hate|i love)",
    r"(?:user's|my)\s+(?:name|preference|location|timezone)",
    r"(?:set|create|add)\s+(?:a\s+)?(?:reminder|task|event)",
    r"(?:todo|to-do|task).*?:",
    r"(?:@\w+|mentions?)\s*:",
)
NOISE = (
    r"^[\s\n]*$",
    r"^(?:hello|hi|hey|okay|ok|yes|no|yep|nope)[\s\.\!]*$",
    r"^[\s]*(?:thanks?|thank you|cheers)[\s\!]*$",
    r"^(?:what|how|when|where|why|who|which)\s+\w+.*\?$",
    r"^(?:can you|could you|would you|please)\s+\w+",
)
WEIGHTY = ("remember", "important", "don't forget", "preference", "name is", "always", "never", "task", "todo", "deadline")
TAG_PATTERNS = {
    "topic": r"(?i)(?:about|topic|subject)\s*:?\s*(\w+)",
    "event": r"(?i)(?:meeting|call|event)\s*:?\s*([^\n]+)",
    "task": r"(?i)(?:task|todo)\s*:?\s*([^\n]+)",
}


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike("(?i)" + p)
    return out


def worth_keeping(text: Column) -> Column:
    size = F.length(F.trim(text))
    return F.when(matches_any(text, IMPORTANT), True).when(matches_any(text, NOISE), False).otherwise(size > 100)


def message_importance(text: Column) -> Column:
    size = F.length(F.trim(text))
    score = F.lit(0.5) + F.when(size > 200, 0.2).when(size < 50, -0.1).otherwise(0.0)
    for word in WEIGHTY:
        score = score + F.when(F.lower(text).contains(word), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def message_tags(text: Column, most: int = 5) -> Column:
    """Hash tags and at most two topics, events and tasks; sorted, so the choice of five is stable."""
    def found(kind, pattern):
        hits = F.filter(F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), 1, 2), lambda m: F.length(m) > 2)
        return F.transform(hits, lambda m: F.concat(F.lit(kind + ":"), F.substring(F.lower(m), 1, 20)))

    tags = [F.transform(F.regexp_extract_all(text, F.lit(r"#(\w+)"), F.lit(1)), lambda t: F.concat(F.lit("tag:"), F.lower(t)))]
    tags += [found(k, p) for k, p in TAG_PATTERNS.items()]
    return F.slice(F.array_sort(F.array_distinct(F.concat(*tags))), 1, most)


# Relation patterns of a subject, a relation and an object.
RELATIONS = (
    (r"([A-Z][a-z]+)\s+(?:is|was)\s+(?:a|an)?\s*([a-z]+)\s+(?:of|at|in)\s+([A-Z][a-z]+)", None),
    (r"([A-Z][a-z]+)\s+(?:works?|worked)\s+(?:at|for)\s+([A-Z][a-z]+)", "works_at"),
    (r"([A-Z][a-z]+)\s+(?:moved|went)\s+to\s+([A-Z][a-z]+)", "moved_to"),
)


def triples(text: Column) -> Column:
    """Structs (subject, relation, object) of all patterns."""
    def found(pattern, name):
        group = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
        relation = group(2) if name is None else F.transform(group(1), lambda _: F.lit(name))
        zipped = F.arrays_zip(group(1).alias("subject"), relation.alias("relation"), group(3 if name is None else 2).alias("object"))
        return F.transform(zipped, lambda t: F.struct(t["subject"].alias("subject"), t["relation"].alias("relation"), t["object"].alias("object")))

    return F.concat(*[found(p, name) for p, name in RELATIONS])
