"""Names and labels in findings: rule ids, categories, CWEs, severities, symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Category words, the first that is found decides.
CATEGORIES = [
    ("injection", r"sql|injection|command|\bexec\b"), ("xss", "xss|cross-site"), ("ssrf", "ssrf|request forgery"), ("path-traversal", "path|traversal|zip-?slip"),
    ("deserialization", "deserial|pickle|yaml.load"), ("secrets", "secret|credential|password|api.?key"), ("crypto", "crypto|cipher|hash|md5|sha1"), ("ai", "prompt|llm|model"),
]
#: CWE families: numbers that name one issue.
FAMILIES = {"injection": [74, 77, 78, 89, 94, 95], "path": [22, 23, 36, 73], "xss": [79, 80], "deserialization": [502], "secrets": [259, 321, 522, 798], "ssrf": [918, 441]}
REDACTED = [
    (r"(?i)((?:password|passwd|secret|token|api_?key)\s*[:=]\s*['\"]?)[^\s'\"]{6,}", "$1<redacted>"),
    (r"AKIA[A-Z0-9]{14,}", "<redacted>"),
    (r"gh[pousr]_[A-Za-z0-9]{36}", "<redacted>"),
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "<redacted>"),
]
ORIGINS = [("remote", 0.9, r"request|params|query|body|headers|cookies"), ("model", 0.7, r"completion|response\.choices|generate\("), ("operator", 0.4, r"argv|environ|getenv|config")]


def bare_rule_id(rule: Column) -> Column:
    """The last part of a dotted id; ids from outside that end in -external stay whole."""
    return F.when(rule.endswith("-external"), rule).otherwise(F.element_at(F.split(rule, r"\."), -1))


def category_of(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(F.lit(False), "")
    for name, words in CATEGORIES:
        out = out.when(low.rlike(words), name)
    return out.otherwise("general")


def cwes(text: Column) -> Column:
    """The numbers of all CWE-n in a text, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)cwe-?(\d+)"), F.lit(1)), lambda x: x.cast("int")))


def cwe_family(cwe: Column) -> Column:
    """The first family that one of the numbers belongs to, or NULL."""
    return F.coalesce(*(F.when(F.arrays_overlap(cwe, F.array(*map(F.lit, numbers))), name) for name, numbers in FAMILIES.items()))


def redacted(text: Column) -> Column:
    for found, becomes in REDACTED:
        text = F.regexp_replace(text, found, becomes)
    return text


def severity_of_score(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise("info")


def symbols(text: Column, most: int = 20) -> Column:
    """Function names in advisory texts: in code spans, or dotted and called. ``most`` of them at most, in order."""
    spans = F.regexp_extract_all(text, F.lit(r"`([A-Za-z_][\w.]*)(?:\(\))?`"), F.lit(1))
    called = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_]\w*(?:\.\w+)+)\("), F.lit(1))
    return F.slice(F.array_distinct(F.concat(spans, called)), 1, most)


def format_verbs(text: Column) -> Column:
    """The verbs of a printf format, '%%' left out."""
    return F.regexp_extract_all(F.replace(text, F.lit("%%"), F.lit("")), F.lit(r"%[-+ #0]*[0-9*]*(?:\.[0-9*]+)?([a-zA-Z])"), F.lit(1))


def numeric_only(text: Column) -> Column:
    """Does a format take numbers only?"""
    return F.forall(format_verbs(text), lambda v: v.isin(*"bcdoxXeEfFgGuU"))


def origin(text: Column) -> Column:
    """struct(label, confidence) of the first source that a text names; unknown at 0.2."""
    kinds = [F.when(text.rlike(words), F.struct(F.lit(name).alias("label"), F.lit(conf).alias("confidence"))) for name, conf, words in ORIGINS]
    return F.coalesce(*kinds, F.struct(F.lit("unknown").alias("label"), F.lit(0.2).alias("confidence")))
