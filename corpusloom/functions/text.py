"""Column functions for cleaning and describing texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the keyword counts.
STOP_WORDS = (
    "the", "and", "or", "is", "in", "to", "of", "a", "for", "with", "as", "on", "by", "this",
    "that", "it", "are", "be", "an", "at", "from", "can", "will", "has", "have", "not",
    "we", "you", "they", "our", "your", "their", "which", "what", "how", "if", "but", "all",
)
#: Patterns of each document type, in order of precedence.
DOC_TYPES = {
    "Policy": (r"\bpolicy\b", r"\bcompliance\b", r"\bguidelines\b", r"\bhandbook\b"),
    "FAQ": (r"\bfaq\b", r"\bfrequently asked questions\b", r"\bq\s*&\s*a\b"),
    "Architecture": (r"\barchitecture\b", r"\bsystem design\b", r"\btechnical spec\b", r"\bmicroservices\b"),
    "Procedure": (r"\bprocedure\b", r"\bhow to\b", r"\bstep-by-step\b", r"\bworkflow\b"),
    "Report": (r"\breport\b", r"\banalysis\b", r"\bsummary\b", r"\bmetrics\b"),
}
#: Terms of each topic.
TOPICS = {
    "Cloud": ("aws", "azure", "gcp", "cloud computing", "docker", "kubernetes"),
    "Ai": ("artificial intelligence", "machine learning", "llm", "rag", "neural network"),
    "Hr": ("leave", "payroll", "benefits", "reimbursement", "vacation"),
    "Security": ("cybersecurity", "infosec", "iso27001", "authentication", "zero trust"),
}
#: Patterns of each content flag.
FLAGS = {
    "contains_faq": r"\bfaq\b|\bfrequently asked questions\b|\bq\s*&\s*a\b",
    "contains_workflow": r"\bworkflow\b|\bprocess flow\b|\bstep \d+\b",
    "contains_architecture": r"\barchitecture\b|\bsystem design\b",
}
#: Fixed value: pattern of a technical name.
TECH = r"\b(?:[A-Z][a-z]*){1,}(?:[A-Z]|[0-9]+)\b"


def clean_unicode(text: Column) -> Column:
    """Without byte order marks and zero-width characters."""
    return F.regexp_replace(text, r"[​-‍﻿]", "")


def normalize_punct(text: Column) -> Column:
    """Plain quotes and dashes; four or more dots become three."""
    return F.regexp_replace(F.translate(text, "’‘”“–—", "''\"\"--"), r"\.{4,}", "...")


def repair_hyphenation(text: Column) -> Column:
    """Words that a line break parted at a hyphen are joined."""
    return F.regexp_replace(text, r"(?U)(\w+)-\s*\n\s*(\w+)", "$1$2")


def merge_wrapped_lines(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=[a-zA-Z,])\n(?=[a-z])", " ")


def drop_ocr_singletons(text: Column) -> Column:
    """Single letters other than a and i between blanks go."""
    return F.regexp_replace(text, "(?<= )[b-hj-zB-HJ-Z](?= )", "")


def collapse_whitespace(text: Column) -> Column:
    """One blank between words, lines stripped, no more than one empty line in a row."""
    # The line-wise steps as three expressions over the whole text: no array of lines is built.
    flat = F.regexp_replace(F.translate(text, "\r", ""), "[ \t]+", " ")
    stripped = F.regexp_replace(flat, r"(?m)^[ \x0b\f]+|[ \x0b\f]+$", "")
    return F.regexp_replace(F.regexp_replace(stripped, "\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def sanitize_extracted(text: Column) -> Column:
    """Without standalone page numbers, dot leaders and runs of empty lines."""
    pages = F.regexp_replace(text, r"(?im)^Page[ \t]+\d+[ \t]*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(pages, r"\.{4,}", "..."), "\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def clean_page(text: Column) -> Column:
    """All steps for one page, in their fixed order."""
    for step in (clean_unicode, normalize_punct, repair_hyphenation, merge_wrapped_lines, drop_ocr_singletons, collapse_whitespace):
        text = step(text)
    return text


def sentences(text: Column) -> Column:
    """Parts after . ! or ? and white space; empty ones go."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)


def clean_markdown_excerpt(text: Column, most: int = 3) -> Column:
    """Brackets, tags and marks stripped; the first sentences."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\[.*?\]|<[^>]+>", " "), r"[#*|_`]", "")
    return F.array_join(F.slice(sentences(F.trim(F.regexp_replace(bare, r"\s+", " "))), 1, most), " ")


def doc_type(text: Column, filename: Column) -> Column:
    """The type with most points: 5 a pattern found in the filename, 1 a match in the text; ties by precedence."""
    low, name = F.lower(text), F.lower(filename)
    scores = []
    for rank, (kind, patterns) in enumerate(DOC_TYPES.items()):
        points = sum((F.when(name.rlike(p), 5).otherwise(0) + F.regexp_count(low, F.lit(p)) for p in patterns), F.lit(0))
        scores.append(F.struct(points.alias("points"), F.lit(-rank).alias("rank"), F.lit(kind).alias("kind")))
    best = F.array_max(F.array(*scores))
    return F.when(best["points"] > 0, best["kind"]).otherwise("General Document")


def topics(text: Column) -> Column:
    low = F.lower(text)
    has = lambda terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))
    found = F.filter(F.array(*[F.when(has(terms), k) for k, terms in TOPICS.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("General")))


def content_flags(text: Column) -> list[Column]:
    return [F.lower(text).rlike(p).alias(k) for k, p in FLAGS.items()]


def tech_entities(text: Column, most: int = 15) -> Column:
    """Distinct capitalised words that end in a capital or digits, in order of appearance."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(TECH), F.lit(0))), 1, most)


def markdown_title(text: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#[ \t]+(.+)$", 1)), F.lit("")), name)


def paragraphs(text: Column) -> Column:
    """Between empty lines, stripped; empty ones go."""
    return F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"\A\s+|\s+\z", "")), lambda p: F.length(p) > 0)


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def content_words(text: Column, shortest: int = 1) -> Column:
    """Distinct lower-cased words (a-z, 0-9) without stop words, in order."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.array_except(words, stop), lambda w: F.length(w) >= shortest)
