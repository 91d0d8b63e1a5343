"""Text functions: words, trigrams, patterns, redaction, digests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PrivacyError

MARK = "[redacted]"
REDACTED_AT_ONCE = 64

#: Where a word begins, and white space, spelled out: engines disagree on their short forms.
EDGE = r"(?<![\p{L}\p{N}_])"
SPACE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

#: Sensitive shapes in the order in which they are replaced (fixed values).
REDACTIONS = (
    (EDGE + r"(?:sk|pk|rk)_live_[A-Za-z0-9]+", MARK),
    (EDGE + r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", MARK),
    (EDGE + r"github_pat_[A-Za-z0-9_]+", MARK),
    ("(?i)" + EDGE + "authorization" + SPACE + "*:" + SPACE + "*bearer" + SPACE + "+[A-Za-z0-9._~-]+", f"{MARK} {MARK}"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", MARK),
    (r"[A-Za-z]:\\[A-Za-z0-9_ .~\\-]+", MARK),
    (r"/[A-Za-z0-9_.~/-]+", MARK),
)

#: Audit categories and their patterns (fixed values).
AUDIT = {
    "private_key": r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----",
    "github_token": r"\b(?:gh[pousr]_[A-Za-z0-9_\-]{20,}|github_pat_[A-Za-z0-9_]{20,})\b",
    "aws_access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "provider_live_key": r"\b(?:sk|pk|rk)_live_[A-Za-z0-9_\-]{16,}\b",
    "bearer_token": r"\bBearer\s+[A-Za-z0-9._\-+/=]{20,}",
    "credential_assignment": r"(?i)\b(?:password|passwd|secret|api[_-]?key)\s*[=:]\s*(?:\"[^\"\n]{8,}\"|'[^'\n]{8,}'|[A-Za-z0-9][A-Za-z0-9_\-+/=]{15,})",
    "host_path": r"(?:/home/[^\s'\"`]+|/Users/[^\s'\"`]+|/root/[^\s'\"`]+|~/(?:\.ssh|\.aws)(?:/[^\s'\"`]*)?)",
    "private_ipv4": r"\b(?:10\.(?:\d{1,3}\.){2}\d{1,3}|192\.168\.(?:\d{1,3}\.)\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.(?:\d{1,3}\.)\d{1,3})\b",
    "email_in_blob": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "us_ssn": r"\b\d{3}-\d{2}-\d{4}\b",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def lexemes(text: Column | str) -> Column:
    """Distinct words with their 1-based positions: array<struct<lexeme, positions>>."""
    tokens = words(text)
    return F.transform(
        F.array_sort(F.array_distinct(tokens)),
        lambda w: F.struct(w.alias("lexeme"), F.filter(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.element_at(tokens, i) == w).alias("positions")),
    )


def query_terms(text: Column | str) -> Column:
    """Terms of a conjunctive query: split at white space, operators stripped, then words."""
    bare = F.regexp_replace(_col(text), r"['&|!()]", " ")
    return F.array_distinct(words(bare))


def trigrams(text: Column | str) -> Column:
    """Distinct trigrams of the words, each padded with two blanks before and one after."""
    return F.array_distinct(
        F.flatten(F.transform(words(text), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    )


def similarity(a: Column | str, b: Column | str) -> Column:
    """Share of common trigrams; 0 where there are none."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def escape_like(value: str) -> str:
    """A user's string with LIKE wildcards taken literally."""
    for c in "\\%_":
        value = value.replace(c, "\\" + c)
    return value


def contains_fold(text: Column | str, needle: Column | str) -> Column:
    """Case-insensitive substring test without patterns."""
    return F.contains(F.lower(_col(text)), F.lower(_col(needle)))


def redact(text: Column | str) -> Column:
    """Replace every recognised sensitive shape."""
    out = _col(text)
    for pattern, mark in REDACTIONS:
        out = F.regexp_replace(out, pattern, mark)
    return out


def redact_tree(value: Column, schema) -> Column:
    """Redact every string inside arrays, structs and map values; keys stay."""
    from pyspark.sql import types as T

    if isinstance(schema, T.StringType):
        return redact(value)
    if isinstance(schema, T.ArrayType):
        return F.transform(value, lambda x: redact_tree(x, schema.elementType))
    if isinstance(schema, T.MapType):
        return F.transform_values(value, lambda _, v: redact_tree(v, schema.valueType))
    if isinstance(schema, T.StructType):
        own = F.struct(*(redact_tree(value[f.name], f.dataType).alias(f.name) for f in schema.fields))
        return F.when(value.isNotNull(), own)
    return value


def redact_json(text: Column | str) -> Column:
    """Redact the strings of JSON of any depth; text that is no JSON is redacted whole.

    A task holds one batch of texts and what became of a slice of it.
    """

    patterns, slice_rows = list(REDACTIONS), REDACTED_AT_ONCE

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import json

        import regex

        rules = [(regex.compile(p), m) for p, m in patterns]

        def clean(v):
            if isinstance(v, str):
                for p, m in rules:
                    v = p.sub(m, v)
                return v
            if isinstance(v, list):
                return [clean(x) for x in v]
            return {k: clean(x) for k, x in v.items()} if isinstance(v, dict) else v

        def one(t):
            if t is None:
                return None
            try:
                return json.dumps(clean(json.loads(t)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            except ValueError:
                return clean(t)

        for texts in batches:
            for at in range(0, len(texts), slice_rows):
                yield pa.array([one(t.as_py()) for t in texts.slice(at, slice_rows)], pa.string())

    return run(_col(text))


def minimize(value: str) -> str:
    """Redact one string on the driver; anything but a string is refused."""
    import regex

    if not isinstance(value, str):
        raise PrivacyError("a string is needed", code="invalid_minimize_input")
    for pattern, mark in REDACTIONS:
        value = regex.sub(pattern, mark, value)
    return value


def audit_matches(text: Column | str) -> Column:
    """First match of each category that occurs: array<struct<category, match>>.

    Of the homes' private folders in ``host_path`` only the two of general tools are listed.
    """
    text = _col(text)
    found = [F.struct(F.lit(name).alias("category"), F.regexp_substr(text, F.lit(pattern)).alias("match")) for name, pattern in AUDIT.items()]
    return F.filter(F.array(*found), lambda x: x["match"].isNotNull())


#: Domains, hosts and values that documentation uses (fixed values).
SAMPLE_DOMAINS = (".example", ".invalid", ".test")
SAMPLE_VALUES = ("password", "secret", "xxx", "<redacted>")
SAMPLE_PREFIXES = ("test-", "fake-", "fixture-", "example-")


def audit_blocking(category: Column | str, match: Column | str) -> Column:
    """False for documented examples, which are reported but do not block."""
    category, match = _col(category), _col(match)
    domain = F.lower(F.substring_index(match, "@", -1))
    value = F.regexp_replace(F.regexp_replace(match, "^[^=]*=", ""), "^[^:]*:", "")  # after the first of each
    value = F.lower(F.regexp_replace(F.trim(value), "^[\"']+|[\"']+$", ""))

    def any_of(tests):
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out

    sample = (
        F.when(category == "email_in_blob", any_of(domain.endswith(d) for d in SAMPLE_DOMAINS))
        .when(category == "credential_assignment", value.isin(*SAMPLE_VALUES) | any_of(value.startswith(p) for p in SAMPLE_PREFIXES))
        .otherwise(F.lit(False))
    )
    return ~sample


def squeeze(text: Column | str) -> Column:
    """White-space runs as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def preview(text: Column | str, size: int = 500) -> Column:
    text = _col(text)
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def short_hash(text: Column | str, size: int = 16) -> Column:
    return F.substring(F.sha2(_col(text), 256), 1, size)


def cjk_chars(text: Column | str) -> Column:
    """Number of unified ideographs."""
    return F.regexp_count(_col(text), F.lit(r"[\x{4E00}-\x{9FFF}]"))
