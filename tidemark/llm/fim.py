"""Fill-in-middle transformation by Arrow-batched pandas functions.

A text is cut into units - white space with the word after it, or white space
at the end - whose end offsets are collected by one ``finditer`` of the
``regex`` library into a compact array; two lookups in it give the code points
where prefix and middle end. The draws come from a SHA-256 of the seed and the
row's id, so they depend neither on the partition nor on the run.

Forms: ``plain`` (the text itself), ``psm`` (prefix, suffix, middle) and
``spm`` (suffix, prefix, middle). A text that holds a sentinel stays plain,
which makes every output exactly reversible (:func:`restore`).

There is no shuffle; a task holds one Arrow batch, which Spark bounds in rows
and, by ``spark.sql.execution.arrow.maxBytesPerBatch``, in bytes.

Edge cases: null and empty texts are plain with no unit and an empty output; a
null id draws like the empty string; repeated ids draw alike, so repeated rows
come out alike, as often as they go in; the two draws may tie (an empty
middle); texts of any length are cut as a whole; an empty table gives no rows.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def draws(seed: int, doc_id: str) -> list[int]:
    """Four 32-bit draws of a row."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def unit_ends(unit: regex.Pattern, text: str) -> array:
    """Offset (in code points) after each unit."""
    return array("I", (m.end() for m in unit.finditer(text)))


def transform(text: str, ends: array, h: list[int], fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[str, int | None, int | None, str]:
    """``form, prefix_chars, middle_chars, output`` of a text."""
    if not text or h[2] % 100 >= fim_percent or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, text
    first, last = sorted(x % (len(ends) + 1) for x in h[:2])
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_percent:
        return "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text from which :func:`transform` made ``output``."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = head.removeprefix(PREFIX).split(SUFFIX)
    else:
        suffix, prefix = head.removeprefix(SUFFIX).split(PREFIX)
    return prefix + middle + suffix


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _transformer(seed: int, fim_percent: int, spm_percent: int):
    @F.pandas_udf(SCHEMA)
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        unit, rows = regex.compile(UNIT), []
        for doc_id, text in zip(ids, texts, strict=True):
            ends = unit_ends(unit, text)
            form, before, middle, output = transform(text, ends, draws(seed, doc_id), fim_percent, spm_percent)
            rows.append((len(ends), form, before, middle, output, _sha(output)))
        made = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])
        return made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return run


def restored(output: Column | str, form: Column | str) -> Column:
    """``text, sha256``: the text behind an output of the given form, and its digest."""

    @F.pandas_udf("text string, sha256 string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = [restore(o, f) for o, f in zip(outputs, forms, strict=True)]
        return pd.DataFrame({"text": texts, "sha256": [_sha(t) for t in texts]}, dtype=object)

    return run(output, form)


def fim_documents(df: DataFrame, *, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output, output_sha256`` of every row."""
    text, own = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    made = _transformer(seed, fim_percent, spm_percent)(F.coalesce(own.cast("string"), F.lit("")), text)
    return df.select(own.alias("doc_id"), made.alias("made")).select("doc_id", "made.*")


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fim_documents(table(spark, sf_dir, "documents")).withColumn("back", restored("output", "form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.col("back.sha256").alias("restored_sha256"))


#: The same rows in DuckDB's SQL: the restored text is the text itself there.
ORACLE = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
        sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
    FROM documents
), drawn AS (
    SELECT doc_id, t, u, len(u) AS n, [CAST('0x' || substr(d, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS h FROM cut
), chosen AS (
    SELECT doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
             WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT doc_id, t, n, form, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM chosen
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(p || m || s) AS restored_sha256
FROM parts
"""
