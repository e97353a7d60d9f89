"""Licence scan by canonical digests (DataFrame functions only).

A unit is a whole document or one whole line of it. The canonical form of a unit drops copyright
lines, lower-cases A-Z, rewrites equivalent spellings, turns punctuation into spaces and squeezes
spaces; its MD5 digest is hash-joined to the digests of the known licence texts.

Every line is canonicalised once; the form of a document is made of the forms of its lines.

Defined results: a null or empty text, or one whose canonical form is empty, matches nothing; a text
of any length is read whole; a unit that equals the texts of several licences reports each; repeated
rows each report their matches; an empty table gives no rows; a null doc_id is kept as null; columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import UPPER, ascii_lower, load
from mercato.llm.license_texts import KNOWN

# Spellings that licence matching treats as equal, as (pattern, spelling).
SPELLINGS = [
    ("licence", "license"),
    ("noncommercial", "non commercial"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("fulfilment", "fulfillment"),
    ("judgement", "judgment"),
    ("sub license", "sublicense"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
]
#: A line that names an owner, begins with the sign or the word, or reserves all rights ...
COPYRIGHT_LINE = r"(?i)^[^a-z0-9(©]*((portions )?(copyright|©|\(c\))([^a-z0-9]|$).*|all rights reserved[^a-z0-9]*)$"
#: ... but doesn't go on as a sentence of a licence does.
BODY_LINE = r"(?i)^[^a-z0-9(©]*copyright[^a-z0-9©(]+(notices?|holders?|owners?|licen[cs]es?|laws?|statements?|interests?|protection|treat(y|ies)|act|and|or|in|is|are|of|on|to|under|that|with|shall|may|as)([^a-z0-9].*)?$"
PUNCTUATION = r"[^a-z0-9]+"


def _form(line: Column) -> Column:
    """Canonical form of a line; empty for a copyright line."""
    text = F.trim(F.regexp_replace(ascii_lower(line), PUNCTUATION, " "))
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.when(line.rlike(COPYRIGHT_LINE) & ~line.rlike(BODY_LINE), "").otherwise(text)


def _joined(forms: Column) -> Column:
    """Canonical form of lines from theirs: spellings of two words may go over the end of a line."""
    text = F.array_join(F.filter(forms, lambda x: x != ""), " ")
    for old, new in SPELLINGS:
        if " " in old:
            text = F.replace(text, F.lit(old), F.lit(new))
    return text


def canonical(lines: Column) -> Column:
    """Canonical form of an array of lines."""
    return _joined(F.transform(lines, _form))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """``digest, license_id`` of (license_id, text): a list, or a DataFrame for a larger collection."""
    texts = known if isinstance(known, DataFrame) else spark.createDataFrame(known, "license_id string, text string")
    form = canonical(F.split("text", r"\n"))
    return texts.select("license_id", form.alias("form")).where("form <> ''").select(F.md5("form").alias("digest"), "license_id").distinct()


def scan_licenses(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """One row per matching unit of ``docs(doc_id, text)``: doc_id, unit, line_no (0 for the whole document), license_id.

    Only digests meet in the join; the known list is broadcast by Spark's own size check and
    shuffled if it is larger. No text is shuffled.
    """
    forms = docs.where("text is not null").select("doc_id", F.transform(F.split("text", r"\n"), _form).alias("forms"))
    units = F.concat(F.array(_joined(F.col("forms"))), F.col("forms"))
    return (
        forms.select("doc_id", F.posexplode(units).alias("line_no", "form"))
        .where("form <> ''")
        .select("doc_id", "line_no", F.md5("form").alias("digest"))
        .join(digests, "digest")
        .select("doc_id", F.when(F.col("line_no") == 0, "document").otherwise("line").alias("unit"), "line_no", "license_id")
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents"), known_digests(spark, KNOWN))


def _canonical_sql(lines: str) -> str:
    text = f"array_to_string(list_filter({lines}, lambda x: NOT regexp_matches(x, '{COPYRIGHT_LINE}') OR regexp_matches(x, '{BODY_LINE}')), ' ')"
    text = f"trim(regexp_replace(translate({text}, '{UPPER}', '{UPPER.lower()}'), '{PUNCTUATION}', ' ', 'g'))"
    for old, new in SPELLINGS:
        text = f"replace({text}, '{old}', '{new}')"
    return text


_KNOWN_SQL = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)
SQL = f"""
WITH known(license_id, text) AS (VALUES {_KNOWN_SQL}),
digests AS (SELECT DISTINCT md5({_canonical_sql("string_split(text, chr(10))")}) AS digest, license_id FROM known),
lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
units AS (
    SELECT doc_id, 0 AS line_no, ls FROM lines
    UNION ALL SELECT doc_id, n AS line_no, [ls[n]] AS ls FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS n FROM lines)),
forms AS (SELECT doc_id, line_no, {_canonical_sql("ls")} AS form FROM units)
SELECT doc_id, CASE WHEN line_no = 0 THEN 'document' ELSE 'line' END AS unit, line_no::INTEGER AS line_no, license_id
FROM forms JOIN digests ON md5(form) = digest WHERE form <> ''
"""
