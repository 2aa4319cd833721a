"""License scans by canonical digests of entire texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .license_texts import TEXTS, known_texts

#: Words that licences spell in more than one way (fixed values, after the SPDX matching guidelines).
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"), ("authorisation", "authorization"), ("authorised", "authorized"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("fulfilment", "fulfillment"), ("noncommercial", "non commercial"), ("whilst", "while"), ("percent", "per cent"), ("copyright owner", "copyright holder")]
COPYRIGHT_LINE = r"(?im)^[ \t*#/;-]*(?:copyright\b|\(c\)|©)[^\r\n]*\d{4}[^\r\n]*$|^[ \t*#/;-]*all rights reserved\.?[ \t]*$"
#: Also without a year, where a holder or placeholder follows the mark; a wrapped line of a licence's body has no mark.
UNDATED_LINE = COPYRIGHT_LINE + r"|^[ \t*#/;-]*(?:copyright[ \t]*(?:\(c\)|©|[\[<{])|©)[^\r\n]*$"


def canonical(text):
    """A text without copyright lines, case, punctuation and white space of its own, in one spelling. Null counts as empty."""
    out = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), UNDATED_LINE, " "))
    # two spaces between words, so that each word has a space of its own on either side and none shadows the next
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {one.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """Which known licence (of known_texts, if no texts are given) each document's entire text is.

    Texts are made canonical (canonical) and their digests joined with those of the known texts, a table whose size
    is the number of known licences. Returns doc_id, text_sha256 (of the canonical text), license (null if none).
    Null and empty texts, and any without letters or digits, are no licence; repeated rows stay; two known texts that
    are the same canonically count as the first by name; texts of any length are read whole; an empty table gives no rows;
    other columns, whatever their names, are left out.
    """
    known = docs.sparkSession.createDataFrame(sorted((known_texts() if texts is None else texts).items()), "name string, body string")
    known = known.select("name", F.sha2(canonical(F.col("body")), 256).alias("text_sha256")).groupBy("text_sha256").agg(F.min("name").alias("license"))
    found = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("text_sha256"))
    return found.join(F.broadcast(known), "text_sha256", "left").select("doc_id", "text_sha256", "license")


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The scan over TEXTS alone, with dated copyright lines: the query knows more, and is the same where a table holds no more."""
    def canon(x: str) -> str:
        out = rf"lower(regexp_replace(coalesce({x}, ''), '{COPYRIGHT_LINE}', ' ', 'g'))"
        out = rf"' ' || trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', '  ', 'g')) || ' '"
        for other, one in SPELLINGS:
            out = f"replace({out}, ' {other.replace(' ', '  ')} ', ' {one.replace(' ', '  ')} ')"
        return f"trim(replace({out}, '  ', ' '))"

    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEXTS.items()))
    return f"""
WITH k(name, body) AS (VALUES {quoted}),
known AS (SELECT sha256({canon('body')}) AS text_sha256, min(name) AS license FROM k GROUP BY 1),
d AS (SELECT doc_id, sha256({canon('text')}) AS text_sha256 FROM documents)
SELECT doc_id, d.text_sha256, license FROM d LEFT JOIN known USING (text_sha256)
"""


OP10_SQL = _sql()
