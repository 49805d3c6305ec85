"""Shape the driver tables into the inputs the operators expect.

The driver text is invented prose that contains none of the technical words,
image URLs, markers or links the operators react to, so deterministic marker
text is added per row (the same CASE rule is written in the oracle SQL).
Every input keeps all rows of its table; the markers only change content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import read_table
from . import sqltext as S

# FIXED VALUES — marker texts appended by remainder (documented in FIXTURES.md)
INJECT_IMG = ' <img src="data:image/png;base64,QUJD"> <b>bold</b> &amp; more'
INJECT_TECH = " agent crash memory error on macos with jwt token authentication reset"
# Noise that the injected inputs hold; the operators take it as parameters.
SERVICE_ACCOUNT = "ticket-robot"
SERVICE_BOILERPLATE = "Automatic ticket enrichment"
SUPPORT_SECTION_TITLE = "ADDITIONAL INFORMATION FROM THE HELP DESK"
NOISE = {"account": SERVICE_ACCOUNT, "prefix": SERVICE_BOILERPLATE}
INJECT_SUPPORT = " " + "-" * 72 + "\n" + SUPPORT_SECTION_TITLE + "\nsupport tail text"
INJECT_LINK = " see https://github.com/org/repo for policy json 12345678901"
INJECT_REDACTED = "** REDACTED **"


def _inject(key, text):
    k = key % 7
    return (F.when(k == 0, F.concat(text, F.lit(INJECT_IMG)))
            .when(k == 1, F.concat(text, F.lit(INJECT_TECH)))
            .when(k == 2, F.concat(text, F.lit(INJECT_SUPPORT)))
            .when(k == 3, F.concat(text, F.lit(INJECT_LINK)))
            .when(k == 4, F.lit(INJECT_REDACTED))
            .when(k == 5, F.concat(F.lit(SERVICE_BOILERPLATE + " "), text))
            .otherwise(text))


def _inject_sql(key: str, text: str) -> str:
    return (f"(CASE ({key}) % 7 WHEN 0 THEN {text} || {S.q(INJECT_IMG)} "
            f"WHEN 1 THEN {text} || {S.q(INJECT_TECH)} "
            f"WHEN 2 THEN {text} || {S.q(INJECT_SUPPORT)} "
            f"WHEN 3 THEN {text} || {S.q(INJECT_LINK)} "
            f"WHEN 4 THEN {S.q(INJECT_REDACTED)} "
            f"WHEN 5 THEN {S.q(SERVICE_BOILERPLATE + ' ')} || {text} "
            f"ELSE {text} END)")


def raw_discussions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> discussion rows (incident=conv_id, ts=turn, author=role).
    Rows with remainder 5 come from the service account."""
    c = read_table(spark, sf_dir, "conversations")
    k = F.col("conv_id") + F.col("turn")
    return c.select(
        F.col("conv_id").alias("incident_id"),
        F.col("turn").alias("ts"),
        F.col("turn").alias("pos"),
        F.when(k % 7 == 5, F.lit(SERVICE_ACCOUNT)).otherwise(F.col("role")).alias("author"),
        _inject(k, F.col("text")).alias("content"),
    )


RAW_DISCUSSIONS_SQL = (
    "SELECT conv_id AS incident_id, turn AS ts, turn AS pos, "
    f"CASE WHEN (conv_id + turn) % 7 = 5 THEN {S.q(SERVICE_ACCOUNT)} ELSE role END AS author, "
    f"{_inject_sql('conv_id + turn', 'text')} AS content FROM conversations"
)


def injected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", _inject(F.col("doc_id"), F.col("text")).alias("text"), "lang", "source", "n_chars")


INJECTED_DOCUMENTS_SQL = (
    f"SELECT doc_id, {_inject_sql('doc_id', 'text')} AS text, lang, source, n_chars FROM documents"
)
