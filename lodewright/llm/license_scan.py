"""License scans by canonical digest lookup (operator 8).

A text is brought to a canonical form: copyright lines and a title at its head go, case, punctuation and
spacing are flattened, and words with several accepted spellings get one.  The form does not depend on
how a text is wrapped, as long as copyright lines and titles are lines of their own.  The digest of the whole canonical text is then hash-joined to the digests of known
licence texts.  A line of a document is a text too: its digest finds licence notices that stand inside other prose.

Known are the texts of ``license_texts.TEXTS`` and the digests of ``license_texts.DIGESTS`` (longer texts, with and
without what follows their terms).  More digests can be given as a table; ``digests`` makes it from texts.

The digests of known texts are a parameter table, small by nature; the join broadcasts it only
up to ``MAX_BROADCAST`` rows (the size is counted) and shuffles otherwise.

Defined results: null and empty texts have the digest of the empty text and no licence; very long texts are taken
whole; repeated rows and equal ids are looked up one by one, a null id likewise; a digest that several licences share
goes to the first by name; an empty registry finds nothing; an empty table gives no rows; other columns are ignored,
whatever their names.  A copyright line without a year, "(c)", "by" or a placeholder after the word is text like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import DIGESTS, NOTICES, TEXTS

MAX_BROADCAST = 100_000

# Spellings that licence matching treats as equal, as (variant, canonical).
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("canceled", "cancelled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("cent per", "percent"),
    ("copyright owner", "copyright holder"),
    ("customisation", "customization"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("modernise", "modernize"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("normalise", "normalize"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
# Lines that name an owner, numbers of list items, and titles (in canonical words, among the first lines of a text).
COPYRIGHT_LINE = r"^[\s\W]*(?:(?:portions\s+)?copyright\s*(?:$|\(c\)|©|by\b|[<\[{]|\d{4})|\(c\)\s*(?:copyright|\d{4}|[<\[{])|©|all rights reserved\W*$)"
BULLET = r"(?m)^\s*\(?(?:\d{1,2}|[A-Za-z])[.)]\s+"
TITLE = r"^(?:the )?(?:(?:\w+ ){0,5}license(?: (?:mit|isc|v?\d|version|new|revised|simplified|expat|or|modified|clause)){0,4}|mit no attribution|boost software license version 1 0 august 17th 2003)$"
TITLE_LINES = 2
#: A line of more words is no copyright line or title, however it begins.
OWNER_WORDS = 30


def _spelled(text: Column) -> Column:
    """One spelling; a variant of two words may be broken over lines, so the whole text is looked at."""
    variant = r"\b(?:" + "|".join(a for a, _ in SPELLINGS) + r")\b"
    out = text
    for a, b in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{a}\b", b)
    return F.when(text.rlike(variant), out).otherwise(text)


def canonical_line(line: Column) -> Column:
    """Lower case, words only, one space between; a copyright line is empty."""
    low = F.lower(line)
    flat = F.btrim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))
    short = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) < OWNER_WORDS
    return F.when(low.rlike(COPYRIGHT_LINE) & short, F.lit("")).otherwise(flat)


def canonical_lines(text: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), canonical_line)
    return F.filter(lines, lambda x: x != "")


def canonical(lines: Column) -> Column:
    """A whole text from its canonical lines, without a title among the first ones."""
    rest = F.filter(lines, lambda x, i: (i >= TITLE_LINES) | ~F.regexp_replace(x, "licence", "license").rlike(TITLE))
    return _spelled(F.array_join(rest, " "))


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def digests(texts: DataFrame) -> DataFrame:
    """(license_id, whole, digest) of texts (license_id, whole, text): ``whole`` texts with and without numbers of list items, others as lines."""
    both = F.when(F.col("whole"), F.array("text", F.regexp_replace("text", BULLET, ""))).otherwise(F.array("text"))
    rows = texts.select("license_id", "whole", F.explode(both).alias("text"))
    lines = canonical_lines(F.col("text"))
    form = F.when(F.col("whole"), canonical(lines)).otherwise(_spelled(F.array_join(lines, " ")))
    return rows.select("license_id", "whole", digest(form).alias("digest")).distinct()


def registry(spark: SparkSession) -> DataFrame:
    """(license_id, whole, digest) of the known texts, digests and notices."""
    rows = [(k, True, v) for k, v in TEXTS.items()] + [(k, False, x) for k, v in NOTICES.items() for x in v]
    known = digests(spark.createDataFrame(rows, "license_id string, whole boolean, text string"))
    more = [(k, True, x) for k, v in DIGESTS.items() for x in v]
    return known.unionByName(spark.createDataFrame(more, "license_id string, whole boolean, digest string"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license_id, notices, n_notices) for each document.

    ``license_id`` is the licence whose text the whole document is; ``notices`` are the licences
    named by its lines (sorted, joined by commas), ``n_notices`` the number of such lines.
    """
    known = registry(docs.sparkSession) if known is None else known
    texts = _small(known.filter("whole").groupBy("digest").agg(F.min("license_id").alias("license_id")))
    marks = _small(known.filter("not whole").groupBy(F.col("digest").alias("line_digest")).agg(F.min("license_id").alias("notice")))
    base = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    base = base.select(
        F.col("doc_id"), F.monotonically_increasing_id().alias("row"), digest(canonical(F.col("lines"))).alias("digest"), F.transform("lines", lambda x: digest(_spelled(x))).alias("lines")
    )
    found = base.select("doc_id", "row", "digest", F.explode_outer("lines").alias("line_digest")).join(marks, "line_digest", "left")
    out = found.groupBy("row", "doc_id", "digest").agg(
        F.array_join(F.sort_array(F.collect_set("notice")), ",").alias("notices"), F.count("notice").alias("n_notices")
    )
    return out.join(texts, "digest", "left").select("doc_id", "digest", "license_id", "notices", "n_notices")
