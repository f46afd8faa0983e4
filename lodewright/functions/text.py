"""Text expressions: tokens, cleaning, overlap, citations, cache keys, stub answers, replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tokens leave out.
STOPWORDS = (
    "a an and are as at be by for from has have in is it its of on or that the "
    "to was were will with this these those they we our"
).split()
# Ligatures and their letters.
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
# Phrases that mark an answer as a refusal, and the refusal itself.
REFUSALS = ("not stated", "not provided", "cannot answer", "no relevant", "insufficient", "not found in")
NO_EVIDENCE = "Not stated in the provided context."


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(STOPWORDS))


def clean_ocr(raw: Column) -> Column:
    """Ligatures spelled out, words joined over a hyphenated break, white space collapsed."""
    out = F.coalesce(raw, F.lit(""))
    for glyph, letters in LIGATURES:
        out = F.replace(out, F.lit(glyph), F.lit(letters))
    out = F.regexp_replace(out, r"(?U)(\w)-\s+(\w)", "$1$2")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def lexical_overlap(question: Column, source: Column) -> Column:
    """Share of a question's distinct tokens that its source has; 0 without tokens."""
    q, s = F.array_distinct(tokens(question)), tokens(source)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, s)) / F.size(q)).otherwise(F.lit(0.0))


def citations(answer: Column) -> Column:
    """Trimmed, non-empty contents of innermost brackets."""
    found = F.regexp_extract_all(answer, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    return F.filter(F.transform(found, lambda c: F.trim(c)), lambda c: c != "")


def is_refusal(answer: Column) -> Column:
    return F.lower(answer).rlike("|".join(REFUSALS))


def supported(answer: Column, has_evidence: Column) -> Column:
    """An answer is supported by evidence, or by saying that there is none."""
    return is_refusal(answer) | has_evidence


def cache_key(backend: Column, model: Column, prompt: Column, system: Column | None = None) -> Column:
    """SHA-256 over backend, model, system prompt and prompt, a zero character after each."""
    zero = F.char(F.lit(0))
    system = F.coalesce(system, F.lit("")) if system is not None else F.lit("")
    return F.sha2(F.concat(backend, zero, model, zero, system, zero, prompt, zero), 256)


# What the offline model looks for in a prompt, its replies, and the frame of its digest.
STUB_EXTRACTION = ("Return ONLY valid JSON", '{"entities": [], "relations": []}')
STUB_JUDGE = ("faithfulness", '{"faithfulness": 1.0, "relevance": 1.0}')
STUB_DIGEST = ("Stub answer derived from the provided context [", "].")


def stub_answer(prompt: Column, responses: dict[str, str] | None = None) -> Column:
    """The offline model: given replies by trigger, fixed replies for extraction and judging, else a digest."""
    out = F
    for trigger, reply in (responses or {}).items():
        out = out.when(prompt.contains(trigger), F.lit(reply))
    out = out.when(prompt.contains(STUB_EXTRACTION[0]), F.lit(STUB_EXTRACTION[1]))
    out = out.when(F.lower(prompt).contains(STUB_JUDGE[0]), F.lit(STUB_JUDGE[1]))
    digest = F.substring(F.sha2(prompt, 256), 1, 8)
    return out.otherwise(F.concat(F.lit(STUB_DIGEST[0]), digest, F.lit(STUB_DIGEST[1])))


def json_object(reply: Column) -> Column:
    """A reply's JSON object as a variant: fences are stripped, else what lies between the outer braces is tried."""
    bare = F.regexp_replace(F.trim(reply), r"(?s)^```[A-Za-z]*\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.nullif(inner, F.lit(""))))


def judged(reply: Column) -> Column:
    """struct(faithfulness, relevance) of a judge's reply, null unless both lie in [0, 1]; a missing score is 0."""
    parsed = F.try_parse_json(F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit("")))
    score = lambda name: F.coalesce(F.try_variant_get(parsed, f"$.{name}", "double"), F.lit(0.0))
    faith, rel = score("faithfulness"), score("relevance")
    return F.when(parsed.isNotNull() & faith.between(0, 1) & rel.between(0, 1), F.struct(faith.alias("faithfulness"), rel.alias("relevance")))


def question_reply(reply: Column, min_chars: int = 10) -> Column:
    """struct(question, answer) of a question builder's reply, null without a question of some length."""
    parsed = json_object(reply)
    question = F.trim(F.try_variant_get(parsed, "$.question", "string"))
    answer = F.trim(F.coalesce(F.try_variant_get(parsed, "$.answer", "string"), F.lit("")))
    return F.when(F.length(question) >= min_chars, F.struct(question.alias("question"), answer.alias("answer")))
