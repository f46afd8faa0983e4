"""Quality rules by line-first cleaning (operator 10).

Each line is judged by itself (punctuation, navigation, boilerplate), failing lines go, and
a document is rejected if what is left is too little of it.  Around that verdict stand the
base figures of a whole text.  All of it is one narrow projection of built-in functions:
no shuffle, no join, no Python.

Defined results: a null or empty text has no words, counts of 0, and is rejected with
``base_failed``; repeated rows, null and equal ids are judged one by one; a very long text is judged whole; an empty
table gives no rows; other columns pass through, and an own column of the same name wins over a passed one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: A document is rejected when more than this percentage of its words went with its lines.
MAX_LOST_PERCENT = 50

# Marks that may end a line of prose.
TERMINAL = ".!?:;,\"')]}…”’»。！？"
# Phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "click here",
    "read more",
    "lorem ipsum",
    "powered by",
    "share this",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "cookies akzeptieren",
    "newsletter abonnieren",
    "hier klicken",
    "weiterlesen",
    "tous droits réservés",
    "politique de confidentialité",
    "conditions d'utilisation",
    "accepter les cookies",
    "cliquez ici",
    "lire la suite",
    "todos los derechos reservados",
    "política de privacidad",
    "términos de uso",
    "aceptar cookies",
    "haga clic aquí",
    "leer más",
)
#: A line that shows no terminal mark still passes with this many words (wrapped prose).
WRAPPED_WORDS = 12


_SPACE = r"[\x20\x09-\x0D]"
_FURNITURE = "|".join(BOILERPLATE)


def _line_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(common.WORD))


def _has_words(line: Column, n: int) -> Column:
    """Whether a line has ``n`` words or more; it reads no further than they go."""
    return line.rlike(f"^{_SPACE}*(?:{common.WORD}{_SPACE}+){{{n - 1}}}[^\\x20\\x09-\\x0D]")


def line_passes(line: Column) -> Column:
    """Whether a line holds prose: it has words, ends like prose, and is neither menu, shout nor furniture.

    Ordinary lines leave at the first tests; words are counted only where a line has odd marks.
    """
    n = _line_words(line)
    last = F.substring(F.btrim(line, F.lit(common.SPACES)), -1, 1)
    ended = (F.instr(F.lit(TERMINAL), last) > 0) | _has_words(line, WRAPPED_WORDS)
    menu = F.regexp_count(line, F.lit(f"(?:^|{_SPACE})[|•·»>](?={_SPACE}|$)")) * 4 >= n
    noisy = F.regexp_count(line, F.lit(f"[{SYMBOLS}]")) * 2 >= n
    shouted = F.regexp_count(line, F.lit("!!")) * 2 >= n
    odd = line.rlike(f"[{SYMBOLS}•·»]|!!") & (menu | noisy | shouted)
    furniture = ~_has_words(line, WRAPPED_WORDS + 1) & F.lower(line).rlike(_FURNITURE)
    return line.rlike(common.WORD) & ended & ~odd & ~furniture


def _window_hashes(word_hashes: Column) -> Column:
    """The hashes of all windows, from pairs of pairs of pairs of words."""
    span = 1
    while span < WINDOW:
        word_hashes = _paired(word_hashes, span)
        span *= 2
    return word_hashes


def _paired(hashes: Column, step: int) -> Column:
    # The one-element array binds the hashes to a variable, so that they are computed once.
    shifted = lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - step), F.slice(h, F.lit(step + 1), F.size(h) - step), lambda a, b: F.xxhash64(a, b))
    return F.get(F.transform(F.array(hashes), shifted), F.lit(0))


def _lines(judged: str, wanted) -> Column:
    return F.transform(F.filter(judged, wanted), lambda x: x["line"])


def _words_in_repeated_windows(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, first ones included."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        return F.filter(
            s,
            lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < last) & (F.get(s, j + 1)["h"] == x["h"])),
        )

    # The one-element array binds the sorted windows to a variable, so that they are sorted once.
    found = F.get(F.transform(F.array(placed), repeated), F.lit(0))
    starts = F.sort_array(F.transform(found, lambda x: x["i"]))
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n"), p.alias("at")),
        lambda a: a["n"],
    )


def assess(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base figures, ``base_failed``, ``clean_text``, ``clean_words`` and ``kept``."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({"__words": common.words(F.col(text)), "__lines": F.split(body, "\n", -1)})
    n = F.size("__words")
    out = out.withColumn(
        "__windows",
        F.when(
            n >= WINDOW,
            _window_hashes(F.transform("__words", lambda w: F.xxhash64(w))),
        ),
    )
    worded = F.filter("__lines", lambda x: x.rlike(common.WORD))
    symbols = F.length(body) - F.length(F.translate(body, SYMBOLS, ""))
    out = out.withColumns(
        {
            "__worded": worded,
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.when(body.rlike(f"[{SYMBOLS}]"), symbols).otherwise(0).cast("long"),
            "n_repeat_words": F.when(
                F.size(F.array_distinct("__windows")) < F.size("__windows"), _words_in_repeated_windows(F.col("__windows"))
            )
            .otherwise(0)
            .cast("long"),
            "__judged": F.transform("__lines", lambda x: F.struct(x.alias("line"), F.coalesce(line_passes(x), F.lit(False)).alias("ok"))),
        }
    )
    out = out.withColumns(
        {
            "n_dup_lines": (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long"),
            "clean_text": F.array_join(_lines("__judged", lambda x: x["ok"]), "\n"),
            "clean_words": F.col("n_words") - common.n_words(F.array_join(_lines("__judged", lambda x: ~x["ok"]), "\n")),
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT),
        }
    )
    lost = F.col("n_words") - F.col("clean_words")
    out = out.withColumn("kept", ~F.col("base_failed") & (lost * 100 <= F.col("n_words") * MAX_LOST_PERCENT))
    return out.drop("__words", "__lines", "__windows", "__worded", "__judged")


def keep_clean(docs: DataFrame) -> DataFrame:
    """The documents kept, with their failing lines removed, in the columns of ``docs``."""
    judged = assess(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")))
    own = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return judged.filter("kept").select(*[own.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
