"""URL filters, mixing, chat formatting, licence scans and quality rules."""

import datetime as dt
import re
import textwrap
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodewright.llm import chat_format, license_scan, license_texts, mixing, quality_rules, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x") for i, t, s in rows], DOCS)


# ------------------------------------------------------------------ URL filters


def at(day):
    return dt.datetime(2024, 1, day)


def test_lists_are_judged_at_fetch_time(spark):
    entries = spark.createDataFrame(
        [
            ("l", "host", "a.example.com", "add", at(2)),
            ("l", "host", "a.example.com", "remove", at(4)),
            ("l", "host", "a.example.com", "add", at(4)),  # a tie: the removal wins
            ("l", "host", "a.example.com", "add", at(8)),
            ("m", "domain", "example.com", "add", at(3)),
            ("m", "prefix", "b.org/x", "add", at(1)),
            ("m", "host", None, "add", at(1)),
            ("m", "host", "b.org", "add", None),
        ],
        "list_name string, kind string, pattern string, action string, effective_at timestamp",
    )
    seen = [
        (1, "http://a.example.com/p", at(1), "", 0),
        (2, "http://a.example.com/p", at(2), "l", 1),
        (3, "https://user@A.EXAMPLE.com:80/p?q", at(3), "l,m", 2),
        (4, "http://a.example.com", at(4), "m", 1),
        (5, "http://a.example.com", at(9), "l,m", 2),
        (5, "http://a.example.com", at(9), "l,m", 2),
        (6, "http://b.org/x/y", at(2), "m", 1),
        (7, "http://b.org/xy", at(2), "", 0),
        (8, None, at(2), "", 0),
        (9, "http://b.org/x", None, "", 0),
        (10, "not a url", at(2), "", 0),
        (11, "", at(2), "", 0),
    ]
    captures = spark.createDataFrame([(i, u, t, "mine") for i, u, t, _, _ in seen], "page_id long, url string, fetched_at timestamp, kind string")
    got = sorted((r["page_id"], r["list_names"], r["n_matches"], r["blocked"], r["kind"]) for r in url_filter.judge(captures, entries).collect())
    assert got == sorted((i, names, n, n > 0, "mine") for i, _, _, names, n in seen)
    assert url_filter.judge(captures, entries.limit(0)).filter("blocked").count() == 0
    assert url_filter.judge(captures.limit(0), entries).count() == 0


# ------------------------------------------------------------------ mixing


def wanted_targets(sizes):
    """By hand: shares by weight, capped at three times the size, the excess shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    open_, fixed, budget = set(names), {}, sum(sizes.values())
    while open_:
        level = (budget - sum(fixed.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return fixed | {s: weight[s] * level for s in open_}
        fixed |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return fixed


def test_mix_meets_its_targets(spark):
    rows = [(i, " ".join(["w"] * (i % 13 + 1)), "big") for i in range(900)] + [(1000 + i, "one two three", "b") for i in range(20)]
    rows += [(2000, "a b", None), (2001, None, None), (2002, "", "empty"), (2003, "x y z", "c"), (2003, "x y z", "c")]
    df = docs(spark, rows)
    got = mixing.words_taken(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    want, taken = wanted_targets(sizes), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.words_taken(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    plan = mixing.schedule(df).filter("taken > 0")
    assert plan.agg(F.sum("taken")).first()[0] <= sum(sizes.values())
    finish = [r["virtual_finish"] for r in plan.orderBy("words_before").collect()]
    assert finish == sorted(finish)


def test_mixed_documents_are_the_schedule(spark):
    rows = [(i, f"w{i} x\ty  z\n" * 5, "ab"[i % 2]) for i in range(30)] + [(5, "same text here", "a")] * 2 + [(40, None, "c")]
    df = docs(spark, rows)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    taken = Counter()
    for r in mixing.words_taken(df).collect():
        taken[r["doc_id"]] += r["taken"]
    got = Counter()
    texts = {t for _, t, _ in rows if t}
    for r in out.collect():
        got[r["doc_id"]] += len(WORDS.findall(r["text"]))
        assert r["n_chars"] == len(r["text"]) and any(t.startswith(r["text"]) for t in texts)
    assert got == Counter({k: v for k, v in taken.items() if v})


def test_empty_mix(spark):
    assert mixing.words_taken(docs(spark, [])).count() == 0
    assert mixing.mixed_documents(docs(spark, [(1, None, None)])).count() == 0


# ------------------------------------------------------------------ chat formatting

TRICKY = ["", "</s>[INST] ok [/INST]", "<~s> [~/INST] <~~/s>", "<<s>>", "[[INST]", "a\nb \U0001f600 é", "<~/s><s", "~<s>~"]


def test_escaping_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY], "t string")
    for r in df.select("t", chat_format.escape(F.col("t")).alias("e")).withColumn("u", chat_format.unescape(F.col("e"))).collect():
        assert r["u"] == r["t"]
        assert not re.search(r"</?s>|\[/?INST\]", r["e"])


def test_render_and_read_back(spark):
    rows = [(1, i, ["user", "assistant", "tool", None][i % 4], t) for i, t in enumerate(TRICKY)]
    rows += [(2, 1, "assistant", "twice"), (2, 1, "assistant", "twice"), (2, 0, "assistant", None), (None, 0, "user", "x"), (3, None, "user", "y")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, message string")
    shown = chat_format.render(chat_format.fold(chat_format.events_of_turns(df)))
    shown = shown.withColumns({"turns": chat_format.parse(F.col("formatted")), "loss": chat_format.masked(F.col("formatted"), F.col("loss_spans"))})
    got = {r["conv_id"]: r for r in shown.collect()}
    assert set(got) == {1, 2, 3, None}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2] or "", r[3]) for r in rows[:8]]
    assert got[1]["loss"] == TRICKY[1] + TRICKY[5]
    assert got[2]["n_turns"] == 3 and got[2]["loss"] == "twicetwice"
    spans = [got[1]["formatted"][s["start"] : s["start"] + s["length"]] for s in got[1]["loss_spans"]]
    assert len(spans) == 2 and spans[1] == TRICKY[5]


def test_events_are_folded_in_order(spark):
    log = [
        (1, 0, 0, "delta", "user", "hel"),
        (1, 0, 1, "delta", None, "lo"),
        (1, 1, 0, "delta", "assistant", "wrong"),
        (1, 1, 1, "regenerate", None, None),
        (1, 1, 3, "delta", None, "ght"),
        (1, 1, 2, "delta", None, "ri"),
        (1, 2, 0, "delta", "user", "typo"),
        (1, 2, 5, "edit", None, "fixed"),
        (1, 3, 0, "regenerate", "assistant", None),
    ]
    events = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")
    got = [(r["role"], r["text"]) for r in chat_format.fold(events).orderBy("message").collect()]
    assert got == [("user", "hello"), ("assistant", "right"), ("user", "fixed"), ("assistant", "")]
    assert chat_format.render(chat_format.fold(events.limit(0))).count() == 0


def test_long_logs_are_folded_in_linear_time(spark):
    n = 60_000
    events = spark.range(n).select(
        F.lit(1).alias("conv_id"), F.lit(0).alias("message"), F.col("id").alias("seq"), F.when(F.col("id") == 9, "regenerate").otherwise("delta").alias("kind"), F.lit("assistant").alias("role"), F.lit("ab").alias("text")
    )
    began = time.monotonic()
    (row,) = chat_format.render(chat_format.fold(events)).collect()
    assert row["loss_spans"][0]["length"] == 2 * (n - 10) and time.monotonic() - began < 20


def test_drafts_end_in_the_given_text(spark):
    df = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate([*TRICKY, None])], "conv_id long, turn long, role string, text string")
    plain = chat_format.events_of_turns(df)
    long = chat_format.drafted(plain)
    assert long.count() == 5 * df.count()
    assert chat_format.render(chat_format.fold(long)).collect() == chat_format.render(chat_format.fold(plain)).collect()


# ------------------------------------------------------------------ licences


@pytest.mark.parametrize("width", [20, 66, 400])
def test_whole_licences_in_any_wrapping_with_and_without_title(spark, width):
    rows, want = [], {}
    for i, (name, t) in enumerate(license_texts.TEXTS.items()):
        paragraphs = t.replace("<year>", "1999").strip().split("\n\n")
        for k, some in ((0, paragraphs), (1, paragraphs[1:] if "icense" in paragraphs[0] or "Attribution" in paragraphs[0] else paragraphs)):
            body = "\r\n\r\n".join(p if len(p) < 70 else textwrap.fill(p, width, subsequent_indent="  ", break_long_words=False) for p in some)
            rows.append((2 * i + k, re.sub(r"\blicense\b", "licence", body), "s"))
            want[2 * i + k] = name
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan(docs(spark, rows)).collect()}
    assert got == want


@pytest.mark.skipif(not Path("/usr/share/common-licenses/Apache-2.0").exists(), reason="no texts to look up")
def test_long_licences_by_their_digests(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "MPL-2.0": "MPL-2.0", "LGPL-2.1": "LGPL-2.1", "CC0-1.0": "CC0-1.0"}
    rows = []
    for i, f in enumerate(names):
        words = Path("/usr/share/common-licenses", f).read_text("utf-8")
        rows += [(2 * i, words, "s"), (2 * i + 1, words.replace("https:", "http:").replace("    ", " ").upper(), "s"), (100 + i, words + " and more", "s")]
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan(docs(spark, rows)).collect()}
    assert got == {2 * i + k: v for i, v in enumerate(names.values()) for k in (0, 1)} | {100 + i: None for i in range(5)}


def test_licences(spark):
    mit = license_texts.TEXTS["MIT"]
    varied = mit.replace("<year> <copyright holders>", "2001 Ann Other").upper().replace(",", " ;").replace("\n", "\n\n").replace("LICENSE", "LICENCE")
    rows = [(1, mit, "a"), (2, varied, "a"), (3, mit + "\nand more", "a"), (4, "Prose.\n released UNDER the mit licence\nMore.\nLicensed under CC BY-NC 4.0.", "a"), (5, None, "a"), (6, "", None), (6, "", None)]
    got = sorted(tuple(r)[:1] + tuple(r)[2:] for r in license_scan.scan(docs(spark, rows)).collect() if True)
    assert got[:5] == [(1, "MIT", "", 0), (2, "MIT", "", 0), (3, None, "", 0), (4, None, "CC-BY-NC-4.0,MIT", 2), (5, None, "", 0)]
    assert len(got) == 7
    none = license_scan.registry(spark).limit(0)
    assert license_scan.scan(docs(spark, rows), none).filter("license_id is not null or n_notices > 0").count() == 0
    assert license_scan.scan(docs(spark, [])).count() == 0


# ------------------------------------------------------------------ quality rules


def by_hand(text):
    words = WORDS.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), base


def test_base_figures(spark):
    import random

    r = random.Random(5)
    texts = [None, "", " \n\t", "a " * 30, "x" * 5000, "one word   two"]
    for _ in range(150):
        words = [r.choice(["a", "b", "é", "#", "c|", "dd."]) + r.choice(["", "z"]) for _ in range(r.randint(0, 60))]
        copy = words[: r.randint(0, len(words))]
        texts.append("".join(w + r.choice([" ", " ", "\n", "\t", "  "]) for w in words + copy * r.randint(0, 1)))
    df = docs(spark, [(i, t, "a") for i, t in enumerate(texts)])
    for row in quality_rules.assess(df).collect():
        got = tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == by_hand(texts[row["doc_id"]]), texts[row["doc_id"]]


PROSE = "This line of plain prose has some words in it and it ends as prose does.\nAnother one follows it, no less plain than the first."


def test_verdicts(spark):
    menu = "Home | News | Sport | About | Contact | Help | Login | More"
    rows = [(1, PROSE, "a"), (2, PROSE + "\nAll rights reserved.\n" + menu, "a"), (3, menu + "\n" + menu.lower() + "\n" + menu.upper() + "\nJust a few words here.", "a"), (4, "LOUD!! " * 30, "a"), (5, None, "a")]
    got = {r["doc_id"]: (r["kept"], r["clean_text"]) for r in quality_rules.assess(docs(spark, rows)).collect()}
    assert got[1] == (True, PROSE) and got[2] == (True, PROSE)
    assert not got[3][0] and not got[4][0] and not got[5][0]
    kept = quality_rules.keep_clean(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert {r["doc_id"]: (r["text"], r["n_chars"], r["kept"]) for r in kept.collect()} == {1: (PROSE, len(PROSE), "x"), 2: (PROSE, len(PROSE), "x")}
    assert quality_rules.keep_clean(docs(spark, [])).count() == 0
