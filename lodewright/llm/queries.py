"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anisotropic_ann, chat_format, license_scan, license_texts, minhash_forest, mixing, packing, quality_rules, token_count, url_filter, wavelet_store
from .common import table


def op1_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic_ann.search(table(spark, sf_dir, "embeddings"), anisotropic_ann.query_ids(F.col("vec_id")), k=20)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, judged at a fetch time that follows from its id, by lists that follow from its hosts."""
    captures = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("page_id") % 366) * 86_400).alias("fetched_at")
    )
    return url_filter.judge(captures, _dated_lists(captures)).select("page_id", "fetched_at", "n_matches", "list_names", "blocked")


def _dated_lists(captures: DataFrame) -> DataFrame:
    """Made-up histories of three lists: entries come and go on days given by digits of the pattern's md5."""
    host = url_filter.host_of(F.col("url"))
    hosts = captures.select(host.alias("host")).filter("host is not null").distinct()
    domain = F.regexp_replace("host", r"^(?:m|www|blog)\.", "")
    named = hosts.select(
        F.explode(
            F.array(
                F.struct(F.lit("hosts").alias("list_name"), F.lit("host").alias("kind"), F.col("host").alias("pattern")),
                F.struct(F.lit("domains").alias("list_name"), F.lit("domain").alias("kind"), domain.alias("pattern")),
                F.struct(F.lit("paths").alias("list_name"), F.lit("prefix").alias("kind"), F.concat("host", F.lit("/en")).alias("pattern")),
            )
        ).alias("e")
    ).select("e.*").distinct()
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("pattern"), i, 1)) - 1
    day = lambda d: F.timestamp_seconds(F.lit(1_704_067_200) + d * 86_400)
    named = named.withColumns({"d1": digit(1), "d2": digit(2), "d3": digit(3)}).filter("d1 < 8")
    added = F.struct(F.lit("add").alias("action"), day(F.col("d2") * 10).alias("effective_at"))
    removed = F.struct(F.lit("remove").alias("action"), day(F.col("d2") * 10 + 30 + F.col("d3") * 4).alias("effective_at"))
    again = F.struct(F.lit("add").alias("action"), day(F.col("d2") * 10 + 150).alias("effective_at"))
    return named.select("list_name", "kind", "pattern", F.explode(F.array(added, removed, again)).alias("v")).select(
        "list_name", "kind", "pattern", "v.*"
    )


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.words_taken(table(spark, sf_dir, "documents"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix aims at, document by document: sizes, sources' sizes and targets."""
    return mixing.words_taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return wavelet_store.read(wavelet_store.write(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, reconstructed from a log of drafts, edits and deltas, rendered and read back.

    Conversation -1 says the template's own control strings.
    """
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    shown = chat_format.render(chat_format.fold(chat_format.drafted(chat_format.events_of_turns(rows))))
    shown = shown.withColumns(
        {"turns": chat_format.parse(F.col("formatted")), "loss": chat_format.masked(F.col("formatted"), F.col("loss_spans"))}
    )
    log = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return shown.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(log, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.groups(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and planted texts with negative ids: whole licences as they are found in the wild."""
    planted = spark.createDataFrame(planted_licences(), "doc_id long, text string")
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(planted))


def planted_licences() -> list[tuple[int, str]]:
    """Whole texts: rewrapped, without title, with other bullets, in British spelling, and one with a sentence more."""
    text = lambda name, owner: license_texts.TEXTS[name].replace("<year>", "2014").replace("<copyright holders>", owner).replace("<owner>", owner)
    wrapped = lambda t, width: "\n\n".join(textwrap.fill(p, width) for p in t.split("\n\n"))
    untitled = lambda t: t.split("\n\n", 1)[1]
    return [
        (-1, wrapped(text("MIT", "Ann Other"), 66)),
        (-2, wrapped(untitled(text("ISC", "Ann Other and others")), 60)),
        (-3, wrapped(text("BSD-3-Clause", "Ann Other").replace("BSD 3-Clause License", "The BSD 3-Clause License"), 50).replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")),
        (-4, wrapped(untitled(text("Zlib", "Ann Other")).replace("acknowledgment", "acknowledgement"), 76)),
        (-5, wrapped(text("Unlicense", "").upper(), 40)),
        (-6, wrapped(text("MIT", "Ann Other"), 66) + "\nThe software shall be used for good."),
    ]


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_words")


QUERIES = {
    f.__name__: f
    for f in (
        op1_anisotropic_ann,
        op2_url_filter,
        op3_source_mixing,
        op4_token_store,
        op5_chat_format,
        op6_minhash_forest,
        op7_packing,
        op8_license_scan,
        op9_token_counts,
        op10_quality_rules,
        mix_targets,
    )
}


def oracle_sql() -> dict[str, str]:
    from .oracle import oracles

    return oracles()


ORACLE_SQL = oracle_sql()
