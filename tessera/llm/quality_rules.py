"""Quality rules whose cutoffs adapt to the language and source.

Ratios of a text are compared with fences taken from quantiles of the same
ratio among texts of the same language and source: upper quartile plus reach
times the spread between the quartiles, the spread being at least a floor.
The quantiles come from mergeable KLL sketches, built for each language and
source and merged for each language and for all texts; groups that are too
small use the next wider one. The fences are joined back and filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import GAP, SPACES, materialize
from tessera.llm.line_dedup import lines_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Ratio: least spread between quartiles, and whether a low value is odd as well.
RATIOS = {"word_length": (0.75, True), "symbols_per_word": (0.02, False), "upper_share": (0.05, False), "dup_line_share": (0.1, False), "repeat_share": (0.04, False)}


def _count(text: Column, chars: str) -> Column:
    """How often one-byte characters occur."""
    parts = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars]
    return sum(parts[1:], parts[0])


def measures(docs: DataFrame, window: int = 5) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the ratios of RATIOS.

    docs: doc_id, text, lang and source; other columns are ignored. A null
    text has no words. Without words all ratios are 0.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bare = F.btrim("text", F.lit(SPACES))
    df = base.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP, -1)))
    grams = ", ".join(f"get(words, i + {k})" if k else "get(words, i)" for k in range(window))
    df = df.withColumn("win", F.expr(f"if(size(words) < {window}, array(), transform(sequence(0, size(words) - {window}), i -> xxhash64({grams})))"))
    # most texts have no window twice; only for the others windows are sorted with their places
    df = df.withColumn("placed", F.expr("if(size(array_distinct(win)) = size(win), cast(null as array<struct<h:bigint,i:int>>), sort_array(transform(win, (h, i) -> struct(h as h, i as i))))"))
    df = df.withColumn("twice", F.expr("sort_array(transform(filter(placed, (x, k) -> x.h <=> get(placed, k - 1).h or x.h <=> get(placed, k + 1).h), x -> x.i))"))
    repeats = F.expr(f"coalesce(aggregate(transform(twice, (p, k) -> least({window}, coalesce(get(twice, k + 1) - p, {window}))), 0L, (a, x) -> a + x), 0L)")
    lines = F.filter(lines_of(F.col("text")), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.withColumn("full_lines", lines)
    df = df.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        F.size("full_lines").cast("long").alias("n_full_lines"),
        # lower-casing A-Z changes as many bytes as there are capitals: they are counted by what stays
        F.octet_length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_upper"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(0.0)
    return df.select(
        "*",
        share("word_chars", "n_words").alias("word_length"),
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_dup_lines", "n_full_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
    )


def fences(measured: DataFrame, reach: float = 6.0, min_group: int = 100, k: int = 4096, slices: int = 64) -> DataFrame:
    """lang, source, and for each ratio its low and high fence.

    Sketches are merged in steps: those of tasks by language, source and a
    slice of the tasks, then by language and source, and from these by language
    and over all. So a language and source that holds most rows is no one
    task's, and no task merges more sketches than a slice of tasks gives. k is
    the sketches' size: a group of up to k rows has exact quantiles, larger
    ones are off by some rows in ten thousand.
    """
    names = list(RATIOS)
    part = F.pmod(F.spark_partition_id(), F.lit(slices)).alias("slice")
    by_task = measured.select("lang", "source", part, *names).groupBy("lang", "source", "slice").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(x, k).alias(x) for x in names])
    merged = (F.sum("n").alias("n"), *[F.kll_merge_agg_double(x, k).alias(x) for x in names])
    fine = materialize(by_task.groupBy("lang", "source").agg(*merged), "rules-quantiles", 0)  # a row for each language and source

    def quartiles(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        return df.select(*keys, "n", *[F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(x, F.array(F.lit(0.25), F.lit(0.75)))).alias(f"q_{x}") for x in names])

    lang = quartiles(fine.groupBy("lang").agg(*merged), ("lang",)).alias("b")
    top = quartiles(fine.agg(*merged), ()).alias("c")
    # the widest level is one row
    joined = quartiles(fine, ("lang", "source")).alias("a").join(lang, F.expr("a.lang <=> b.lang"), "left").join(F.broadcast(top), F.lit(True), "left")
    out = [F.col("a.lang").alias("lang"), F.col("a.source").alias("source")]
    for x, (floor, low_too) in RATIOS.items():
        q = F.expr(f"case when a.n >= {min_group} then a.q_{x} when b.n >= {min_group} then b.q_{x} else c.q_{x} end")
        spread = F.greatest(q[1] - q[0], F.lit(floor)) * reach
        out += [(q[1] + spread).alias(f"high_{x}"), (q[0] - spread if low_too else F.lit(float("-inf"))).alias(f"low_{x}")]
    return joined.select(*out)


def apply_rules(docs: DataFrame, reach: float = 6.0, min_group: int = 100) -> DataFrame:
    """For every row of docs its measures, base_failed, outlier (the ratios beyond their fences, joined by commas) and kept.

    docs: doc_id, text, lang and source; other columns are ignored. Null
    languages and sources are groups of their own. A null, empty or blank text
    has no words and fails the base. Repeated rows give repeated rows and count
    repeatedly. Very long texts are measured whole in the task that reads them;
    an empty table gives no rows. A ratio on its fence is no outlier. base_failed: less than ten words, or
    over a fifth of them in repeated windows.
    """
    measured = materialize(measures(docs), "rules-measures")
    limits = fences(measured, reach, min_group).withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    odd = F.concat_ws(",", *[F.when((F.col(x) > F.col(f"high_{x}")) | (F.col(x) < F.col(f"low_{x}")), F.lit(x)) for x in RATIOS])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return joined.withColumn("outlier", odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("outlier") == "")).alias("kept"), "outlier")
