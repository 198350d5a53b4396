"""Line deduplication across documents by range-partitioned hashes.

A line's key is the line without white space at its ends, A-Z lower-cased. A
key of some length that several documents hold stays in the document with the
smallest doc_id and goes from the others.

Keys are hashed to 128 bits and dealt by range of the hash and a slice of the
document, sorted by document and position, and read as a stream: the first
document of a slice is known at once, and what follows from other documents
goes. Only what a slice's first document holds is dealt again, with fewer
slices, at last with one. So a line that a third of all documents share is
spread over as many tasks as there are slices, and the last pass sees it once
a slice. Text is not moved for this; the result is one sparse bitmap a
document: its 64-bit words that hold a dropped line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import SPACES, ascii_lower, materialize
from tessera.types import free_name


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _identity(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash that tells rows with one doc_id but different texts apart."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return base.withColumn("text_hash", F.xxhash64("text"))


def drop_bitmaps(docs: DataFrame, min_key_chars: int = 10, slices: tuple[int, ...] = (1024, 1)) -> DataFrame:
    """For each document that loses lines: doc_id, text_hash, n_dropped long and words, an array of (word, bits): bit p of word w is set if line 64 w + p goes.

    docs: doc_id and text; other columns are ignored. A null text has one
    empty line. Rows of one doc_id count as one document; null doc_ids count
    as one document that comes after all others. Repeated rows give one bitmap.
    """
    if slices[-1] != 1:
        raise ValueError("the last pass must have one slice")
    keyed = (
        _identity(docs)
        .filter(F.length("text") >= min_key_chars)
        .select("doc_id", "text_hash", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .filter(F.length("key") >= min_key_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    # numbers only; dealing by range reads its input twice
    dropped, rest = None, materialize(keyed, "lines-keyed")
    n = 5 * rest.count()
    for n in slices:
        # text_hash only decides among rows of one doc_id
        ranged = rest.withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), "doc_id"), F.lit(n))).repartitionByRange("h1", "h2", "slice").sortWithinPartitions("h1", "h2", "slice", F.col("doc_id").asc_nulls_last(), "pos")
        stream = Window.partitionBy("h1", "h2", "slice").orderBy(F.col("doc_id").asc_nulls_last(), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = materialize(ranged.withColumn("is_first", F.first("doc_id").over(stream).eqNullSafe(F.col("doc_id"))), "lines-seen", n)
        later = seen.filter(~F.col("is_first")).select("doc_id", "text_hash", "pos")
        dropped = later if dropped is None else dropped.unionAll(later)
        rest = seen.filter("is_first").drop("slice", "is_first")
    words = dropped.groupBy("doc_id", "text_hash", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, name: str) -> DataFrame:
    """Every row of docs with its columns and, their names starting with name, lines (before), n_dropped and kept_text; rows as many as docs has."""
    whole, side_id, side_hash, dropped, words, dense, split = (f"{name}{x}" for x in ("whole", "id", "hash", "dropped", "words", "dense", "split"))
    base = docs.select("*", F.coalesce(F.col("text").cast("string"), F.lit("")).alias(whole))
    side = bitmaps.select(F.col("doc_id").alias(side_id), F.col("text_hash").alias(side_hash), F.col("n_dropped").alias(dropped), F.col("words").alias(words))
    joined = base.join(side, (F.col("doc_id").cast("long").eqNullSafe(F.col(side_id))) & (F.xxhash64(whole) == F.col(side_hash)), "left")
    # zero words between those of the bitmap are put back, so that a line finds its bit at once
    filled = F.expr(f"flatten(transform({words}, (x, i) -> concat(array_repeat(0L, cast(x.word - if(i = 0, 0, get({words}, i - 1).word + 1) as int)), array(x.bits))))")
    joined = joined.withColumn(dense, filled).withColumn(split, lines_of(F.col(whole)))
    kept = F.expr(f"filter({split}, (x, i) -> coalesce(getbit(get({dense}, cast(i div 64 as int)), i % 64), 0) = 0)")
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(split).cast("long").alias(f"{name}lines"),
        F.coalesce(dropped, F.lit(0)).cast("long").alias(f"{name}n_dropped"),
        F.when(F.col(dropped).isNull(), F.col(whole)).otherwise(F.array_join(kept, "\n")).alias(f"{name}kept_text"),
    )


def dedup_lines(docs: DataFrame, min_key_chars: int = 10, slices: tuple[int, ...] = (1024, 1)) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every row: drop_bitmaps, then apply_bitmaps.

    docs: doc_id and text; other columns are ignored. A null or empty text is
    one empty line, which stays. Rows of one doc_id count as one document, so
    a line that only they hold stays in all of them; repeated rows give
    repeated rows. Null doc_ids count as one document after all others. A very
    long text is cut into as many rows as it has lines; an empty table gives no
    rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = apply_bitmaps(base, drop_bitmaps(base, min_key_chars, slices), "_")
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.col("_kept_text").alias("kept_text"))


def cleaned_documents(docs: DataFrame, min_key_chars: int = 10, slices: tuple[int, ...] = (1024, 1)) -> DataFrame:
    """The rows of docs with their columns, whatever their names; text is what stays of it (null stays null), n_chars, if there, its number of characters. Otherwise as dedup_lines."""
    own = free_name(docs)
    out = apply_bitmaps(docs, drop_bitmaps(docs, min_key_chars, slices), own)
    new = {"text": F.when(F.col("text").isNotNull(), F.col(f"{own}kept_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(f"{own}n_dropped") > 0, F.char_length(f"{own}kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
