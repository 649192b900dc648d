"""Line deduplication across documents, with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 10
#: A key that many documents share is dealt over so many tasks at least, and one for each so many documents; each passes on one document's lines.
SALTS, SALT_ROWS = 32, 1 << 20
#: Equal ranges that the hashes are cut into, by their top bits.
RANGE_BITS = 16


def split_lines(text: Column) -> Column:
    """Lines between line feeds; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, salts: int | None = None) -> DataFrame:
    """``doc_id, text_hash, pos`` of lines whose key a smaller doc_id holds too.

    Lines are reduced to a 128-bit hash of their key. The hashes are uniform,
    so they are partitioned by equal ranges without looking at them first, with
    a salt by document so that no key is dealt to one task, and sorted by
    document and position; the first document of each (hash, salt) stays, later
    ones are repeats. What stays is as few as ``salts`` documents for a key, and
    is streamed once more without the salt. By default there is a salt for each
    SALT_ROWS documents, SALTS at least.
    """
    if salts is None:
        salts = max(SALTS, -(-docs.count() // SALT_ROWS))
    keys = docs.filter("doc_id is not null").select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.transform(split_lines(F.col("text")), line_key)).alias("pos", "key"),
    )
    hashed = keys.filter(F.char_length("key") >= min_chars).select(
        F.shiftright(F.xxhash64("key"), 64 - RANGE_BITS).alias("range"),
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(1), "key").alias("h2"),
        F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(salts)).cast("int").alias("salt"),
        "doc_id",
        "text_hash",
        "pos",
    )
    ranged = hashed.repartition("range", "salt")
    in_salt = Window.partitionBy("range", "salt", "h1", "h2").orderBy("doc_id", "pos")
    streamed = ranged.withColumn("first_here", F.first("doc_id").over(in_salt))
    again = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos")
    firsts = streamed.filter("doc_id = first_here").withColumn("first", F.first("doc_id").over(again))
    later = streamed.filter("doc_id <> first_here").select("doc_id", "text_hash", "pos")
    return later.union(firsts.filter("doc_id <> first").select("doc_id", "text_hash", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, salts: int | None = None) -> DataFrame:
    """``doc_id, text_hash, dropped``: a compressed bitmap of the lines that a document loses.

    ``dropped`` is a sorted array of (word, bits): 64 lines a word, words
    without a dropped line left out. Documents that keep all lines have no row.
    ``text_hash`` tells apart texts under one repeated doc_id.
    """
    words = repeated_lines(docs, min_chars, salts).groupBy("doc_id", "text_hash", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits")
    )
    return words.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def _dense(dropped: Column) -> Column:
    """All words of a bitmap up to its last."""
    before = lambda i: F.coalesce(F.get(dropped, i - 1)["word"], F.lit(-1))
    return F.flatten(
        F.transform(
            dropped,
            lambda x, i: F.concat(F.array_repeat(F.lit(0).cast("long"), x["word"] - before(i) - 1), F.array(x["bits"])),
        )
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, salts: int | None = None) -> DataFrame:
    """``docs`` with the lines dropped that a smaller doc_id holds, in a new ``text``.

    A key of at least ``min_chars`` code points keeps all its lines in the
    smallest doc_id that holds it and none elsewhere. Adds ``n_lines`` (before)
    and ``n_dropped``; a column of docs with such a name is replaced.

    A null text counts as empty: one line, text ''. Rows with a null doc_id
    keep all lines and count for no key. Rows of one doc_id are one document.
    Empty tables give empty results.
    """
    bitmaps = keep_bitmaps(docs.select("doc_id", "text"), min_chars, salts).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "dropped"
    ).withColumnRenamed("dropped", "__dropped")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*kept).join(
        bitmaps, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left"
    )
    dense = joined.withColumns({"__lines": split_lines(F.col("text")), "__words": _dense(F.coalesce("__dropped", F.expr("array()")))})
    word = lambda i: F.get(F.col("__words"), F.shiftright(i, 6))
    gone = lambda i: F.coalesce(F.getbit(word(i), i.bitwiseAND(63)), F.lit(0)) == 1
    left = F.filter("__lines", lambda x, i: ~gone(i))
    text = F.when(F.size("__words") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(left, "\n"))
    dropped = F.aggregate("__words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))
    return dense.select(
        *[(text if c == "text" else F.col(c)).alias(c) for c in kept],
        F.size("__lines").cast("long").alias("n_lines"),
        dropped.alias("n_dropped"),
    )
