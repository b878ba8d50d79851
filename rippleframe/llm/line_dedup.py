"""Line dedup with content-defined chunks of lines. DataFrame functions only.

A rolling hash over the hashes of the last ``window`` lines decides after which lines a
chunk ends, so a boundary depends on nearby content and not on the position in the
document: inserting lines shifts no later boundary. A hit right after another, after a
long line or on the first line sets no boundary, so that short lines do not stand alone;
a line of at least ``long_words`` words is a chunk of its own. Chunks of at least
``min_lines`` lines, and long lines, that occur more than once in the corpus lose every
occurrence but the first (the smallest doc_id, then the earliest place). Only hashes are shuffled to find repeats;
texts are fetched for repeated hashes alone and compared byte by byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.llm.base import WORD, keeps_names
from rippleframe.session import durable

WINDOW = 2
#: One line in so many is a hit.
HIT_LINES = 2
MIN_LINES = 2
LONG_WORDS = 50
#: The rolling hash is a polynomial in this base, modulo 2^31 - 1.
BASE, MODULUS = 1_000_003, (1 << 31) - 1


def _hash31(text: Column) -> Column:
    """31 bits of a line's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % MODULUS


def _long(line: Column, words: int) -> Column:
    """Whether a line has so many words; it needs as many separators less one."""
    return F.when(F.length(line) >= 2 * words - 1, F.regexp_count(line, F.lit(WORD)) >= words).otherwise(False)


def _shifted(values: Column, by: int, front: Column) -> Column:
    """``values`` moved ``by`` places to the right, ``front`` before them."""
    return F.concat(F.array_repeat(front, by), F.slice(values, F.lit(1), F.greatest(F.size(values) - by, F.lit(0))))


def chunks(docs: DataFrame, window: int = WINDOW, hit_lines: int = HIT_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """Add ``__chunks``, an array of (lines, text) structs whose texts joined by a line feed give the text.

    A null text has a null array; an empty text is one chunk of one empty line. Lines are
    separated by a line feed alone.
    """
    # Each step reads the arrays of the step before as whole columns, outside any lambda,
    # or twice in a projection, so that Catalyst does not evaluate them per element.
    lines = docs.withColumn("__lines", F.split(F.col("text").cast("string"), "\n", -1))
    hashed = lines.withColumn("__h", F.transform("__lines", _hash31)).withColumn("__long", F.transform("__lines", lambda x: _long(x, long_words)))
    zipped = F.arrays_zip(*[_shifted(F.col("__h"), k, F.lit(0).cast("long")).alias(f"h{k}") if k else F.col("__h").alias("h0") for k in range(window)])

    def rolled(z: Column) -> Column:
        value = F.lit(0).cast("long")
        for k in reversed(range(window)):
            value = (value * BASE + z[f"h{k}"]) % MODULUS
        return value % hit_lines == 0

    hits = hashed.withColumn("__hit", F.transform(zipped, rolled)).drop("__h")
    # Whether a line is a hit or long, the latter also of the line after it.
    near = F.arrays_zip(
        F.col("__hit").alias("hit"),
        F.col("__long").alias("long"),
        _shifted(F.col("__hit"), 1, F.lit(True)).alias("hit_before"),
        _shifted(F.col("__long"), 1, F.lit(True)).alias("long_before"),
        F.concat(F.slice("__long", F.lit(2), F.size("__long")), F.array(F.lit(False))).alias("long_after"),
    )
    ends = hits.withColumn("__end", F.transform(near, lambda z: z["long"] | z["long_after"] | (z["hit"] & ~z["hit_before"] & ~z["long_before"]))).drop("__hit", "__long")
    # Ordinals of the chunk ends; the last line always ends a chunk.
    stops = F.filter(
        F.transform("__end", lambda e, i: F.when(e, i + 1)),
        lambda i: i.isNotNull(),
    )
    placed = ends.withColumn("__stops", F.array_distinct(F.concat(stops, F.array(F.size("__end"))))).drop("__end")
    placed = placed.withColumn("__starts", F.concat(F.array(F.lit(0)), F.slice("__stops", F.lit(1), F.greatest(F.size("__stops") - 1, F.lit(0)))))
    spans = placed.withColumn("__spans", F.arrays_zip(F.col("__starts").alias("a"), F.col("__stops").alias("b")))

    def cut(s: Column) -> Column:
        # Naming the lines twice keeps the split outside the lambda.
        own = F.when(F.size("__lines") >= s["b"], F.array_join(F.slice("__lines", s["a"] + 1, s["b"] - s["a"]), "\n"))
        return F.struct((s["b"] - s["a"]).alias("lines"), own.alias("text"))

    return spans.withColumn("__chunks", F.transform("__spans", cut)).drop("__lines", "__stops", "__starts", "__spans")


def _key(docs: DataFrame) -> Column:
    """Identity of a document: rows that agree in doc_id and text are one document."""
    return F.xxhash64(F.col("doc_id"), F.col("text"), F.col("doc_id").isNull(), F.col("text").isNull())


def repeated_chunks(docs: DataFrame, window: int = WINDOW, hit_lines: int = HIT_LINES, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc key, chunk numbers) of the chunk occurrences to remove."""
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    cut = chunks(base.withColumn("__doc", _key(base)), window, hit_lines, long_words)
    # The outer form: the plain one would compute all chunks a second time to test for emptiness.
    each = cut.select("doc_id", "__doc", F.posexplode_outer("__chunks").alias("__no", "__c"))
    each = each.where((F.col("__c.lines") >= min_lines) | _long(F.col("__c.text"), long_words)).select("doc_id", "__doc", "__no", F.col("__c.text").alias("__text"))
    hashed = each.select("doc_id", "__doc", "__no", "__text", F.xxhash64("__text").alias("__hash"))
    twice = hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("__hash").alias("__h"))
    # Only repeated hashes fetch their texts; hot ones are split by the join at run time.
    found = hashed.join(twice, hashed["__hash"] == twice["__h"], "left_semi")
    found = durable(found, "chunks")
    first = found.groupBy("__hash", "__text").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "__doc", "__no")).alias("__first"))
    first = first.select(F.col("__hash").alias("__h"), F.col("__text").alias("__t"), F.col("__first.__doc").alias("__d"), F.col("__first.__no").alias("__p"))
    same = (found["__hash"] == first["__h"]) & (found["__text"] == first["__t"])
    later = found.join(first, same).where((F.col("__doc") != F.col("__d")) | (F.col("__no") != F.col("__p")))
    return later.groupBy("__doc").agg(F.collect_set("__no").alias("__gone"))


@keeps_names
def dedup_lines(docs: DataFrame, window: int = WINDOW, hit_lines: int = HIT_LINES, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text`` and the counts ``n_chunks``, ``removed_chunks`` and ``removed_lines``.

    Every row stays. A document that loses all its chunks has an empty text, a null text
    stays null with zero counts, and an empty text is left as it is (a single line of
    fewer than ``long_words`` words is never removed alone). Rows that agree in doc_id and text are one document and get the same
    result, so such a repetition alone removes nothing. A null doc_id counts as the
    largest. Columns of these three names in ``docs`` are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_chunks", "removed_chunks", "removed_lines")]
    gone = repeated_chunks(docs, window, hit_lines, min_lines, long_words).withColumnRenamed("__doc", "__d")
    own = docs.select(*names).withColumn("text", F.col("text").cast("string"))
    own = own.withColumn("__doc", _key(own))
    # Texts are joined before they are cut into chunks, so only whole rows move.
    both = own.join(gone.hint("shuffle_hash"), F.col("__doc") == F.col("__d"), "left")
    cut = chunks(both, window, hit_lines, long_words)
    marked = cut.withColumn("__marked", F.transform("__chunks", lambda c, i: F.struct(c.alias("c"), F.coalesce(F.array_contains("__gone", i), F.lit(False)).alias("gone"))))
    kept = F.filter("__marked", lambda m: ~m["gone"])
    lost = F.filter("__marked", lambda m: m["gone"])
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda m: m["c"]["text"]), "\n"))
    return marked.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in names],
        F.coalesce(F.size("__chunks"), F.lit(0)).cast("long").alias("n_chunks"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("removed_chunks"),
        F.coalesce(F.aggregate(lost, F.lit(0), lambda a, m: a + m["c"]["lines"]), F.lit(0)).cast("long").alias("removed_lines"),
    )
