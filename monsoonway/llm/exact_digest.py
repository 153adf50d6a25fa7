"""Exact document fingerprints by SQL functions alone.

The canonical text is the NFC form of the case-folded NFC form, with white space runs turned into one
space and trimmed; ICU, which Spark ships for its collations, does the first two through the SQL
function ``java_method``. Its digest is 128 bits wide: two XXH64 values under different seeds.
Rows are grouped by digest and the canonical bytes are compared inside each group: should
two different texts ever meet, the texts of that digest get distinct suffixes, so equal
fingerprints always mean equal canonical texts.

Rows. Null text is empty. A null ``doc_id`` comes after all others, as the smallest id. Rows that
share an id follow each other by a hash of their text. A single row is its own next document. A very long text is one
value, as in the table. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Text that one task should sort, in code points.
RANGE_CHARS = 2_000_000
#: Quantiles of the keys that the driver holds; between two of them ranges are cut evenly by the key.
QUANTILES = 1000
#: Blocks of ranges; a window over no more rows than these joins them.
BLOCKS = 1000


def canonical(text: Column) -> Column:
    """Normalised, case-folded text with single spaces."""
    compose = lambda c: F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    fold = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    return F.trim(F.regexp_replace(compose(fold), r"[\s\x{85}\p{Z}]+", " "))


def digest(canonical_text: Column) -> Column:
    """32 hex digits: XXH64 of the canonical bytes under two seeds."""
    word = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canonical_text))), 16, "0")
    return F.concat(word(1), word(2))


def clashing_digests(rows: DataFrame) -> DataFrame:
    """Rows (print): digests that more than one canonical text has.

    Equal texts are merged by the partial aggregate, so a large group of copies is one row for each task.
    """
    return rows.groupBy("print").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).where("low <> high").select("print")


def resolve(rows: DataFrame, clashes: DataFrame, column: str) -> DataFrame:
    """Give each text of a clashing digest its own suffix, numbered by the bytes of the text."""
    nth = clashes.select(F.col("print").alias("clash_print"), F.col("canon").alias("clash_canon"), F.row_number().over(Window.partitionBy("print").orderBy("canon")).alias("clash_nth"))
    canon = f"{column}_canon"
    return rows.join(nth, (F.col(column) == F.col("clash_print")) & (F.col(canon) == F.col("clash_canon")), "left").withColumn(
        column, F.when(F.col("clash_nth") > 1, F.concat(column, F.lit("-"), F.col("clash_nth").cast("string"))).otherwise(F.col(column))).drop("clash_print", "clash_canon", "clash_nth")


def _edges_below(table: Column, count: int, value: Column) -> Column:
    """How many of the ``count`` sorted values of ``table`` are at most ``value``, by halving."""
    middle = lambda acc: F.floor((acc["low"] + acc["high"]) / 2).cast("int")
    above = lambda acc: F.element_at(table, middle(acc) + 1) > value
    step = lambda acc, _: F.when(acc["low"] >= acc["high"], acc).otherwise(
        F.struct(F.when(above(acc), acc["low"]).otherwise(middle(acc) + 1).alias("low"), F.when(above(acc), middle(acc)).otherwise(acc["high"]).alias("high")))
    whole = F.struct(F.lit(0).alias("low"), F.lit(count).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(count.bit_length())), whole, step, lambda acc: acc["low"])


def _range_edges(keys: DataFrame, ranges: int) -> list[float]:
    """The least and greatest of ``keys(order_key)`` and quantiles between them, at most ``QUANTILES`` + 1 however many ranges there are to be."""
    n = min(ranges, QUANTILES)
    if n < 2:
        return []
    quantiles = F.percentile_approx("order_key", [i / n for i in range(1, n)], 10 * n)
    low, inner, high = keys.agg(F.min("order_key"), quantiles, F.max("order_key")).first()
    return sorted({low, *(inner or []), high} - {None})


def _range_of(edges: list[float], value: Column, ranges: int) -> Column:
    """The range of a key, about ``ranges`` in all; never falls where the key rises.

    Between two edges lie as many even cuts as are wanted. Keys that crowd together there make ranges uneven, not wrong.
    """
    if len(edges) < 2:
        return F.lit(0).cast("long")
    cuts = -(-ranges // (len(edges) - 1))
    table = F.split(F.lit(",".join(map(repr, edges))), ",").cast("array<double>")
    at = F.least(F.greatest(_edges_below(table, len(edges), value), F.lit(1)), F.lit(len(edges) - 1))
    if cuts == 1:
        return at.cast("long")
    low, high = F.element_at(table, at), F.element_at(table, at + 1)
    cut = F.least(F.floor((value - low) / (high - low) * cuts), F.lit(cuts - 1))
    return at.cast("long") * cuts + cut.cast("long")


def _closed_ranges(firsts: DataFrame, ranges: int) -> DataFrame:
    """``firsts(range, first_place)`` with the range that each closes: the next one above that has rows, for the last the lowest.

    Ranges are taken in blocks of neighbours, so the one window without a key sees a row for each block, at most about ``BLOCKS``.
    """
    blocked = firsts.withColumn("block", F.floor(F.col("range") / max(1, ranges // BLOCKS)))
    order = Window.orderBy(F.desc("block"))
    lowest = F.last("low").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    above = blocked.groupBy("block").agg(F.min("range").alias("low")).select("block", F.coalesce(F.lag("low").over(order), lowest).alias("above"))
    inside = F.lag("range").over(Window.partitionBy("block").orderBy(F.desc("range")))
    return blocked.withColumn("inside", inside).join(above, "block").select("range", "first_place", F.coalesce("inside", "above").alias("closes"))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, next_text): the next document by falling id, the first after the last.

    Rows are dealt by approximate quantiles of (id, hash of the text), and even cuts between them, to ranges of about ``RANGE_CHARS`` code
    points, however many those are, so rows that share an id, or have none, are spread as well. Each range also gets
    the first document of the range after it, so a window over the range sees every next text and the texts move once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a null id sorts below every other
    rows = rows.withColumn("place", F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64("text").alias("tie")))
    # never falls where the place rises: rounding keeps the order
    part = F.col("place.tie").cast("double") / float(1 << 64) + 0.5
    rows = rows.withColumn("order_key", F.when(F.col("place.known"), F.col("doc_id").cast("double") + part).otherwise((part - 2.0) * 1e19))
    chars, = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    ranges = -(-chars // RANGE_CHARS)
    edges = _range_edges(rows.select("order_key"), ranges)
    dealt = rows.withColumn("range", _range_of(edges, F.col("order_key"), ranges)).select("range", "place", "doc_id", "text")
    # the first document of a range also closes the range before it; the first of all closes the last. One short row for each range
    firsts = _closed_ranges(dealt.groupBy("range").agg(F.max("place").alias("first_place")), ranges)
    heads = dealt.join(firsts, "range").where(F.col("place") == F.col("first_place")).groupBy("range", "closes").agg(F.first("place").alias("place"), F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    heads = heads.select(F.col("closes").alias("range"), F.lit(1).alias("copy"), "place", "doc_id", "text")
    window = Window.partitionBy("range").orderBy("copy", F.desc("place"))
    both = dealt.select("range", F.lit(0).alias("copy"), "place", "doc_id", "text").unionByName(heads)
    return both.withColumn("next_text", F.lead("text").over(window)).where("copy = 0").select("doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many first ones of the following text."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(following, F.lit(1), third))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    verify = docs.select(canonical(F.coalesce("text", F.lit(""))).alias("canon")).select("canon", digest(F.col("canon")).alias("print"))
    prints = clashing_digests(verify)
    # digests this wide hardly ever clash: whether any do is asked once, and only then are texts joined
    clash = not prints.isEmpty()
    rows = with_next(docs).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("fingerprint_canon"), canonical(F.col("edit")).alias("edited_fingerprint_canon"), canonical(F.col("next_text")).alias("next_canon"))
    rows = rows.withColumn("fingerprint", digest(F.col("fingerprint_canon"))).withColumn("edited_fingerprint", digest(F.col("edited_fingerprint_canon")))
    if clash:
        clashes = verify.join(prints, "print", "left_semi").select("print", "canon").distinct()
        rows = resolve(resolve(rows, clashes, "fingerprint"), clashes, "edited_fingerprint")
    same = lambda other: (F.col("fingerprint_canon") == F.col(other)).cast("double")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint_canon").alias("near_edited"), same("next_canon").alias("near_next"))
