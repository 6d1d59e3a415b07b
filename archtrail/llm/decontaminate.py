"""Benchmark decontamination over a distributed positional inverted index.

Postings (term, document, position) of training tokens are stored for the terms that a
lookup starts from: in every window of an item the terms that are rarest in the
training texts. A window's lists, shifted by the terms' offsets, are intersected from
the rarest on; what is left are starts of phrases, which are then compared in full.
Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archtrail.llm.chunks import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words after lower-casing: all of ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Terms are looked for in groups of this size, one pass over the texts each (a set in the plan).
TERMS_A_PASS = 20_000
#: A side of a join is broadcast up to so many bytes (of its rows as text, and 16 a row), else joined by shuffle.
BROADCAST_BYTES = 32_000_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN), lambda w: w != "")


def _passes(terms: DataFrame) -> list[list[str]]:
    """Distinct terms in groups; ``terms`` are of the benchmark, and each group costs one pass."""
    parts = -(-terms.count() // TERMS_A_PASS)
    return [[r[0] for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).collect()] for k in range(parts)]


def checked_broadcast(frame: DataFrame) -> DataFrame:
    """``frame`` with a broadcast hint where it is small; measured first, so it should be written."""
    size = frame.agg(F.sum(F.length(F.to_json(F.struct("*"))) + 16)).first()[0]
    return F.broadcast(frame) if (size or 0) <= BROADCAST_BYTES else frame


def _among(terms: list[str], field: str | None = None) -> Callable[[Column], Column]:
    return lambda x: (x[field] if field else x).isin(terms)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def windows_of(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """``item``, ``words`` and ``length`` (words of a window: ``size``, or all of a shorter item); items without words are left out."""
    return (
        items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
        .where("size(words) > 0").withColumn("length", F.least(F.lit(size), F.size("words"))).withColumn("key", F.xxhash64("item", F.concat_ws(" ", "words"))).distinct()
    )


def frequencies(words: DataFrame, terms: list[list[str]]) -> DataFrame:
    """How often each of ``terms`` occurs in ``words`` (an array column of that name)."""
    return _union([words.select(F.explode(F.filter("words", _among(part))).alias("term")).groupBy("term").count() for part in terms])


def postings(docs: DataFrame, terms: list[list[str]]) -> DataFrame:
    """The index: ``term, doc, text_key, position`` of every occurrence of ``terms``; ``docs`` have ``doc, text_key, words``."""
    parts = []
    for part in terms:
        at = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("term"), i.alias("position"))), _among(part, "term"))
        parts.append(docs.select("doc", "text_key", F.inline(at)))
    return _union(parts)


def starting_points(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Per item the offsets of the two rarest words of its windows: ``key, term, offset, rank, mate``.

    ``mate`` is the offset of the window's second rarest place (that of the rarest itself in a window of one).
    """
    each = windows.select("key", "length", F.posexplode("words").alias("offset", "term")).join(counts, "term", "left")
    lists = each.groupBy("key", "length").agg(F.array_sort(F.collect_list(F.struct("offset", F.coalesce("count", F.lit(0)).alias("count"), "term"))).alias("places"))
    by_rarity = lambda s: F.array_sort(F.transform(F.slice("places", s + 1, F.col("length")), lambda p: F.struct(p["count"].alias("count"), p["offset"].alias("offset"), p["term"].alias("term"))))
    pairs = F.transform(F.sequence(F.lit(0), F.size("places") - F.col("length")), lambda s: F.slice(by_rarity(s), 1, 2))
    two = lists.select("key", F.explode(F.array_distinct(pairs)).alias("two"))
    first, second = F.col("two")[0], F.element_at("two", -1)
    return two.select("key", first["term"].alias("term"), first["offset"].alias("offset"), second["term"].alias("mate_term"), second["offset"].alias("mate"), first["count"].alias("count")).where("count > 0")


def phrase_starts(index: DataFrame, points: DataFrame, slop: int = 0) -> DataFrame:
    """Intersect offset-adjusted lists: ``doc, text_key, key, shift`` where both rarest words of a window stand.

    ``shift`` is where the item's first word would be. With ``slop`` the second word may stand
    up to that many words off its place (a proximity match).
    """
    rarest = index.join(checked_broadcast(points.select("key", "term", "offset", "mate").distinct()), "term")
    rarest = rarest.select("doc", "text_key", "key", "mate", (F.col("position") - F.col("offset")).alias("shift"))
    mates = index.join(checked_broadcast(points.select("key", F.col("mate_term").alias("term"), "mate").distinct()), "term")
    mates = mates.select("doc", "text_key", "key", "mate", (F.col("position") - F.col("mate")).alias("shift"))
    if slop:
        mates = mates.withColumn("shift", F.explode(F.sequence(F.col("shift") - slop, F.col("shift") + slop)))
    same = ["doc", "text_key", "key", "mate", "shift"]
    sides = rarest.withColumn("side", F.lit(1)).unionByName(mates.withColumn("side", F.lit(2)))
    return sides.groupBy(*same).agg(F.bit_or("side").alias("sides")).where("sides = 3").select("doc", "text_key", "key", "shift").distinct()


def find_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 13) -> tuple[DataFrame, DataFrame]:
    """Documents with ``doc, text_key, n_words`` and the runs that items cover in them.

    Runs have ``doc, text_key, item, first, last`` (word positions): every maximal stretch that
    agrees with an item over at least ``size`` words, or over all of a shorter item.
    """
    windows = written(windows_of(items, item_col, item_text, size))
    base = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_key"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    vocabulary = written(windows.select(F.explode("words").alias("term")).distinct())
    counts = written(frequencies(base, _passes(vocabulary) or [[]]))
    points = written(starting_points(windows, counts))
    used = points.select("term").unionByName(points.select(F.col("mate_term").alias("term"))).distinct()
    index = written(postings(base, _passes(used) or [[]]))
    starts = written(phrase_starts(index, points))
    wanted = checked_broadcast(starts.select("doc", "text_key").distinct())
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    same = texts["doc"].eqNullSafe(wanted["doc"]) & (texts["text_key"] == wanted["text_key"])
    found = texts.join(wanted, same, "left_semi").dropDuplicates(["doc", "text_key"]).select("doc", "text_key", words_of(F.col("text")).alias("doc_words"))
    pairs = starts.alias("s").join(found.alias("f"), F.col("s.doc").eqNullSafe(F.col("f.doc")) & (F.col("s.text_key") == F.col("f.text_key"))).select("s.*", "doc_words")
    aligned = pairs.join(checked_broadcast(windows), "key")
    inside = F.slice("doc_words", F.greatest(F.col("shift"), F.lit(0)) + 1, F.size("words") - F.greatest(-F.col("shift"), F.lit(0)))
    cut = F.slice("words", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.size("words"))
    agree = F.zip_with(inside, cut, lambda a, b: F.coalesce(a == b, F.lit(False)))
    # lengths of the agreeing stretches, by walking over the comparison once
    marks = F.transform(agree, lambda x, i: F.struct(x.alias("same"), i.alias("i")))
    broken = F.array_union(F.filter(F.transform(marks, lambda m: F.when(~m["same"], m["i"])), lambda i: i.isNotNull()), F.array(F.size(agree)))
    runs = F.transform(broken, lambda b, k: F.struct(F.when(k == 0, F.lit(0)).otherwise(F.element_at(broken, F.greatest(k, F.lit(1))) + 1).alias("a"), (b - 1).alias("b")))
    stretches = aligned.select("doc", "text_key", "item", "length", F.greatest(F.col("shift"), F.lit(0)).alias("at"), F.inline(runs)).where("b - a + 1 >= length")
    runs_found = stretches.select("doc", "text_key", "item", (F.col("at") + F.col("a")).alias("first"), (F.col("at") + F.col("b")).alias("last"))
    return base.select("doc", "text_key", F.size("words").cast("long").alias("n_words")), written(runs_found)


def near_passages(docs: DataFrame, items: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 13) -> DataFrame:
    """Proximity matches from the same index: ``doc, text_key, item, first, distance``.

    A match is a place ``first`` where the rarest word of one of the item's windows stands as if
    the item began there and the second rarest at most ``slop`` words off its own place (the least
    ``distance`` counts; 0: both in place). The words between may be others, which exact
    phrases do not allow; negative ``first``: the document begins inside the item.
    """
    windows = written(windows_of(items, item_col, item_text, size))
    base = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_key"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    vocabulary = written(windows.select(F.explode("words").alias("term")).distinct())
    points = written(starting_points(windows, written(frequencies(base, _passes(vocabulary) or [[]]))))
    used = points.select("term").unionByName(points.select(F.col("mate_term").alias("term"))).distinct()
    index = written(postings(base, _passes(used) or [[]]))
    near = [phrase_starts(index, points, k).withColumn("distance", F.lit(k)) for k in range(slop + 1)]
    least = _union(near).groupBy("doc", "text_key", "key", "shift").agg(F.min("distance").alias("distance"))
    named = least.join(checked_broadcast(windows.select("key", "item")), "key")
    return named.groupBy("doc", "text_key", "item", F.col("shift").alias("first")).agg(F.min("distance").alias("distance"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 13, share: int = 20) -> DataFrame:
    """Per input row ``doc_id, text_key, n_words, n_hit, items`` (sorted texts), ``spans`` and ``contaminated``; other columns are not read.

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z; null has
    none. A word inside any occurrence of an item's window (``size`` words; a shorter item
    is one window, one without words none) is hit. Contaminated: ``share * n_hit >= n_words``
    and any hit. An item without an id hits but is not listed. Rows with a null or repeated id are judged by their own text, whose
    64-bit hash is ``text_key``.
    """
    counts, runs = find_passages(docs, items, id_col, text_col, item_col, item_text, size)
    merged = F.expr(
        "aggregate(array_sort(collect_set(struct(first, last))), cast(array() as array<struct<first: int, last: int>>), (done, r) -> "
        "if(size(done) > 0 and element_at(done, -1).last + 1 >= r.first, "
        "concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).first as first, greatest(element_at(done, -1).last, r.last) as last))), "
        "concat(done, array(struct(r.first as first, r.last as last)))))"
    )
    hits = runs.groupBy("doc", "text_key").agg(merged.alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    hits = hits.select(F.col("doc").alias("hit_doc"), F.col("text_key").alias("hit_key"), "spans", "items")
    both = counts.join(hits, F.col("doc").eqNullSafe(F.col("hit_doc")) & (F.col("text_key") == F.col("hit_key")), "left")
    n_hit = F.coalesce(F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1)"), F.lit(0).cast("long"))
    return both.select(
        F.col("doc").alias("doc_id"), "text_key", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<first: int, last: int>>")).alias("spans"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
