"""Benchmark decontamination by winnowing, in DataFrame expressions only.

The fingerprints of a text are the least hashes of GRAM words in every window of
WINDOW words. Two texts that share a window share its least hash, so a join on
fingerprints finds every document with an occurrence of a benchmark window.
Documents that meet a fingerprint are looked at again: windows with a known
fingerprint are compared in full and extended to the words they cover.

Items with fewer words than a window are one window each, found by the hash of
all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.session import stored

WINDOW = 10
GRAM = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased; empty for null."""
    # lower() is the fast way where it does the same: in texts of ASCII only.
    ascii_only = F.length(text) == F.octet_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(folded, _BETWEEN), ""), F.array().cast("array<string>"))


def _upto(n: Column, size: int) -> Column:
    """Places 0.. where ``size`` of ``n`` begin; empty if there is none."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_fingerprints(grams: Column, n: Column) -> Column:
    """The least gram hash of each window of WINDOW words."""
    return F.transform(_upto(n, WINDOW), lambda j: F.least(*[F.get(grams, j + k) for k in range(WINDOW - GRAM + 1)]))


def gram_hashes(hashes: Column, n: Column) -> Column:
    return F.transform(_upto(n, GRAM), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(GRAM)]))


def short_fingerprint(size: int, at: Column) -> Column:
    """Hash of ``size`` words from ``at``, apart from those of other sizes."""
    return F.xxhash64(F.lit(size), *[F.get("hashes", at + k) for k in range(size)])


def _each_short(size: int, told) -> Column:
    """``told(place, fingerprint)`` at every place where ``size`` words begin."""
    return F.transform(_upto(F.col("n"), size), lambda i: told(i, short_fingerprint(size, i)))


def _laid_out(df: DataFrame, *keep: str) -> DataFrame:
    """``keep``, words, their number, hashes and gram hashes, each worked out once."""
    split = df.select(*keep, words_of(F.col("text")).alias("words"))
    counted = split.select("*", F.size("words").alias("n"), word_hashes(F.col("words")).alias("hashes"))
    return counted.select("*", gram_hashes(F.col("hashes"), F.col("n")).alias("grams"))


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """Windows ``window, fp, items`` of all items, item sets ``items, item_id``, and the lengths of short items.

    ``items`` names the set of items that have the window. Items without words
    have no window; a null id counts as an empty one.
    """
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")
    laid = _laid_out(benchmark.select(item, "text").distinct(), "item_id")
    prints = window_fingerprints(F.col("grams"), F.col("n"))
    text_at = lambda j, size: F.array_join(F.slice("words", j + 1, size), " ")
    long = F.transform(prints, lambda fp, j: F.struct(text_at(j, WINDOW).alias("window"), fp.alias("fp"), F.lit(WINDOW).alias("size")))
    short = F.lit(None)
    for size in range(1, WINDOW):
        one = F.struct(F.array_join("words", " ").alias("window"), short_fingerprint(size, F.lit(0)).alias("fp"), F.lit(size).alias("size"))
        short = F.when(F.col("n") == size, F.array(one)).otherwise(short)
    rows = laid.select("item_id", F.inline(F.when(F.col("n") >= WINDOW, long).otherwise(short))).distinct()
    listed = rows.groupBy("window", "fp", "size").agg(F.array_sort(F.collect_set("item_id")).alias("held"))
    windows = stored(listed.select("window", "fp", "size", F.md5(F.array_join("held", ",")).alias("items"), "held"), "windows")
    sets = windows.select("items", "held").dropDuplicates(["items"]).select("items", F.explode("held").alias("item_id"))
    # At most WINDOW - 1 numbers.
    sizes = [r["size"] for r in windows.filter(F.col("size") < WINDOW).select("size").distinct().collect()]
    return windows.drop("held"), sets, sorted(sizes)


def _fingerprints(sizes: list[int]) -> Column:
    """All distinct fingerprints of a laid-out text."""
    parts = [window_fingerprints(F.col("grams"), F.col("n"))]
    parts += [_each_short(size, lambda i, fp: fp) for size in sizes]
    return F.array_distinct(F.concat(*parts))


def _known_windows(sizes: list[int]) -> Column:
    """Structs ``at, size, fp, window`` of all windows of a laid-out text."""
    text_at = lambda j, size: F.array_join(F.slice("words", j + 1, size), " ")

    def told(size):
        return lambda j, fp: F.struct(j.alias("at"), F.lit(size).alias("size"), fp.alias("fp"), text_at(j, size).alias("window"))

    prints = window_fingerprints(F.col("grams"), F.col("n"))
    parts = [F.transform(prints, lambda fp, j: told(WINDOW)(j, fp))]
    parts += [_each_short(size, told(size)) for size in sizes]
    return F.concat(*parts)


def covered_words(intervals: Column) -> Column:
    """Words inside at least one of the sorted intervals ``at, size``."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def add(a: Column, x: Column) -> Column:
        end = x["at"] + x["size"]
        fresh = F.greatest(F.lit(0), end - F.greatest(a["end"], x["at"])).cast("long")
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["total"] + fresh).alias("total"))

    return F.aggregate(intervals, start, add)["total"]


def contaminated_words(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document with the words that lie in benchmark windows.

    ``doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, n_rows``;
    equal rows of ``doc_id`` and text are one row here, ``n_rows`` of them.
    """
    windows, sets, sizes = benchmark_windows(benchmark)
    prints = windows.select("fp").distinct()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    laid = _laid_out(keyed, "doc_id", "text_hash")
    # A null fingerprint for the row itself, then its own.
    own = F.concat(F.array(F.lit(None).cast("long")), _fingerprints(sizes))
    rows = laid.select("doc_id", "text_hash", "n", F.explode(own).alias("fp"))
    met = rows.join(prints.select(F.col("fp").alias("known")), F.col("fp") == F.col("known"), "left")
    seen = stored(
        met.groupBy("doc_id", "text_hash", "n").agg(
            F.count(F.when(F.col("fp").isNull(), 1)).alias("n_rows"), F.count("known").alias("met")
        ),
        "seen",
    )

    suspects = seen.filter("met > 0").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    again = _laid_out(keyed.join(suspects, same, "left_semi"), "doc_id", "text_hash")
    places = again.select("doc_id", "text_hash", F.inline(_known_windows(sizes))).join(prints, "fp", "left_semi")
    hits = stored(
        places.join(windows, ["fp", "size", "window"]).select("doc_id", "text_hash", "at", "size", "items").distinct(), "hits"
    )
    key = ["doc_id", "text_hash"]
    intervals = hits.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("at", "size"))).alias("intervals"))
    lengths = intervals.select(*key, covered_words(F.col("intervals")).alias("n_hit"))
    items = hits.select(*key, "items").distinct().join(sets, "items").groupBy(*key).agg(F.collect_set("item_id").alias("held"))
    found = lengths.alias("l").join(
        items.alias("i"), F.col("l.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("l.text_hash") == F.col("i.text_hash"))
    )
    found = found.select(F.col("l.doc_id").alias("id"), F.col("l.text_hash").alias("hash"), "n_hit", "held")
    joined = seen.join(found, same, "left")
    held = F.coalesce("held", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "text_hash",
        F.col("n").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(held).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(held), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "n_rows",
    )


def judge_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs`` (``doc_id, text``).

    A null or empty text has no words and no hits; items without words are
    ignored, repeated items count once, a null item id counts as an empty one.
    Repeated rows give repeated rows, other columns are not read, empty tables
    give no rows or no hits.
    """
    judged = contaminated_words(docs, benchmark)
    return judged.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows")))).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without an occurrence of a benchmark window."""
    bad = contaminated_words(docs.select("doc_id", "text"), benchmark).filter("contaminated")
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"))
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"])
    return docs.join(bad, same, "left_anti")
