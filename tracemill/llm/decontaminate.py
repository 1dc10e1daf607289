"""Benchmark decontamination with DataFrame functions only.

Words are lower-case runs of letters and digits. A window is a run of words of a document as long as a benchmark
item, or the whole document if that is shorter. To be as similar to an item as asked, a window of w shingles (five words each) and an
item of g must have similarity * (g + w) / (1 + similarity) shingles in common, so it holds as many positions whose shingle
stands in an item of that length. All windows with so many are laid, in whatever order the shingles stand, and no others:
a position is in at most 1.125 windows for each length of the items, whatever the document. Each distinct window
gets a 128-bit SimHash of its shingles, as does each item. Both are cut into eight blocks of 16 bits; items are
indexed under their length and every value within two bits of a block. A pair at a Hamming distance of up to 23 has a
block that differs in two bits at most, so all windows within that radius of an item of their length become candidates.
Candidates are verified exactly: the overlap of the shingles as multisets, each weighted by its number of
occurrences, sum(min) / sum(max), must be at least `similarity`. A pair of that similarity that lies beyond the radius and
meets in no block is missed; see the README for how often that happens.

Items of fewer than five words have one shingle, of all their words. Items without a word match nothing.

Defined results: null and empty texts match nothing; repeated documents or items each give their own rows; equal items
give a row each; of several windows of a document that match an item, the most similar one counts, then the
first; empty tables give an empty result; very long texts are read whole, a row for each word; columns besides the ids and texts are
ignored by matches() and returned as they are by clean(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, picked, plain_words, with_row_id, written
from .simhash import with_fingerprint

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 16, 2
#: So many rows of a few numbers (some 16 MB) are broadcast at most; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000

#: The shingles of an array column `words`; one of all words if there are fewer than five.
GRAMS = (
    f"case when size(words) = 0 then cast(array() as array<string>) when size(words) < {SHINGLE} then array(array_join(words, ' ')) "
    f"else transform(sequence(0, size(words) - {SHINGLE}), i -> array_join(slice(words, i + 1, {SHINGLE}), ' ')) end"
)


def gram_hashes(size: int) -> Column:
    """Array of the hashes of all runs of `size` words."""
    refs = ", ".join(f"get(words, i + {j})" for j in range(size))
    return F.expr(f"case when size(words) >= {size} then transform(sequence(0, size(words) - {size}), i -> xxhash64({refs})) end")


def small(df: DataFrame) -> DataFrame:
    """df, a written table of a few numbers a row, marked for broadcast if its rows are counted few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_table(benchmark: DataFrame) -> DataFrame:
    """_item (running id), words and size of the items that have a word."""
    rows = with_row_id(benchmark.select("item_id", "text"), "item_id", keep=("item_id", "text"))
    words = rows.select(F.col("_rid").alias("_item"), "item_id", plain_words(F.col("text")).alias("words"))
    return words.withColumn("size", F.size("words")).filter("size > 0")


def windows(rows: DataFrame, items: DataFrame, similarity: float) -> DataFrame | None:
    """_rid, start, laid (the items' length) and words of all windows of rows (_rid, text) that can be as similar to an item; None without items."""
    docs = rows.select("_rid", plain_words(F.col("text")).alias("words"))
    kinds = [r.k for r in items.select(F.least("size", F.lit(SHINGLE)).alias("k")).distinct().collect()]
    found = None
    for k in sorted(kinds):  # at most five: 1, 2, 3, 4 (whole short items) and 5
        own = items.filter(F.least("size", F.lit(SHINGLE)) == k)
        known = written(own.select(F.col("size").alias("laid"), F.explode_outer(gram_hashes(k)).alias("h")).distinct(), "shingles")
        # The outer forms: for the others, and for filters on what they read, the optimizer would split every text once more for each word.
        at = docs.select("_rid", F.size("words").alias("n"), gram_hashes(k).alias("hs")).select("_rid", "n", F.posexplode_outer("hs").alias("at", "h"))
        spots = at.filter("h is not null").join(small(known), "h").groupBy("_rid", "n", "laid").agg(F.sort_array(F.collect_list("at")).alias("p"))
        wide = F.least("n", "laid") - k  # from the first to the last shingle of a window
        need = F.ceil((F.col("laid") + F.least("n", "laid") + 2 - 2 * k) * (similarity / (1 + similarity)) - 1e-9).cast("int")
        spots = spots.select("_rid", "n", "laid", "p", wide.alias("wide"), F.greatest(need, F.lit(1)).alias("need"))
        runs = "transform(sequence(0, size(p) - need), i -> case when p[i + need - 1] - p[i] <= wide then sequence(greatest(0, p[i + need - 1] - wide), greatest(0, least(p[i], n - laid))) else cast(array() as array<int>) end)"
        starts = F.expr(f"case when size(p) >= need then array_distinct(flatten({runs})) else cast(array() as array<int>) end")
        laid = written(spots.select("_rid", "laid", F.explode_outer(starts).alias("start")).filter("start is not null"), "starts")
        dropped(known)
        found = laid if found is None else found.union(laid)
    if found is None:
        return None
    ids = written(found.select("_rid").distinct(), "window-rows")
    texts = picked(rows, ids).select("_rid", plain_words(F.col("text")).alias("words"))
    each = texts.join(found, "_rid").select("_rid", "laid", "start", "words")
    return each.select("_rid", "start", "laid", F.expr("slice(words, start + 1, laid)").alias("words"))


def prints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, f1 and f2 of texts (keys, words)."""
    return with_fingerprint(texts.select(*keys, F.expr(f"transform({GRAMS}, g -> xxhash64(g))").alias("grams")), "grams", keys)


def near_values() -> Column:
    """All masks of BLOCK_BITS bits of which BLOCK_RADIUS are set at most."""
    one = [1 << i for i in range(BLOCK_BITS)]
    return F.array(*[F.lit(x) for x in [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i])]])


def block_values() -> Column:
    """Array of (block number, value) of f1 and f2."""
    value = lambda f, at: F.shiftrightunsigned(F.col(f), at).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    return F.array(*[F.struct(F.lit(i).alias("block"), value("f1" if i < 4 else "f2", BLOCK_BITS * (i % 4)).alias("value")) for i in range(BLOCKS)])


def overlap() -> Column:
    """Multiset Jaccard similarity of the string arrays g and w."""
    common = F.expr(
        "case when size(array_distinct(g)) = size(g) and size(array_distinct(w)) = size(w) then size(array_intersect(g, w)) "
        "else aggregate(array_distinct(g), 0, (s, x) -> s + least(size(filter(g, y -> y = x)), size(filter(w, y -> y = x)))) end"
    )
    return common / (F.size("g") + F.size("w") - common)


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, start (word), n_words and similarity of the best window for each document and item that match.

    docs: doc_id, text; benchmark: item_id, text."""
    rows = with_row_id(docs, keep=("doc_id", "text"))
    got = hits(rows.select("_rid", "text"), benchmark, similarity)
    return got.join(rows.select("_rid", "doc_id"), "_rid").select("doc_id", "item_id", "start", "n_words", "similarity")


def hits(rows: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """_rid, item_id, start, n_words and similarity of rows (_rid, text)."""
    items = written(item_table(benchmark), "items")
    none = rows.sparkSession.createDataFrame([], "_rid long, item_id bigint, start int, n_words int, similarity double")
    placed = windows(rows, items, similarity)
    if placed is None:
        return none.withColumn("item_id", F.col("item_id").cast(dict(benchmark.dtypes)["item_id"]))
    placed = written(placed.withColumn("_win", F.xxhash64("laid", "words")), "windows")
    texts = written(placed.groupBy("_win", "laid").agg(F.first("words").alias("words")), "window-texts")
    keyed = prints(texts, ["_win", "laid"]).select("_win", "laid", F.explode(block_values()).alias("b")).select("_win", "laid", "b.block", "b.value")
    indexed = prints(items, ["_item", "size"]).select("_item", F.col("size").alias("laid"), F.explode(block_values()).alias("b"))
    indexed = indexed.select("_item", "laid", "b.block", "b.value", F.explode(near_values()).alias("mask")).select("_item", "laid", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    pairs = keyed.join(indexed, ["laid", "block", "value"]).select("_win", "_item").distinct()
    side = texts.select("_win", F.size("words").alias("n_words"), F.expr(GRAMS).alias("w"))
    own = items.select("_item", "item_id", F.expr(GRAMS).alias("g"))
    good = pairs.join(side, "_win").join(own, "_item").withColumn("similarity", overlap()).filter(F.col("similarity") >= similarity - 1e-12)
    good = written(good.select("_win", "_item", "item_id", "similarity", "n_words"), "alike")
    all_hits = placed.select("_rid", "start", "_win").join(small(good), "_win")
    best = all_hits.groupBy("_rid", "_item", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("m"))
    best = written(best.select("_rid", "item_id", (-F.col("m.back")).alias("start"), F.col("m.n_words").alias("n_words"), F.col("m.similarity").alias("similarity")), "matches")
    dropped(items, placed, texts, good)
    return best


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without those that hold a benchmark item; other columns may have any names."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kept = tuple(inner.columns)
    rows = with_row_id(inner.withColumn("doc_id", F.col(f"c{names.index('doc_id')}")), keep=kept)
    bad = hits(rows.select("_rid", F.col(f"c{names.index('text')}").alias("text")), benchmark, similarity).select("_rid").distinct()
    return rows.join(bad, "_rid", "left_anti").select(*kept).toDF(*names)
