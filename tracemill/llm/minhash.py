"""Near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles (lower-case runs of letters and digits; a shorter
document is one shingle). Its signature has `bands * rows` components. For each shingle, levels 0, 1, 2, ... stand for
the first, second, third, ... occurrence. Levels are laid out in dyadic layers [0,1), [1,2), [2,4), [4,8), ...; in
each layer a Poisson process, seeded by shingle and layer, makes points in order of time; each point falls on
a component and on a level of the layer, and counts if the shingle occurs often enough to reach that level.
A component is the earliest time of its points, so that two documents agree in it with a probability of exactly
sum(min)/sum(max) of the counts. Points later than a bound by which every component has one are never made;
a document for which the bound was too low is done again with a higher one.

Signatures are cut into bands; documents that share a band are candidates; an exact overlap of the multisets
of at least `threshold` makes a link. Exact copies (equal word sequences) take part as one. Classes are the
connected components of the links; see components.bucket_classes for why no bucket lists all its pairs. There a pair
is spared the exact test if the shingles that no other row of such buckets has leave too few for the threshold.

Defined results: documents without a word (null, empty, only signs) are in no class but their own. Repeated rows are
exact copies. class_id is the doc_id of the class's row with the smallest row id. A document with fewer than five words
equals only documents with the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import byte_chunks
from .common import dropped, picked, shipped, with_row_id, written
from .components import bucket_classes, size_class

SHINGLE = 5
BANDS, ROWS = 24, 5
THRESHOLD = 0.8

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            f = np.full(n, base, np.uint64)
            f[0] = 1
            _powers[key] = np.cumprod(f, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of texts whose words stand one space apart, and the texts they are from (ascending)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    space = data == 32
    begins = np.ones(len(data), bool)
    begins[1:] = space[:-1]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    begins &= ~space
    stops = np.ones(len(data), bool)
    stops[:-1] = space[1:]
    stops[(offsets[1:] - 1)[np.diff(offsets) > 0]] = True
    stops &= ~space
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    k = size - 1
    whole = doc[:-k] == doc[k:] if len(doc) > k else np.zeros(0, bool)
    i = np.flatnonzero(whole)
    words = np.bincount(doc, minlength=len(offsets) - 1)
    short = np.flatnonzero((words > 0) & (words < size))
    first = np.searchsorted(doc, short)
    s = np.concatenate([start[i], start[first]])
    e = np.concatenate([end[i + k], end[first + words[short] - 1]])
    owner = np.concatenate([doc[i], short])
    return mix((total[e] - total[s]) * down[s]), owner


def counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, 44 hash bits) as one ascending key, owner in the upper 20 bits, and their counts."""
    key = (owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20))
    key.sort()
    if not len(key):
        return key, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.diff(np.append(at, len(key)))


def bag_minhash(key: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs x m times); rows of documents without a shingle stay infinite."""
    doc = (key >> np.uint64(44)).astype(np.int64)
    item = mix(key & np.uint64((1 << 44) - 1))
    weight = np.bincount(doc, weights=count, minlength=n_docs)
    out = np.full((n_docs, m), np.inf)
    todo = weight > 0
    bound = (np.log(m) + 3) / np.maximum(weight, 1)
    while todo.any():
        pick = todo[doc]
        _points(item[pick], doc[pick], count[pick], bound, out.ravel(), m)
        todo &= ~np.isfinite(out).all(axis=1)
        out[todo] = np.inf
        bound *= 2
    return out


def _points(item: np.ndarray, doc: np.ndarray, count: np.ndarray, bound: np.ndarray, out: np.ndarray, m: int) -> None:
    layer, begin = 0, 0
    while len(item):
        width = max(begin, 1)
        seed = mix(item + np.uint64(layer * 0x632BE59BD9B4E019 % (1 << 64)))
        x, d, c = seed, doc, count
        limit = bound[d]
        t = np.zeros(len(x))
        rate = 1.0 / (m * width)
        while len(x):
            x = mix(x + _BASE)
            t = t - np.log1p((x >> np.uint64(11)).astype(np.float64) * -(2.0**-53)) * rate
            go = t <= limit
            x, d, c, t, limit = x[go], d[go], c[go], t[go], limit[go]
            y = mix(x ^ np.uint64(0xD6E8FEB86659FD93))
            comp = ((y >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            level = begin + (((y & np.uint64(0xFFFFFFFF)) * np.uint64(width)) >> np.uint64(32)).astype(np.int64)
            hit = level < c
            np.minimum.at(out, d[hit] * m + comp[hit].astype(np.int64), t[hit])
        layer, begin = layer + 1, max(1, begin * 2)
        more = count > begin
        item, doc, count = item[more], doc[more], count[more]


def band_buckets(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands 64-bit hashes of the bands."""
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _BASE), (len(signatures), bands))
    for r in range(rows):
        h = mix((h ^ bits[:, :, r]) + _BASE)
    return h.view(np.int64)


def flat_words(text):
    """Lower-case runs of letters and digits, one space apart."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def signatures(rows: DataFrame, bands: int = BANDS, width: int = ROWS) -> DataFrame:
    """_rid, print (md5 of the words) and buckets (one number a band) of rows (_rid, text) that have a word."""
    shipped(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_chunks(batch.column(2)):
                key, count = counted(*shingles(data, offsets))
                sig = bag_minhash(key, count, hi - lo, bands * width)
                flat = pa.array(np.ascontiguousarray(band_buckets(sig, bands, width)).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo) * bands + 1, bands), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), lists], names=["_rid", "print", "buckets"])

    flat = rows.filter(F.col("text").rlike(r"[\p{L}\p{N}]")).select("_rid", flat_words(F.col("text")).alias("flat"))
    return flat.select("_rid", F.md5("flat").alias("print"), "flat").mapInArrow(run, "_rid long, print string, buckets array<long>")


def overlaps(pairs: DataFrame, rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of pairs (a, b) of row ids those whose shingle multisets overlap enough.

    Texts of candidates only are read and moved."""
    pairs = written(pairs, "pairs")
    nodes = written(pairs.select(F.col("a").alias("_rid")).union(pairs.select("b")).distinct(), "nodes")
    texts = written(picked(rows, nodes).select("_rid", flat_words(F.col("text")).alias("flat")), "texts")
    both = (
        pairs.join(texts.select(F.col("_rid").alias("a"), F.col("flat").alias("ta")), "a")
        .join(texts.select(F.col("_rid").alias("b"), F.col("flat").alias("tb")), "b").select("a", "b", "ta", "tb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            side = [byte_bags(batch.column(i)) for i in (2, 3)]
            for (ka, ca), (kb, cb) in zip(*side):
                _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                common = int(np.minimum(ca[i], cb[j]).sum())
                good.append(common >= threshold * (int(ca.sum()) + int(cb.sum()) - common) - 1e-9)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def rare_facts(nodes: DataFrame, rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, fact (size: shingles, shared: those that stand in another of the nodes too, at most) and the class of its size."""
    ids = written(nodes.select(F.col("node").alias("_rid")), "nodes")
    texts = picked(rows, ids).select("_rid", flat_words(F.col("text")).alias("flat"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = list(byte_bags(batch.column(1)))
            ends = pa.array(np.cumsum([0, *[len(k) for k, _ in bags]]), pa.int32())
            keys = pa.array(np.concatenate([k for k, _ in bags]).astype(np.int64)) if bags else pa.array([], pa.int64())
            counts = pa.array(np.concatenate([c for _, c in bags]).astype(np.int64)) if bags else pa.array([], pa.int64())
            size = pa.array([int(c.sum()) for _, c in bags], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.ListArray.from_arrays(ends, keys), pa.ListArray.from_arrays(ends, counts)], names=["node", "size", "keys", "counts"])

    bags = written(texts.mapInArrow(run, "node long, size long, keys array<long>, counts array<long>"), "bags")
    each = bags.select("node", F.explode(F.arrays_zip("keys", "counts")).alias("s")).select("node", "s.keys", "s.counts")
    alone = each.groupBy("keys").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"), F.sum("counts").alias("c")).filter("n = 1")
    alone = alone.groupBy("node").agg(F.sum("c").alias("alone"))
    out = bags.select("node", "size").join(alone, "node", "left")
    return out.select("node", F.struct("size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared")).alias("fact"), size_class(F.col("size"), threshold).alias("size"))


def byte_bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingle hashes and counts of each text of a column."""
    for lo, hi, data, offsets in byte_chunks(column):
        key, count = counted(*shingles(data, offsets))
        cuts = np.searchsorted(key, np.arange(hi - lo + 1, dtype=np.uint64) << np.uint64(44))
        low = np.uint64((1 << 44) - 1)
        for i in range(hi - lo):
            yield key[cuts[i] : cuts[i + 1]] & low, count[cuts[i] : cuts[i + 1]]


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, width: int = ROWS) -> DataFrame:
    """doc_id, class_id and is_first (the row that stays) of every row of docs (columns doc_id, text)."""
    rows = with_row_id(docs, keep=("doc_id", "text"))
    sigs = written(signatures(rows, bands, width), "signatures")
    firsts = sigs.groupBy("print").agg(F.min("_rid").alias("first"))
    reps = sigs.join(firsts, (sigs["print"] == firsts["print"]) & (F.col("_rid") == F.col("first")), "left_semi")
    members = reps.select(F.explode("buckets").alias("bucket"), F.col("_rid").alias("node"))

    def possible(x: str, y: str):
        """The overlap is at most the lesser number of shared shingles; over sum(max) that must reach the threshold."""
        most = F.least(f"{x}.shared", f"{y}.shared")
        return most * (1 + threshold) >= (F.col(f"{x}.size") + F.col(f"{y}.size")) * threshold - 1e-6

    roots = bucket_classes(members, lambda pairs: overlaps(pairs, rows, threshold), lambda nodes: rare_facts(nodes, rows, threshold), possible)
    copies = sigs.select("_rid", "print").join(firsts, "print").select("_rid", "first")
    owner = written(copies.join(roots, F.col("first") == F.col("node"), "left").select("_rid", F.coalesce("root", "first").alias("root")), "owners")
    dropped(sigs, roots)
    ids = rows.select("_rid", "doc_id")
    out = ids.join(owner, "_rid", "left").select("_rid", "doc_id", F.coalesce("root", "_rid").alias("root"))
    named = out.join(ids.select(F.col("_rid").alias("root"), F.col("doc_id").alias("class_id")), "root")
    return named.select("_rid", "doc_id", "class_id", (F.col("_rid") == F.col("root")).alias("is_first"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without all but the first row of each class; other columns may have any names."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kept = tuple(inner.columns)
    rows = with_row_id(inner.withColumn("doc_id", F.col(f"c{names.index('doc_id')}")), keep=kept)
    text = rows.select(F.col("_rid").alias("doc_id"), F.col(f"c{names.index('text')}").alias("text"))
    firsts = classes(text).filter("is_first").select(F.col("doc_id").alias("_rid"))
    return rows.join(firsts, "_rid", "left_semi").select(*kept).toDF(*names)
