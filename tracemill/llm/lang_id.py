"""Language identification by cross-parsing entropy.

For each language a suffix automaton accepts every substring of a bounded sample of labelled text.
A text is cross-parsed against each automaton: starting anew after every phrase, the longest match
that the automaton allows is one phrase. The number of phrases per symbol estimates the cross entropy
of the text under the language; the language that needs fewest wins.

Symbols are UTF-8 bytes, letters folded to lower case, each run of bytes that no letter uses folded to one
separator. Whole texts are parsed. So that all blocks of many texts step through an automaton side by side in numpy, each
block is first parsed as if a phrase began with it; the phrase that really crosses into it is then followed until both parses
begin a phrase at the same symbol, from where they agree, and the counts are put right. Where that does not happen within a
block, the next one is followed again from the state so found: the result is that of one parser running through the whole text.

Every language with a labelled text takes part; the bytes learned of each shrink with their number, so that the tables of
all automata together stay below a fixed size.

Defined results: a null text, an empty one and one without a letter give `und` with score 0; if there is no
labelled row at all, every text does. A tie goes to the language first in alphabetical order. Rows
repeat as they repeat in the input; other columns of the input are ignored by identify() and kept by accepted(), whatever their names. A
null id counts as held out. An empty table gives an empty one. Texts of any length are parsed in chunks of whole texts, in time that grows with their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import byte_chunks
from .common import held_out, shipped

UND = "und"
BREAK = np.uint32(1 << 31)

#: Bounds of the training sample: texts per language, bytes taken of each text, bytes of all languages together.
DOCS_PER_LANG = 64
BYTES_PER_DOC = 768
TOTAL_BYTES = 4 * DOCS_PER_LANG * BYTES_PER_DOC
#: Symbols parsed side by side in one block, and bytes of text in one chunk of blocks.
BLOCK = 256
CHUNK = 1 << 20


def fold_table() -> np.ndarray:
    """Byte to folded byte; 0 is the separator."""
    t = np.zeros(256, np.uint8)
    for b in range(ord("a"), ord("z") + 1):
        t[b] = b
        t[b - 32] = b
    for b in range(0x80, 0x100):
        t[b] = b + 0x20 if b < 0xA0 else b  # in two-byte Latin letters this folds the case
    return t


FOLD = fold_table()


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded symbols with runs of separators collapsed, and the texts' new offsets."""
    s = FOLD[data]
    keep = np.ones(len(s), bool)
    if len(s):
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        firsts = offsets[:-1][np.diff(offsets) > 0]
        keep[firsts] = True
    at = np.zeros(len(s) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return s[keep], at[offsets]


def suffix_automaton(symbols: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts the substrings of symbols; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Automaton:
    """Transition table over the symbols of one language's sample."""

    def __init__(self, text: bytes):
        seen = sorted(set(text))
        unknown, self.pad = len(seen), len(seen) + 1  # codes for symbols never seen, and for what follows a text's end
        self.code = np.full(256, unknown, np.uint8)
        self.code[seen] = np.arange(len(seen))
        self.width = len(seen) + 2
        nxt = suffix_automaton(text)
        # One state more: no phrase goes on, so any symbol begins one. A symbol that no phrase can hold is a phrase alone.
        self.idle = np.uint32(len(nxt) * self.width)
        step = np.full((len(nxt) + 1, self.width), self.idle | BREAK, np.uint32)
        for c, to in nxt[0].items():
            step[:, self.code[c]] = np.uint32(to * self.width) | BREAK
        for s, edges in enumerate(nxt):
            for c, to in edges.items():
                step[s, self.code[c]] = to * self.width
        step[:, self.pad] = np.arange(len(nxt) + 1) * self.width
        self.step = step.ravel()

    def count(self, symbols: np.ndarray, starts: np.ndarray, lens: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases that begin in each block; a block follows the one before it, or begins a text."""
        n, width = len(starts), int(lens.max(initial=0))
        order = np.argsort(-lens, kind="stable")  # the longest first, so that those still running stand in front
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        sizes = lens[order]
        active = np.searchsorted(-sizes, -np.arange(1, width + 1), side="right")
        codes = np.concatenate([self.code[symbols], np.full(width, self.pad, np.uint8)])
        grid = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, max(width, 1))[starts[order]].T) if n else np.zeros((0, 0), np.uint8)
        state = np.full(n, self.idle, np.uint32)
        begins = np.zeros((width, n), bool)
        for t in range(width):
            k = active[t]
            x = self.step.take(state[:k] + grid[t, :k])
            np.greater_equal(x, BREAK, out=begins[t, :k])
            np.bitwise_and(x, ~BREAK, out=state[:k])
        fresh, ends = begins.sum(axis=0)[place], state[place]
        counts, exits = fresh.copy(), ends.copy()
        todo = np.flatnonzero(follows)
        while len(todo):
            live, cur, col = np.arange(len(todo)), exits[todo - 1], place[todo]
            delta = np.zeros(len(todo), np.int64)
            for t in range(width):
                inside = lens[todo[live]] > t
                if not inside.all():  # the last block of a text ends
                    live, cur, col = live[inside], cur[inside], col[inside]
                if not len(live):
                    break
                x = self.step.take(cur + grid[t, col])
                here, was = x >= BREAK, begins[t, col]
                delta[live] += here.astype(np.int64) - was
                go = ~(here & was)
                live, cur, col = live[go], (x & ~BREAK)[go], col[go]
            out = ends[todo].copy()
            out[live] = cur
            counts[todo] = fresh[todo] + delta
            changed = todo[out != exits[todo]]
            exits[todo] = out
            todo = changed[changed + 1 < n] + 1
            todo = todo[follows[todo]]
        return counts


class CrossParser:
    """Parses texts against the automata of several languages."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.langs = sorted(samples)
        self.automata = []
        for lang in self.langs:
            raw = [np.frombuffer(x, np.uint8) for x in samples[lang]]
            ends = np.cumsum([0, *map(len, raw)])
            self.automata.append(Automaton(folded(np.concatenate(raw) if raw else np.zeros(0, np.uint8), ends)[0].tobytes()))

    def phrases(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """For each text the number of phrases by language, and its number of symbols."""
        symbols, at = folded(data, offsets)
        sizes = np.diff(at)
        n_blocks = -(-sizes // block)
        owner = np.repeat(np.arange(len(sizes)), n_blocks)
        number = np.arange(len(owner)) - (np.cumsum(n_blocks) - n_blocks)[owner]
        starts = at[owner] + number * block
        lens = np.minimum(at[owner + 1] - starts, block)
        total = np.zeros((len(self.langs), len(sizes)), np.int64)
        for k, a in enumerate(self.automata):
            counts = a.count(symbols, starts, lens, number > 0)
            total[k] = np.bincount(owner, weights=counts, minlength=len(sizes)).astype(np.int64)
        return total, sizes


_parsers: dict[int, CrossParser] = {}


def parser(samples: dict[str, list[bytes]]) -> CrossParser:
    """One parser for each Python worker and sample."""
    key = hash(tuple((k, *v) for k, v in sorted(samples.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(samples)
    return _parsers[key]


def sample(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, bytes_per_doc: int = BYTES_PER_DOC, total_bytes: int = TOTAL_BYTES) -> dict[str, list[bytes]]:
    """Labelled texts that are not held out: of each language those with the smallest hashes of id and text.

    At most docs_per_lang texts of a language and bytes_per_doc bytes of each, from a place that the hash tells; fewer bytes if
    all languages would have more than total_bytes."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each language
    if not counts:
        return {}
    size = max(8, min(bytes_per_doc, total_bytes // (len(counts) * docs_per_lang)))
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(scale, scale * 8 * docs_per_lang // r.n + 1))])
    mark = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(scale))
    part = (
        rows.select("lang", mark.alias("mark"), "text").filter(F.col("mark") < F.element_at(share, F.col("lang")))
        .filter(F.col("text").rlike(r"\p{L}"))
        .select("lang", "mark", F.expr(f"substring(text, 1 + cast(pmod(mark, greatest(length(text) - {size} + 1, 1)) as int), {size})").alias("part"))
    )
    out: dict[str, list[bytes]] = {}
    for r in sorted(part.distinct().collect(), key=lambda r: (r.lang, r.mark, r.part)):
        got = out.setdefault(r.lang, [])
        if len(got) < docs_per_lang:
            got.append(r.part.encode()[:size])
    return out


def predict(docs: DataFrame, samples: dict[str, list[bytes]], keep: tuple[str, ...], as_names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs' columns `keep` with lang_pred and score (or as_names).

    score: 1 - fewest / second fewest phrases per symbol, scaled to 0..1 by a logistic curve; above 0.5 for
    any text with a letter and a strict winner; 0 for und."""
    shipped(docs.sparkSession)
    inner = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    schema = docs.select(*keep).schema
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(samples)
        for batch in batches:
            best, score = [], []
            letter = batch.column(len(names) + 1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in byte_chunks(batch.column(len(names)), CHUNK):
                if not p.langs:
                    best += [UND] * (hi - lo)
                    score += [0.0] * (hi - lo)
                    continue
                counts, sizes = p.phrases(data, offsets)
                rate = (counts / np.maximum(sizes, 1)).T
                win = rate.argmin(axis=1)
                low = np.sort(rate, axis=1)
                second = low[:, 1] if low.shape[1] > 1 else np.maximum(low[:, 0], 1.0)
                margin = 1 - low[:, 0] / np.maximum(second, 1e-9)
                sure = 1 / (1 + np.exp(-20 * np.maximum(margin, 0)))
                ok = letter[lo:hi]
                best += [p.langs[w] if y else UND for w, y in zip(win, ok)]
                score += np.where(ok, sure, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*names, *as_names])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return inner.mapInArrow(run, f"{ddl}, {as_names[0]} string, {as_names[1]} double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs (columns doc_id, text, lang)."""
    return predict(docs.withColumn("held_out", held_out()), sample(docs), ("doc_id", "held_out"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows whose language is known (not und); other columns may have any names."""
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = F.col(f"c{docs.columns.index('text')}")
    got = predict(inner.withColumn("text", text), sample(docs), tuple(inner.columns), as_names=("p0", "p1"))
    return got.filter(F.col("p0") != UND).select(*inner.columns).toDF(*docs.columns)
