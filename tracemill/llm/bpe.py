"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on arrays: every code point becomes a symbol (its class, with what the pattern looks ahead for),
every symbol a transition function on the scanner's few states. All functions that composition can yield form
a small monoid, numbered once with its composition table; an associative scan over the numbers gives the state
before every code point, and with it the token boundaries. No regular expression runs over a text. The pieces
go through a cache to greedy pair merging by rank. Character and token offsets stay available for decoding.

The boundaries are those of the pattern
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
and no special token is recognised.

Defined results: null and empty texts have no ids; every other text has ids that decode to its bytes; repeated rows
give equal rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import shipped

#: Cached pieces of a Python worker; beyond, the cache starts anew.
CACHE_PIECES = 400_000
#: Ids of cached pieces, likewise.
CACHE_IDS = 1 << 22
#: New pieces of up to so many bytes are merged together, in arrays of one of these widths.
WIDTHS = (8, 16, 32)
#: So many pieces stand in those arrays at a time, which then fit into a processor's own cache.
MERGED_AT_ONCE = 4096
#: Pieces of up to so many one-byte code points, which fit into one number, are looked up once a chunk.
KEY_CHARS = 8
#: Code points scanned at once.
CHUNK_CHARS = 1 << 20
SCAN_ROWS = 64

# Symbols of the scanner.
LETTER, NUMBER, OTHER, GAP, SPACE_END, GAP_END, GAP_LAST, SHORT2, SHORT3 = range(9)
N_SYMBOLS = 9
# States: what the current token is. LEAD is a space that the next run takes in.
START, IN_L, IN_N, IN_O, IN_GAP, LEAD, MORE1, MORE2 = range(8)
N_STATES = 8


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a token begins at this symbol.

    GAP: white space followed by white space or the end; SPACE_END: U+0020 before something else; GAP_END: other white
    space before something else; SHORT2, SHORT3: an apostrophe that begins a contraction of two or three
    characters if a token begins there."""
    if state in (MORE1, MORE2):
        return (START if state == MORE1 else MORE1), False
    if symbol == GAP:
        return IN_GAP, state != IN_GAP
    if symbol == SPACE_END:
        return LEAD, True
    if symbol == GAP_END:
        return START, True
    if symbol in (SHORT2, SHORT3) and state not in (LEAD, IN_O):
        return (MORE1 if symbol == SHORT2 else MORE2), True
    into = {LETTER: IN_L, NUMBER: IN_N}.get(symbol, IN_O)
    return into, state not in (LEAD, into)


def _monoid():
    """Transition functions closed under composition: rows of next states, composition table, number of each symbol's function."""
    gens = [tuple(_step(s, c)[0] for s in range(N_STATES)) for c in range(N_SYMBOLS)]
    gens += [tuple([_step(START, c)[0]] * N_STATES) for c in range(N_SYMBOLS)]  # the first symbol of a text
    ident = tuple(range(N_STATES))
    known = {ident: 0}
    queue = [ident]
    for f in queue:
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    maps = np.array(queue, np.uint8)
    n = len(queue)
    compose = np.zeros((n, n), np.uint16)
    for i, f in enumerate(queue):
        for j, g in enumerate(queue):
            compose[i, j] = known[tuple(g[x] for x in f)]
    number = np.array([known[g] for g in gens], np.uint16)
    return maps, compose.ravel(), number, n


MAPS, COMPOSE, FUNCTION, N_MAPS = _monoid()
NO_KEY = (1 << 31) - 1
BEGINS = np.array([[_step(s, c)[1] for c in range(N_SYMBOLS)] for s in range(N_STATES)])

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point: LETTER, NUMBER, OTHER or GAP (white space)."""
    if not _classes:
        points = np.arange(0x110000, dtype=np.uint32)
        points[0xD800:0xE000] = ord("!")
        text = points.tobytes().decode("utf-32-le")
        out = np.full(0x110000, OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", GAP)):
            for m in regex.finditer(pattern, text):
                out[m.start() : m.end()] = kind
        out[0x1C:0x20] = OTHER  # separators that are no White_Space in Unicode
        _classes.append(out)
    return _classes[0]


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The scanner's symbols of code points; first marks where a text begins."""
    kind = classes()[points]
    out = kind.copy()
    n = len(points)
    ends = np.ones(n, bool)  # the last of its text
    ends[:-1] = first[1:]
    gap = kind == GAP
    before_other = np.zeros(n, bool)
    before_other[:-1] = gap[:-1] & ~gap[1:] & ~ends[:-1]
    out[before_other] = GAP_END
    out[before_other & (points == 32)] = SPACE_END
    quote = np.flatnonzero((points == 39) & ~ends)
    if len(quote):
        a = points[quote + 1]
        out[quote[np.isin(a, (115, 116, 109, 100))]] = SHORT2
        room = quote[~ends[quote + 1]]
        pair = points[room + 1].astype(np.int64) * 1000 + points[room + 2]
        out[room[np.isin(pair, (114 * 1000 + 101, 118 * 1000 + 101, 108 * 1000 + 108))]] = SHORT3
    return out


def scan(functions: np.ndarray) -> np.ndarray:
    """Composition of all functions before each position: an exclusive associative scan in blocks."""
    n = len(functions)
    if n <= SCAN_ROWS:
        out = np.zeros(n, np.uint16)
        acc = 0
        for i in range(n):
            out[i] = acc
            acc = COMPOSE[acc * N_MAPS + functions[i]]
        return out
    cols = -(-n // SCAN_ROWS)
    grid = np.zeros(cols * SCAN_ROWS, np.uint16)  # 0 is the identity
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(cols, SCAN_ROWS).T)
    inner = np.zeros_like(grid)
    acc = np.zeros(cols, np.uint16)
    for t in range(SCAN_ROWS):
        inner[t] = acc
        acc = COMPOSE.take(acc.astype(np.int32) * N_MAPS + grid[t])
    outer = scan(acc).astype(np.int32) * N_MAPS
    return np.ascontiguousarray(COMPOSE.take(outer[None, :] + inner).T).ravel()[:n]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions where tokens begin."""
    syms = symbols(points, first)
    before = scan(FUNCTION[syms + N_SYMBOLS * first.astype(np.uint8)])
    state = MAPS[:, START][before]
    state[first] = START
    return np.flatnonzero(BEGINS[state, syms])


def alike(points: np.ndarray, cut: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in cut that stand for all pieces, and which of them stands for each piece.

    Equal pieces of up to KEY_CHARS code points from 1 to 255 have one; any other piece has its own."""
    odd = np.cumsum((points == 0) | (points > 255))
    short = (sizes <= KEY_CHARS) & (odd[cut + sizes - 1] == odd[cut] - ((points[cut] == 0) | (points[cut] > 255)))
    own, some = np.flatnonzero(~short), np.flatnonzero(short)
    keys = np.zeros(len(some), np.uint64)
    at, size = cut[some], sizes[some]
    for i in range(KEY_CHARS):
        if i:
            more = size > i
            keys[more] |= points[at[more] + i].astype(np.uint64) << np.uint64(8 * i)
        else:
            keys |= points[at]
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    which = np.empty(len(cut), np.int64)
    which[some[order]] = np.cumsum(new) - 1
    first = some[order[new]]
    which[own] = len(first) + np.arange(len(own))
    return np.concatenate([first, own]), which


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pieces:
    """Numbers of pieces met before, and the ids of each, which stand one behind the other in an array."""

    def __init__(self, ranks: dict[bytes, int], merges: Merges):
        self.ranks, self.merges = ranks, merges
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.long: list[str] = []  # pieces that are not kept
        self.many = self.held = 0  # pieces numbered and ids held
        self.ids, self.begin, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece, good until the next call; new ones are merged together."""
        for piece in self.long:
            del self.number[piece]
        self.long = []
        out = np.fromiter(map(self.number.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            new = set(map(pieces.__getitem__, missing))
            if self.many + len(new) >= CACHE_PIECES or self.held >= CACHE_IDS:
                self.clear()
                missing, new = range(len(pieces)), set(pieces)
            self._learn(list(new))
            out[missing] = np.fromiter(map(self.number.__getitem__, map(pieces.__getitem__, missing)), np.int64, len(missing))
        return out

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces with these numbers, one behind the other, and where those of each piece end."""
        counts = self.count[numbers]
        ends = np.cumsum(counts)
        return self.ids[np.repeat(self.begin[numbers] - ends + counts, counts) + np.arange(counts.sum())], ends

    def _learn(self, new: list[str]) -> None:
        try:
            raws = list(map(str.encode, new))
        except UnicodeEncodeError:
            raws = [x.encode("utf-8", "surrogatepass") for x in new]
        whole = np.fromiter(map(self.ranks.get, raws, itertools.repeat(-1)), np.int32, len(raws))
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        known = np.flatnonzero(whole >= 0)
        sizes[known] = 0
        self._add([new[i] for i in known.tolist()], whole[known], np.ones(len(known), np.int64))
        widths = WIDTHS if self.merges.usable else ()
        for least, width in zip((0, *widths), widths):
            some = np.flatnonzero((sizes > least) & (sizes <= width)).tolist()
            if some:
                self._add([new[i] for i in some], *self.merges.flat([raws[i] for i in some], width))
        rest = np.flatnonzero(sizes > (widths[-1] if widths else 0)).tolist()
        for i in rest:
            ids = merged(raws[i], self.ranks)
            self._add([new[i]], np.array(ids, np.int32), np.array([len(ids)]))
        self.long = [new[i] for i in rest if len(new[i]) > 256]

    def _add(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        many, held = self.many + len(pieces), self.held + len(ids)
        self.number.update(zip(pieces, range(self.many, many)))
        self.ids, self.begin, self.count = _with_room(self.ids, held), _with_room(self.begin, many), _with_room(self.count, many)
        self.ids[self.held : held] = ids
        self.begin[self.many : many] = self.held + np.cumsum(counts) - counts
        self.count[self.many : many] = counts
        self.many, self.held = many, held


def _with_room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or one of twice that size at least with the same beginning."""
    return array if size <= len(array) else np.concatenate([array, np.zeros(2 * size - len(array), array.dtype)])


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank is merged, the leftmost first, until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 200:
        return _merged_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = ranks.get
    pair = [get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
    while pair:
        low = min(pair)
        if low == 1 << 60:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], 1 << 60)
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], 1 << 60)
    return [ranks[p] for p in parts]


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list, for pieces where many merges would each scan all pairs."""
    import heapq

    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = bytearray(b"\x01") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j] = 0
        end[i] = stop
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Merges:
    """merged() for many short pieces at once: one merge of every piece a step, on arrays of ids.

    A piece is a column, its places are linked both ways, and a merge touches four places of a column. The pairs of ids that have a rank stand
    in a hash table with open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for whole, rank in ranks.items():
            for i in range(1, len(whole)):
                a, b = ranks.get(whole[:i]), ranks.get(whole[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slots = self.slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of several for one slot the last stays
            self.values[slots[free]] = values[free]
            lost = self.keys[slots] != keys
            keys, values, slots = keys[lost], values[lost], slots[lost] + 1 & len(self.keys) - 1
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.none = max(ranks.values(), default=0) + 1  # the id of a place that holds nothing; no pair has it
        # A key has the rank and, in six bits, the place.
        self.usable = bool(pairs) and bool((self.bytes >= 0).all()) and self.none < 1 << 25

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def key(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids side by side above the pair's place, NO_KEY if it has none."""
        want = a.astype(np.int64) << 32 | b
        slot = self.slots(want)
        got = self.keys[slot]
        out = np.where(got == want, self.values[slot] << 6 | place, NO_KEY)
        open_ = np.flatnonzero((got != want) & (got >= 0))
        while len(open_):
            at = slot[open_] + 1 & len(self.keys) - 1
            slot[open_] = at
            got = self.keys[at]
            hit = got == want[open_]
            some = open_[hit]
            out[some] = self.values[at[hit]] << 6 | place[some]
            open_ = open_[~hit & (got >= 0)]
        return out

    def ids(self, pieces: list[bytes], width: int) -> tuple[list[int], np.ndarray]:
        """flat() with the ids as a list."""
        flat, counts = self.flat(pieces, width)
        return flat.tolist(), counts

    def flat(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (of 1 to width bytes), one behind the other, and how many each has."""
        flat, counts = zip(*[self._ids(pieces[lo : lo + MERGED_AT_ONCE], width) for lo in range(0, len(pieces), MERGED_AT_ONCE)])
        return np.concatenate(flat), np.concatenate(counts)

    def _ids(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        n, places = len(pieces), width + 2  # with an empty one at either end
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width).T
        ids = np.full((places, n), self.none, np.int32)
        held = np.arange(width)[:, None] < np.array([len(p) for p in pieces])[None, :]
        ids[1:-1][held] = self.bytes[raw[held]]
        rank = np.full((places, n), NO_KEY, np.int32)
        place, column = np.nonzero(held[1:])
        rank[place + 1, column] = self.key(ids[place + 1, column], ids[place + 2, column], (place + 1).astype(np.int32))
        grid = np.arange(places * n, dtype=np.int64)
        after, before = grid + n, grid - n  # of each place, as places of the flat arrays
        flat, ranks = ids.reshape(-1), rank.reshape(-1)
        while True:
            low = rank.min(axis=0)  # the leftmost of the lowest
            column = np.flatnonzero(low != NO_KEY)
            if not len(column):
                break
            low = low[column]
            left = (low & 63).astype(np.int64) * n + column
            id_ = low >> 6
            gone = after[left]
            right, prior = after[gone], before[left]
            flat[left], flat[gone], ranks[gone] = id_, self.none, NO_KEY
            after[left], before[right] = right, left
            ranks[left] = self.key(id_, flat[right], low & 63)
            ranks[prior] = self.key(flat[prior], id_, (prior // n).astype(np.int32))
        held = np.ascontiguousarray(ids.T)
        full = held != self.none
        return held[full], full.sum(axis=1)


class Encoder:
    """Encodes and decodes by the ranks in a file."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.merges = Merges(self.ranks)
        self.pieces = Pieces(self.ranks, self.merges)
        self.by_id = {i: b for b, i in self.ranks.items()}
        self.as_text = {i: str(i) for i in self.by_id}

    def texts(self, texts: list[str]) -> Iterator[str]:
        """Ids of each text, as decimal numbers joined by commas."""
        for ids in self.ids(texts):
            yield ",".join(map(self.as_text.__getitem__, ids.tolist()))

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        lo = 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo])
            while hi < len(texts) and size + len(texts[hi]) <= CHUNK_CHARS:
                size += len(texts[hi])
                hi += 1
            part = texts[lo:hi]
            whole = "".join(part)
            starts = np.cumsum([0, *map(len, part)])
            points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
            cut = self.cuts(points, starts)
            sizes = np.diff(cut, append=len(points))
            first, which = alike(points, cut, sizes)
            numbers = self.pieces.numbers([whole[s:e] for s, e in zip(cut[first].tolist(), (cut[first] + sizes[first]).tolist())])
            flat, ends = self.pieces.of(numbers[which])
            where = np.concatenate([[0], ends])[np.searchsorted(cut, starts)].tolist()
            for s, e in zip(where, where[1:]):
                yield flat[s:e]
            lo = hi

    def cuts(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where pieces begin in texts that stand one behind the other, of which these are the code points."""
        if not len(points):
            return np.zeros(0, np.int64)
        first = np.zeros(len(points) + 1, bool)
        first[starts] = True
        return boundaries(points, first[:-1])

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and the byte offsets (begin, end) of each in the text's UTF-8 form."""
        ids = next(self.ids([text])).tolist()
        ends = np.cumsum([len(self.by_id[i]) for i in ids]).tolist()
        return ids, list(zip([0, *ends][:-1], ends))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.by_id[i] for i in ids])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def digests(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """The id column, n_tokens, ids_sha256 and decoded_sha256 of every row of docs."""
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        shown, back = enc.as_text.__getitem__, enc.by_id.__getitem__
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n, ids_sha, text_sha = [], [], []
            for found in enc.ids(texts):
                ids = found.tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(shown, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(b"".join(map(back, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(id_col, "text").mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """The id column and ids (array<int>) of every row of docs."""
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = list(enc.ids(texts))
            ends = np.cumsum([0, *map(len, ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))], names=["id", "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, "text").mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
