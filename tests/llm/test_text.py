import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tracemill.llm import bpe, lang_id, packing, pii, quality, toxicity, url_filter

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_byte_bpe_equals_the_library(docs, texts, strange, empty):
    enc = bpe.encoder(PATH)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    r = random.Random(1)
    alphabet = "''''strevmld  \n\t  　aZ9!-é\x1c\x85½Ⅷ中🙂'"
    many = ["".join(r.choice(alphabet) for _ in range(r.randrange(14))) for _ in range(5000)] + ["a" * 3000, "'s" * 40, "<|endoftext|>", " " * 500 + "x"]
    for t, joined in zip(many, enc.texts(many)):
        assert joined == ",".join(map(str, own.encode_ordinary(t)))
    ids, spans = enc.encode("Über 'quoted'")
    assert enc.decode(ids).decode() == "Über 'quoted'" and spans[-1][1] == len("Über 'quoted'".encode())
    got = {r.doc_id: r for r in bpe.digests(docs, PATH).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(strange, PATH).count() == strange.count() and bpe.digests(empty, PATH).count() == 0


def test_pieces_merged_together_equal_those_merged_alone():
    enc = bpe.encoder(PATH)
    r = random.Random(8)
    some = ["".join(r.choice("tionerchéßü中 \ud800") for _ in range(r.randrange(1, 12))).encode("utf-8", "surrogatepass") for _ in range(3 * bpe.MERGED_AT_ONCE // 2)]
    for width in (16, 48):
        fit = [p for p in some if len(p) <= width]
        ids, counts = enc.merges.ids(fit, width)
        ends = np.cumsum([0, *counts]).tolist()
        assert len(fit) > bpe.MERGED_AT_ONCE and len(ids) == ends[-1]
        for p, a, b in zip(fit, ends, ends[1:]):
            if p not in enc.ranks:
                assert ids[a:b] == bpe.merged(p, enc.ranks)
    few = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259}
    for p in (b"aaa", b"aaaa", b"bcab", b"z", b"abcabaabc"):
        assert bpe.Merges(few).ids([p], 16)[0] == bpe.merged(p, few)
    assert not bpe.Merges({b"a": 0}).usable and not bpe.Merges({}).usable


def test_short_pieces_are_looked_up_once_a_chunk(monkeypatch):
    """Equal short pieces are one lookup; what is alike in part, odd code points, long pieces and a full cache change no id."""
    enc = bpe.Encoder(PATH)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    asked = []
    plain = bpe.Pieces.numbers
    monkeypatch.setattr(bpe.Pieces, "numbers", lambda self, pieces: (asked.append(len(pieces)), plain(self, pieces))[1])
    assert [x.tolist() for x in enc.ids(["one two one" * 500, "", " two"])] == [own.encode_ordinary(x) for x in ("one two one" * 500, "", " two")]
    assert asked == [4]  # "one", " two", " oneone", " one"
    r = random.Random(3)
    some = ["a\0", "a", "\0", "\0\0a", "é", "éa", "abcdefgh", "abcdefghi", "中", "中a", "ā", "z" * 300, "qx" * 900, "", " ", "\n"]
    texts = [" ".join(r.choice(some) for _ in range(r.randrange(9))) for _ in range(600)]
    want = [own.encode_ordinary(x) for x in texts]
    assert [x.tolist() for x in enc.ids(texts)] == want
    monkeypatch.setattr(bpe, "CACHE_PIECES", 30)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    for most in (1 << 22, 40):
        monkeypatch.setattr(bpe, "CACHE_IDS", most)
        assert [x.tolist() for x in enc.ids(texts)] == want
    assert not any(len(x) > 256 for x in enc.pieces.number if x not in enc.pieces.long)
    few = {bytes([i]): i for i in range(256)}  # no pair has a rank
    pieces = bpe.Pieces(few, bpe.Merges(few))
    assert not pieces.merges.usable and [x.tolist() for x in pieces.of(pieces.numbers(["ab", "c", "ab"]))] == [[97, 98, 99, 97, 98], [2, 3, 5]]


def test_packing_loses_nothing(docs, texts, empty):
    enc = bpe.encoder(PATH)
    rows = packing.packed(docs, PATH, row_tokens=256).collect()
    back = {}
    for r in rows:
        ids = packing.matrix([bytes(r.ids)], 256)[0]
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 256 and r.position_resets == r.cu_seqlens[:-1]
        for d, at, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            back.setdefault(d, {})[at] = ids[a:b].tolist()
    for i, t in enumerate(texts):
        assert sum((back.get(i, {})[k] for k in sorted(back.get(i, {}))), []) == enc.encode(t or "")[0]
    assert packing.packed(empty, PATH).count() == 0


def test_best_fit_decreasing_against_a_plain_search():
    r = random.Random(2)
    for _ in range(50):
        sizes = [r.randrange(1, 65) for _ in range(r.randrange(1, 60))]
        bins, room = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [b for b in range(len(bins)) if room[b] >= sizes[i]]
            if not fits:
                bins.append([])
                room.append(64)
                fits = [len(bins) - 1]
            b = min(fits, key=lambda b: room[b])
            bins[b].append(i)
            room[b] -= sizes[i]
        got = packing.best_fit_decreasing(sizes, 64)
        assert sorted(i for b in got for i in b) == list(range(len(sizes)))
        assert sorted(sum(sizes[i] for i in b) for b in got) == sorted(sum(sizes[i] for i in b) for b in bins)  # rows of equal room may be swapped


def test_languages_of_held_out_texts(spark, empty):
    r = random.Random(3)
    parts = {"aa": ["tha", "ing", "er", "on"], "bb": ["eau", "ai", "ou", "é"], "cc": ["sch", "ung", "ei", "ü"]}
    word = lambda k: "".join(r.choice(parts[k]) for _ in range(r.randrange(1, 4)))
    rows = [(i, " ".join(word(k) for _ in range(60)), k) for i in range(300) for k in [r.choice("abc") * 2]] + [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !?", "bb"), (1003, "中文", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in lang_id.identify(docs).collect()}
    test = [x for x in rows[:300] if held(x[0])]
    assert all(got[i].held_out == held(i) for i in got) and sum(got[i].lang_pred == k for i, _, k in test) >= 0.97 * len(test)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred != "und"
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.doc_id for x in lang_id.accepted(docs).collect()} == set(got) - {1000, 1001, 1002}
    assert lang_id.identify(empty).count() == 0
    assert {x.lang_pred for x in lang_id.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("doc_id < 0")).collect()} == set()


def test_cross_parsing_against_a_plain_parser():
    r = random.Random(2)
    syllables = ["ab", "ra", "ca", "da", "bra", "sim", "sa", "la", "bim", " "]
    some = lambda n: "".join(r.choice(syllables) for _ in range(n)).encode()
    long = some(400)
    sample = {"x": [b"abracadabra and more" + some(60)], "y": [b"simsalabim or less", long]}
    p = lang_id.CrossParser(sample)
    texts = [b"abra sala dab zzz more", long, long * 3, b"a" * 700, b"", some(900), b"zq" * 300]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    known = {}
    for k in p.langs:
        raw = [np.frombuffer(x, np.uint8) for x in sample[k]]
        known[k] = lang_id.folded(np.concatenate(raw), np.cumsum([0, *map(len, raw)]))[0].tobytes()
    for block in (5, 64, lang_id.BLOCK, 10_000):  # phrases cross blocks
        counts, sizes = p.phrases(data, ends, block)
        for k, lang in enumerate(p.langs):
            for d, t in enumerate(texts):
                t = lang_id.folded(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tobytes()
                i = n = 0
                while i < len(t):
                    j = i + 1
                    while j < len(t) and t[i : j + 1] in known[lang]:
                        j += 1
                    i, n = j, n + 1
                assert counts[k][d] == n and sizes[d] == len(t), (block, lang, d)


def test_many_languages_and_odd_rows(spark):
    """More languages than one table of 32-bit states held before; null and repeated ids, very long texts, clashing names."""
    r = random.Random(12)
    alphabet = [chr(c) for c in range(0x561, 0x587)] + list("abcdefghijklmnopqrstuvwxyz")
    parts = {f"l{k:03d}": ["".join(r.choice(alphabet) for _ in range(2)) for _ in range(6)] for k in range(150)}
    text = lambda k, n: " ".join("".join(r.choice(parts[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(k, 30), k, "a") for i, k in enumerate(sorted(parts) * 4)] + [(None, text("l007", 40_000), "l007", "b"), (5, text("l009", 30), None, "c"), (5, text("l009", 30), None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    samples = lang_id.sample(docs)
    assert len(samples) == 150 and sum(len(x) for v in samples.values() for x in v) <= lang_id.TOTAL_BYTES
    got = lang_id.identify(docs).collect()
    assert len(got) == len(rows) and sum(x.lang_pred == "l009" for x in got if x.doc_id == 5) >= 2
    assert [x.lang_pred for x in got if x.doc_id is None] == ["l007"]
    assert lang_id.accepted(docs).columns == docs.columns


def test_base_statistics_and_rules(spark, docs, texts, empty):
    odd = ["hello \u0085", "a b \u2028", "a b \u2029", "one two \u0085", "\u0085 x", "a\u2028\nb\u2028\nb\u2028", " " * 1_000_000, "x" + " \t" * 400_000 + "y", "\x0b\x0c one \x1c two"]
    texts = texts + odd
    docs = docs.select("doc_id", "text", "root").union(spark.createDataFrame([(len(texts) - len(odd) + i, t, "r") for i, t in enumerate(odd)], "doc_id long, text string, root string"))
    got = {r.doc_id: r for r in quality.statistics(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        ls = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        win = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(win)
        covered = {p for k, x in enumerate(win) if n[x] > 1 for p in range(k, k + 5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(covered))
    r = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, " ".join(f"w{r.randrange(500)}{'***' if bad else ''}" for _ in range(40))))
        labels.append((i, 0 if bad else 1))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(1, None), (999, 0)], "doc_id long, quality int")
    rules = quality.fit(d, lab)
    kept = {x.doc_id: x.kept for x in quality.judged(d, rules).collect()}
    assert rules and sum(kept[i] == (i % 4 != 0) for i in kept) >= 0.98 * len(kept)
    assert quality.fit(d, lab.limit(0)) == [] and quality.judged(empty, rules).count() == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def test_personal_data(spark, empty):
    r = random.Random(7)
    odd = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 010.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (377) 555-0271", "+12", "x" * 3000, "9" * 5000, ("1 " * 3000), "a.b@" + "c." * 2000, None, "", "ü🙂 me@x.org ü", "+1234567890.", "@@a@b", "é@a.b"]
    mixed = ["".join(r.choice("ab1279.@+-_ ()é\n") for _ in range(60)) for _ in range(300)]
    lines = [f"report of zorgblat {n} from jim@corp.example today {n}" for n in ("x", "y", "z")] + ["nothing of interest here today"] * 20
    texts = odd + mixed + lines
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in pii.digests(docs).collect()}
    for i, t in enumerate(texts):
        spans = []
        for k, (kind, p) in enumerate(BASE):
            for m in re.finditer(p, t or ""):
                d = re.sub("[^0-9]", "", m[0])
                if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "phone" and 10 <= len(d) <= 15 or kind == "card" and 14 <= len(d) <= 19 and luhn(d):
                    spans.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        want = ",".join(s for *_, s in sorted(spans))
        x = got[i]
        assert x.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, want, x)
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == j for _, k, _ in spans) for j in range(4)]
    first = got[len(odd) + len(mixed)]
    assert f"term:{lines[0].index('zorgblat')}:{lines[0].index('zorgblat') + 8}" in first.spans and ":today" not in first.spans
    clean = {x.doc_id: x.text for x in pii.sanitised(docs).collect()}
    assert clean[odd.index("ü🙂 me@x.org ü")] == "ü🙂 [EMAIL] ü" and "zorgblat" not in clean[len(odd) + len(mixed)] and clean[odd.index(None)] is None
    assert pii.digests(empty).count() == 0


def test_terms_of_an_entity_in_one_document(spark):
    lines = ["call quixel at jo@one.example today"] + ["nothing of interest here today, call at will"] * 20
    got = {x.doc_id: x for x in pii.digests(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert f"term:{lines[0].index('quixel')}:{lines[0].index('quixel') + 6}" in got[0].spans and got[0].n_term == 1
    assert not any(got[i].n_term for i in range(1, len(lines)))


def test_toxic_texts(spark, words, empty):
    r = random.Random(8)
    insults = ["scum", "idiot", "clown"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        rows.append((i, " ".join([r.choice(words) for _ in range(40)] + [r.choice(insults)] * (2 * toxic))))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(2, None)], "doc_id long, toxic int"))
    got = {x.doc_id: x for x in toxicity.score(docs, model, evidence=True).collect()}
    test = [i for i in range(400) if held(i)]
    assert sum(got[i].predicted == int(i % 5 == 0) for i in test) >= 0.97 * len(test)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values()) and got[1000].score == got[1001].score
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))).collect()
    assert {x.score for x in none} == {0.0}
    flat = model.index.transpose(1, 0, 2).reshape(model.index.shape[1], -1)
    for i in test[:25]:  # the pruned search against all cosines
        at, v = model.vector(Counter(w for w in toxicity.WORD.findall(rows[i][1]) if w in model.terms))
        if len(at):
            cos = np.round(v @ flat[at], 9)
            want = sorted(((-c, k) for k, c in enumerate(cos.tolist()) if c > 0))[: toxicity.K]
            near = model.neighbours(at, v)
            assert [round(c, 5) for c, _ in near] == [round(-c, 5) for c, _ in want]


def test_terms_are_counted_as_whole_words(spark):
    terms = ["ab", "abc", "bc", "é", "b½", "Ⅷ".lower(), "σας"]
    count = toxicity.Terms(terms).count
    texts = ["ab abc bc", "AB,abcab_ab9ab", "xab abx", "É é éé e", "b½ b ½", "Ⅷ ⅷ1", "ΣΑΣ ΣΑΣ.", "", " ", "ab" * 1000 + " ab", "bc\u00a0ab\x1cabc\u2028bc"]
    for t in texts:
        assert count(t) == Counter(w for w in toxicity.WORD.findall(t.lower()) if w in terms), t
    assert toxicity.Terms([]).count("ab") == Counter()
    odd = "½²Ⅷ〇٣9_-é\u0301ßñ日ª\u200bΩ"  # the sample is split on the JVM, texts in Python
    split = spark.createDataFrame([("a".join(odd),)], "t string").select(F.split("t", toxicity.WORD_JVM)).first()[0]
    assert [w for w in split if w] == toxicity.WORD.findall("a".join(odd))


def test_url_verdicts(spark):
    captures = [(1, "https://a.bad.org/x", "2024-02-01"), (2, "http://user@a.bad.org:80/", "2024-05-01"), (3, "http://bad.org./", "2024-05-01"), (4, "nonsense", "2024-05-01"), (5, None, "2024-05-01"), (6, "https://notbad.org", "2024-05-01"), (7, "https://bad.org", None), (2, "http://a.bad.org", "2023-01-01")]
    entries = [("bad.org", "2024-01-01", "block"), ("bad.org", "2024-04-01", "clear"), ("a.bad.org", "2024-04-15", "allow"), ("a.bad.org", "2024-04-15", "block"), (None, "2024-01-01", "block"), ("x.org", None, "block")]
    c = spark.createDataFrame(captures, "page_id long, url string, at string").selectExpr("page_id", "url", "cast(at as timestamp) as fetched_at", "1 as name")
    e = spark.createDataFrame(entries, "name string, at string, action string").selectExpr("name", "cast(at as timestamp) as at", "action")
    got = [(r.page_id, r.verdict) for r in url_filter.verdicts(c, e).collect()]
    assert sorted(got) == [(1, "block"), (2, "block"), (2, "none"), (3, "none"), (4, "none"), (5, "none"), (6, "none"), (7, "none")]
    assert {r.verdict for r in url_filter.verdicts(c, e.limit(0)).collect()} == {"none"}
    assert url_filter.verdicts(c.limit(0), e).count() == 0


def test_pipeline(spark, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]


def test_disclosing_terms_against_brute_force(spark, monkeypatch):
    """Counts, PMI / IC and the spans of all terms over the threshold, from plain loops over the lines."""
    import math

    r = random.Random(31)
    vocabulary = [f"word{i}" for i in range(40)] + ["Ärger", "x", "12", "of"]
    people = [f"p{i}@mail.example" for i in range(5)] + ["10.0.0.1"]
    texts = []
    for i in range(60):
        lines = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 7))) for _ in range(r.randrange(1, 5))]
        if i % 4 == 0:
            k = r.randrange(len(people))
            lines.append(f"{people[k]} nick{k} {r.choice(vocabulary)} only{i}")
        texts.append("\n".join(lines))
    texts += [None, "", texts[0], texts[0]]
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, term string")
    tokens = lambda s: re.findall(r"[^\W_]+", s.lower())
    lines = [x for t in texts for x in (t or "").split("\n")]
    n = len(lines)
    held = lambda s: {m[0] for k, p in BASE[:2] for m in re.finditer(p, s)}
    n_c, n_ct, n_t = Counter(), Counter(), Counter()
    for s in lines:
        own = held(s)
        n_t.update(set(tokens(s)))
        terms = {w for w in tokens(s) if not re.fullmatch(r"[0-9]+|[a-zä]", w)} - set(tokens(" ".join(own)))
        n_c.update(own)
        n_ct.update((c, w) for c in own for w in terms)
    bad = {w for (c, w), k in n_ct.items() if math.log(k * n / (n_c[c] * n_t[w])) / math.log(n / n_c[c]) >= pii.THRESHOLD}
    assert any(w.startswith("nick") for w in bad) and any(w.startswith("only") for w in bad) and not any(w.startswith("word") for w in bad)
    want = []
    for t in texts:
        spans = [(m.start(), k, m.end()) for k, (_, p) in enumerate(BASE[:2]) for m in re.finditer(p, t or "")]
        spans += [(m.start(), 4, m.end()) for m in re.finditer(r"[^\W_]+", t or "") if m[0].lower() in bad]
        want.append(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)))
    assert sorted(x.spans for x in pii.digests(docs).collect()) == sorted(want)
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)  # the ways beyond the broadcasts give the same
    assert sorted(x.spans for x in pii.digests(docs).collect()) == sorted(want)
    got = [x.text for x in pii.sanitised(docs).collect() if x.text]
    assert not any(w in tokens(x) for x in got for w in bad) and any("[TERM]" in x for x in got)


def test_many_matches_in_a_text(spark):
    """Twenty thousand addresses in one text: positions by running sums, as a plain search finds them."""
    text = " ".join(f"u{i}@h{i % 7}.example" for i in range(20_000))
    got = pii.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.start, s.end) for s in got.base] == [m.span() for m in re.finditer(BASE[0][1], text)]


def test_strange_and_empty_tables(strange, empty, docs, spark):
    """Null and repeated ids, repeated rows and clashing names: a row for each row, with the ids as they came; nothing of nothing."""
    ids = sorted(str(x.doc_id) for x in strange.select("doc_id").collect())
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic", "cast(doc_id % 2 as int) as quality")
    rules, model = quality.fit(docs, labels), toxicity.fit(docs, labels)
    for run in (lambda d: quality.judged(d, rules), pii.digests, lambda d: toxicity.score(d, model), lambda d: bpe.digests(d, PATH), lang_id.identify):
        assert sorted(str(x.doc_id) for x in run(strange).collect()) == ids and run(empty).count() == 0
    whole = packing.packed(strange, PATH, row_tokens=512).collect()
    assert sum(x.n_tokens for x in whole) == sum(x.n_tokens for x in bpe.digests(strange, PATH).collect())


def test_pipeline_runs(spark, docs, strange, empty, words, tmp_path):
    """Every stage on what the one before kept: columns stay, clean documents stay, copies and passages go; also on odd and empty tables."""
    cp = pytest.importorskip("corpus_pipeline")
    passage = " ".join(words[:50])
    more = docs.union(spark.createDataFrame([(500, "before it " + passage + " and after", "en", "s", 1, "r")], docs.schema))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    for name, table in (("plain", more), ("odd", strange), ("none", empty)):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    seen = {}
    for name in ("plain", "odd", "none"):
        kept = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for k, (stage, f) in enumerate(cp.STAGES):
            kept = f(spark, kept, str(tmp_path / name))
            if k < len(cp.STAGES) - 1:
                assert kept.columns == docs.columns
            kept.write.parquet(str(tmp_path / name / stage))
            kept = spark.read.parquet(str(tmp_path / name / stage))
            seen[name, stage] = kept.collect()
    ids = lambda stage: {x.doc_id for x in seen["plain", stage]}
    assert 500 in ids("near_dedup") and 500 not in ids("decontamination") and set(range(8)) <= ids("byte_bpe")
    assert not set(range(24, 29)) & ids("near_dedup")  # the exact copies of 0 to 4
    enc = bpe.encoder(PATH)
    for x in seen["plain", "decontamination"]:
        got = next(y for y in seen["plain", "byte_bpe"] if y.doc_id == x.doc_id)
        assert got.n_tokens == len(enc.encode(x.text)[0]) and got.decoded_sha256 == hashlib.sha256(x.text.encode()).hexdigest()
    assert not seen["none", "byte_bpe"]
    assert sorted(x.n_tokens for x in cp.run(spark, str(tmp_path / "plain")).collect()) == sorted(x.n_tokens for x in seen["plain", "byte_bpe"])
