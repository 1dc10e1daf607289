import os
import random
import re
import time
from collections import Counter, defaultdict

from tracemill.llm import common, components, decontaminate, line_dedup, minhash


def norm(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def grams(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    c = sum((a & b).values())
    return c / max(1, sum(a.values()) + sum(b.values()) - c)


def classes(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)] + [(300, 300 + i) for i in range(1, 20)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == got[101] == got[100] == 100 and got[319] == 300 and 200 not in got
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_buckets_lose_no_link(spark):
    """A chain inside one bucket: only neighbours are links, so stars alone would lose it."""
    members = spark.createDataFrame([(1, i) for i in range(12)] + [(2, 20), (2, 5)], "bucket long, node long")
    tested = []

    def verify(pairs):
        tested.extend((r.a, r.b) for r in pairs.collect())
        return pairs.filter("abs(a - b) = 1 and a < 20")

    got = {r.node: r.root for r in components.bucket_classes(members, verify).collect()}
    assert {got[i] for i in range(12)} == {0} and 20 not in got
    assert len(tested) == len(set(tested))


def test_weighted_signatures_estimate_jaccard():
    import numpy as np

    x = np.arange(1, 200, dtype=np.uint64) << np.uint64(24)
    one = np.ones(199, np.int64)
    two = np.where(np.arange(199) % 3 == 0, 5, 1)
    keys = np.concatenate([x, x | np.uint64(1 << 44)])
    keys.sort()
    sig = minhash.bag_minhash(keys, np.concatenate([one, two]), 2, 4000)
    want = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03 and np.isfinite(sig).all()


def test_near_duplicates_match_brute_force(docs, texts):
    bags = [grams(norm(t)) for t in texts]
    want = classes(len(texts), lambda a, b: bool(bags[a]) and jaccard(bags[a], bags[b]) >= 0.8)
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_near_duplicates_of_strange_tables(strange, empty):
    assert minhash.classes(strange).count() == strange.count()
    assert minhash.classes(empty).count() == 0 and minhash.deduplicated(empty).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_against_brute_force(docs, texts):
    lines = [(i, j, " ".join(norm(x))) for i, t in enumerate(texts) for j, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    got = {r.doc_id: r for r in line_dedup.report(docs).collect()}
    dropped = {(i, j) for i, r in got.items() for j in r.dropped}
    first = {}
    for i, j, s in lines:
        first.setdefault(s, (i, j))
    assert all((i, j) in dropped for i, j, s in lines if first[s] != (i, j))  # every exact copy goes
    near = defaultdict(list)
    for s, at in first.items():
        if at in dropped:  # what goes though it is the first of its kind is like a line before it
            near[at] = [o for o, p in first.items() if p < at and abs(len(o) - len(s)) <= 0.2 * max(len(o), len(s)) and distance(o, s) <= 0.2 * max(len(o), len(s)) + 1e-9]
            assert near[at]
    assert near  # changed lines are found
    assert not any(got[i].n_dropped for i, t in enumerate(texts) if not norm(t))
    clean = {r.doc_id: r for r in line_dedup.cleaned(docs).collect()}
    for i, r in clean.items():
        kept = "\n".join(x for j, x in enumerate((texts[i] or "").split("\n")) if (i, j) not in dropped)
        assert (r.text or "") == (kept if got[i].n_dropped else texts[i] or "") and r.root == "clash"
        assert r.n_chars == len(r.text or "")


def test_long_lines_and_strange_tables(spark, strange, empty, words):
    big = " ".join(words[i * i % len(words)] for i in range(20_000))
    two = spark.createDataFrame([(1, big), (2, big + " end"), (3, "short but other line")], "doc_id long, text string")
    assert [r.n_dropped for r in line_dedup.report(two).orderBy("doc_id").collect()] == [0, 1, 0]
    assert line_dedup.report(strange).count() == strange.count()
    assert line_dedup.report(empty).count() == 0 and line_dedup.cleaned(empty).count() == 0


def test_ends_of_lines_reject_no_link(spark):
    r = random.Random(9)
    some = lambda n: "".join(r.choice("abcdefé ") for _ in range(n))
    rows = []
    for _ in range(400):
        x = some(r.randrange(1, 60))
        y, share = list(x), r.random() * 0.4
        for _ in range(int(share * len(x))):
            i = r.randrange(len(y) + 1)
            y[i : i + r.randrange(2)] = some(r.randrange(2))
        rows.append((x, "".join(y) if r.random() < 0.8 else some(r.randrange(1, 60))))
    got = spark.createDataFrame(rows, "x string, y string").selectExpr("x", "y", line_dedup.most_edits("x", "y", 0.8) + " as most", line_dedup.ends_allow("x", "y", line_dedup.most_edits("x", "y", 0.8)) + " as ok").collect()
    links = [z for z in got if distance(z.x, z.y) <= z.most]
    assert links and all(z.ok for z in links) and sum(not z.ok for z in got) > 50


def test_long_lines_that_share_a_passage_are_not_listed_as_pairs(spark, words, monkeypatch):
    """Lines of over 400 characters are compared inside the second step's join: only links leave it."""
    r = random.Random(4)
    some = lambda n: " ".join(r.choice(words) + r.choice("abcdefgh") for _ in range(n))
    passage = some(50)
    lines = [f"{some(25)} {passage} {some(25)}" for _ in range(36)]
    lines += [x + " end" for x in lines[::6]]
    assert all(400 < len(x) < line_dedup.CARRIED for x in lines)
    listed = []
    plain = line_dedup.alike
    monkeypatch.setattr(line_dedup, "alike", lambda pairs, *rest: (listed.append(pairs.count()), plain(pairs, *rest))[1])
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert [x.n_dropped for x in line_dedup.report(docs).orderBy("doc_id").collect()] == [0] * 36 + [1] * 6
    assert len(listed) == 2 and listed[1] <= 6


def test_decontamination(spark, docs, strange, empty, words, texts):
    w = [x for x in norm(texts[20])]
    items = [(1, " ".join(w[:40])), (2, " ".join(words[:45])), (3, None), (4, ""), (5, "one two"), (6, " ".join(words[100:160])), (6, " ".join(words[100:160]))]
    inside = " ".join(["before", "it", *words[100:130], "replaced", *words[131:160], "after"])
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(900, inside.upper()), (901, " ".join(words[60:90]))], "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(more, bench).collect()}
    want = {}
    for d, t in [*enumerate(texts), (900, inside)]:
        x = norm(t)
        for i, item in {i: norm(t) for i, t in items if t}.items():
            n = len(item)
            best = max((jaccard(grams(item), grams(x[s : s + n])) for s in range(max(1, len(x) - n + 1))), default=0) if x else 0
            if best >= 0.8:
                want[d, i] = best
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()} and (900, 6) in got
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(strange, bench).columns == strange.columns


def test_recall_of_changed_lines(spark):
    """Lines with changed characters and words, against the edit distance: nearly all go, and no line that is not similar."""
    r = random.Random(11)
    letters = "abcdefghiklmnoprstuvw"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randrange(3, 9)))
    rows, want = [], {}
    for n in [2, 3, 5, 8, 12, 20, 30, 60] * 12:
        one = [word() for _ in range(n)]
        for kind in ("character", "characters", "word"):
            two = list(one)
            for i in r.sample(range(n), min(n, 2 if kind == "characters" else 1)):
                at = r.randrange(len(two[i]))
                two[i] = word() if kind == "word" else two[i][:at] + r.choice(letters) + two[i][at + 1 :]
            a, b = " ".join(one), " ".join(two)
            if a != b and distance(a, b) <= 0.2 * max(len(a), len(b)):
                want[len(rows) + 1] = kind
            rows += [(len(rows), a), (len(rows) + 1, b)]
    got = {x.doc_id for x in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_dropped > 0").collect()}
    assert sum(k in got for k in want) >= 0.99 * len(want)
    tiny = [(i, t) for i, t in enumerate(["la ja", "la xa", "abcdefgh", "abcdefgx", "one two three", "oxe two thrxe", "la"])]
    assert {x.doc_id for x in line_dedup.report(spark.createDataFrame(tiny, "doc_id long, text string")).filter("n_dropped > 0").collect()} == {1, 3, 5}


def test_recall_of_replaced_words(spark):
    """One to three words replaced in lines of 8 to 30 words, against all pairs by the edit distance."""
    r = random.Random(23)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randrange(2, 11)))
    lines = []
    for _ in range(200):
        one = [word() for _ in range(r.randrange(8, 31))]
        two = list(one)
        for i in r.sample(range(len(one)), r.randrange(1, 4)):
            two[i] = word()
        lines += [" ".join(one), " ".join(two)]
    near = {b for b in range(len(lines)) for a in range(b) if abs(len(lines[a]) - len(lines[b])) <= 0.2 * max(len(lines[a]), len(lines[b])) and len(set(lines[a].split()) & set(lines[b].split())) > 2 and distance(lines[a], lines[b]) <= 0.2 * max(len(lines[a]), len(lines[b])) + 1e-9}
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(lines)], "doc_id long, text string, pos string, norm string")
    got = {x.doc_id for x in line_dedup.report(docs).filter("n_dropped > 0").collect()}
    assert got <= near and len(near) > 120 and len(got) >= 0.95 * len(near)
    assert line_dedup.cleaned(docs).columns == docs.columns


def test_fingerprints_against_a_plain_count(spark):
    from tracemill.llm.simhash import with_fingerprint

    r = random.Random(1)
    words = [[f"w{r.randrange(10 ** 6)}" for _ in range(n)] for n in (0, 1, 2, 7, 63, 64, 300, 8191, 8192, 20_000)]
    df = spark.createDataFrame(list(enumerate(words)), "id int, words array<string>")
    df = df.selectExpr("id", "transform(words, w -> xxhash64(w)) as a")
    hashes = {x.id: (x.a, x.b) for x in df.selectExpr("id", "a", "transform(a, w -> xxhash64(w, 1)) as b").collect()}
    for x in with_fingerprint(df, "a", ["id"]).collect():
        for got, hs in zip((x.f1, x.f2), hashes[x.id]):
            want = sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))
            assert got % (1 << 64) == want


def test_windows_of_any_order(spark, words):
    """Halves that stand in the other order, insertions and repeated shingles, against the windows at all starts."""
    r = random.Random(9)
    item = words[:60]
    rep = (words[100:106] * 9)[:50]
    texts = [words[200:230] + item[30:] + item[:30] + words[230:250], words[300:310] + item[:20] + ["inserted"] + item[20:] + words[310:320], words[:4] + rep + words[4:8], rep[:45], item[:57], rep * 3 + ["odd"] + rep, item[1:] + item[:1]]
    texts += [[r.choice(item + words[400:404]) for _ in range(200)] for _ in range(3)]
    items = [(1, " ".join(item)), (2, " ".join(rep)), (3, " ".join(words[100:103]))]
    docs = spark.createDataFrame([(i, " ".join(t), "clash") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    got = {(x.doc_id, x.item_id): (x.start, round(x.similarity, 9)) for x in decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, x in enumerate(texts):
        for i, t in items:
            w = norm(t)
            best = max(((round(jaccard(grams(w), grams(x[s : s + len(w)])), 9), -s) for s in range(max(1, len(x) - len(w) + 1))))
            if best[0] >= 0.8:
                want[d, i] = (-best[1], best[0])
    assert got == want and (0, 1) in got and (5, 2) in got


def test_links_against_the_edit_distance(spark):
    """Words and characters changed, put in, taken out and moved at all places, also where nothing is left of one line."""
    r = random.Random(5)
    pairs = [("a b c", "a c"), ("b c", "c"), ("a b", "a"), ("aé b", "é b"), ("ab cd ef", "abc def"), ("x", "y"), ("a", "a b a"), ("q" * 300, "q" * 241)]
    for n in [2, 4, 7, 12, 25] * 40:
        one = ["".join(r.choice("abcdé") for _ in range(r.randrange(1, 7))) for _ in range(n)]
        two = list(one)
        for _ in range(r.randrange(1, 3 + n // 4)):
            i = r.randrange(len(two))
            two[i : i + 1] = r.choice([[], [two[i], "ab"], [two[i] + "c"], [two[i][1:] or "d"], [two[i][::-1]]]) or two[i : i + 1][: len(two) == 1]
        pairs.append((" ".join(one), " ".join(two)))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {x.i for x in df.filter(line_dedup.similar("a", "b", 0.8)).collect()}
    words = lambda a, b: len(set(a.split()) & set(b.split())) >= 0.3 * min(len(set(a.split())), len(set(b.split())))
    want = {i for i, (a, b) in enumerate(pairs) if (min(len(a), len(b)) <= 80 or words(a, b)) and distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9}
    assert got == want and 0 < len(want) < len(pairs)


def test_unlike_lines_of_a_piece_are_not_listed(spark, monkeypatch):
    """Short lines that share a piece by chance, among which one link: the pairs that are no links are not handed on."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(n))
    lines = [f"{word(9)} {word(8)} sharedx {word(9)}" for _ in range(150)]
    lines += [lines[70][:-1] + "z", "other words stand in this line", "other words stand in that line"]
    listed, alike = [], line_dedup.alike
    monkeypatch.setattr(line_dedup, "alike", lambda pairs, *a: listed.append(pairs.count()) or alike(pairs, *a))
    monkeypatch.setattr(components, "PART", 16)
    got = {x.doc_id for x in line_dedup.report(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).filter("n_dropped > 0").collect()}
    assert got == {150, 152}
    assert sum(listed) < 5 * len(lines)  # the stars are listed, as before; all pairs would be 11,000


def test_shuffle_files_of_written_tables_are_removed(spark):
    """They took up to half of the disk of line dedup until the driver's garbage collector found them."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")
    before = files()
    got = common.written(spark.range(5000).selectExpr("id % 700 as k", "id").groupBy("k").sum("id"), "sums")
    until = time.time() + 10
    while files() > before and time.time() < until:
        time.sleep(0.1)
    assert files() <= before and got.count() == 700
    assert spark.conf.get(common.CLEANUP) == "false"  # as it was
    common.dropped(got)


def test_pieces_are_gone_before_lines_are_compared(spark, docs, monkeypatch):
    """The pieces are the largest table: buckets are found in parts, and the table goes before the pairs are made."""
    at, there, found = common.scratch(spark)[len("file://"):], [], []
    alike, written = line_dedup.alike, components.written

    def columns(pairs, *rest):
        there.append([p for p in os.listdir(at) for f in [spark.read.parquet(f"{at}/{p}")] if {"own", "k2"} <= set(f.columns)])
        return alike(pairs, *rest)

    def counted(df, name):
        out = written(df, name)
        found.extend([out.count()] if name == "several" else [])
        return out

    before = {p for p in (os.listdir(at) if os.path.isdir(at) else []) if p.startswith(("lines", "pieces"))}
    monkeypatch.setattr(line_dedup, "alike", columns)
    monkeypatch.setattr(components, "written", counted)
    assert line_dedup.report(docs).filter("n_dropped > 0").count() > 0
    assert there and not [p for made in there for p in made if p not in before]
    assert max(found) < 0.5 * sum(found)


def test_passes_lose_no_link(spark):
    """Chains of nodes in several buckets, some links of which only the second step finds, in three passes."""
    r = random.Random(8)
    rows = [(b, n) for b in range(9) for n in r.sample(range(60), 12)]
    members = spark.createDataFrame(rows + rows[:30], "bucket long, node long")

    parent = list(range(60))

    def root(n):
        return n if parent[n] == n else root(parent[n])

    for b, n in rows:
        for c, m in rows:
            if b == c and n != m and (n + m) % 7 == 0:
                lo, hi = sorted((root(n), root(m)))
                parent[hi] = lo
    size = {n: sum(root(m) == root(n) for m in range(60)) for n in range(60)}
    want = {n: root(n) for n in range(60) if size[n] > 1}
    verify = lambda pairs: pairs.filter("(a + b) % 7 = 0")
    got = components.classes(components.in_company(members, 3), verify, passes=3)
    assert {x.node: x.root for x in got.collect()} == want
