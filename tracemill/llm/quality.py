"""Quality rules with DataFrame functions only: base statistics, and a decision list learned by sequential covering.

Statistics of every text come from expressions inside its row; nothing is shuffled. Rules are learned on the
driver from the statistics of a bounded sample of labelled texts that pass the base rule: a rule is a conjunction of thresholds
grown for the best gain on two thirds of the sample, pruned on the other third, kept if it is precise there; the
examples it covers leave, and the next rule is grown. The list becomes one ordered conditional expression.

Words are runs of characters besides U+0020 and U+0009 to U+000D.

Defined results: a null text has no words and fails the base rule, as has an empty one; without labelled rows the list is empty and
the base rule decides alone; documents with contradicting or null labels, and labels with a null id, teach nothing; repeated rows give equal rows,
null and repeated ids come back as they are; of rules with the same gain the one first in the list of features, then of the lower threshold, is
taken; an empty table gives an empty result; texts of any length are read whole in time that grows with their words (times its logarithm where
windows repeat); other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, held_out

#: Bounds of the sample and of the list.
SAMPLE_ROWS = 8_000
MAX_RULES = 12
MAX_CONDITIONS = 4
CUTS = 48
MIN_PRECISION = 0.9
MIN_COVER = 3

WINDOW = 5
_GAP = SPACE_CLASS.replace("\\", "\\\\")


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), n_chars, n_lines, n_upper, n_marks, n_distinct of docs (text)."""
    base = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_t"))
    words = F.expr(f"array_remove(split(_t, '[{_GAP}]+', -1), '')")
    lines = F.expr(f"filter(split(_t, '\\n', -1), x -> x rlike '[^{_GAP}]')")
    one = base.select(*keep, "_t", words.alias("_w"), lines.alias("_l"))
    refs = ", ".join(f"_w[i + {j}]" for j in range(WINDOW))
    hashes = F.expr(f"case when size(_w) < {WINDOW} then cast(array() as array<bigint>) else transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64({refs})) end")
    count = lambda pattern: F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))
    two = one.select(
        *keep, F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").cast("long").alias("n_symbols"), F.expr("cast(size(_l) - size(array_distinct(_l)) as bigint)").alias("n_dup_lines"),
        F.length("_t").cast("long").alias("n_chars"), F.size("_l").cast("long").alias("n_lines"), count(r"\p{Lu}").cast("long").alias("n_upper"), count(r"[!?]").cast("long").alias("n_marks"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"), hashes.alias("_h"),
    )
    facts = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_chars", "n_lines", "n_upper", "n_marks", "n_distinct"]
    # Only texts with a repeated window sort their windows to find which.
    order = F.expr("case when size(array_distinct(_h)) = size(_h) then cast(array() as array<struct<h:bigint,i:int>>) else array_sort(transform(_h, (h, i) -> struct(h, i))) end")
    three = two.select(*facts, order.alias("_s"))
    twice = F.expr("array_sort(transform(filter(_s, (e, k) -> (k > 0 and _s[greatest(k - 1, 0)].h = e.h) or (k < size(_s) - 1 and _s[least(k + 1, size(_s) - 1)].h = e.h)), e -> e.i))")
    four = three.select(*facts, twice.alias("_p"))
    covered = F.expr(
        f"case when size(_p) = 0 then 0L else aggregate(sequence(0, size(_p) - 1), cast(0 as bigint), (a, k) -> a + case when k = size(_p) - 1 then {WINDOW} else least({WINDOW}, _p[least(k + 1, size(_p) - 1)] - _p[k]) end) end"
    )
    return four.select(*facts, covered.alias("n_repeat_words"))


BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"

#: What rules may look at.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.cut!r}D"


def learn(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[list[Condition]]:
    """Ordered rules for the bad rows of x (rows x features)."""
    rng = np.random.default_rng(7)
    part = rng.permutation(len(bad))
    grow, prune = part[: 2 * len(bad) // 3], part[2 * len(bad) // 3 :]
    rules: list[list[Condition]] = []

    def covers(rule: list[Condition], rows: np.ndarray) -> np.ndarray:
        out = np.ones(len(rows), bool)
        for c in rule:
            v = x[rows, names.index(c.feature)]
            out &= v > c.cut if c.above else v <= c.cut
        return out

    def worth(rule: list[Condition]) -> float:
        hit = covers(rule, prune)
        p, n = int(bad[prune][hit].sum()), int((~bad[prune][hit]).sum())
        return (p - n) / (p + n + 2)

    while len(rules) < MAX_RULES and bad[grow].sum() >= MIN_COVER:
        rule, inside = [], np.ones(len(grow), bool)
        while len(rule) < MAX_CONDITIONS and (~bad[grow][inside]).any():
            rows = grow[inside]
            y = bad[rows]
            p0, n0 = y.sum(), (~y).sum()
            best = (1e-9, None)
            for f, name in enumerate(names):
                v = x[rows, f]
                for cut in np.unique(np.quantile(v, np.linspace(0, 1, CUTS))):
                    for above in (True, False):
                        hit = v > cut if above else v <= cut
                        p, n = y[hit].sum(), (~y[hit]).sum()
                        if p < MIN_COVER:
                            continue
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, Condition(name, above, float(cut)))
            if best[1] is None:
                break
            rule.append(best[1])
            inside &= covers([best[1]], grow)
        if not rule:
            break
        cuts = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(cuts, key=lambda r: (worth(r), -len(r)))
        hit = covers(rule, prune)
        p, n = int(bad[prune][hit].sum()), int((~bad[prune][hit]).sum())
        if p + n == 0 or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
        grow, prune = grow[~covers(rule, grow)], prune[~hit]
    return rules


def expression(rules: list[list[Condition]]) -> Column:
    """The verdict: false at the first rule that holds, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(F.expr(" and ".join(c.sql() for c in rule)), F.lit(False)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """Rules from labelled documents that are not held out: about `limit` by the hash of their id."""
    own = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    n = own.count()
    scale = 1 << 30
    picked = own.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(scale)) < min(scale, scale * limit // max(n, 1) + 1))
    single = picked.groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).filter("lo = hi").select("doc_id", (F.col("lo") == 0).alias("bad"))
    rows = docs.select("doc_id", "text").join(F.broadcast(single), "doc_id")
    # No filter here: it would be moved below the statistics and repeat them.
    facts = statistics(rows, ("doc_id", "bad")).select(F.expr(BASE_FAILED).alias("failed"), "doc_id", "bad", *[F.expr(sql).alias(f) for f, sql in FEATURES.items()])
    got = sorted({tuple(r)[1:] for r in facts.collect() if not r.failed})
    if not got:
        return []
    x = np.array([r[2:] for r in got], float)
    return learn(x, np.array([r[1] for r in got]), list(FEATURES))


def judged(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept of every row of docs (doc_id, text)."""
    facts = statistics(docs)
    failed = F.expr(BASE_FAILED)
    return facts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & expression(rules)).alias("kept"),
    )
