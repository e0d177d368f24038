"""Quality rules: a decision list learnt from labelled statistics, applied as Spark expressions.

Statistics of a text are counts that built-in functions compute inside the row. A
rule is a conjunction of thresholds on ratios of them. Sequential covering learns an
ordered list for the rarer, bad class: grow a rule on two thirds of the labelled rows
by the best gain, prune its last conditions on the other third, keep it if it is
right often enough there, take away what it covers, and go on. The list becomes one
conditional expression.

At most ``SAMPLE`` labelled rows are used for learning, those with the smallest hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, set_aside, words
from .secrets import SPAN, let

SAMPLE = 6000
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]+"
#: Thresholds tried for each statistic.
CUTS = 40
MAX_RULES = 8
MAX_CONDITIONS = 3
#: Share of bad texts among those a rule covers in the pruning part, below which learning ends.
PRECISION = 0.9
LEAST_COVER = 4

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("n_words", "word_length", "symbol_share", "dup_lines", "repeat_share", "upper_share", "distinct_share", "bang_share", "lines_share")


@dataclass
class Condition:
    statistic: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.statistic) > self.cut if self.above else F.col(self.statistic) <= self.cut


@dataclass
class Rule:
    conditions: list[Condition]
    share_bad: float  # in the pruning part

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{c.statistic} {'>' if c.above else '<='} {c.cut:.6g}" for c in self.conditions)


def repeat_words(hashes: Column) -> Column:
    """Words that lie in WINDOW-word windows occurring twice or more, given the hashes of the windows in order.

    Equal windows are found by sorting (hash, place); a window adds the words between
    it and the next one, at most WINDOW.
    """
    places = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def covered(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]))
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])

    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeated, let(F.array_sort(places), covered)).otherwise(0)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the BASE counts (long) and further counts ``_upper``, ``_bang``, ``_distinct``, ``_lines``.

    A null text counts as empty. Columns of these names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    held, pairs, filled = (free_name(docs, c) for c in ("words_", "windows_", "filled_"))
    staged = docs.withColumn(held, words(text))
    hashed = F.transform(held, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(WINDOW)])))
    staged = staged.withColumn(pairs, F.when(F.size(held) >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    staged = staged.withColumn(filled, lines)
    counts = {
        "n_words": F.size(held),
        "word_chars": F.length(F.array_join(held, "")),
        "n_symbols": F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, "")),
        "n_dup_lines": F.size(filled) - F.size(F.array_distinct(filled)),
        "n_repeat_words": repeat_words(F.col(pairs)),
        "_upper": F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", "")),
        "_bang": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
        "_distinct": F.size(F.array_distinct(F.transform(held, lambda w: F.xxhash64(w)))),
        "_lines": F.size(filled),
    }
    return staged.withColumns({k: v.cast("long") for k, v in counts.items()}).drop(held, pairs, filled)


def ratios() -> dict[str, Column]:
    """The statistics that rules look at, from the counts."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "repeat_share": F.col("n_repeat_words") / n,
        "upper_share": F.col("_upper") / chars,
        "distinct_share": F.col("_distinct") / n,
        "bang_share": F.col("_bang") / n,
        "lines_share": F.col("_lines") / n,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _gain(bad: np.ndarray, covers: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """FOIL's gain of each candidate cover (rows) over the present one."""
    p = covers @ bad
    n = covers.sum(axis=1) - p
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, gain, -1.0)


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 3) -> list[Rule]:
    """Ordered rules for the bad rows of ``x`` (columns RATIOS)."""
    rng = np.random.default_rng(seed)
    grow_part = rng.random(len(bad)) < 2 / 3
    candidates = []
    for f, name in enumerate(RATIOS):
        values = np.unique(x[:, f])
        if len(values) > 1:
            mids = (values[1:] + values[:-1]) / 2
            cuts = np.unique(np.quantile(mids, np.linspace(0, 1, CUTS), method="nearest"))
            ranked = np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS), method="nearest"))
            for cut in np.union1d(cuts, ranked[:-1]):
                candidates += [Condition(name, True, float(cut)), Condition(name, False, float(cut))]
    if not candidates:
        return []
    holds = np.array([(x[:, RATIOS.index(c.statistic)] > c.cut) == c.above for c in candidates])
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < MAX_RULES:
        grow, prune = left & grow_part, left & ~grow_part
        if bad[grow].sum() < LEAST_COVER:
            break
        chosen: list[int] = []
        now = grow.copy()
        while len(chosen) < MAX_CONDITIONS and (now & ~bad).any():
            gain = _gain(bad[now].astype(np.int64), holds[:, now].astype(np.int64), int(bad[now].sum()), int((~bad[now]).sum()))
            best = int(np.argmax(gain))
            if gain[best] <= 0:
                break
            chosen.append(best)
            now = now & holds[best]
        if not chosen:
            break

        def worth(part: list[int], prune: np.ndarray = prune) -> tuple[float, int]:
            covered = prune & holds[part].all(axis=0)
            p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
            return ((p - n) / (p + n) if p + n else -1.0), p

        kept = max((chosen[:k] for k in range(1, len(chosen) + 1)), key=lambda c: (worth(c)[0], -len(c)))
        covered = left & holds[kept].all(axis=0)
        share = float(bad[prune & covered].mean()) if (prune & covered).any() else 0.0
        if share < PRECISION or bad[covered].sum() < LEAST_COVER:
            break
        rules.append(Rule([candidates[k] for k in kept], share))
        left &= ~covered
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Rules from the labelled rows of ``docs``; label 0 is bad. No labels, no rules.

    Rows that the base conditions fail are not learnt from: they are settled already.
    An id counts once, however often it occurs, and as bad if any of its labels is; null
    ids and labels don't count. At most MAX_RULES rules of MAX_CONDITIONS conditions come
    out, at thresholds among CUTS quantiles; on a tie the first statistic counts.
    """
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.min(label_col) == 0).alias("bad"))
    count = marks.count()
    order = F.pmod(F.xxhash64(id_col), F.lit(SPAN))
    few = marks.filter(order < int(SPAN * min(1.0, 2 * SAMPLE / max(1, count)))).orderBy(order).limit(SAMPLE)
    # At most SAMPLE ids of a few bytes each.
    rows = statistics(docs.select(id_col, text_col).join(F.broadcast(few), id_col), text_col)
    # One row for an id, however often it occurs. base_failed is sifted out on the driver: as a
    # filter it would be pushed below the join and count every text.
    seen = [F.min(c).alias(f"r{i}") for i, c in enumerate(ratios().values())]
    got = rows.groupBy(id_col).agg(F.max(base_failed()).alias("failed"), F.max("bad").alias("bad"), *seen).collect()
    got = sorted(tuple(r)[2:] for r in got if not r.failed)
    x = np.array([r[1:] for r in got], float).reshape(-1, len(RATIOS))
    return learn(x, np.array([r[0] for r in got], bool))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), k).otherwise(out)
    return out


def rate(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with the BASE counts, base_failed, rule (0: none) and kept.

    Null and empty texts fail the base conditions. Columns of these names are
    replaced; every row stays.
    """
    docs, again = set_aside(docs, ("_upper", "_bang", "_distinct", "_lines", "_r"))
    rows = statistics(docs, again.get(text_col, text_col)).withColumn("base_failed", base_failed())
    rows = rows.withColumn("_r", F.struct(*[c.alias(n) for n, c in ratios().items()]))
    shown = [Rule([Condition(f"_r.{c.statistic}", c.above, c.cut) for c in r.conditions], r.share_bad) for r in rules]
    rows = rows.withColumn("rule", verdict(shown))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).drop("_r", "_upper", "_bang", "_distinct", "_lines").withColumnsRenamed(again)
