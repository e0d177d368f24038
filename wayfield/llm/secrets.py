"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of ``LEAST`` or more characters that tokens are made of, or a
value of ``LEAST_GIVEN`` or more right after a credential's name and an assignment. The
forest sees its length and character classes, how usual its character transitions
are, how much of it common words cover, whether it lies in a path or address, and
which words stand beside it, each by the log-odds it has in labelled findings.
Everything runs inside the row as Spark expressions: finding, features, votes and
redaction, so nothing is exploded or shuffled to score a text.

Transitions and common words are counted over all texts. The forest is fitted on at
most ``FINDINGS`` labelled findings of each class: reviewed ones, or those of ``findings``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import findings, forest
from .common import checkpointed, free_name

LEAST = 16
#: Shortest value right after a credential's name and an assignment.
LEAST_GIVEN = 6
CHARS = "A-Za-z0-9+/_=-"
_RUN = "A-Za-z0-9+/_-"
_NAME = r"(?i:token|secret|passw|pwd|api.?key|access.?key|private.?key|auth(?!or)|credential)"
_ASSIGNED = r"""["'`]?\s{0,3}[=:]\s{0,3}["'`]?"""
#: What may follow a name: anything up to a blank, quote or separator, but no address. The short looks behind spare most places the long one.
_GIVEN_VALUE = (
    r"""(?<=[=:\s"'`])(?<=[=:]\s{0,3}["'`]?)""" + rf"(?<={_NAME}[A-Za-z0-9_-]{{0,24}}{_ASSIGNED})"
    r"(?![a-z]{2,8}://)" + rf"""[^\s"'`<>,;&=:][^\s"'`<>,;&]{{{LEAST_GIVEN - 2},}}[^\s"'`<>,;&.)]"""
)
#: Any other run of token characters, without a name that is assigned to; '=' only as padding. Only long runs are searched for a name.
_LONG = rf"(?<![{_RUN}])(?=[{_RUN}]{{{LEAST}}})(?![{_RUN}]{{0,64}}?{_NAME}[{_RUN}]{{0,64}}{_ASSIGNED}[{_RUN}])[{_RUN}]{{{LEAST},}}+(?:={{1,2}}(?![{CHARS}]))?"
CANDIDATE = f"(?:{_GIVEN_VALUE}|{_LONG})"
FINDINGS = 2000
#: Common words that are looked for inside candidates, and words beside findings that have odds.
WORDS, NEIGHBOURS = 200, 300
#: Characters of what counts as a word of the corpus.
WORD_SIZE = 24
#: Characters of context on either side.
BESIDE = 48
ACCEPT = 0.5
MARKER = "[SECRET]"
SPAN = 1 << 40

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_KINDS = len(ALPHABET) + 1

PATH = r"(://\S*|www\.\S*|[/\\@.~])$"
ASSIGNED = r"""[=:]\s*["'`]?$"""

FEATURES = (
    "length", "digits", "uppers", "lowers", "switches", "transitions", "covered",
    "slashes", "in_path", "assigned", "quoted", "nearest", "before", "after",
)


@dataclass
class Scanner:
    transitions: list[float]  # log2 probability of each pair of character kinds
    common: list[str]
    odds: dict[str, float]  # of words beside a finding
    trees: list[forest.Tree]


def _kinds(value: Column) -> Column:
    """Numbers of the characters in ALPHABET, 0 for any other."""
    return F.transform(F.split(F.lower(value), ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, n): how often each run of 2 to WORD_SIZE letters and token characters occurs in ``text``, in lower case.

    Summed in each partition before the shuffle. Longer runs are no words.
    """
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"[\p{{L}}{CHARS}]{{2,}}"), F.lit(0)))
    return texts.select(word.alias("w")).filter(F.length("w") <= WORD_SIZE).groupBy("w").agg(F.count("*").alias("n"))


def learn_transitions(counted: DataFrame) -> list[float]:
    """Log2 probabilities of pairs of neighbouring characters in words (w, n); add-one smoothing."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substr("w", i, F.lit(2))))
    kind = lambda at: F.instr(F.lit(ALPHABET), F.substr("p", F.lit(at), F.lit(1)))
    pairs = counted.select(pair.alias("p"), "n").groupBy(kind(1).alias("a"), kind(2).alias("b")).agg(F.sum("n").alias("n")).collect()
    seen = np.ones((_KINDS, _KINDS))
    for r in pairs:
        seen[r.a, r.b] += r.n
    return np.log2(seen / seen.sum(axis=1, keepdims=True)).round(3).ravel().tolist()


def learn_words(counted: DataFrame, n: int = WORDS) -> list[str]:
    """The ``n`` most frequent words of 2 to 12 letters; ties by the word."""
    return [r.w for r in counted.filter(F.col("w").rlike(r"^\p{L}{2,12}$")).orderBy(F.desc("n"), "w").limit(n).collect()]


def long_words(counted: DataFrame, n: int = FINDINGS // 4) -> list[str]:
    """The ``n`` most frequent words that are candidates by their length alone: plain letters, no secrets."""
    return [r.w for r in counted.filter(F.col("w").rlike(rf"^[a-z]{{{LEAST},}}$")).orderBy(F.desc("n"), "w").limit(n).collect()]


def neighbours(text: Column) -> Column:
    """Words of letters in what stands beside a finding, in order, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; a lambda's body would compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces(text: Column) -> Column:
    """struct<value: all candidates, between: what stands around them>; null if there are none."""
    values = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    return let(values, lambda v: F.when(F.size(v) > 0, F.struct(v.alias("value"), F.split(text, CANDIDATE, -1).alias("between"))))


def found(text: Column) -> Column:
    """array<struct<no, value, before, after>> of all candidates, in order."""
    rows = let(
        pieces(text),
        lambda p: F.transform(
            p["value"],
            lambda v, i: F.struct(
                i.alias("no"), v.alias("value"),
                F.right(F.get(p["between"], i), F.lit(BESIDE)).alias("before"),
                F.left(F.get(p["between"], i + 1), F.lit(BESIDE)).alias("after"),
            ),
        ),
    )
    return F.coalesce(rows, F.array().cast("array<struct<no:int,value:string,before:string,after:string>>"))


def starts(text: Column, numbers: Column) -> Column:
    """Code points before the candidates of these numbers."""
    total = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    return let(pieces(text), lambda p: F.transform(numbers, lambda i: total(p["between"], i + 1) + total(p["value"], i)))


def features(f: Column, transitions: list[float], common: list[str], odds: dict[str, float]) -> Column:
    """struct of FEATURES of one finding."""
    value, before, after = f["value"], f["before"], f["after"]
    length = F.length(value).cast("double")
    share = lambda pattern: 1 - F.length(F.regexp_replace(value, pattern, "")) / length
    table = F.array(*map(F.lit, transitions))
    usual = F.aggregate(
        _kinds(value),
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda a, k: F.struct(k.alias("last"), (a["sum"] + F.when(a["last"] < 0, 0.0).otherwise(F.get(table, a["last"] * _KINDS + k))).alias("sum")),
        lambda a: a["sum"] / (length - 1),
    )
    covered = share("(?i)" + "|".join(sorted(common, key=lambda w: (-len(w), w)))) if common else F.lit(0.0)
    switches = F.length(F.regexp_replace(value, r"(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]", "!!")) - F.length(value)
    known = F.create_map(*[F.lit(x) for pair in sorted(odds.items()) for x in pair]) if odds else F.lit(None).cast("map<string,double>")
    told = lambda w: F.coalesce(known[w], F.lit(0.0))
    near = F.slice(F.reverse(neighbours(before)), 1, 3)
    mean = lambda ws: F.aggregate(ws, F.lit(0.0), lambda a, w: a + told(w))
    flag = lambda c: c.cast("double")
    cols = (
        length, share("[0-9]+"), share("[A-Z]+"), share("[a-z]+"), switches / length, usual, covered,
        share("[/]+"), flag(before.rlike(PATH)), flag(before.rlike(ASSIGNED)), flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        let(near, lambda ws: F.when(F.size(ws) > 0, told(F.get(ws, F.lit(0)))).otherwise(0.0)), mean(near), mean(F.slice(neighbours(after), 1, 2)),
    )
    return F.struct(*[c.alias(n) for n, c in zip(FEATURES, cols, strict=True)])


def learn_odds(rows: list[tuple[str, str, int]], most: int = NEIGHBOURS) -> dict[str, float]:
    """Log-odds of words beside labelled findings (before, after, label); the ``most`` telling ones, each seen in 5 findings or more."""
    import re

    seen: dict[str, list[int]] = {}
    total = [1 + sum(r[2] == v for r in rows) for v in (0, 1)]
    for before, after, label in rows:
        for w in {*re.findall("[a-z]{2,}", before.lower())[-3:], *re.findall("[a-z]{2,}", after.lower())[:2]}:
            seen.setdefault(w, [0, 0])[label] += 1
    odds = {w: round(float(np.log((n[1] + 0.5) / total[1]) - np.log((n[0] + 0.5) / total[0])), 3) for w, n in seen.items() if sum(n) >= 5}
    return dict(sorted(odds.items(), key=lambda x: (-abs(x[1]), x[0]))[:most])


def labelled_findings(spark: SparkSession, common: list[str], plain: list[str], n: int = FINDINGS) -> DataFrame:
    """(value, before, after, label) drawn from a seed; see ``findings``."""
    rows = [(f.value, f.before, f.after, f.label) for f in findings.drawn(n, common, plain)]
    return spark.createDataFrame(rows, "value string, before string, after string, label int")


def fit(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Scanner:
    """A scanner for texts like ``docs``.

    ``labelled`` has reviewed findings (value, before, after, label 0/1); at most FINDINGS
    of each label are used, those with the smallest hashes, and copies count once.
    Without it ``labelled_findings`` are taken. Without any positive label nothing is
    accepted. Null and empty texts have no words; repeated rows count each time; an empty
    table leaves transitions alike and no common words.
    """
    counted = checkpointed(word_counts(docs.select(F.col(text_col).alias("text"))))
    common, transitions = learn_words(counted), learn_transitions(counted)
    if labelled is None:
        labelled = labelled_findings(docs.sparkSession, common, long_words(counted))
    rows = labelled.filter("value <> '' and label is not null").select(F.struct("value", *[F.coalesce(c, F.lit("")).alias(c) for c in ("before", "after")]).alias("f"), "label").dropDuplicates()
    rows = rows.withColumn("h", F.pmod(F.xxhash64("f"), F.lit(SPAN)))
    both = [rows.filter(F.col("label") == v).orderBy("h", "f").limit(FINDINGS) for v in (0, 1)]
    few = checkpointed(both[0].union(both[1]))
    odds = learn_odds([(r.f.before, r.f.after, r.label) for r in few.orderBy("label", "h", "f").collect()])
    picked = sorted((r.label, r.h, tuple(r.x)) for r in few.select("label", "h", features(F.col("f"), transitions, common, odds).alias("x")).collect())
    x = np.array([v for _, _, v in picked], float).reshape(-1, len(FEATURES))
    return Scanner(transitions, common, odds, forest.fit(x, np.array([v for v, _, _ in picked])))


def scanned(text: Column, scanner: Scanner) -> Column:
    """array<struct<no, value, score>> of all candidates of a text."""

    def rated(f: Column) -> Column:
        votes = let(features(f, scanner.transitions, scanner.common, scanner.odds), lambda x: forest.score(scanner.trees, lambda i: x[FEATURES[i]]))
        return F.struct(f["no"].alias("no"), f["value"].alias("value"), votes.alias("score"))

    return F.transform(found(text), rated)


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each accepted finding: id, start (code points before it), length, score, value_sha256.

    Null and empty texts have none. Repeated rows give repeated findings; ids may be
    null. Other columns are not read.
    """
    good = F.filter(scanned(F.col(text_col), scanner), lambda f: f["score"] >= ACCEPT)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), good.alias("good")).filter(F.size("good") > 0)
    at = starts(F.col("text"), F.transform("good", lambda f: f["no"]))
    rows = rows.select("id", F.explode(F.arrays_zip(at.alias("start"), F.col("good").alias("f"))).alias("x"))
    f = F.col("x.f")
    return rows.select(F.col("id").alias(id_col), F.col("x.start").cast("long").alias("start"), F.length(f["value"]).cast("long").alias("length"), F.round(f["score"], 4).alias("score"), F.sha2(f["value"], 256).alias("value_sha256"))


def redact(docs: DataFrame, scanner: Scanner, text_col: str = "text") -> DataFrame:
    """``docs`` with every accepted finding replaced by MARKER; all rows and columns stay, null texts stay null."""
    text, held = F.col(text_col), free_name(docs, "found")
    marked = docs.withColumn(held, scanned(text, scanner))
    shown = F.transform(held, lambda f: F.when(f["score"] >= ACCEPT, MARKER).otherwise(f["value"]))
    joined = F.zip_with(F.split(text, CANDIDATE, -1), shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    hit = F.exists(held, lambda f: f["score"] >= ACCEPT)
    return marked.withColumn(text_col, F.when(hit, F.array_join(joined, "")).otherwise(text)).drop(held)
