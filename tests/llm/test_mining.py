"""Line dedup, ranked search and collocations against brute force, and odd rows."""

import math
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfield.llm import collocations, line_dedup, ranked, token_counts
from wayfield.llm.queries import QUERIES, table

DATA = "/root/testdata/sf0.001"
LINE = "Shared line that is long enough."
ODD = [
    (1, f"{LINE}\none\n  {LINE.upper()}\t", "en"), (2, None, None), (3, "", "en"), (3, "", "en"), (None, f"{LINE}\nno id", None), (4, f"\n\n{LINE}\n", "de"),
    (5, "word " * 30_000, "en"), (6, f"{LINE} \r\n{LINE}", None), (6, f"{LINE} \r\n{LINE}", None), (7, "日本語 текст ñandú \U0001f600 日本語 текст ñandú \U0001f600", "xx"), (8, " \n" * 1000, "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like results and helpers."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("x") for c in ("n_lines", "n_dropped", "id", "keys", "drops", "_k1", "rank", "score", "n", "w1", "phrase", "f", "shard", "query", "terms")})


# ---- token counts of long runs of blanks


def test_long_runs_of_blanks(spark, monkeypatch):
    made = token_counts.encoding(token_counts.default_path())
    runs = ["\n" * 40 + " " * 30, " " * 9 + "\u3000" * 3, "\t \t \t" * 7, " \x85\xa0" * 9, "\r\n" * 8 + " "]
    texts = [a + r + b for r in runs for a in ("", "word", "it's", "!") for b in ("", "x", "'s", "7 ", "\x1c", "...", "é" + r)]
    monkeypatch.setattr(token_counts, "RUN", 5)
    monkeypatch.setattr(token_counts, "_RUNS", [])
    assert [token_counts.counted(t, made) for t in texts] == [len(made.encode_ordinary(t)) for t in texts]
    monkeypatch.undo()
    monkeypatch.setattr(token_counts, "_RUNS", [])
    long = [(1, " " * 1_000_000), (2, "\n" * 1_000_000 + "end"), (3, "a" + " " * 2_000_000 + "b" + "\n" * 1_000_000)]
    got = token_counts.histogram(spark.createDataFrame(long, "doc_id long, text string")).collect()
    assert sum(r.n_docs for r in got) == 3


# ---- line dedup


def kept_lines(rows):
    """(id, lines, dropped, text) of each (id, text)."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    least = -(1 << 63)
    holders = defaultdict(list)
    for i, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(least if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if not (len(own := holders.get(key(line), [])) >= 3 and max(own) != (least if i is None else i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def in_order(rows):
    return sorted(rows, key=repr)


def test_lines_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    got = [tuple(r) for r in QUERIES["op11_line_dedup"](spark, DATA).collect()]
    want = [(i, n, d, sha256(t.encode()).hexdigest()) for i, n, d, t in kept_lines(rows)]
    assert in_order(got) == in_order(want)
    assert any(d for _, _, d, _ in want)


def test_lines_odd_rows(odd):
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup(odd).collect()]
    assert in_order(got) == in_order(kept_lines([(i, t) for i, t, _ in ODD]))
    assert not line_dedup.dedup(odd.filter("false")).count()


def test_lines_of_null_ids_alone(spark):
    rows = [(None, f"{LINE}\n{k}") for k in range(4)]
    assert [r.n_dropped for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0] * 4


def test_hot_lines_and_others(spark, monkeypatch):
    """A line in every document and many in some: by the hot shard and by the others."""
    monkeypatch.setattr(line_dedup, "HOT", 8)
    rows = [(k, "\n".join([LINE, *(f"{LINE} {(k * j) % 97}" for j in range(5)), f"only in document number {k}"])) for k in range(300)]
    got = [tuple(r) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", "text").collect()]
    assert in_order(got) == in_order(kept_lines(rows))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 1 << 30))
def test_perfect_hash(n, seed):
    draw = np.random.default_rng(seed)
    h1, h2 = draw.integers(0, 1 << 63, (2, n), np.uint64)
    h1[: n // 3] = 7  # equal in one half
    counts, lasts = draw.integers(1, 99, n), draw.integers(-99, 99, n)
    made = line_dedup.Shard.of_row(line_dedup.Shard.build(h1, h2, counts, lasts).row())
    assert sorted(made.places(h1, h2)) == list(range(n))
    found = made.probe(h1, h2)
    assert (found[0] == counts).all() and (found[1] == lasts).all()
    assert not made.probe(h1, h2 ^ np.uint64(1 << 40))[0].any()


# ---- ranked search


def ranks(docs, items, top=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(w)) for i, t in docs if (w := terms(t))]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // total
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, r in asked.items() if t in b)
            if score:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return out


@pytest.mark.parametrize("postings", [1 << 21, 500])
def test_ranks_against_brute_force(spark, monkeypatch, postings):
    """In one block a task, and in many, where thresholds cut lists off."""
    monkeypatch.setattr(ranked, "POSTINGS", postings)
    docs = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    got = [tuple(r) for r in QUERIES["op12_ranked_search"](spark, DATA).collect()]
    assert in_order(got) == in_order(ranks(docs, items))


def test_ranks_odd_rows(spark, odd, monkeypatch):
    items = [(1, "Shared LINE nothing-known line"), (1, "текст"), (None, "word"), (2, None), (3, ""), (4, "!?"), (5, "word"), (5, "word")]
    made = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x"))
    want = in_order(ranks([(i, t) for i, t, _ in ODD], items))
    assert in_order(tuple(r) for r in ranked.best(odd, made).collect()) == want
    monkeypatch.setattr(ranked, "QUERY_BYTES", 8)  # a pass for each few queries
    assert in_order(tuple(r) for r in ranked.best(odd, made).collect()) == want
    assert not ranked.best(odd.filter("false"), made).count() and not ranked.best(odd, made.filter("false")).count()


def test_search_skips_but_loses_none():
    draw = np.random.default_rng(3)
    n = 2000
    parts = [np.flatnonzero(draw.random(n) < p) for p in (0.9, 0.8, 0.5, 0.2, 0.02, 0.01, 0.005)]
    of, terms = np.concatenate(parts), np.concatenate([np.full(len(p), t, np.int32) for t, p in enumerate(parts)])
    lists = ranked.Lists(np.arange(n), draw.integers(5, 500, n), of, terms, draw.integers(1, 20, len(of)).astype(np.int32), n, n * 250, len(parts))
    query = [(t, int(w)) for t, w in enumerate((3, 20, 150, 900, 2500, 3000, 4000))]
    docs, scores = ranked.search(lists, query, 1)
    for least in np.quantile(scores, (0.1, 0.5, 0.9, 0.995, 1)).astype(int).tolist() + [int(scores.max()) + 1]:
        some, own = ranked.search(lists, query, least)
        assert dict(zip(some, own)) == {d: s for d, s in zip(docs, scores) if s >= least}


# ---- collocations


def mined(docs, least, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        good = {p: f for p, f in own.items() if f >= least}
        inside = Counter()
        for p, f in good.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], f)
        rows = []
        for p, a in good.items():
            if len(p) > 1 and inside[p] < a:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(rows)[:top])]
    return out


@pytest.mark.parametrize("least", [5, 20])
def test_phrases_against_brute_force(spark, least):
    docs = table(spark, DATA, "documents")
    want = mined([(r.text, r.lang) for r in docs.collect()], least, 300)
    got = [tuple(r) for r in collocations.phrases(docs, least=least, top=300).collect()]
    assert in_order(got) == in_order(want) and len(want) > 50


def test_phrases_odd_rows(odd):
    rows = [(t, la) for _, t, la in ODD]
    for least in (1, 2, 3):
        assert in_order(tuple(r) for r in collocations.phrases(odd, least=least).collect()) == in_order(mined(rows, least))
    assert not collocations.phrases(odd.filter("false")).count()


def test_phrase_counts_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits: the expression alone, on given numbers."""
    a, n, le, r = 4 * 10**12, 9 * 10**14, 5 * 10**12, 7 * 10**12
    row = spark.range(1).select(F.expr(f"(cast({a} as decimal(19,0)) * cast({n} as decimal(19,0)) * 1000bd) div (cast({le} as decimal(19,0)) * cast({r} as decimal(19,0))) as s")).first()
    assert row.s == 1000 * a * n // (le * r)
