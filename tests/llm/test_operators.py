"""Each numbered operator on small tables: brute force, round trips, and odd rows."""

import html as htmllib
import random
import re
import struct
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfield.llm import bpe, decontaminate, forest, html_extract, langid, quality_pu, quality_rules, secrets, sharding, simhash, token_counts
from wayfield.llm.queries import QUERIES, table

DATA = "/root/testdata/sf0.001"
ODD = [
    (1, "the cat sat on the mat and looked at the dog " * 3, "en"), (2, None, None), (3, "", "en"), (3, "", "en"), (None, "no id here", None),
    (4, " \t\n ", "de"), (5, "word " * 30_000, "en"), (6, "1234 5678", None), (7, "日本語 текст ñandú \U0001f600", "xx"), (1, "the cat sat on the mat and looked at the dog " * 3, "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like results."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    clash = {c: F.lit("x") for c in ("score", "ids", "n_tokens", "decoded", "lang_pred", "predicted", "kept", "n_words", "fp", "root", "slot", "shard", "size", "_k", "h", "f", "x", "label", "source")}
    return df.withColumns(clash)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---- language ID


def test_langid_accuracy(docs):
    learn = langid.training_part()
    model = langid.fit(docs.filter(learn))
    rows = langid.identify(docs, model).filter(~learn).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_langid_odd_rows(docs, odd, empty):
    model = langid.fit(docs)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == len(ODD)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if not any(c.isalpha() for c in r.text or ""))
    assert all(r.source == "x" for r in rows)
    assert langid.identify(empty, model).count() == 0
    assert langid.fit(empty) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_langid_against_brute_force(spark, docs):
    """Counts, weights and cosines again in plain Python, over the whole table."""
    learn = langid.training_part()
    model = langid.fit(docs.filter(learn))

    def nearest(text):
        c = [ord(x) for x in f" {text.lower()} "]
        c = [32 if x < 65 or 90 < x < 97 or 122 < x < 128 else x for x in c]
        c = [x for i, x in enumerate(c) if not i or x != 32 or c[i - 1] != 32]
        counts, h = [0] * langid.DIM, [0] * len(c)
        for n in range(3):
            h = [(h[i] + c[i + n]) * 2654435761 % 2**32 for i in range(len(c) - n)]
            h = [x ^ (x >> 15) for x in h]
            for x in h:
                counts[x % langid.DIM] += 1
        v = [np.log1p(n) * w for n, w in zip(counts, model.idf.tolist())]
        size = sum(x * x for x in v) ** 0.5
        return max((sum(x * y for x, y in zip(v, row)) / size, model.langs[j]) for j, row in enumerate(model.vectors.tolist()))

    rows = QUERIES["op1_language_id"](spark, DATA).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(text)
    for r in rows:
        if any(x.isalpha() for x in text[r.doc_id] or ""):
            cosine, lang = nearest(text[r.doc_id])
            assert r.lang_pred == lang and abs(r.score - cosine) < 1e-4
        else:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)


def test_langid_rejection_keeps_the_prediction(docs, odd):
    model = langid.fit(docs)
    rows = langid.identify(odd, model).collect()
    assert {r.lang_pred for r in rows if any(c.isalpha() for c in r.text or "")} <= set(model.langs)
    kept = langid.recognised(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(not r.rejected for r in rows)
    known = langid.identify(docs, model).filter("rejected and lang is not null").count()
    assert known <= 0.005 * docs.count()


def test_langid_rejects_what_is_far(docs):
    model = langid.fit(docs)
    assert langid.classify("продолжение следует завтра утром", model)[0] == "und"


# ---- sharding


def test_sharding_law(docs):
    rows = sharding.shard(docs, 24).collect()
    assert len(rows) == docs.count()
    load, places = Counter(), {}
    for r in rows:
        load[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    sizes = [load[s] for s in range(24)]
    assert max(sizes) - min(sizes) <= max(r.size for r in rows)


def test_sharding_odd_rows(odd, empty):
    rows = sharding.shard(odd, 3).collect()
    assert len(rows) == len(ODD)
    assert sum(r.size for r in rows) == sum(8 + len((t or "").encode()) for _, t, _ in ODD)
    assert sharding.shard(empty, 3).count() == 0


def test_an_id_that_many_rows_share(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows = sharding.shard(df, 24).collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) < 100 and len(load) == 24
    assert max(Counter(r.virtual_slot for r in rows if r.doc_id == 7).values()) < 30


def test_versions_of_the_map(spark, tmp_path):
    first = sharding.first_map(spark, 4, 64)
    load = spark.createDataFrame([(i, 1000 if i % 4 == 0 else 10) for i in range(64)], "virtual_slot int, bytes long")
    path = sharding.write_map(sharding.rebalanced(first, load, 4), str(tmp_path / "map"))
    stored = sharding.read_map(spark, path)
    assert {r.shard for r in sharding.at_version(stored, 0).filter("virtual_slot % 4 = 1").collect()} == {1}
    now = sharding.at_version(stored).join(load, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
    assert max(r.b for r in now) - min(r.b for r in now) < 1000
    assert stored.filter("version = 1").count() < 64
    fewer = sharding.at_version(sharding.rebalanced(stored, load, 3))
    assert {r.shard for r in fewer.collect()} == {0, 1, 2} and fewer.count() == 64


# ---- decontamination


def brute_leaks(docs, items):
    token = lambda t: re.findall(r"\w+", (t or "").lower())
    out = set()
    for d, text in docs:
        k = token(text)
        for i, item in items:
            b = token(item)
            w = min(13, len(b))
            if w < 9:
                continue
            for o in range(-len(b), len(k)):
                same = [0 <= q + o < len(k) and k[q + o] == b[q] for q in range(len(b))]
                if any(sum(same[x : x + w]) >= (11 if w == 13 else w) and x + o >= 0 and x + o + w <= len(k) for x in range(len(b) - w + 1)):
                    out.add((d, i))
                    break
    return out


def test_masks_see_any_two_substitutions():
    for a in range(13):
        for b in range(13):
            assert any({a, b}.isdisjoint(o + p for p in m) for m in decontaminate.MASKS for o in range(13 - decontaminate.SPAN + 1))


def test_leaks_with_substitutions(spark, odd, empty):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([5, 9, 11, 13, 20, 40])))) for i in range(30)]
    rows = []
    for d in range(120):
        w = rng.choices(vocab, k=60)
        if d % 2:
            own = items[rng.randrange(30)][1].split()
            for _ in range(d % 5):
                own[rng.randrange(len(own))] = "other"
            w[20 : 20 + len(own)] = own
        rows.append((d, "  ".join(w).replace("w1 ", "W1, ")))
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_leaks(rows, items)
    bench = spark.createDataFrame([*items, (None, None), (77, "")], "item_id long, text string")
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(odd, bench.filter("false")).count() == 0
    held = spark.createDataFrame([(9, "the cat sat on the mat and looked at the dog the cat")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, held).collect()} == {(1, 9)}
    kept = decontaminate.without_leaks(odd, held)
    assert kept.count() == len(ODD) - 2 and kept.columns == odd.columns


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_leaks_against_sql(spark, sf):
    import duckdb

    from wayfield.llm.queries import ORACLES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    got = QUERIES["op3_decontamination"](spark, f"/root/testdata/{sf}")
    assert got.columns == ["doc_id", "item_id", "place", "agreed", "words"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLES["op3_decontamination"]).fetchall())


# ---- SimHash


def brute_fingerprint(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = words(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    distinct = sorted(set(prints))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in distinct}


def test_simhash_against_brute_force(docs, odd, empty):
    for df in (docs, odd):
        text = [(r.doc_id, r.text) for r in df.collect()]
        prints = Counter((d, f"{brute_fingerprint(t):016x}") for d, t in text)
        rows = simhash.groups(df).collect()
        assert Counter((r.doc_id, r.fingerprint) for r in rows) == prints
        root = brute_groups([int(f, 16) for _, f in prints])
        least = {}
        for d, f in prints:
            k = root[int(f, 16)]
            least[k] = min((x for x in (d, least.get(k)) if x is not None), default=None)
        assert all(r.component_id == least[root[int(r.fingerprint, 16)]] for r in rows)
    assert simhash.groups(empty).count() == 0


def test_components_of_chains(spark):
    base = 0x0F0F0F0F0F0F0F0F
    chain = [base]
    for k in range(30):
        chain.append(chain[-1] ^ (1 << (2 * k)) ^ (1 << (2 * k + 1)))
    far = base ^ 0xFFFF
    fps = [f - (1 << 64) if f >> 63 else f for f in [*chain, far ^ (1 << 60) ^ (1 << 61) ^ (1 << 62)]]
    got = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()
    root = brute_groups([f & (2**64 - 1) for f in fps])
    assert len({r.root for r in got}) == len({root[f & (2**64 - 1)] for f in fps if list(root.values()).count(root[f & (2**64 - 1)]) > 1})


def test_deduplicate_keeps_one_of_each(odd, empty):
    kept = simhash.deduplicate(odd)
    rows = kept.collect()
    groups = {brute_fingerprint(t) for _, t, _ in ODD}
    assert len(rows) == len(groups) and kept.columns == odd.columns
    assert Counter(r.doc_id for r in rows)[1] == 1
    assert simhash.deduplicate(empty).count() == 0


# ---- quality rules


def brute_counts(t):
    t = t or ""
    w, lines = words(t), [s for s in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = Counter(windows)
    covered = {j for i, x in enumerate(windows) if twice[x] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, docs, odd):
    rng = random.Random(1)
    made = [(i, "".join(rng.choices(["a", "b", " ", "  ", "\n", "\x0b", "#", "é", "a b a b a b\n"], k=rng.randrange(80))), None) for i in range(300)]
    for df in (docs.select("doc_id", "text", "lang"), odd.filter("doc_id <> 5 or doc_id is null"), spark.createDataFrame(made, "doc_id long, text string, lang string")):
        for r in quality_rules.statistics(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(r.text)


def test_rules_are_learnt_and_pruned():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality_rules.RATIOS)))
    bad = (x[:, 2] > 0.8) | ((x[:, 4] > 0.7) & (x[:, 5] > 0.7))
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= np.all([(x[:, quality_rules.RATIOS.index(c.statistic)] > c.cut) == c.above for c in r.conditions], axis=0)
    assert (hit == bad).mean() > 0.97 and all(len(r.conditions) <= 3 for r in rules)


def test_quality_rules_on_documents(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rules = quality_rules.fit(docs, labels)
    rated = quality_rules.rate(odd, rules)
    rows = rated.collect()
    assert len(rows) == len(ODD) and all(not r.kept for r in rows if not words(r.text))
    assert quality_rules.rate(empty, rules).count() == 0
    assert quality_rules.fit(docs, labels.filter("false")) == []
    marked = quality_rules.rate(docs, rules).join(labels, "doc_id").filter("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in marked]) > 0.9


def test_rules_on_held_out_labels(spark):
    """Rules learnt on three quarters of the labels against the rest, of rows that pass the base conditions."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    learn = quality_pu.training_part()
    rules = quality_rules.fit(docs.filter(learn), labels.filter(learn))
    rows = quality_rules.rate(docs.filter(~learn), rules).join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_helper_names_do_not_clash(spark, docs):
    """Columns that go by the names of helpers keep their values through every operator that keeps columns."""
    names = ["_k1", "_k2", "_words", "_windows", "_filled", "_upper", "_bang", "_distinct", "_lines", "_r", "_lang", "_found", "row_key_1", "lang_", "found", "both", "words_"]
    few = docs.limit(40).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    items = spark.createDataFrame([(1, "w " * 20)], "item_id long, text string")
    scanner = secrets.Scanner([-5.0] * secrets._KINDS**2, [], {}, [0.0])
    made = [
        simhash.deduplicate(few), decontaminate.without_leaks(few, items), quality_rules.rate(few, []), langid.recognised(few, langid.fit(few)),
        langid.identify(few, None), bpe.encode(few), quality_pu.scored(few, None), secrets.redact(few, scanner),
    ]
    for df in made:
        rows = df.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


# ---- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def check_texts(library, texts):
    codec = bpe.codec(bpe.default_path())
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), max_size=60), max_size=6))
def test_bpe_on_any_text(library, texts):
    check_texts(library, texts)


def test_bpe_on_pieces_of_the_vocabulary(library):
    rng = random.Random(2)
    pieces = [t.removesuffix(bpe.END) for t in bpe.codec(bpe.default_path()).trie.ids if t.removesuffix(bpe.END).isascii()]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 5))) for _ in range(4000)]
    check_texts(library, [*texts, "a" * 3000, "ha" * 500, "<|endoftext|>it's<|startoftext|> 'LL", "====" * 99])


def test_bpe_rows(library, docs, odd, empty):
    for df in (docs, odd):
        got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.encode(df)).collect()}
        want = set()
        for r in df.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want.add((r.doc_id, len(ids), sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert got == want
    assert bpe.encode(empty).count() == 0


# ---- quality classifier


def test_prior_and_scores():
    rng = np.random.default_rng(4)
    good = lambda n: rng.normal(0, 1, (n, 3))
    bad = lambda n: rng.normal([3, 0, -3], 1, (n, 3))
    unlabelled = np.concatenate([good(2800), bad(1200)])
    model = quality_pu.fit_rows(good(2000), unlabelled[rng.permutation(4000)])
    assert 0.55 < model.prior < 0.72  # a lower bound of 0.7
    assert (model.score(good(1000)) > 0.5).mean() > 0.9 and (model.score(bad(1000)) < 0.5).mean() > 0.9


def test_classifier_on_documents(spark, odd, empty):
    # A thousand documents: the smallest table has too few positives to tell much.
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learn = quality_pu.training_part()
    model = quality_pu.fit(docs.filter(learn), labels.filter("quality = 1").filter(learn))
    rows = quality_pu.scored(docs, model).filter(~learn).join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert quality_pu.scored(odd, model).count() == len(ODD)
    assert quality_pu.scored(empty, model).count() == 0
    assert {r.score for r in quality_pu.scored(odd, None).collect()} == {0.5}
    assert quality_pu.fit(empty, labels) is None


# ---- token counts


def test_token_counts(spark, docs, odd, empty):
    encode = token_counts.encoding(token_counts.default_path()).encode_ordinary
    for df in (docs, odd):
        n = sorted(len(encode(r.text or "")) for r in df.collect())
        rows = token_counts.histogram(df)
        got = {r.n_tokens: r for r in rows.collect()}
        assert {k: r.n_docs for k, r in got.items()} == Counter(n)
        for k, r in got.items():
            assert (r.docs_at_least, r.tokens_at_least, r.truncated_total) == (sum(x >= k for x in n), sum(x for x in n if x >= k), sum(min(x, k) for x in n))
        limits = [0, 1, 7, 100, 10**6]
        cut = {r.limit: (r.longer, r.truncated_total) for r in token_counts.at_limits(rows, spark.createDataFrame([(x,) for x in limits], "limit long")).collect()}
        assert cut == {x: (sum(y > x for y in n), sum(min(x, y) for y in n)) for x in limits}
        for q in (0.1, 0.5, 0.99, 1.0):
            assert token_counts.quantile(rows, q) == n[int(np.ceil(q * len(n))) - 1]
        assert {(r.q, r.n_tokens) for r in token_counts.quantiles(rows, [0.07, 0.29, 0.5]).collect()} == {(q, n[-(-round(q * 100) * len(n) // 100) - 1]) for q in (0.07, 0.29, 0.5)}
    assert token_counts.histogram(empty).count() == 0
    assert {(r.limit, r.docs, r.total) for r in token_counts.at_limits(token_counts.histogram(empty), spark.createDataFrame([(5,)], "limit long")).collect()} == {(5, 0, 0)}


def test_token_report(spark, docs, empty):
    """The registered query's rows: lengths and limits alike."""
    n = sorted(len(token_counts.encoding(token_counts.default_path()).encode_ordinary(r.text or "")) for r in docs.collect())
    rows = {r.n_tokens: r for r in QUERIES["op8_token_counts"](spark, DATA).collect()}
    assert set(rows) == set(n) | set(token_counts.CONTEXTS)
    for k, r in rows.items():
        assert (r.n_docs, r.docs_at_least, r.longer, r.is_limit) == (n.count(k), sum(x >= k for x in n), sum(x > k for x in n), k in token_counts.CONTEXTS)
        assert (r.tokens_at_least, r.truncated_total) == (sum(x for x in n if x >= k), sum(min(x, k) for x in n))
        assert r.percentiles == [p for p in token_counts.PERCENTILES if n[-(-p * len(n) // 100) - 1] == k]
    assert {(r.n_docs, r.truncated_total) for r in token_counts.report(empty).collect()} == {(0, 0)}


# ---- secrets


KEY = "5aad00685accefdd91653537b82ad0dab34e35e3"


def secret_rows():
    rng = random.Random(9)
    prose = "the of and with chachaulichengeheitheit in thisonwhbleon to internationalisation".split()
    rows = []
    for i in range(200):
        w = rng.choices(prose, k=40)
        key = "".join(rng.choices("0123456789abcdef", k=40))
        if i % 4 == 0:
            w.insert(20, f'token = "{key}"')
        if i % 4 == 1:
            w.insert(20, f"commit {key}")
        if i % 4 == 2:
            w.insert(20, f"https://example.com/a/{key}/index")
        rows.append((i, " ".join(w)))
    return rows


def test_secrets(spark, odd, empty):
    rows = secret_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scanner = secrets.fit(df)
    got = {(r.doc_id, r.start, r.length) for r in secrets.scan(df, scanner).collect()}
    want = {(i, m.start(1), 40) for i, t in rows for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    assert got == want
    redacted = {r.doc_id: r.text for r in secrets.redact(df, scanner).collect()}
    assert redacted == {i: re.sub(r'(?<=token = ")[0-9a-f]{40}', secrets.MARKER, t) for i, t in rows}
    extra = odd.withColumn("text", F.when(F.col("doc_id") == 7, F.concat("text", F.lit(f' api_key: "{KEY}" é'))).otherwise(F.col("text")))
    found = secrets.scan(extra, scanner).collect()
    assert [(r.doc_id, r.start) for r in found] == [(7, len(ODD[8][1]) + len(' api_key: "'))]
    assert secrets.redact(extra, scanner).count() == len(ODD) and secrets.redact(extra, scanner).columns == extra.columns
    assert secrets.scan(empty, scanner).count() == 0 and secrets.redact(empty, scanner).count() == 0
    assert secrets.scan(odd, secrets.fit(empty)).count() == 0


def test_reviewed_labels(spark):
    rows = [("A" * 10 + str(i) * 10, "x ", " y", 1) for i in range(10)] + [("a" * 20, "x ", " y", 0) for _ in range(10)]
    labelled = spark.createDataFrame(rows, "value string, before string, after string, label int")
    df = spark.createDataFrame([(1, "AAAAAAAAAA7777777777 and aaaaaaaaaaaaaaaaaaaa")], "doc_id long, text string")
    assert [r.start for r in secrets.scan(df, secrets.fit(df, labelled)).collect()] == [0]


def test_forest_expression(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    trees = forest.fit(x, (x[:, 0] + x[:, 1] > 1).astype(int))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = [r.s for r in df.select(forest.score(trees, lambda i: F.col("abc"[i])).alias("s")).collect()]

    def vote(t, r):
        return vote(t[2] if r[t[0]] <= t[1] else t[3], r) if isinstance(t, tuple) else t

    assert np.allclose(got, [np.mean([vote(t, r) for t in trees]) for r in x])
    assert np.mean((np.array(got) > 0.5) == (x[:, 0] + x[:, 1] > 1)) > 0.93


# ---- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy now, the best of all and it is for you.</div>
<article><h1>Head &amp; line</h1><p><b>The first of the paragraphs is long enough to be decided on its own, it has the words.<br>After a break<p>Short.
<p title="a > b">Second   of\nthe long paragraphs is here and it has &lt;tags&gt; in it, as all of them do, and more.</p><aside>Related: the other article that you may like to read</aside>
<form><label>Name</label><input><button>Go</button></form><p>End&nbsp;it.</p></article><div id="comments"><p>I think that this is the best of all the articles that I have read in the year, and it was good.</p></div>
<footer>&copy; all of it is ours and the rest is yours</footer></body></html>"""


def test_main_text():
    assert html_extract.extract(PAGE).split("\n\n") == [
        "Head & line",
        "The first of the paragraphs is long enough to be decided on its own, it has the words. After a break",
        "Short.",
        "Second of the long paragraphs is here and it has <tags> in it, as all of them do, and more.",
        "End it.",
    ]


def test_pages_without_article():
    body = "The house on the hill is old and it was built by the people of the town for their children and all of the others. " * 2
    page = f"<body><div class='menu'><a href=x>One</a></div><div><a href=1>The links of the page are here for you and all of them are links</a></div><div><p>{body}</p><p>Tiny one.</p><p>{body}</p></div><div>imprint</div></body>"
    assert html_extract.extract(page) == "\n\n".join([body.strip(), "Tiny one.", body.strip()])


def test_article_known_by_name():
    page = """<body><div id="main-menu"><a href=1>One</a></div><div class="page-content"><ul><li><a href=2>Two</a></ul><h2>Title</h2>
    <p>aab | ccd | eef | ggh | iij | kkl | mmn | oop | qqr | sst | uuv | wwx | yyz | aab | ccd</p><p>Short.</p><div class="cookie-notice">We use them</div></div><div>other</div></body>"""
    assert html_extract.extract(page).split("\n\n") == ["Title", "aab | ccd | eef | ggh | iij | kkl | mmn | oop | qqr | sst | uuv | wwx | yyz | aab | ccd", "Short."]


@settings(max_examples=200, deadline=None)
@given(st.text("<>/=\"'&;! abpdivscrlenty-\n", max_size=200))
def test_broken_markup_does_no_harm(page):
    html_extract.extract(page)
    html_extract.extract("<article>" + page)


def test_page_rows(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = html_extract.main_text(pages).collect()
    for r in rows:
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)
        parts = [" ".join(htmllib.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|article)[^>]*>", m[1] if m else "")]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "plain", "x")], "page_id long, html string, text string")
    assert [(r.text, r.n_chars) for r in html_extract.main_text(odd).orderBy("page_id").collect()][:2] == [("", 0), ("", 0)]
    assert html_extract.main_text(odd.filter("false")).count() == 0


# ---- queries and pipeline


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_run(spark, name):
    df = QUERIES[name](spark, DATA)
    n = df.count()
    assert n > 0 or name.startswith("op9")  # the smallest table holds no secret
    if name.split("_")[0] not in ("op3", "op8", "op9"):
        assert n == table(spark, DATA, "pages" if name.startswith("op10") else "documents").count()


def brute_similar(rows):
    """The smallest id of each row's group: five-word shingles alike by 0.8 or more, compared in full."""
    def sets(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    own, up = {d: sets(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(up)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if own[a] == own[b] or len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in ids}


def test_pipeline_against_brute_force(spark, library):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    model = langid.fit(docs.filter(langid.training_part()))
    left = [(r.doc_id, r.text) for r in docs.collect() if r.text and langid.classify(r.text, model)[0] != "und"]
    root = brute_similar(left)
    left = sorted((d, t) for d, t in left if root[d] == d)
    leaking = {d for d, _ in brute_leaks(left, items)}
    left = [(d, re.sub(r'(?i)(?<=token = ")[0-9a-f]{40}', secrets.MARKER, t)) for d, t in left if d not in leaking]
    want = {}
    for d, t in left:
        ids = library.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "bpe"]


def test_pipeline_stages_on_an_empty_table(spark, odd):
    import corpus_pipeline

    frame = odd.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, DATA)
        assert frame.count() == 0


def test_pipeline_stages_keep_columns_and_odd_rows(spark, odd):
    import corpus_pipeline

    frame = odd
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, DATA)
        if name != "bpe":
            assert set(odd.columns) <= set(frame.columns)
        frame.count()
