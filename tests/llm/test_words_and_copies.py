"""Spelling variants, collocations and exact duplicates against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspine.llm import collocations, exact_dedup, spelling

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))
DOCS = "doc_id long, text string, lang string"


def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, ties, clashing names."""
    base = "alpha beta gamma delta"
    data = [(1, base, "en"), (1, base, "en"), (2, None, None), (None, base + " ", "en"), (3, "", "fr"), (4, LONG, None), (5, " \n\t\x0b\x0c\r", "en"), (6, "alphabetagamma delta", "en"), (7, LONG.replace(" ", "\n"), "de"), (None, None, None), (8, "Alpha beta gamma delta", "en"), (9, base + " ", "en")]
    df = spark.createDataFrame(data, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("id", "key", "norm", "n", "word", "phrase", "row", "variant", "best", "h")}), data


# --- exact duplicates


def plain_groups(data):
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in data:
        norm = re.sub("[\x20\x09-\x0d]", "", text or "")
        groups[norm].append((-len(text or ""), doc_id is not None, doc_id or 0))
    rows = []
    for norm, members in groups.items():
        keep = min(members)
        for m in members:
            rows.append((m[2] if m[1] else None, keep[2] if keep[1] else None, len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return collections.Counter(rows), {hashlib.sha256(k.encode()).hexdigest() for k in groups}


@pytest.mark.parametrize("poor", [False, True])
def test_exact_duplicates(spark, poor):
    df, data = odd(spark)
    how = {"hash_of": lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 32, "0"))} if poor else {}
    got = exact_dedup.exact_duplicates(df, **how).collect()
    want, groups = plain_groups(data)
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert sorted(r["text_sha256"] for r in kept) == sorted(groups)  # one row of each group, also of repeated rows
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_duplicates_large_and_small_groups(spark):
    data = [(i, "a b" if i % 3 == 0 else f"text {i // 2}", "en") for i in range(4000)]  # one group is broadcast, the others are joined
    got = exact_dedup.exact_duplicates(spark.createDataFrame(data, DOCS)).collect()
    want, groups = plain_groups(data)
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_duplicates_of_nothing(spark):
    out = exact_dedup.exact_duplicates(spark.createDataFrame([], DOCS))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and out.count() == 0


def test_exact_duplicates_stay_in_the_jvm(spark):
    out = exact_dedup.exact_duplicates(spark.createDataFrame([(1, "a", "en")], DOCS))
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())


# --- spelling variants


def plain_words(data):
    out = collections.Counter()
    for doc_id, text, *_ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def plain_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def plain_variants(words):
    near = {w: [x for x in words if plain_near(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] is not None else None)
    return out


def variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("letters", ["ab", "abcdé", "aabcdefghijklmnopqrstuvwxyzßöÿ"])
def test_variants_against_all_pairs(spark, letters):
    rng = random.Random(letters)
    words = {}
    for _ in range(150):
        w = "".join(rng.choices(letters, k=rng.randint(5, 9)))
        words[w] = rng.randint(3, 300)
        i = rng.randrange(len(w))
        for v in (w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], rng.choice(letters) + w, w + rng.choice(letters)):
            if len(v) >= 5:
                words[v] = rng.choice([3, 3, 6, 12, rng.randint(3, 300)])
    got = variants(spelling.variants_of(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain_variants(words)


def test_variants_of_documents(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdeöÀ", k=rng.randint(3, 8))) for _ in range(60)]
    texts = [" ".join(rng.choice(base) + rng.choice(["", "", "e", "-x", "7"]) for _ in range(200)) for _ in range(120)]
    data = [(i if i % 10 else None, t.upper() if i % 3 == 0 else t, "en") for i, t in enumerate(texts)] + [(5, None, None), (6, "", "en"), (7, "b" * 4_000 + " " + "b" * 3_999, None)] * 3
    words = plain_words(data)
    assert "b" * 4_000 in words and words != {w: n for w, n in collections.Counter(x for t in texts for x in re.findall("[a-zöÀ]+", t)).items()}
    got = spelling.spelling_variants(spark.createDataFrame(data, DOCS).withColumns({"word": F.lit(1), "n": F.lit(2), "key": F.lit(3)}))
    assert variants(got) == plain_variants(words)


def test_chains_of_forms(spark):
    words = {"x" * 5 + "y" * k: 2 ** (k + 2) for k in range(9)}
    got = variants(spelling.variants_of(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain_variants(words) and got["xxxxx"][1] == "x" * 5 + "y" * 8


def test_variants_broadcast_no_table(spark, monkeypatch):
    plans, keep = [], spelling.stored
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(spelling, "stored", lambda df, name: (out := keep(df, name), plans.append(plan(df)))[0])
    words = {"x" * 5 + "y" * k: 2 ** (k + 2) for k in range(4)}
    out = spelling.variants_of(keep(spark.createDataFrame(list(words.items()), "word string, n long"), "small"))
    got = variants(out)
    plans.append(plan(out))  # as it ran, joins chosen anew by size included
    assert got == plain_variants(words) and sum("SortMergeJoin" in p for p in plans) >= 4
    assert not any("Broadcast" in p for p in plans)


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    df, data = odd(spark)
    assert variants(spelling.spelling_variants(df)) == plain_variants(plain_words(data))


def test_pivots_are_the_rarest_disjoint_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        places = rng.permutation(12)[: rng.integers(3, 6)]
        weights = rng.integers(1, 30, len(places))
        got = spelling.pivots_of(places, weights)
        cost = {int(p): int(w) for p, w in zip(places, weights, strict=True)}
        pairs = [(cost[a] + cost[b]) for a, b in itertools.combinations(sorted(cost), 2) if b - a >= 2]
        assert got[1] - got[0] >= 2 and cost[got[0]] + cost[got[1]] == min(pairs)


# --- collocations


def plain_collocations(data, least, most):
    f, totals = collections.Counter(), collections.Counter()
    for _, text, lang in data:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    f = {p: n for p, n in f.items() if n >= least}
    rows = collections.defaultdict(list)
    for (lang, words), a in f.items():
        if len(words) < 2:
            continue
        if any(g == lang and len(w) > len(words) and 100 * n >= 100 * a and any(w[i : i + len(words)] == words for i in range(len(w))) for (g, w), n in f.items()):
            continue
        cuts = [(1000 * a * totals[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        rows[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for lang, x in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:most])}


def table(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def talk(seed, docs, vocabulary=14):
    rng = random.Random(seed)
    words = ["The", "of", "to", "été", "ÉTÉ", "new", "york", "x y", "a-b", "it's", "z" * 30, "12", "q", "\U0001f600"][:vocabulary]
    out = []
    for i in range(docs):
        text = ""
        for _ in range(rng.randint(0, 120)):
            text += rng.choice([*words, "new york city hall", "of the of the"]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "?", "\x0b"])
        out.append((i, text if i % 17 else None, [None, "en", "fr", "und"][i % 4]))
    return out


@pytest.mark.parametrize(("one_in", "least"), [(1, 5), (4, 9), (10**9, 6)])
def test_collocations_whatever_the_sample_proposes(spark, one_in, least):
    data = talk(one_in, 90)
    got = collocations.collocations(spark.createDataFrame(data, DOCS).repartition(3), least=least, most=40, one_in=one_in)
    want = plain_collocations(data, least, 40)
    assert table(got) == want and len(want) > 60


def test_false_bits_change_nothing(spark, monkeypatch):
    full = lambda found, *a: spark.sparkContext.broadcast(np.full(2**10, -1, np.int64).view(np.uint64))
    monkeypatch.setattr(collocations, "_bits", full)
    data = talk(2, 60)
    assert table(collocations.collocations(spark.createDataFrame(data, DOCS), least=6, most=25)) == plain_collocations(data, 6, 25)


def test_tallies_lose_no_count():
    rng = np.random.default_rng(1)
    want, got, tally = collections.Counter(), collections.Counter(), collocations.Tally(7)

    def take():
        h, n = tally.take()
        assert (np.diff(h.astype(object)) > 0).all()
        got.update(dict(zip(h.tolist(), n.tolist(), strict=True)))

    for _ in range(50):
        h = rng.integers(0, 2**63, 12).astype(np.uint64)[rng.integers(0, 12, rng.integers(0, 30))]
        want.update(h.tolist())
        if tally.add(h):
            take()
    take()
    assert got == want


@pytest.mark.parametrize("bits", [1, 4, 24])
def test_blocks_of_hashes_come_back_summed(bits):
    rng = np.random.default_rng(bits)
    h = np.append(rng.integers(0, 2**63, 400).astype(np.uint64) * 2, [np.uint64(0), np.uint64(2**64 - 1)])
    rows, want = [], collections.Counter()
    for _ in range(3):
        tally = collocations.Tally()
        seen = h[rng.integers(0, len(h), 900)]
        tally.add(seen)
        want.update((seen >> np.uint64(32 - bits)).tolist())
        rows += collocations._blocks(tally, bits).to_pylist()
    rows.sort(key=lambda r: r["part"])
    batch = collocations.pa.RecordBatch.from_pylist(rows, schema=collocations._blocks(collocations.Tally(), bits).schema)
    out = [r for b in collocations._merged(bits, 8)([batch.slice(0, 5), batch.slice(5)]) for r in b.to_pylist()]
    assert {(r["h"] & (2**64 - 1)) >> (32 - bits): r["n"] for r in out} == {k: n for k, n in want.items() if n >= 8}


def test_products_beyond_64_bits(spark):
    f = {"a": 9 * 10**12, "b": 8 * 10**12 + 1, "c": 7 * 10**12, "a b": 6 * 10**12 + 7, "b c": 10**12 + 3, "a b c": 10**12 + 1}
    n = 10**13 + 9
    phrases = spark.createDataFrame([("en", p, k) for p, k in f.items()], "lang string, phrase string, f long")
    got = {r["phrase"]: (r["l"], r["r"], r["score"]) for r in collocations.scored(phrases, spark.createDataFrame([("en", n)], "lang string, n long")).collect()}
    want = {}
    for p in ("a b", "b c", "a b c"):
        w = p.split()
        score, k = min((1000 * f[p] * n // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w)))
        want[p] = (f[" ".join(w[:k])], f[" ".join(w[k:])], score)
    assert got == want


def test_collocations_of_odd_rows(spark):
    df, data = odd(spark)
    assert table(collocations.collocations(df, least=2, most=50)) == plain_collocations(data, 2, 50)
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
