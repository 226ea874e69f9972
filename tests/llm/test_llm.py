"""The text operators on small inputs, against brute force where it is cheap."""

from __future__ import annotations

import collections
import hashlib
import io
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspine.llm import chat, decontam, html_extract, langid, neardup, packing, pii, quality, token_blocks, toxicity

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra and clashing columns."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    data = [(1, base, "en", "s", 1), (1, base, "en", "s", 1), (2, None, None, None, None), (None, base + " nu", "en", "s", 2), (3, "", "fr", "s", 0), (4, LONG, "en", None, 5), (5, "x", "en", "t", 1), (6, base.upper(), "en", "s", 1), (7, "  \n\t ", "en", "s", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"shard": F.lit(1), "key": F.lit("k"), "node": F.lit(2), "host": F.lit("h"), "bands": F.lit(0), "path": F.lit("p")})


def empty(df):
    return df.where("false")


# --- token blocks


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 2**32 - 1)), max_size=700), st.integers(0, 700), st.integers(0, 700))
def test_segments_round_trip(ids, a, b):
    x = np.array(ids, np.uint32)
    data = token_blocks.encode_segment(x)
    assert (token_blocks.decode_segment(data) == x).all()
    lo, hi = sorted((min(a, len(x)), min(b, len(x))))
    assert (token_blocks.decode_segment(data, lo, hi) == x[lo:hi]).all()


def test_shard_random_access(monkeypatch):
    monkeypatch.setattr(token_blocks, "SEGMENT", 256)
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50_000, n).astype("<u4") for n in (0, 1, 300, 1000, 5)]
    out = io.BytesIO()
    w = token_blocks.ShardWriter(out)
    for i, d in enumerate(docs):
        w.add(None if i == 0 else i, d.tobytes())
    w.close()
    r = token_blocks.ShardReader(out, len(out.getvalue()))
    whole = np.concatenate(docs)
    assert (r.read(0, len(whole)) == whole).all() and (r.read(250, 700) == whole[250:700]).all()
    assert [(d, n, c) for d, _, n, c in r.documents()] == [(None if i == 0 else i, len(d), zlib.crc32(d.tobytes())) for i, d in enumerate(docs)]


def test_word_tokenizer_is_exact():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole, mine = Tokenizer.from_file(path), token_blocks.WordTokenizer(path)
    for t in ["It's A TEST, isn't it? 3.14", "naïve Ñandú ÉTÉ straße", "a<|endoftext|>b", "東京 tower", "Σίσυφος İstanbul", "x\x1cy z\xa0w\x85v", "é combining", "Привет, МИР", "😀 ok", "", "  ", "ǅ ſ K"]:
        assert np.frombuffer(mine(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 0x24F), st.integers(0, 0x10FFFF).filter(lambda c: not 0xD800 <= c < 0xE000), st.sampled_from([ord(c) for c in " ab'ſıЙй0\u0306\u0301"])), max_size=30))
def test_word_tokenizer_agrees_on_any_code_points(codes):
    P = pytest.importorskip("public_tokenizers")
    mine = token_blocks.word_tokenizer(P.path("word_bpe_49k.json"))
    t = "".join(map(chr, codes))
    assert np.frombuffer(mine(t), "<u4").tolist() == mine.whole.encode(t, add_special_tokens=False).ids


def test_word_tokenizer_agrees_on_every_small_code_point(tmp_path):
    """Each of the first 0x600 code points alone, inside a word and between words; a file with other steps is not shortcut."""
    P = pytest.importorskip("public_tokenizers")
    import json

    path = P.path("word_bpe_49k.json")
    mine = token_blocks.WordTokenizer(path)
    for c in map(chr, range(0x600)):
        for t in (c, f"hel{c}lo", f"hello {c} world", f"Hello{c}World"):
            assert np.frombuffer(mine(t), "<u4").tolist() == mine.whole.encode(t, add_special_tokens=False).ids, repr(t)
    steps = json.load(open(path, encoding="utf-8"))
    steps["normalizer"]["normalizers"] = steps["normalizer"]["normalizers"][:2]
    (tmp_path / "other.json").write_text(json.dumps(steps), encoding="utf-8")
    other = token_blocks.WordTokenizer(str(tmp_path / "other.json"))
    assert not other.known and np.frombuffer(other("HELLO World"), "<u4").tolist() == other.whole.encode("HELLO World", add_special_tokens=False).ids


def test_token_blocks_match_brute_force(spark):
    """doc_id, start, n_tokens and crc of all rows, with one id on most of them, against a plain loop."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = np.random.default_rng(4)
    texts = [" ".join(f"Word{x}\x07é" for x in rng.integers(50, size=int(rng.integers(0, 30)))) for _ in range(300)]
    data = [(7 if i % 3 else i, t) for i, t in enumerate(texts)] + [(7, "same")] * 200 + [(5, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = token_blocks.token_blocks(df, P.path("word_bpe_49k.json"), shards=6).orderBy("start").collect()
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) > 2  # one id fills several shards
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(i for i, _ in data)
    crc = lambda t: (n := whole.encode(t or "", add_special_tokens=False).ids + [1]) and (len(n), zlib.crc32(np.array(n, "<u4").tobytes()))
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == collections.Counter((i, *crc(t)) for i, t in data)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]).tolist()


def test_paths_get_schemes(spark):
    assert token_blocks.qualified(spark, "/tmp/x") == "file:/tmp/x"
    fs, path = token_blocks._open("file:/tmp/x")
    assert path == "/tmp/x" and fs.type_name == "local"
    assert token_blocks.arrow_uri("s3a://bucket/x") == "s3://bucket/x" and token_blocks.arrow_uri("hdfs://n/x") == "hdfs://n/x"


def test_token_blocks(spark, odd_docs):
    P = pytest.importorskip("public_tokenizers")
    got = token_blocks.token_blocks(odd_docs, P.path("word_bpe_49k.json")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]).tolist()
    assert got[3]["n_tokens"] == 1 and got[3]["ids_crc32"] == zlib.crc32(b"\1\0\0\0")
    assert token_blocks.token_blocks(empty(odd_docs), P.path("word_bpe_49k.json")).count() == 0


# --- surrogates


def test_surrogates(spark):
    data = [
        (1, "Mail jo.doe9@mail.example.com or JO.DOE9@mail.example.com, call +1 (017) 555-7713 from 10.0.0.7."),
        (2, "jo.doe9@mail.example.com paid with 4111 1111 1111 1111; key 04dbebab91ab85687d33eeaaf9ac699e1188f962; ssn 123-45-6789"),
        (3, "Mrs Anna Berg met Mr. Paul Stone; Господин Иван Петров; Mrs Anna Berg left."),
        (4, "Nothing here: version 1.2.3, year 2024, 12 apples."),
        (5, None),
        (6, ""),
        (4, "Nothing here: version 1.2.3, year 2024, 12 apples."),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("e", F.lit("clash"))
    got = {r["doc_id"]: r for r in pii.replace_pii(df).collect()}
    assert got[4]["text"] == data[3][1] and got[4]["n_entities"] == 0
    assert got[5]["text"] is None and got[6]["text"] == ""
    one, two, three = got[1]["text"], got[2]["text"], got[3]["text"]
    mail = re.search(r"Mail (\S+) or (\S+),", one)
    assert mail[1].lower() == mail[2].lower() and two.startswith(mail[1]) and "jo.doe9" not in one
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} from \d+\.\d+\.\d+\.\d+\.", one) and "555-7713" not in one
    card = re.search(r"4\d{3} \d{4} \d{4} \d{4}", two)[0].replace(" ", "")
    digits = [int(c) for c in card]
    assert card != "4111111111111111" and (sum(digits[1::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[0::2])) % 10 == 0
    assert re.search(r"key [0-9a-f]{40}; ssn \d{3}-\d{2}-\d{4}$", two)
    names = re.fullmatch(r"Mrs (\w+) (\w+) met Mr\. (\w+) (\w+); Господин ([а-яё]+) ([а-яё]+); Mrs (\w+) (\w+) left\.", three, re.I)
    assert names and names[1] == names[7] and names[2] == names[8]
    assert names[1] in pii.NAMES["woman", "latin"].split() and names[3] in pii.NAMES["man", "latin"].split() and names[5] in pii.NAMES["man", "cyrillic"].split()
    assert pii.replace_pii(empty(df)).count() == 0
    assert "Python" not in pii.replace_pii(df)._jdf.queryExecution().executedPlan().toString()


def test_surrogates_stay_distinct(spark):
    """Short numbers collide at first; all end distinct and none is an entity of the corpus."""
    df = spark.range(900).select("id", F.concat(F.lit("1."), F.lit("1."), (F.col("id") % 30).cast("string"), F.lit("."), F.floor(F.col("id") / 30).cast("string")).alias("text"))
    got = pii.replace_pii(df).collect()
    new = [r["text"] for r in got]
    assert len(set(new)) == 900 and not set(new) & {r["text"] for r in df.collect()}
    looked = pii.replace_pii(df, lookup_rows=-1 + 1).collect()
    assert sorted(r["text"] for r in looked) == sorted(new)


def test_surrogates_of_all_formats_agree(spark):
    """The formats of one IBAN, phone or card differ in their separators alone, also when redrawn."""
    groups = [["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "DE893704 00440532 0130 00"], ["+15551234567", "+1 555 123 4567", "+1 (555) 123-4567", "+1-555-123-4567"], ["+49301234567", "+49 30 1234567", "+493 01 234567"], ["+358 40 123 4567", "+358401234567"], ["4111 1111 1111 1111", "4111111111111111"], ["555-123-4567", "(555) 123-4567"]]
    df = spark.createDataFrame([(i, k, e) for i, g in enumerate(groups) for k, e in enumerate(g)], "g long, k long, e string")
    for attempt in (0, 1):
        got = df.select("g", "k", "e", pii.surrogates(F.array("e"), lambda form: F.lit(attempt), "key")[0]["new"].alias("new")).collect()  # noqa: B023
        assert all(re.sub(r"[A-Z0-9]", "", r["e"]) == re.sub(r"[A-Z0-9]", "", r["new"]) and len(r["e"]) == len(r["new"]) for r in got)
        for g in range(len(groups)):
            assert len({re.sub(r"[^A-Z0-9]", "", r["new"]) for r in got if r["g"] == g}) == 1, groups[g]
        new = {r["e"]: r["new"] for r in got}
        assert new["+15551234567"].startswith("+1") and new["+49301234567"].startswith("+49") and new["+358401234567"].startswith("+358")
        assert new["DE89370400440532013000"].startswith("DE") and new["DE89370400440532013000"] != "DE89370400440532013000"


def test_hint_knows_entities_without_digits(spark):
    """Of the types that need no digit or @, every form passes the hint and is replaced."""
    keys = [f"{p}{c}{'Abcdefghijklmnop'}" for p in ("sk", "pk", "ghp", "gho", "xoxb", "xoxp") for c in "-_"] + ["AKIA" + "ABCDEFGHIJKLMNOP", "AIza" + "Abcdefg_hij-klmnopqrstuvwxyzABCDEFG"]
    titles = "Mr Herr Monsieur Señor Sr Господин Mrs Ms Miss Frau Madame Mme Señora Sra Госпожа".split()
    names = [f"{t}{dot} {'Иванов' if t[0] == 'Г' else 'Stone'}" for t in titles for dot in ("", ".")]
    df = spark.createDataFrame([(i, f"see {e} here") for i, e in enumerate(keys + names)], "doc_id long, text string")
    left = df.select("text", pii.entities(F.col("text")).alias("found")).collect()
    assert [r["text"] for r in left if len(r["found"]) != 1] == []
    kept = df.join(pii.replace_pii(df), ["doc_id", "text"]).collect()
    assert [r["text"] for r in kept] == []


def test_surrogates_keep_coreference_gender_and_script(spark):
    """Family names agree with and without a given name and between genders; untitled full names follow; scripts stay."""
    data = [
        (1, "Mr John Smith came. Mr Smith sat. John Smith spoke; Mrs Smith did not. Johnny Smithers left."),
        (2, "Госпожа Мария Иванова и господа. Мария Иванова. Господин Иванов; Госпожа Иванова."),
        (3, "write to 田中@例え.jp, иван@почта.рф or ねこ@いぬ.jp; Mr Smith again"),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"n_entities": F.lit("mine"), "a.b": F.lit(1), "pii_found": F.lit(2)})
    out = pii.replace_pii(df)
    assert out.columns == [*df.columns, "n_entities_"] and pii.replace_pii(df, count_col=None).columns == df.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["n_entities"] == "mine" and got[1]["n_entities_"] == 3
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. Mr (\w+) sat\. (\w+) (\w+) spoke; Mrs (\w+) did not\. Johnny Smithers left\.", got[1]["text"])
    assert m and m[1] == m[4] != "John" and m[2] == m[3] == m[5] == m[6] != "Smith"
    m = re.fullmatch(r"Госпожа ([а-яё]+) ([а-яё]+) и господа\. ([а-яё]+) ([а-яё]+)\. Господин ([а-яё]+); Госпожа ([а-яё]+)\.", got[2]["text"], re.I)
    assert m and m[1] == m[3] and m[2] == m[4] == m[6] == m[5] + "а" and m[5].endswith("ов") and m[5] != "Иванов"
    m = re.fullmatch(r"write to ([\u4e00-\u9fff]{2})@([\u4e00-\u9fff])([\u3041-\u3096])\.jp, ([а-я]{4})@([а-я]{5})\.рф or ([\u3041-\u3096]{2})@([\u3041-\u3096]{2})\.jp; Mr (\w+) again", got[3]["text"])
    assert m and m[1] != "田中" and m[8] == re.search(r"Mr (\w+) sat", got[1]["text"])[1]


def test_surrogates_of_whole_names(spark):
    """No part of a name stays; titles, particles, white space and what follows the name do."""
    cases = {
        "Mr McDonald called.": r"Mr (?!Mc)\w+ called\.",
        "Mr Smith-Jones called.": r"Mr (?!Smith)[A-Z]\w+-(?!Jones)[A-Z]\w+ called\.",
        "Mr John Paul Smith called.": r"Mr (?!John)\w+ (?!Paul)\w+ (?!Smith)\w+ called\.",
        "Mrs Anna de Vries": r"Mrs (?!Anna)\w+ de (?!Vries)\w+",
        "Mr Smith However left.": r"Mr (?!Smith)\w+ However left\.",
        "Mr O'Brien and Mr d’Artagnan.": r"Mr O'(?!Brien)\w+ and Mr d’(?!Artagnan)\w+\.",
        "MR JOHN SMITH": r"MR (?!JOHN)[A-Z]+ (?!SMITH)[A-Z]+",
        "Mr J. Smith and Mr J Smith": r"Mr [A-Z]\. (?!Smith)(\w+) and Mr [A-Z] \1",
        "Mr  John Smith": r"Mr  (?!John)\w+ (?!Smith)\w+",
        "Mr\nJohn\nSmith.\n\nNext": r"Mr\n(?!John)\w+\n(?!Smith)\w+\.\n\nNext",
        "Dr Jane Roe, Prof. Dr. Ludwig van Beethoven": r"Dr (?!Jane)\w+ (?!Roe)\w+, Prof\. Dr\. (?!Ludwig)\w+ van (?!Beethoven)\w+",
        "Herr Dr. Weber und Frau Prof. Weber": r"Herr Dr\. (?!Weber)(\w+) und Frau Prof\. \1",
        "Mr  Karl Benz came. Karl Benz left.": r"Mr  (?!Karl)(\w+) (?!Benz)(\w+) came\. \1 \2 left\.",
        "Mr Smith's dog, Mrs He Ying, mr smith": r"Mr (?!Smith)\w+'s dog, Mrs (?!He )\w+ (?!Ying)\w+, mr smith",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    new = {r["doc_id"]: r["text"] for r in pii.replace_pii(df).collect()}
    assert {t: new[i] for i, (t, p) in enumerate(cases.items()) if not re.fullmatch(p, new[i])} == {}


def test_surrogates_of_more_numbers_and_secrets(spark):
    """Spaced phones, 15-digit cards, IPv6, tokens and keys; bare numbers that fail Luhn, times and other code stay."""
    iban = "GB82 WEST 1234 5698 7654 32"
    cases = {
        "call 555 123 4567 now": r"call (?!555 123 4567)\d{3} \d{3} \d{4} now",
        "3782 822463 10005": r"3(?!782 822463 10005)\d{3} \d{6} \d{5}",
        "at 2001:db8::1 or 2001:0db8:0:0:0:0:0:1": r"at (?!2001:db8::1 )\d{4}:[a-f]{2}\d::\d or \d{4}:\d[a-f]{2}\d:\d:\d:\d:\d:\d:\d",
        "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NSJ9.dozjgNryP4J3jVmN": r"eyJ(?!hbGciOiJIUzI1NiJ9)[\w-]+\.(?!eyJ)[\w-]+\.(?!dozjgNryP4J3jVmN)[\w-]+",
        "-----BEGIN RSA PRIVATE KEY-----\nMIIEabc1\n-----END RSA PRIVATE KEY-----": r"-----BEGIN RSA PRIVATE KEY-----\n(?!MIIEabc1)\w{8}\n-----END RSA PRIVATE KEY-----",
        iban: r"GB(?!82)\d\d (?!WEST)[A-Z]{4} \d{4} \d{4} \d{4} \d\d",
        "order 12345678901234": "order 12345678901234",
        "12:30:45 std::vector 1 555 123 4567 8": "12:30:45 std::vector 1 555 123 4567 8",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.replace_pii(df).collect()}
    assert {t: got[i]["text"] for i, (t, p) in enumerate(cases.items()) if not re.fullmatch(p, got[i]["text"])} == {}
    assert [got[i]["n_entities"] for i in range(8)] == [1, 1, 2, 1, 1, 1, 0, 0]
    plain = got[5]["text"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    spark.conf.set(pii.KEY_SETTING, "another")
    try:
        assert pii.replace_pii(df).where("doc_id = 0").first()["text"] != got[0]["text"]
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_surrogates_of_small_spaces_stay_distinct(spark):
    """All two-letter family names and one-letter mail names of a corpus get distinct surrogates, none of them in the corpus."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"{a.upper()}{b}" for a in letters[:12] for b in letters[:12]]
    data = [(i, f"Mr {n} here") for i, n in enumerate(names)] + [(1000 + i, f"{a}@b.com") for i, a in enumerate(letters)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    new = {r["doc_id"]: r["text"] for r in pii.replace_pii(df).collect()}
    family = [new[i].split()[1] for i in range(len(names))]
    mail = [new[1000 + i] for i in range(26)]
    assert len(set(family)) == len(names) and not set(family) & set(names)
    assert len(set(mail)) == 26 and not set(mail) & {t for _, t in data}


# --- chats


def test_reply_tree_paths(spark):
    data = [("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", "a", 0.9), ("t", 3, 1, "assistant", "b", 0.1), ("t", 4, 2, "user", "c", 0.5), ("t", 4, 2, "user", "c", 0.5), ("t", 5, 3, None, None, None), ("u", 1, 1, "user", "self", 0.0), ("c", 1, 2, "user", "x", 0.0), ("c", 2, 1, "user", "y", 0.0)]
    df = spark.createDataFrame(data, "tree string, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["leaf"]): r for r in chat.conversations(df).collect()}
    assert set(got) == {("t", 4), ("t", 5), ("u", 1)}
    assert got["t", 4]["rank"] == 1 and got["t", 5]["rank"] == 2
    assert got["t", 4]["formatted"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert [r["leaf"] for r in chat.conversations(df, best=1).where("tree = 't'").collect()] == [4]
    assert chat.conversations(empty(df)).count() == 0


def test_paths_match_brute_force(spark):
    """Random forests with cycles, unknown parents and a long chain."""
    rng = np.random.default_rng(7)
    data = [("chain", i, i - 1 if i else None) for i in range(300)]
    for t in range(12):
        n = int(rng.integers(1, 40))
        data += [(f"t{t}", i, int(rng.integers(-3, n))) for i in range(n)]
    parent = {(t, i): p for t, i, p in data}
    linked = lambda t, i: (t, parent[t, i]) in parent and parent[t, i] != i
    inner = {(t, parent[t, i]) for t, i in parent if linked(t, i)}
    want = set()
    for t, i in set(parent) - inner:
        path = [i]
        while linked(t, path[0]) and len(path) <= len(parent):
            path.insert(0, parent[t, path[0]])
        if len(path) <= len(parent):
            want.add((t, i, tuple(path)))
    df = spark.createDataFrame(data, "tree string, node long, parent long")
    assert {(r["tree"], r["leaf"], tuple(r["path"])) for r in chat.paths(df).collect()} == want


def test_chat_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|x <\\\\| <|", "", None, "plain\ntext\\n", LONG, "<|im_start|>", "\\<|a"]
    data = [(1, i, ["user", "assistant", "we<|ird\nro\\nle", None][i % 4], t) for i, t in enumerate(texts)] + [(2, None, "assistant", "x"), (2, None, "assistant", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in data[:8])
    loss = "".join(t or "" for _, _, r, t in data[:8] if r == "assistant")
    assert got[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2]["n_turns"] == 2
    assert chat.format_chats(empty(df)).count() == 0
    assert "Python" not in chat.format_chats(df)._jdf.queryExecution().executedPlan().toString()


def test_chat_without_id(spark):
    """Rows of a null conversation are one conversation, as in the SQL."""
    data = [(None, 0, "user", "hi"), (None, 1, "assistant", "yes"), (None, None, "user", "first"), (7, 0, "assistant", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert set(got) == {None, 7} and (got[None]["n_turns"], got[None]["loss_chars"], got[7]["n_turns"]) == (3, 3, 1)
    assert got[None]["turns_sha256"] == hashlib.sha256(b"user\nfirst\nuser\nhi\nassistant\nyes\n").hexdigest()
    tree = spark.createDataFrame([(None, 1, None), (None, 2, 1), (None, 3, 1), ("a", 1, None)], "tree string, node long, parent long")
    assert sorted((r["tree"] or "", r["leaf"], r["path"]) for r in chat.paths(tree).collect()) == [("", 2, [1, 2]), ("", 3, [1, 3]), ("a", 1, [1])]


# --- packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 4), st.integers(0, 8)), max_size=60))
def test_best_fit_takes_the_tightest_bin(rows):
    items = [(n, i, f"s{s}", c) for i, (n, s, c) in enumerate(rows)]
    got = packing.best_fit(items, 50, 2)
    bins = collections.defaultdict(list)
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        size, _, s, c = items[i]
        fits = [(50 - sum(items[j][0] for j in b), k) for k, b in bins.items() if sum(items[j][0] for j in b) + size <= 50 and all(items[j][3] != c for j in b) and sum(items[j][2] == s for j in b) < 2]
        assert got[i][0] in ([k for r, k in fits if r == min(fits)[0]] if fits else [len(bins)])
        assert got[i][1] == sum(items[j][0] for j in bins[got[i][0]])
        bins[got[i][0]].append(i)


def test_packing(spark, odd_docs):
    """Sizes are token counts, every token has a place, and no bin breaks a constraint."""
    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    got = packing.pack_documents(odd_docs, path, 4096).collect()
    tokens = token_blocks.WordTokenizer(path)
    want = collections.Counter()
    for r in odd_docs.collect():
        want[r["doc_id"]] += tokens.count(r["text"] or "") + 1
    have, size = collections.Counter(), collections.Counter()
    for r in got:
        have[r["doc_id"]] += r["n_tokens"]
        size[r["bin_id"]] += r["n_tokens"]
    assert have == want and max(size.values()) <= 4096
    for r in got:
        inside = [x for x in got if x["bin_id"] == r["bin_id"] and x is not r]
        assert all(x["bin_offset"] + x["n_tokens"] <= r["bin_offset"] or r["bin_offset"] + r["n_tokens"] <= x["bin_offset"] for x in inside)
    assert packing.pack_documents(empty(odd_docs), path).count() == 0


def test_packing_keeps_conflicts_apart(spark):
    """Through Spark, with a source and a cluster on a third of all rows, one id on
    a third and equal rows: no bin holds a cluster twice or a source over twice."""
    rng = np.random.default_rng(3)
    rows = [(i if i % 3 else 7, int(rng.integers(0, 60)), "hot" if i % 3 == 1 else f"s{i % 11}", 5 if i % 3 == 2 else i) for i in range(900)]
    rows += [(7, 4, "t", 1)] * 200 + [(None, 3, None, None)] * 20
    items = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster long")
    got = packing.pack(items, 100, pack_rows=200).collect()
    key = {}
    for d, n, s, c in rows:
        key.setdefault((d, n), set()).add((s, c))
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in got) == collections.Counter((d, n) for d, n, _, _ in rows)
    assert len({r["bin_id"] >> 32 for r in got if r["doc_id"] == 7}) > 2  # the hot id is in several packs
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(key[r["doc_id"], r["n_tokens"]])
    for held in bins.values():
        sure = [next(iter(k)) for k in held if len(k) == 1]  # what the output tells without doubt
        clusters = [c for _, c in sure if c is not None]
        sources = collections.Counter(s for s, _ in sure if s is not None)
        assert len(clusters) == len(set(clusters)) and all(n <= 2 for n in sources.values())
    assert sorted(r["copy"] for r in packing.numbered(items.where("source = 't'"), 30).collect()) == list(range(200))


def test_packing_by_given_clusters(spark):
    P = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(i, f"text number {i}", f"s{i}") for i in range(12)], "doc_id long, text string, source string")
    classes = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, class_id long")
    bins = collections.defaultdict(list)
    for r in packing.pack_documents(docs, P.path("word_bpe_49k.json"), 100, clusters=classes).collect():
        bins[r["bin_id"]].append(r["doc_id"])
    assert sum(map(len, bins.values())) == 12
    assert all(len([d for d in b if d < 10]) == len({d % 2 for d in b if d < 10}) for b in bins.values())


# --- decontamination


def test_decontamination_recall_and_precision(spark):
    rng = np.random.default_rng(3)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(8, 60)))) for i in range(40)] + [(90, ""), (91, None), (92, "lonelyword")]
    docs, want = [], set()
    for d in range(120):
        words = list(rng.choice(vocab, 150))
        k = int(rng.integers(40))
        w = items[k][1].split()
        if d % 3:
            for _ in range(int(0.2 * len(w)) if d % 3 == 2 else 0):
                j = int(rng.integers(len(w)))
                [lambda: w.__setitem__(j, "zzz"), lambda: w.pop(j), lambda: w.insert(j, "zzz")][int(rng.integers(3))]()
            words[70:70] = w
            want.add((d, k))
        docs.append((d, " ".join(words).upper() if d % 2 else ", ".join(words)))
    docs += [(500, None), (501, ""), (502, "so lonelyword it is"), (None, items[0][1])]
    dd = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5))
    ii = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.contaminated(dd, ii).collect()}
    assert (502, 92) in got and (None, 0) in got
    planted = {k for k in got if k[0] is not None and k[0] < 500}
    assert len(planted & want) >= 0.97 * len(want)
    for d, k in planted:  # exact verification: no false one
        text, item = decontam.words_of(docs[d][1]), decontam.words_of(items[k][1])
        ids = {w: i for i, w in enumerate({*text, *item})}
        assert decontam.closest_window(np.array([ids[w] for w in item]), np.array([ids[w] for w in text]))[0] == got[d, k] <= 0.2 * len(item)
    clean = decontam.keep_clean(dd, ii)
    assert clean.columns == dd.columns and {r["doc_id"] for r in clean.collect()} == {r[0] for r in docs if r[0] is not None} - {d for d, _ in got}
    assert decontam.contaminated(empty(dd), ii).count() == 0 and decontam.contaminated(dd, empty(ii)).count() == 0


@pytest.mark.parametrize("n", [15, 40, 59, 100])
def test_decontamination_recall_by_kind_and_place(n):
    """Passages with the most edits of one kind, inside a text, at its end and as
    the whole text; each text alone and among others."""
    rng = np.random.default_rng(n)
    items = [(i, [f"w{x}" for x in rng.integers(2000, size=n)]) for i in range(60)]
    bench, e = decontam.Benchmark([(i, " ".join(w)) for i, w in items]), int(0.2 * n + 1e-9)
    for kind in ("delete", "insert", "replace"):
        for place in ("inside", "end", "alone"):
            texts = []
            for _, w in items:
                w = list(w)
                for j in sorted(rng.choice(n, e, replace=False).tolist(), reverse=True):
                    w[j : j + (kind != "insert")] = [] if kind == "delete" else [f"z{rng.integers(10**9)}"]
                around = [[f"c{x}" for x in rng.integers(500, size=30)] for _ in range(2)]
                texts.append(" ".join({"inside": around[0] + w + around[1], "end": around[0] + w, "alone": w}[place]))
            got = decontam.search(bench, texts)
            assert sum(any(x[0] == i and x[1] <= e for x in g) for i, g in enumerate(got)) >= 0.95 * len(items), (kind, place)
            assert got == [decontam.search(bench, [t])[0] for t in texts]


def test_closest_window_matches_brute_force():
    rng = np.random.default_rng(1)

    def edits(a, b):
        table = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + int(a[i - 1] != b[j - 1]))
        return table[-1][-1]

    for _ in range(60):
        item, text = rng.integers(0, 4, rng.integers(1, 7)), rng.integers(0, 4, rng.integers(0, 12))
        cost, start, end = decontam.closest_window(item, text)
        assert cost == edits(item, text[start:end]) == min(edits(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1))


def test_decontamination_in_blocks(spark, monkeypatch):
    """Several blocks of the benchmark find what one finds."""
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"so {' '.join(f'i{i}w{k}' for k in range(1, 12))} it is") for i in range(5)] + [(9, "clean")], "doc_id long, text string")
    want = sorted(decontam.contaminated(docs, items).collect())
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 50)
    assert len(want) == 5 and sorted(decontam.contaminated(docs, items).collect()) == want
    assert [r["doc_id"] for r in decontam.keep_clean(docs, items).collect()] == [9]


# --- language and toxicity


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(["▁", "a", "b", "ab", "▁a", "ba"])
    prob = np.zeros((len(pieces.pieces) + 1, 1))
    prob[:-1, 0] = np.arange(1, len(pieces.pieces) + 1) / 100
    p = {x: prob[i, 0] for i, x in enumerate(pieces.pieces)}

    def brute(w):
        return 1.0 if not w else sum((p.get(w[:k], 0) + (langid.UNKNOWN if k == 1 else 0)) * brute(w[k:]) for k in range(1, len(w) + 1))

    for w in ("▁ab", "▁aba", "▁bab", "▁q"):
        assert np.exp(langid.forward(pieces, prob, langid.matrix_of([w]))[0, 0]) == pytest.approx(brute(w))


def test_forward_tells_languages_apart_in_long_words():
    """Where no piece covers most of a long word, the rest of it still counts."""
    pieces = langid.Pieces(["ab"])
    prob = np.array([[0.5, 0.001], [0.0, 0.0]])
    word = "q" * 38 + "ab"
    got = langid.forward(pieces, prob, langid.matrix_of([word]))[0]
    assert got[0] - got[1] == pytest.approx(np.log(0.5 / 0.001), rel=1e-6) and got[0] == pytest.approx(38 * np.log(langid.UNKNOWN) + np.log(0.5), rel=1e-6)


def test_training_texts_are_bounded(spark):
    df = spark.createDataFrame([(i, "en", "x" * 10) for i in range(20)] + [(None, "de", "y")], "doc_id long, lang string, text string")
    from panelspine.llm.common import bounded_texts

    assert len(bounded_texts(df, "lang", 10**6)) == 21
    some = bounded_texts(df, "lang", 55)
    assert sum(len(t) for _, t in some) <= 55 and len(some) >= 5


def test_toxicity_matches_a_plain_version():
    """Scores from the table by a loop over words and n-grams, and one training step's direction by finite differences."""
    rows = [(1, "awful mean words"), (0, "kind nice words"), (0, "calm day"), (1, "awful")]
    m = toxicity.fit(rows, table_rows=512, dimensions=3, epochs=3, least_steps=0, batch=2)

    def grams(w):
        w = f"<{w}>"
        out = {w} | {w[i : i + g] for g in toxicity.GRAMS if g < len(w) for i in range(len(w) - g + 1)}
        return [w[i : i + g] for g in {*(g for g in toxicity.GRAMS if g < len(w)), len(w)} for i in range(len(w) - g + 1)] if out else []

    for _, t in rows:
        vectors = []
        for w in t.split():
            for g in grams(w):
                ids, _ = toxicity.subwords([g], 512) if len(g) < min(toxicity.GRAMS) else (None, None)
                h = np.full(1, np.uint64(len(g)))
                for c in g:
                    h = h * toxicity.GOLDEN + np.uint64(ord(c))
                vectors.append(m.table[int(toxicity.mix(h)[0] % np.uint64(512))])
        z = np.mean(vectors, axis=0) @ m.out + m.bias
        assert m.scores([t])[0] == pytest.approx(1 / (1 + np.exp(z[0] - z[1])))
    long = toxicity.fit(rows, table_rows=512, dimensions=3, epochs=200, least_steps=400, batch=2)
    assert [s > 0.5 for s in long.scores([t for _, t in rows])] == [bool(y) for y, _ in rows]


def test_language(spark, odd_docs):
    P = pytest.importorskip("public_tokenizers")
    rng = np.random.default_rng(2)
    en, de = ["the", "thing", "with", "there", "other"], ["und", "nicht", "schön", "durch", "über"]
    data = [(i, " ".join(rng.choice(en if i % 2 else de, 30)), "en" if i % 2 else "de") for i in range(80)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").union(odd_docs.select("doc_id", "text", F.lit(None).cast("string")).where("doc_id in (2, 3, 7)").withColumn("doc_id", F.col("doc_id") + 1000))
    got = {r["doc_id"]: r for r in langid.identify(df, P.path("piece_bpe_32k.model")).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in data)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in data)
    assert [got[i]["lang_pred"] for i in (1002, 1003, 1007)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(empty(df), P.path("piece_bpe_32k.model")).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string")), P.path("piece_bpe_32k.model")).collect()} == {"und"}


def test_toxicity_shares_grams_with_misspellings(spark):
    rng = np.random.default_rng(4)
    vocab = [f"{a}{b}" for a in ("lo", "mi", "ra", "te") for b in ("ran", "vel", "dos", "kip", "sun")]
    rows = [(i % 2, " ".join([*rng.choice(vocab, 20), *(["disgusting", "worthless"] if i % 2 else [])])) for i in range(160)]
    m = toxicity.fit(rows)
    s = m.scores(["loran mivel disgustingg worthles tekip", "loran mivel tekip rados", ""])
    assert s[0] > 0.5 > s[1] and (0 <= s).all() and (s <= 1).all()
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)] + [(1000, None), (1001, ""), (None, "x")], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, (y, _) in enumerate(rows)] + [(2000, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, lab).collect()}
    held = [i for i in range(160) if got[i]["held_out"]]
    assert held and np.mean([got[i]["predicted"] == rows[i][0] for i in held]) > 0.95
    assert toxicity.score_toxicity(empty(df), lab).count() == 0
    assert all(r["score"] == pytest.approx(0.001) for r in toxicity.score_toxicity(df, empty(lab)).collect())


# --- quality


def test_rule_counts():
    texts = ["a b c d e f a b c d e", "x\nx\n\n\ny\n x\nx", "# <tag> 100% *|&$", "", " one two three", "a a a a a a"]
    got = quality.count_rules(texts)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        marked = {j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(k, k + 5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked))
        assert tuple(int(got[c][i]) for c in quality.COUNTS) == want, t


def test_host_verdicts(spark, odd_docs):
    good = " ".join(f"w{i}" for i in range(50))
    data = [(i, good, "fine") for i in range(40)] + [(100 + i, "spam " * 30, "bad") for i in range(30)] + [(200, good, "bad"), (201, good, "tiny"), (202, good, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("n_words", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality.quality_verdicts(df).collect()}
    assert all(got[i]["kept"] for i in (*range(40), 201, 202)) and not got[200]["kept"] and not got[200]["base_failed"]
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    many = quality.keep_good(df, most_hosts=0)  # the way for more failed hosts than fit a set
    assert many.columns == df.columns and sorted(many.collect(), key=str) == sorted(kept.collect(), key=str)
    odd = quality.quality_verdicts(odd_docs).collect()
    assert len(odd) == odd_docs.count() and {r["base_failed"] for r in odd if r["doc_id"] in (2, 3, 5, 7)} == {True}
    assert quality.quality_verdicts(empty(df)).count() == 0 and quality.keep_good(empty(df)).count() == 0


# --- near-duplicates


def test_signatures_are_unbiased():
    rng = np.random.default_rng(5)
    bags = []
    keys = rng.integers(0, 2**63, 60).astype(np.uint64)
    for _ in range(4):
        some = np.sort(rng.choice(keys, 40, replace=False))
        bags.append((some, rng.integers(1, 9, 40)))
    sig = neardup.bag_signatures([*bags, (keys[:0], np.zeros(0, np.int64))], 20_000)
    for i in range(4):
        for j in range(i):
            assert (sig[i] == sig[j]).mean() == pytest.approx(neardup.weighted_jaccard(bags[i], bags[j]), abs=0.02)
    assert np.isinf(sig[4]).all()


def test_signatures_do_not_depend_on_the_batch():
    """A bag signed alone, among few and among 100,000 shingles has the same components."""
    rng = np.random.default_rng(8)
    bags = [(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), rng.integers(1, 4, n)) for n in (1, 10, 20, 46, 235, 1000)]
    rest = [(np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64)), np.ones(2000, np.int64)) for _ in range(50)]
    for m in (neardup.BANDS * neardup.ROWS, neardup.FINE_BANDS * neardup.FINE_ROWS):
        alone = np.concatenate([neardup.bag_signatures([b], m) for b in bags])
        assert (neardup.bag_signatures(bags, m) == alone).all()
        assert (neardup.bag_signatures([*rest, *bags], m)[len(rest) :] == alone).all()


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(25):
        base = [f"t{rng.integers(3000)}" for _ in range(int(rng.integers(40, 120)))]
        for _ in range(int(rng.integers(1, 9))):
            w = list(base)
            for _ in range(int(rng.integers(0, 5))):
                w[int(rng.integers(len(w)))] = f"e{rng.integers(10**6)}"
            texts.append(" ".join(w))
    texts += ["a b", "A  b", "a b c", "", None, " ", LONG, LONG + " end"]
    bags = neardup.shingle_bags([t or "" for t in texts])
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if neardup.weighted_jaccard(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    both = df.union(df)
    assert neardup.near_duplicates(both).count() == 2 * len(texts)
    kept = neardup.keep_one(both)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))
    assert neardup.near_duplicates(empty(df)).count() == 0 and neardup.keep_one(empty(df)).count() == 0


def test_near_duplicates_of_odd_rows(spark, odd_docs):
    got = neardup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert len({r["class_id"] for r in got if r["doc_id"] in (2, 3, 7)}) == 1
    assert neardup.keep_one(odd_docs).columns == odd_docs.columns


# --- pages

PAGE = (
    "<html><head><title>T</title><script>var a='</p>'</script></head><body><header><p>Site name</p></header><nav><a href=x>Menu</a></nav>"
    "<article><h1>Title &amp; more</h1><p>First  para\n graph<br>second line<p>Third<ul><li>one<li>two</ul><div class='ad'>Buy</div></article>"
    "<div class=comments><p>I think so.</p></div><footer>&copy; 2020</footer>"
)


def test_extraction(spark):
    trees = html_extract.train([PAGE] * 5)
    assert html_extract.extract([PAGE], trees) == ["Title & more\nFirst para graph\nsecond line\nThird\none\ntwo"]
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>just <b"), (None, "u", "</div></p>&#9999999999;<a <b>>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract_main(df).collect()
    assert len(got) == 6 and {r["text"] for r in got if r["page_id"] == 1} == {"Title & more\nFirst para graph\nsecond line\nThird\none\ntwo"}
    assert [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract_main(empty(df)).count() == 0


def test_extraction_without_telling_elements():
    """Held-out pages give the same text when article and all sectioning elements are plain divs without attributes."""
    pages = html_extract.examples(220, seed=3)
    trees = html_extract.train(pages[:200])
    want = []
    for page in pages[200:]:
        nodes = html_extract.parse(page)
        y = html_extract.teacher(nodes)
        keep = y.astype(bool)
        for i in np.nonzero(y)[0]:
            up = nodes[i].parent
            while up:
                keep[up.index] = True
                up = up.parent
        want.append(html_extract.text_of(nodes, keep, np.where(y > 0, 1.0, -1.0)))
    hidden = [re.sub(r"<(/?)(?:article|main)\b[^>]*>", r"<\1div>", p) for p in pages[200:]]
    assert np.mean([a == b for a, b in zip(html_extract.extract(pages[200:], trees), want, strict=True)]) >= 0.8
    got = html_extract.extract(hidden, trees)
    words = [(set(a.split()), set(b.split())) for a, b in zip(got, want, strict=True)]
    assert np.mean([len(a & b) / max(1, len(a | b)) for a, b in words]) >= 0.9
    body = [" ".join(["A sentence stands here, and it goes on.", "Another follows, as it must."] * (2 + k % 3)) for k in range(6)]
    page = "<html><body><div><ul><li><a href='/a'>Menu one</a></li><li><a href='/b'>Menu two</a></li></ul></div><div>" + "".join(f"<p>{x}</p>" for x in body) + "</div><div><a href='/c'>terms</a> &copy; us</div></body></html>"
    assert html_extract.extract([page], trees) == ["\n".join(body)]


@pytest.fixture(scope="module")
def page_trees():
    return html_extract.train(html_extract.examples(60, seed=5))


S = "The river ran past the old mill. Nobody had come to see it for years."
SEE = "<p>See <a href=/x>this other page about it</a> and <a href=/y>that one</a>.</p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<p>{S}</p>", S),
        (S, S),
        (f"<article>{S}<br><br>{S}</article>", f"{S}\n{S}"),
        (f"<article><p>{S}</p>{SEE}<p>{S}</p></article>", f"{S}\nSee this other page about it and that one.\n{S}"),
        (f"<body><nav><a href=/>Home</a> <a href=/n>News</a></nav><article><h1>Title</h1><p>{S}</p>{SEE}</article><footer>&copy; us</footer>", f"Title\n{S}\nSee this other page about it and that one."),
        (f"<article><p>{S}</p><figure><img src=a><figcaption>The mill in 1920</figcaption></figure><p>{S}</p></article>", f"{S}\nThe mill in 1920\n{S}"),
        ("<article><header><h1>Title</h1></header><p>Short text.</p><pre>code  here</pre><table><tr><td>x<td>y</table></article>", "Title\nShort text.\ncode here\nx\ny"),
        (f"<body><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>{S}<p>{S}</p><footer>&copy; 2020 us</footer>", f"{S}\n{S}"),
        (f"<article><p>{S}</p><form><label>Mail</label><input><button>Go</button></form></article>", S),
        ("<article><p>A <b>bold</b> and <em>fine</em> <span>thing</span> <code>x</code>.</p></article>", "A bold and fine thing x."),
        ("<body><nav><a href=/a>One</a></nav>", ""),
    ],
)
def test_blocks_are_whole(page_trees, page, text):
    """Hand-written pages: a block keeps its links, bold words and captions, also without an article around it."""
    assert html_extract.extract([page], page_trees) == [text]


def test_extraction_by_construction(page_trees):
    """Held-out pages put together here, with the text known as they are made: 0.95 are exact."""
    rng = np.random.default_rng(17)
    words = "stone water bridge letter winter garden market evening window silver morning harbour kitchen teacher weather".split()

    def sentence():
        return " ".join(rng.choice(words, int(rng.integers(4, 15)))).capitalize() + "."

    def prose():
        return " ".join(sentence() for _ in range(int(rng.integers(1, 5))))

    def block():
        a, b = prose(), " ".join(rng.choice(words, 3))
        return [
            (f"<p>{a}</p>", a),
            (f"<p>{a} <a href='/{b}'>{b}</a> <i>{b}</i></p>", f"{a} {b} {b}"),
            (f"<h2>{b}</h2><p>{a}</p>", f"{b}\n{a}"),
            (f"<ul><li>{a}</li><li>{b}</li></ul>", f"{a}\n{b}"),
            (f"<blockquote>{a}</blockquote>", a),
        ][int(rng.integers(5))]

    got, want = [], []
    for _ in range(200):
        blocks = [block() for _ in range(int(rng.integers(1, 8)))]
        tag = ["article", "main", "div"][int(rng.integers(3))]
        menu = "".join(f"<li><a href='/m'>{w}</a></li>" for w in rng.choice(words, 4))
        page = f"<html><body><nav><ul>{menu}</ul></nav><{tag}>{''.join(h for h, _ in blocks)}</{tag}><div class='ad'>{sentence()}</div><footer><p>&copy; {words[0]}</p></footer></body></html>"
        got.append(html_extract.extract([page], page_trees)[0])
        want.append("\n".join(t for _, t in blocks))
    assert np.mean([a == b for a, b in zip(got, want, strict=True)]) >= 0.95


@pytest.mark.parametrize("piece", ["<a ", '<a "', '<a b="', "<a b='", "</x>", "<div>", "<b><div></b>", "<!--", '<a =">', "<", "<p>x</p>", "<li>", "<script>"])
def test_long_pages_take_linear_time(piece):
    """60,000 repetitions of what could make a scanner or a count of siblings quadratic."""
    import time

    began = time.perf_counter()
    nodes = html_extract.parse("<div>" + piece * 60_000)
    html_extract.features(nodes)
    assert time.perf_counter() - began < 20


def test_trees_match_brute_force():
    """One split on one column is the one of largest gain; scores follow the training rows."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)).astype(np.float32)
    y = (x[:, 1] > 0.3).astype(np.int8)
    trees = html_extract.Trees(rounds=1, depth=1).fit(x, y)
    p = y.mean()
    edges = np.unique(np.quantile(x[:, 1], np.linspace(0, 1, 33)[1:-1]))

    def gain(e):
        left = x[:, 1] <= e
        score = lambda rows: (p - y[rows]).sum() ** 2 / (p * (1 - p) * rows.sum() + 1)
        return score(left) + score(~left)

    assert trees.trees[0][0][0] == 1 and trees.trees[0][1][0] == max(edges, key=gain)
    more = html_extract.Trees().fit(x, y)
    z = more.log_odds(x[:, :2], x[:, 2:])
    assert ((z > 0) == y).mean() > 0.98 and (more.log_odds(x[:, :2], x[:, 2:], rows=7) == z).all()


def test_no_kept_node_under_a_dropped_one():
    nodes = html_extract.parse(PAGE)
    rng = np.random.default_rng(0)
    for _ in range(20):
        keep = html_extract.choose(nodes, rng.normal(0, 2, len(nodes)))
        assert all(keep[x.parent.index] for i, x in enumerate(nodes) if keep[i] and x.parent)


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    item = " ".join(f"b{i}" for i in range(20))
    text = lambda: " ".join(f"q{rng.integers(10**6)}" for _ in range(60))
    one = text()
    data = [(1, one, "s"), (2, one + " tail", "s"), (3, text() + " " + item, "s"), (4, text() + " reach me at a.b@c.example.org", "t"), (5, "short", "s"), (6, None, None), (7, text(), None)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.lit(1)})
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    import tempfile

    d = "file://" + tempfile.mkdtemp()
    df.write.parquet(f"{d}/documents.parquet")
    bench.write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == df.columns, name
        seen.append(sorted(r["doc_id"] for r in docs.collect()))
    assert seen == [[1, 2, 3, 4, 7], [1, 3, 4, 7], [1, 4, 7], [1, 4, 7]]
    assert "a.b@c.example.org" not in docs.where("doc_id = 4").first()["text"]
    assert sorted({r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()}) == [1, 4, 7]
