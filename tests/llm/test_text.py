"""The text operators against plain loops, and on odd input."""

from __future__ import annotations

import random
import re
import unicodedata as ud

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import leakage, lookalike, tokenize

FORM = lookalike.Canonicaliser()


# -- look-alike texts
@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("ﬁx ﬀ", "fix ff", True),
        ("ﬀi", "ﬃ", True),
        ("é", "é", True),
        ("е́ ё", "é ë", True),
        ("Ｈｅｌｌｏ　ｘ", "Hello x", True),
        ("a​b﻿­", "ab", True),
        ("e‍́", "é", True),
        ("x y z", "x y z", True),
        ("КKΚ", "KKK", True),
        ("раss", "pass", True),
        ("a‐b–c", "a-b-c", True),
        ("が", "が", True),
        ("A", "a", False),
        ("é", "e", False),
        ("a  b", "a b", False),
        ("a\r\nb", "a\nb", False),
        ("a\tb", "a b", False),
        ("½", "1/2", False),
        ("x²", "x2", False),
        ("0", "O", False),
        ("1", "l", False),
        ("Σ", "C", False),
        ("ς", "c", False),
        ("ſ", "s", False),
        ("ϱ", "p", False),
        ("″", '"', True),
        ('"', "''", False),
        ("æ", "ae", False),
        ("ø", "o", False),
        ("—", "-", False),
        ("―", "—", True),
        ("ı", "i", True),
        ("´", "'", True),
        ("ᎪꓐС", "ABC", True),
        ("հց", "hg", True),
        ("〇一", "〇⼀", True),
    ],
)
def test_equal_looks(a: str, b: str, same: bool) -> None:
    assert (FORM.form(a) == FORM.form(b)) is same


def test_no_class_holds_real_differences() -> None:
    _, members = lookalike.classes()
    for sk, ms in members.items():
        one = {c for c in (*ms, sk) if len(c) == 1}
        assert sum(c.isascii() for c in one) <= 1, one
        if any(c.isascii() for c in one):
            # neither two cases of a letter, nor numbers of different value, nor a letter that is a digit
            assert not [c for c in one if c.lower() != c and c.lower() in one], one
            assert len({ud.digit(c, None) for c in one}) == 1, one
    plain = "Σίσυφος ἀνέβη λόγος · Съешь ещё этих мягких булок · שלום · سلام ١٢٣ · 日本語カタカナ"
    assert FORM.form(plain).isprintable() and len(FORM.form(plain)) == len(ud.normalize("NFC", plain)) and "C" not in FORM.form("ΣΣ")


def test_the_public_table_is_read_whole() -> None:
    t = lookalike.confusables()
    assert len(t) > 6000 and t["а"] == "a" and t["m"] == "rn" and t["\U0001d41a"] == "a"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aаαeеéëё́̈​  ﬁﬀfiｆ\n-–KКöôó"), st.characters(codec="utf-8")), max_size=30))
def test_forms_are_fixed_points_and_don_t_depend_on_composition(s: str) -> None:
    f = FORM.form(s)
    assert FORM.form(f) == f and FORM.form(ud.normalize("NFC", s)) == f and FORM.form(ud.normalize("NFD", s)) == f


def test_representatives_follow_frequency() -> None:
    c = lookalike.Canonicaliser(lookalike.rules({"а": 5, "a": 2, "é": 1, "е́": 9}))
    assert c.form("aа") == "аа" and c.form("é") == c.form("е́") == c.form("é") == "е́"
    assert c.form("plain") == "plаin"


def test_pairs_against_a_loop(spark) -> None:  # noqa: ANN001
    r = random.Random(1)
    base = ["pass the word", "naïve é", "ﬁne", "Automatic backup", "x", ""]
    swap = {"a": "а", "e": "е", "s": "ѕ", " ": " ", "é": "é", "ﬁ": "fi", "x": "х"}
    rows = [(i, "".join(swap[ch] if ch in swap and r.random() < 0.2 else ch for ch in r.choice(base))) for i in range(150)]
    rows += [(1000 + i, "Automatic backup") for i in range(100)] + [(2000, None), (None, "x"), (2001, "X"), (2002, "pass  the word"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c1", F.lit("clash"))
    kept = sorted({(i, t) for i, t in rows if i is not None and t})
    want = {(min(a, b), max(a, b)) for a, s in kept for b, t in kept if a != b and s != t and FORM.form(s) == FORM.form(t)}
    got = [tuple(x) for x in lookalike.lookalike_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0
    rows_of = lookalike.lookalike_classes(df).collect()
    c = {x.class_id: x.n_variants for x in rows_of}
    every = [(i, t) for i, t in rows if t]
    links = sorted(sum(FORM.form(u) == FORM.form(t) and u != t for _, u in every) for _, t in every)
    assert sorted(x.n_links for x in rows_of) == links
    assert max(c.values()) == max(len({t for _, t in rows if t and FORM.form(t) == f}) for f in {FORM.form(t) for _, t in rows if t})


# -- tokens
def plain():  # noqa: ANN201
    import tiktoken

    return tiktoken.Encoding("t", pat_str=tokenize.PATTERN, mergeable_ranks=tokenize.read_vocabulary(), special_tokens={}).encode_ordinary


def test_ids_equal_those_of_whole_texts(spark) -> None:  # noqa: ANN001
    r = random.Random(2)
    parts = ["é", "a", "b ", "中", "\n", "  ", " x", "-", "'s", " ", "1", "東京", "　", "<|endoftext|>", "\r\n", "\x1c"]
    rows = [(i, "".join(r.choice(parts[: r.choice([2, 5, 16])]) for _ in range(r.choice([0, 3, 400, 20000])))) for i in range(50)]
    rows += [(60, "a" * 50_000), (61, "中" * 9000 + " x"), (62, None), (None, "a b"), (None, None), rows[3], rows[3], (63, " " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("k1", F.lit(2))
    enc = plain()
    order = lambda v: (v[0] if v[0] is not None else -1, len(v[1]), v[1])
    got = sorted(((x.doc_id, list(x.ids)) for x in tokenize.encode_corpus(df).collect()), key=order)
    assert got == sorted(((i, enc(t or "")) for i, t in rows), key=order)
    assert tokenize.encode_corpus(df.limit(0)).count() == 0


def test_chunks_follow_content_and_are_shared() -> None:
    import pyarrow as pa

    r = random.Random(4)
    body = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(r.randrange(1000)) for _ in range(3000))
    cut = lambda t: (lambda d, b, e, *_: [bytes(d[x:y]) for x, y in zip(b, e, strict=True)])(*tokenize.chunk_batch(pa.array([t])))
    a, b = cut(body), cut("something else in front of it. " + body)
    assert b"".join(a).decode() == body and len(set(a) & set(b)) >= len(a) - 2 and 50 < len(a) < 400


def test_repair_agrees_at_any_cut() -> None:
    r, enc = random.Random(5), tokenize.Encoder(tokenize.read_vocabulary(), tokenize.PATTERN)
    for _ in range(300):
        t = "".join(r.choice(["a", " ", "b1", "'ll", "é", "\n", "  ", "xyz", ".", "中"]) for _ in range(r.randrange(2, 60)))
        cuts = sorted({0, *(r.randrange(len(t)) for _ in range(3)), len(t)})
        pieces = [t[x:y].encode() for x, y in zip(cuts, cuts[1:], strict=False)]
        parts = [(p, enc.ids(p.decode()).tobytes(), i == 0) for i, p in enumerate(pieces)]
        assert np.frombuffer(enc.joined(parts), enc.dtype).tolist() == enc.plain(t)


def test_long_texts_without_blanks_take_linear_work() -> None:
    import time

    import pyarrow as pa

    enc, r = tokenize.Encoder(tokenize.read_vocabulary(), tokenize.PATTERN), random.Random(6)

    def join(t: str) -> list[int]:
        d, b, e, _, safe = tokenize.chunk_batch(pa.array([t]))
        return np.frombuffer(enc.joined([(bytes(d[x:y]), enc.encode(bytes(d[x:y])), bool(s)) for x, y, s in zip(b, e, safe, strict=True)]), enc.dtype).tolist()

    for alphabet in ("abcdefghij0123456789_-/=+", "".join(map(chr, range(0x4E00, 0x9F00, 7))), "aбв"):
        t = "".join(r.choice(alphabet) for _ in range(100_000))
        assert join(t) == enc.plain(t)
        begin = time.process_time()
        join(t * 3)
        assert time.process_time() - begin < 20
    for unit, most in (("Съешь ещё этих мягких ", 0), ("日本語の文、です。", 0)):
        d, b, e, _, safe = tokenize.chunk_batch(pa.array([unit * 5000 if most else "".join(unit + str(r.randrange(10**6)) + "漢。" for _ in range(3000))]))
        assert safe.all() and 20 < len(b)


def test_a_chunk_of_very_many_texts_is_spread(spark) -> None:  # noqa: ANN001
    enc = plain()
    t = "the same message again and again, with some words and 12 numbers"
    df = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.lit(t)).otherwise(F.concat(F.lit("doc "), F.col("id"))).alias("text"))
    got = {x.doc_id: list(x.ids) for x in tokenize.encode_corpus(df).collect()}
    assert len(got) == 20_000 and all(got[i] == enc(t if i % 3 < 2 else f"doc {i}") for i in range(0, 20_000, 37))


# -- leaks
def words(t):  # noqa: ANN001, ANN201
    return [w for w in re.split(r"[\W_]+", FORM.form(FORM.form(t).lower())) if w] if t else []


def test_leaks_against_a_loop(spark) -> None:  # noqa: ANN001
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ærø", "naïve", "it"]
    sentence = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(sentence(r.choice([5, 12, 13, 30])))) for i in range(20)]
    shared = sentence(13)
    items += [(100, " ".join(shared + sentence(6))), (101, " ".join(sentence(4) + shared)), (102, None), (103, ""), items[2]]
    docs = []
    for i in range(120):
        t = sentence(r.randrange(0, 60))
        if r.random() < 0.5:
            src = r.choice([x for _, x in items if x]).split()
            n = r.choice([12, 13, 14, 40])
            at = r.randrange(max(1, len(src) - n + 1))
            k = r.randrange(len(t) + 1)
            t[k:k] = src[at : at + n]
        text = "".join(w + r.choice([" ", "\n", " -- ", "_", ", "]) for w in t)
        docs.append((i, text.upper() if r.random() < 0.2 else text.replace("w", "ｗ").replace("i", "і​") if r.random() < 0.3 else text))
    docs += [(500, " ".join(shared)), (501, "x " * 30_000 + " ".join(shared) + " y" * 30_000), (502, None), (503, ""), docs[1], (None, "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(9)).withColumn("plain", F.lit(""))
    e = spark.createDataFrame(items, "item_id long, text string")
    index: dict = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 12):
            index.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = {(i, x) for i, t in docs for w in [words(t)] for k in range(len(w) - 12) for x in index.get(tuple(w[k : k + 13]), ())}
    got = [tuple(x) for x in leakage.leaked_items(d, e).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {(501, 100), (501, 101)} <= want
    assert leakage.leaked_items(d.limit(0), e).count() == 0 and leakage.leaked_items(d, e.limit(0)).count() == 0
    block, leakage.BLOCK_WORDS = leakage.BLOCK_WORDS, 60  # several blocks give the same
    try:
        assert {tuple(x) for x in leakage.leaked_items(d, e).collect()} == want
    finally:
        leakage.BLOCK_WORDS = block


def test_edited_copies_are_scored(spark) -> None:  # noqa: ANN001
    text = "the quiet anchor seals every ledger that a lofty compass turns near the wharf while nobody at all is watching it closely today"
    edited = text.replace("lofty", "broken").replace("nobody at all", "someone")
    e = spark.createDataFrame([(1, text)], "item_id long, text string")
    d = spark.createDataFrame([(1, "zz " * 9 + text), (2, edited), (3, "nothing of the kind")], "doc_id long, text string")
    got = {x.doc_id: x for x in leakage.leaks(d, e).collect()}
    assert set(got) == {1, 2} and got[1].identity == 1.0 and 0.7 < got[2].identity < 1.0 and got[2].run < 13


def test_edited_copies_are_found_however_many_copies_there_are(spark) -> None:  # noqa: ANN001
    text = "the quiet anchor seals every ledger that a lofty compass turns near the wharf while nobody at all is watching it closely today"
    edited = "zz quiet anchor seals every ledger zz a zz compass turns near the wharf zz nobody zz all is watching it closely zz"
    e = spark.createDataFrame([(1, text)], "item_id long, text string")
    # each window's rarest n-gram is none of those the edited copy holds
    copies = spark.range(1100).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.range(2000, 3000).select(F.col("id").alias("doc_id"), F.lit(edited).alias("text")))
    assert {x.doc_id for x in leakage.leaks(copies.filter("doc_id in (0, 2000)"), e).collect()} == {0, 2000}
    got = leakage.leaks(copies, e).groupBy("run").count().collect()
    assert {x.run: x["count"] for x in got} == {len(text.split()): 1100, 5: 1000}
    assert leakage.leaked_items(copies, e).count() == 1100


def local(a: list[str], b: list[str]) -> int:
    """The textbook's Smith-Waterman score."""
    prev, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, prev[j - 1] + (2 if x == y else -1), prev[j] - 1, row[-1] - 1))
        best, prev = max(best, *row), row
    return best


def test_alignments_against_a_loop_over_all_pairs(spark) -> None:  # noqa: ANN001
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(80)]
    items = {i: [r.choice(vocabulary) for _ in range(r.choice([13, 25, 60]))] for i in range(12)}
    docs = {}
    for i in range(60):
        t = [r.choice(vocabulary) for _ in range(r.randrange(80))]
        for _ in range(r.randrange(3)):
            src = r.choice(list(items.values()))
            at = r.randrange(len(t) + 1)
            t[at:at] = [r.choice(vocabulary) if r.random() < 0.15 else w for w in src if r.random() > 0.05]
        docs[i] = t
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    want = {(i, j): s for i, d in docs.items() for j, t in items.items() if grams(d) & grams(t) and (s := local(t, d)) >= leakage.LEAST}
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string")
    e = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.score for x in leakage.leaks(d, e).collect()}
    assert got == want and len(want) > 20


RECALL = {0.05: 0.99, 0.1: 0.98, 0.15: 0.95}


@pytest.mark.parametrize("rate", RECALL)
def test_recall_of_copies_edited_at_a_known_rate(spark, sf: str, rate: float) -> None:  # noqa: ANN001
    """Each word of an item is replaced, left out or followed by another at ``rate``; 240 items in long documents."""
    r = random.Random(int(rate * 100))
    items = [x for x in spark.read.parquet(f"{sf}/eval_items.parquet").select("item_id", "text").collect() if x.text]
    filler = sorted({w for x in items for w in words(x.text)})
    docs = []
    for x in items:
        w, out = words(x.text), []
        for token in w:
            u = r.random() / rate
            out += [r.choice(filler)] if u < 1 / 3 else [] if u < 2 / 3 else [token, r.choice(filler)] if u < 1 else [token]
        pad = [r.choice(filler) for _ in range(300)]
        docs.append((x.item_id, " ".join(pad[:150] + out + pad[150:])))
    found = {(a.doc_id, a.item_id) for a in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x.item_id, x.text) for x in items], "item_id long, text string")).collect()}
    long = [x.item_id for x in items if len(words(x.text)) >= 13]
    recall = sum((i, i) in found for i in long) / len(long)
    print(f"recall at {rate}: {recall:.3f} of {len(long)}, {len(found)} reported")
    assert recall >= RECALL[rate]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_alignment_against_the_textbook(a: list[int], b: list[int]) -> None:
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    run = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            run[i][j] = run[i - 1][j - 1] + 1 if x == y else 0
    more = [(np.array(x, np.int32), np.array(y, np.int32)) for x, y in ((a, b), ([1, 2, 3], [1, 2, 3, 1]), ([], [1]), ([1], []))]
    score, longest = leakage.align(more)
    assert score.tolist() == [max(map(max, h)), 6, 0, 0] and longest.tolist() == [max(map(max, run)), 3, 0, 0]
