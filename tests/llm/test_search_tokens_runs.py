"""Lexical search, token counts and runs of words against brute force, and what each does with odd rows."""
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldrounds.llm import lexical, queries, runs, tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("key", "row", "term", "docs", "tfs", "sizes", "block", "part", "grp", "kind", "score", "rank", "n_tokens", "n_words", "runs", "digest", "words", "step", "first",
         "stop", "fragments", "island", "opens", "start", "length", "period", "item_row", "df", "times", "own")
LOOP = " ".join(["alpha beta gamma delta"] * 12)
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One two THREE four five six"), (4, "One two THREE four five six"), (None, "one two three four five six"),
       (6, "word " * 30_000), (7, f"Head\x1cÄpfel äPFEL naïve 😀 {LOOP}\ntail <|endoftext|> end"), (8, "x" * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "b", 1) for i, t in ODD]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in CLASH})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Lexical search

def brute_search(docs, items, k=20):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    terms = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(t))
    held = [(d, terms(t)) for d, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    out = []
    for item_id, text in items:
        scored = []
        for d, t in held:
            m = 100 - 25 + (25 * len(t) * n_docs) // n_terms
            s = 0
            for x in terms(text):
                tf, df = t.count(x), sum(x in o for _, o in held)
                if tf:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if s > 0 and d is not None:
                scored.append((-s, d))
        out += [(item_id, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,group,short,window,k", [(lexical.BLOCK, lexical.GROUP, lexical.SHORT, lexical.WINDOW, 20), (25, 3, 6, 4, 3), (9, 2, 0, 2, 5)])
def test_search_is_that_of_a_plain_loop(spark, block, group, short, window, k):
    rng = random.Random(block)
    common, rare = ["the", "of", "it"], [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n))
    docs = [(i, text(rng.randrange(12))) for i in range(120)] + [(5, "the w1"), (500, "the w1"), (None, "w1 w2 w3")]
    items = [(i, text(rng.randrange(8))) for i in range(7)] + [(3, "the w1"), (None, "w2"), (9, None), (10, "nowhere")]
    inverted = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "doc_id"), block)
    got = lexical.search(inverted, spark.createDataFrame(items, "item_id long, text string"), k, group, short, window)
    assert rows(got) == brute_search(docs, items, k)


def test_windows_are_passed_over():
    ids = np.arange(10_000)
    tfs = np.where(ids < 40, 50, 1)
    p = lexical.Postings(ids, tfs, -(-len(ids) // 100), 100)
    best = lexical.Best(20)
    assert lexical.pass_block([(3, p)], ids, np.ones(len(ids), bool), best, short=10, window=100) == 99
    assert best.ids.tolist() == list(range(20)) and set(best.scores.tolist()) == {150}


def test_search_of_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "ÄPFEL word"), (1, "ÄPFEL word"), (2, ""), (3, None), (4, "SIX")], "item_id long, text string").withColumns(
        {c: F.lit("x") for c in CLASH})
    got = rows(lexical.search(lexical.index(odd), items))
    assert got == brute_search(ODD, [(1, "ÄPFEL word"), (1, "ÄPFEL word"), (2, ""), (3, None), (4, "SIX")])
    assert [r[2] for r in got if r[0] == 4] == [4, 4]
    assert rows(lexical.search(lexical.index(odd.limit(0)), items)) == []
    assert rows(lexical.search(lexical.index(odd), items.limit(0))) == []


# Token counts

def library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(VOCABULARY).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_tokens_are_those_of_the_library():
    rng = random.Random(1)
    pool = "abcdefgh  \n\t'sstdlé中\U0001F600́\x1c\x1f\x85 ​　  123١½.,!"
    texts = ["", "a" * 700, "aaaaab" * 9, "<|endoftext|>" * 3 + " a<|endoftext|> b", " " * 77 + "x", "the quick  brown\n\n fox's " * 400]
    for _ in range(1500):
        odd = lambda: chr(rng.choice([rng.randrange(1, 0x3000), rng.randrange(0x3000, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)]))
        texts.append("".join(rng.choice(pool) if rng.random() < 0.97 else odd() for _ in range(rng.randrange(1, 80))))
    for kept in (tokens.KEPT, 7):                # a small memory of pre-tokens changes nothing
        assert tokens.Counter(tokens.Merges.load(VOCABULARY), kept).tokens(texts) == library(texts)


def test_long_texts_are_cut_where_no_pre_token_reaches_over():
    text = "It's  a long \n text, with 12 words.\t" * 300
    parts = list(tokens.pieces(text, 100))
    assert "".join(parts) == text and len(parts) > 50
    assert sum(len(tokens.PRE_TOKENS.findall(p)) for p in parts) == len(tokens.PRE_TOKENS.findall(text))
    assert list(tokens.pieces("x" * 500, 100)) == ["x" * 500]


def test_tokens_of_odd_rows(spark, odd):
    got = tokens.token_counts(odd, VOCABULARY, limit=5)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n, n > 5) for (i, t), n in zip(ODD, library([t for _, t in ODD]))]
    assert rows(got) == sorted(want, key=repr)
    assert got.limit(0).count() == 0 and tokens.token_counts(odd.limit(0), VOCABULARY).count() == 0


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        tokens.Merges.load(public_tokenizers.path("word_bpe_49k.json"))


# Runs

def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, q, m) for (a, m), q in found.items())


def looped(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(300))]
    for _ in range(rng.randrange(4)):
        if len(words) > 30:
            q, a = rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 40]), rng.randrange(len(words))
            for i in range(a + q, min(len(words), a + q * rng.choice([2, 3, 4, 9]))):
                words[i] = words[i - q]
    return [f"w{x}" for x in words]


@pytest.mark.parametrize("strip", [runs.STRIP, 64])
def test_runs_are_those_of_a_plain_loop(spark, strip):
    rng = random.Random(strip)
    texts = [looped(rng) for _ in range(60)]
    got = runs.find(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), strip).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(60))
    for r in got:
        words = texts[r["doc_id"]]
        want = brute_runs(words)
        assert [(x["start"], x["period"], x["length"]) for x in r["runs"]] == want and r["n_words"] == len(words)
        gone = {i for a, q, m in want for i in range(a + q, a + m)}
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert r["digest"] == hashlib.sha256(left.encode()).hexdigest() and r["text"] == (left if want else None)


def test_z_function():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 30))]
        assert runs.z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def test_strips_cover_every_place_once():
    for n in (0, 23, 24, 1000, 5000):
        want = {(s, b) for s in runs.steps_for(n) for b in range(0, n, s)}
        got = [(s, b) for first, stop, margin, steps in runs.strips(n, 64) for s in steps for b in range(-(-first // s) * s, stop, s)]
        assert len(got) == len(set(got)) and set(got) == want


def test_runs_of_odd_rows(spark, odd):
    got = {repr((r["doc_id"], r["n_words"])): r for r in runs.find(odd, 4096).collect()}
    assert runs.find(odd).count() == len(ODD) and len(got) == len(ODD) - 1
    long, mixed = got[repr((6, 30_000))], got[repr((7, 55))]
    assert [tuple(x) for x in long["runs"]] == [(0, 30_000, 1)] and long["text"] == "word"
    assert [tuple(x) for x in mixed["runs"]] == [(4, 48, 4)] and mixed["text"].endswith("😀 alpha beta gamma delta tail <|endoftext|> end")
    empty = hashlib.sha256(b"").hexdigest()
    assert all(got[repr((i, 0))]["digest"] == empty for i in (1, 2, 3))
    assert runs.find(odd.limit(0)).count() == 0


def test_strongest_run(spark):
    some = spark.createDataFrame([([(5, 30, 10), (40, 30, 10), (90, 28, 7)],), ([(5, 30, 10), (2, 60, 20)],), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    assert [tuple(r[0]) if r[0] else None for r in some.select(runs.strongest(F.col("runs"))).collect()] == [(90, 28, 7), (5, 30, 10), None]


def test_loops_follow_the_rule(spark):
    import zlib
    docs = [(i, " ".join(f"{i}.{j}" for j in range(i % 37))) for i in range(400)] + [(None, "a b c")]
    for r in queries.with_loops(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        words = dict(docs)[r["doc_id"]].split()
        h = zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert r["text"].split() == words
