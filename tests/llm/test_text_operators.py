"""Secret scan, BPE, MinHash and toxicity against brute force."""

import base64
import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from claimtrail.llm import bpe, oph, queries, secrets, toxicity
from tests.llm import data

RANKS = bpe.read_ranks(queries.VOCABULARY)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_encoding_equals_the_library(tik):
    rng = random.Random(1)
    parts = ["a", "b", " ", "\n", "é", "ß", "the", "ing", "tion", "1", "23", "!", "   ", "中", "\U0001f600", "'s", "\x1c",
             "\x85", "\xa0", " ", "ſ", "\t", "=", "aaaa", "<|endoftext|>"]
    for leaf in (1, 2, 5, 64):
        b = bpe.Bpe(RANKS, queries.PATTERN, leaf_bytes=leaf, leaf_chars=16)
        for _ in range(1500):
            s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
            assert b.encode(s) == tik.encode_ordinary(s), repr(s)
            assert b.decode(b.encode(s)) == s.encode()


def test_very_long_pieces(tik):
    b = bpe.Bpe(RANKS, queries.PATTERN)
    rng = random.Random(2)
    for s in ("a" * 5000, "ab" * 4000, " " * 3000 + "x", "é" * 2000, "".join(rng.choice("abcdefgh") for _ in range(9000))):
        assert b.encode(s) == tik.encode_ordinary(s)


def test_bpe_round_trip_of_a_table(spark, tik):
    got = queries.encoded(data.frame(spark)).collect()
    want = Counter()
    for i, t, *_ in data.rows():
        ids = tik.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want
    assert queries.encoded(data.empty(spark)).collect() == []


def _base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    parts = ["password", "PassWd", "token", "api_key", "apikey", "ſecret", "secret", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef" * 2,
             '"', "'", " ", ":", "=", "é", "xyz.12345", "\n", "a", "F", "deadbeef"]
    for _ in range(4000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        got = [x[:3] for x in secrets.scan_text(s, lambda t: len(t)) if x[1] < 3]
        assert got == _base(s), repr(s)


def test_token_efficiency_finds_random_strings_only(spark):
    secret = "x9Kq2LmZ7pTv4Wc8RbYd3Fh"
    cases = {
        1: f"value {secret} end", 2: "9765fab7324201a5ddfac0becd9064abbef40be8", 3: "123e4567-e89b-12d3-a456-426614174000",
        4: "4111111111111111222233334444", 5: "some_long_function_name_of_a_module", 6: f"see https://example.com/{secret}",
        7: "Donaudampfschifffahrtsgesellschaftskapitaen", 8: None, 9: ""}
    df = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    got = {r.doc_id: [(s["kind"], cases[r.doc_id][s["start"]:s["end"]]) for s in r.spans]
           for r in secrets.scan(df, queries.VOCABULARY, queries.PATTERN).collect()}
    assert got.pop(1) == [("random", secret)]
    assert got.pop(6) == [("random", secret)]           # a random segment of an address's path
    assert got.pop(2) == [("hex", cases[2])] and got.pop(4) == [("hex", cases[4])]      # base patterns stay
    assert all(x == [] for x in got.values()), got


def test_token_efficiency_behind_addresses_and_on_letters():
    b = bpe.Bpe(RANKS, queries.PATTERN)
    found = lambda t: [t[x[0]:x[2]] for x in secrets.scan_text(t, lambda s: len(b.encode(s))) if x[1] == 3]
    secret, letters = "x9Kq2LmZ7pTv4Wc8RbYd3Fh", "xKqJLmZwpTvQWcRbYdFhGzNs"
    for t in ("postgres://app:{}@db/main", '{{"url":"https://a.b/c","note":"{}"}}', "a@b.c,{}", "https://a.b/c?{}", "www.a.b;{}",
              "https://a.b:80/c#{}", "a@{}", "https://" + "a" * 300 + "/," + "{}"):
        assert found(t.format(secret)) == [secret] and found(t.format(letters)) == [letters], t
    assert found(letters) == [letters] and found("sk-" + letters) == ["sk-" + letters]
    for t in (f"https://a.b/words/{secret}/and/more", f"www.a.b/{secret}", "https://a.b/" + "c" * 300 + "/" + secret):
        assert secret in found(t), t
    for t in (f"a@{secret}.org", f"https://{secret}.org:80/a", "https://app:pw@" + secret, "https://a.b/some-long-title-of-an-article-in-words/2024/12",
              "https://a.b/getElementsByTagNameFromDocument/index", "getElementsByTagNameFromDocument", "SomeVeryLongClassName_with_words", "www.example.org/some/long/path/of/words2"):
        assert found(t) == [], t
    assert found("www.," * 100_000 + "://,@" * 100_000 + " " + secret) == [secret]      # linear time


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcXYZ0123456789defghUVW",
                                      "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"])
def test_random_strings_of_every_alphabet_are_found(alphabet):
    """At least 95 % of planted strings of 20 to 64 characters."""
    b, rng, hit = bpe.Bpe(RANKS, queries.PATTERN), random.Random(8), 0
    for i in range(400):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(20, 64)))
        text = rng.choice(["key {} end", "https://a.org/x/{}?y", "({})", "{}"]).format(s)
        hit += any(text[a:e] in s and e - a >= 0.6 * len(s) for a, _, e, _ in secrets.scan_text(text, lambda x: len(b.encode(x))))
    assert hit >= 0.95 * 400, hit


def test_words_are_no_secrets():
    """False positives over long words and compounds of the given documents: none."""
    import pyarrow.parquet as pq
    b = bpe.Bpe(RANKS, queries.PATTERN)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    found = [t[a:e] for t in texts if t for a, k, e, _ in secrets.scan_text(t, lambda x: len(b.encode(x))) if k == 3]
    assert [s for s in found if s.isalpha()] == []


def test_many_hits_take_linear_time():
    import time
    part = "k = x9Kq2LmZ7pTv4Wc8RbYd3Fh password=abcdefgh1234 0123456789abcdef0123456789abcdef "
    spent = []
    for n in (1000, 8000):
        t = time.perf_counter()
        assert len(secrets.scan_text(part * n, lambda s: 20)) == 3 * n
        spent.append(time.perf_counter() - t)
    assert spent[1] < 8 * 4 * spent[0]


def test_secret_scan_of_a_table(spark):
    got = secrets.scan(data.frame(spark), queries.VOCABULARY, queries.PATTERN).collect()
    want = Counter((i, tuple(_base(t or ""))) for i, t, *_ in data.rows())
    assert Counter((r.doc_id, tuple((s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in r.spans)) for r in got) == want
    assert secrets.scan(data.empty(spark), queries.VOCABULARY, queries.PATTERN).collect() == []


def _jaccard(a, b, k=5):
    def shingles(t):
        w = data.words(t)
        n = min(k, len(w))
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_against_exact_likeness(spark):
    df = data.frame(spark, n=150)
    rows = sorted(((data.key(i), t or "") for i, t, *_ in data.rows(n=150)))
    got = sorted((data.key(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next)
                 for r in oph.compare_edited(df).collect())
    want, errors = [], []
    for n, (i, t) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        k = len(t) // 4
        new = t[:len(t) - k] + following[:k]
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), _jaccard(t, new), _jaccard(t, following)))
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert Counter(x[:3] for x in got) == Counter(x[:3] for x in want)
    by = {x[:3]: x[3:] for x in want}
    errors = [a - b for x in got for a, b in zip(x[3:], by[x[:3]])]
    assert max(map(abs, errors)) < 0.15 and abs(sum(errors) / len(errors)) < 0.02
    assert oph.compare_edited(data.empty(spark)).collect() == []


def test_one_row_is_its_own_successor(spark):
    r = oph.compare_edited(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0


def test_equal_texts_have_equal_fingerprints(spark):
    found = {}
    for r, (i, t, *_) in zip(oph.fingerprints(spark.createDataFrame(data.rows(), data.SCHEMA).coalesce(1)).collect(), data.rows()):
        assert found.setdefault(t or "", r.fingerprint) == r.fingerprint


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _step(row, i, x, b)
    return row[-1]


def _step(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return new


def test_automaton_equals_edit_distance():
    rng = random.Random(4)
    terms = {"idiot": False, "stupid": False, "worthless": False, "scum": False, "lowei": True, "disgusting": True}
    match = toxicity.Matcher(terms)
    letters = "idotsupwrhlecmnga"
    for _ in range(6000):
        t = rng.choice(list(terms))
        w = list(t + (rng.choice(["", "x", "ab"]) if terms[t] else ""))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k:k + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
        w = "".join(w)
        best = []
        for term, stem in terms.items():
            d = min((_levenshtein(term, w[:k]) for k in range(len(w))), default=99) if stem else _levenshtein(term, w)
            if d <= toxicity.edits_for(term):
                best.append((d, -len(term), term))
        want = (min(best)[2], min(best)[0]) if best else None
        assert match(w) == want, (w, match(w), want)


def test_toxicity_learns_and_spares_clean_and_quoted(spark):
    rng = random.Random(5)
    plain = [f"w{i}ord" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        w = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["loser", "worthless", "lowei" + rng.choice(["ab", "cd", "ef", "gh"])]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.learn(toxicity.sample(df, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert {"loser", "worthless"} <= set(lexicon.terms) and any(t.startswith("low") and s for t, s in lexicon.terms.items())
    ask = {1: "you are a loser and worthless", 2: "plain words here", 3: None, 4: "", 5: "w0rthless loser", 6: "loweizz loweiab loser",
           7: 'he said "loser" is an insult'}
    got = {r.doc_id: r.score for r in toxicity.score(
        spark.createDataFrame(list(ask.items()), "doc_id long, text string").withColumn("score", F.lit("clash")), lexicon).collect()}
    assert min(got[1], got[5], got[6]) >= toxicity.THRESHOLD > max(got[2], got[3], got[4]) and got[7] < got[1]
    nothing = toxicity.learn(toxicity.sample(data.empty(spark), spark.createDataFrame([], "doc_id long, toxic int")))
    assert nothing.terms == {} and toxicity.score(data.empty(spark), nothing).collect() == []
