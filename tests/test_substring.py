"""Substring joins against brute force, and the number of proposals they make."""

import random

import pytest
from pyspark.sql import functions as F

from claimtrail.functions import substring
from claimtrail.plans import fixtures
from tests.conftest import SF_CHECK


def _joined(spark, texts, patterns):
    return [tuple(r) for r in substring.containing(
        spark.createDataFrame(texts, "t long, x string").repartition(3), "t", "x",
        spark.createDataFrame(patterns, "p long, y string").repartition(3), "p", "y").collect()]


@pytest.mark.parametrize("seed,alphabet,longest,text,chars", [
    (1, "ab é\U0001f600", 400, 900, 1 << 20), (2, "abcdefgh\n中é", 300, 3000, 512), (3, "a", 400, 900, 200), (4, "ab", 40, 200, 5000)])
def test_joins_equal_brute_force(spark, monkeypatch, seed, alphabet, longest, text, chars):
    monkeypatch.setattr(substring, "CHARS", chars)
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
    texts = [(i, word(text)) for i in range(50)] + [(None, "ab"), (77, None), (78, ""), (3, "abab")]
    patterns = [(i, word(6)) for i in range(50)] + [(500, None), (501, ""), (502, "ab"), (503, "ab")]
    for i in range(60):
        t = rng.choice(texts[:50])[1]
        a = rng.randrange(len(t)) if t else 0
        patterns.append((1000 + i, t[a:a + rng.randint(1, longest)]))
    got = _joined(spark, texts, patterns)
    assert len(got) == len(set(got))
    assert set(got) == {(p, t) for p, y in patterns if y for t, x in texts if t is not None and x and y in x}


def test_empty_sides(spark):
    assert _joined(spark, [], [(1, "a")]) == [] and _joined(spark, [(1, "a")], []) == [] and _joined(spark, [(1, "a")], [(1, "")]) == []


def _proposals(texts, patterns):
    """Proposals of texts ``(_tid, _t)`` for patterns ``(_p)``."""
    of = F.array_max(F.filter(F.array(*map(F.lit, substring.CLASSES)), lambda c: c <= F.length("_p")))
    p = substring.written(patterns.distinct().select("_p", of.alias("_c"), F.monotonically_increasing_id().alias("_pid")), "patterns")
    return substring.proposed(texts, substring.anchors(texts, p)).count()


def test_proposals_of_measurement_names_grow_with_the_names(spark):
    """Two thousand keys ``P<number>x`` share their first letter and most of their digits."""
    names = fixtures.measurement_results(spark, SF_CHECK).select(F.col("image").alias("_tid"), F.col("image").alias("_t"))
    assert _proposals(names, fixtures.measurement_truth(spark, SF_CHECK).select(F.col("object").alias("_p"))) <= 4 * names.count()


@pytest.mark.parametrize("length", [12, 100, 300])
def test_a_gram_that_all_share_proposes_no_pairs(spark, length):
    """Patterns and texts have one long beginning in common; only their ends differ."""
    rng = random.Random(5)
    head = "".join(rng.choice("abcdefgh") for _ in range(length))
    patterns = [(f"{head}{i:05d}",) for i in range(400)]
    texts = spark.createDataFrame([(i, f"x{i} {head}{i:05d} {head}") for i in range(600)], "_tid long, _t string")
    assert _proposals(texts, spark.createDataFrame(patterns, "_p string")) <= 8 * 600


def test_only_keys_that_occur_leave_a_text(spark):
    """Texts of the patterns' own letters, where every gram meets many patterns."""
    rng = random.Random(7)
    texts = [(i, "".join(rng.choice("Px012") for _ in range(300))) for i in range(200)]
    patterns = {f"P{rng.randrange(3 ** 7):o}x" for _ in range(500)}
    true = sum(p in t for _, t in texts for p in patterns)
    assert true <= _proposals(spark.createDataFrame(texts, "_tid long, _t string"), spark.createDataFrame([(p,) for p in patterns], "_p string")) <= 1.5 * true + 200
