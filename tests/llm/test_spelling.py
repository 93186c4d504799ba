import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from panelloom.llm import spelling
from panelloom.llm.spelling import letter_bits, near_words, prefix_and_pivots, variants, vocabulary


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def slow_vocabulary(docs, drop=97):
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def slow_variants(words, distance=1, ratio=2):
    near = {w: [v for v in words if v != w and edits(v, w) <= distance] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    rows = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, words[w], len(near[w]), form[w] and words[form[w]]))
    return sorted(rows, key=str)


def frame(spark, words):
    return spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, near string")


def random_words(seed, alphabet, lengths, size):
    rng = random.Random(seed)
    found = {"".join(rng.choices(alphabet, k=rng.choice(lengths))) for _ in range(size)}
    for w in sorted(found)[: size // 2]:  # neighbours one edit away
        i = rng.randrange(len(w))
        found |= {w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1 :]}
    return {w: rng.choice([3, 3, 4, 7, 15, 40, 90]) for w in sorted(found) if len(w) >= min(lengths)}


@pytest.mark.parametrize("distance, alphabet, lengths", [(1, "ab", (5, 6, 7)), (1, "abcdeé", (5, 6, 9)), (2, "abc", (6, 7, 8))])
def test_variants_against_brute_force(spark, distance, alphabet, lengths):
    words = random_words(distance, alphabet, lengths, 150)
    found = variants(frame(spark, words), distance).collect()
    assert sorted(map(tuple, found), key=str) == slow_variants(words, distance)
    assert any(r.root != r.form for r in found if r.form)


def test_pivots_do_not_overlap_and_cost_least():
    rng = random.Random(0)
    for _ in range(300):
        word = "".join(rng.choices("abc", k=rng.randint(6, 9)))
        counts = np.array([rng.randint(0, 9) for _ in range(spelling.CELLS)])
        prefix, pivots = prefix_and_pivots(word, counts, 2)
        assert prefix == sorted(prefix) and all(word[i : i + 2] == g for _, g, i in prefix)
        places = [p[2] for p in pivots]
        assert len(pivots) == 3 and all(b - a >= 2 for a, b in zip(places, places[1:], strict=False))
        others = [
            (x[0] + y[0] + z[0])
            for x in prefix[:5] for y in prefix[:5] for z in prefix[:5]
            if y[2] - x[2] >= 2 and z[2] - y[2] >= 2
        ]
        assert sum(p[0] for p in pivots) == min(others)


def test_vocabulary(spark):
    rng = random.Random(1)
    stems = random_words(5, "abcÀé", (5, 6), 40)
    docs = [(i, " ".join(rng.choices([w.upper() for w in stems], k=400)) + "9x-y", 1) for i in range(30)]
    docs += [(None, "nameless " * 5, 1), (7, None, 1), (8, "", 1), (9, "zz " + "long" * 5000, 1), (9, "ÀÉÎÕ×÷ÿ ÀÉÎÕ×÷ÿ ÀÉÎÕ×÷ÿ", 1)]
    docs += [(50, "again again", 1)] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string, word int")
    for drop in (None, 97, 5):
        found = dict(map(tuple, vocabulary(df, drop_one_in=drop).collect()))
        assert found == slow_vocabulary([d[:2] for d in docs], drop)
    assert vocabulary(df.where("false")).count() == 0


def test_edges(spark):
    assert variants(frame(spark, {})).count() == 0
    odd = spark.createDataFrame([(None, 9), ("alone", 3), ("twice", 2), ("twice", 4), ("twixe", 3)], "word string, n long")
    assert sorted(map(tuple, variants(odd).collect()), key=str) == [
        ("alone", None, "alone", 3, 0, None),
        ("twice", None, "twice", 6, 1, None),
        ("twixe", "twice", "twice", 3, 1, 6),
    ]
    # Ties go to the smallest near word; a form needs twice the occurrences.
    tied = variants(frame(spark, {"house": 3, "mouse": 6, "louse": 6, "hause": 5})).collect()
    assert {r.word: r.form for r in tied} == {"house": "louse", "mouse": None, "louse": None, "hause": None}
    long = "ab" * 30_000
    both = near_words(frame(spark, {long: 3, long + "c": 9})).collect()
    assert {(r.word == long, r.near == long) for r in both} == {(True, False), (False, True)}
    with pytest.raises(Exception, match="too short"):
        near_words(frame(spark, {"abc": 3})).collect()


def test_a_long_chain_of_forms(spark):
    words = {"a" * i + "b" * (40 - i): 2**i for i in range(40)}
    found = {r.word: r.root for r in variants(frame(spark, words)).collect()}
    assert set(found.values()) == {"a" * 39 + "b"}


def test_letter_bits_of_edited_words():
    """At most two bits an edit, so that only words that differ more are not compared letter by letter."""
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzàéÿŁ漢𝒳"
    for _ in range(2000):
        word = "".join(rng.choices(letters, k=rng.randint(4, 12)))
        i, c = rng.randrange(len(word)), rng.choice(letters)
        for other in (word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :]):
            assert (letter_bits(word) ^ letter_bits(other)).bit_count() <= 2
        assert 0 <= letter_bits(word) < 2**63


def test_words_that_meet_are_sifted_and_never_broadcast(spark, monkeypatch):
    """Letters are compared only where the sets of letters allow it; the join goes by merging."""
    plans = []
    keep = spelling.stored
    monkeypatch.setattr(spelling, "stored", lambda df, name: plans.append((name, df)) or keep(df, name))
    assert near_words(frame(spark, {"letter": 9, "better": 3, "lettuce": 4})).count() == 2
    plan = dict(plans)["near-words"]._jdf.queryExecution().executedPlan().toString()
    assert "bit_count" in plan and "BroadcastHashJoin" not in plan
