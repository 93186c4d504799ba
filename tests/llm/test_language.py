import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.llm import language

WORDS = {
    "aa": ["lala", "mola", "nalo", "lomal", "anola"],
    "bb": ["krit", "stik", "trisk", "kist", "rikst"],
    "cc": ["öüsch", "schü", "üöch", "chösch", "ü"],
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.mark.parametrize("n", [2, 3, 5, 7, 9, 30])
def test_codewords_differ(n):
    code = language.codewords(n)
    apart = (code.shape[1] - code @ code.T) / 2
    assert (np.abs(code).min(), np.abs(code).max()) == (1, 1)
    assert apart[~np.eye(n, dtype=bool)].min() >= 1
    assert (np.abs(code.sum(axis=0)) < n).all()
    if n > 3:
        assert apart[~np.eye(n, dtype=bool)].min() >= 3  # one wrong bit is corrected


def test_blocks_of_a_long_text_count_all_grams(monkeypatch):
    text = language.letters("Abc déf, ghi! " * 40)
    whole = language.histogram(text)
    for size in (3, 7, 100):
        monkeypatch.setattr(language, "CHUNK", size)
        assert (language.histogram(text) == whole).all()
    assert whole.sum() == 3 * len(text) - 3


def test_languages_are_told_apart(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, lang, rng.randrange(1, 30)), lang, 1) for i, lang in enumerate("aa bb cc".split() * 100)]
    rows += [(900, None, "aa", 1), (901, "123 --- !!", "bb", 1), (902, "", "cc", 1), (903, "Lala MOLA", None, 1)]
    rows += [(None, "krit stik", "bb", 1), (904, "schü " * 100_000, "cc", 1), (904, "schü " * 100_000, "cc", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    apart = language.held_out(F.col("doc_id"))
    model = language.train(docs.where(~apart))
    assert model.languages == ["aa", "bb", "cc"]
    found = language.with_language(docs, model, F.col("text"), "found")
    assert found.columns == [*docs.columns, "found"]
    got = found.select("doc_id", "lang", "found.lang", "found.score", "found.ambiguous").collect()
    assert len(got) == len(rows)
    for doc, lang, guess, score, unsure in got:
        if doc in (900, 901, 902):
            assert (guess, score, unsure) == ("und", 0.0, True)
        else:
            assert guess == (lang or "aa") and 0.5 <= score <= 1
    # Two languages in equal parts are flagged.
    mixed = " ".join(WORDS["aa"] + WORDS["bb"])
    scores = model.decode(mixed, 0.2)
    assert scores[2] and not model.decode("lala mola nalo", 0.2)[2]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "aa")], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert [r[0] for r in language.with_language(docs, model, F.col("text"), "x").select("x.lang").collect()] == ["und"] * 2
    one = language.train(spark.createDataFrame([("abc", "aa")], "text string, lang string"))
    assert one.decode("xyz", 0.05) == ("aa", 1.0, False)


def test_letters_are_category_l():
    for text in (None, "", "12 --- !!", "½ ² Ⅷ", "①② ٣٤ ५", "\u0301 \u093f", "_"):
        assert language.letters(text) == ""
    assert language.letters("Ⅷ x² Été2É") == " x été é "
    assert language.letters("हिन्दी भाषा!") == " हिन्दी भाषा "  # marks stay inside words
    assert language.letters("e\u0301te\u0301") == " e\u0301te\u0301 "


def grams(text):
    """Buckets of all n-grams by plain integers, one n-gram at a time."""
    words = language.letters(text)
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            h = n
            for c in words[i : i + n]:
                h = (h * 0x01000193 + ord(c)) % 2**32
            yield ((h ^ (h >> 15)) * 0x9E3779B1 % 2**32) >> (32 - language.DIM_BITS)


def test_training_and_decoding_equal_a_plain_version(spark):
    rng = random.Random(11)
    rows = [(sentence(rng, lang, rng.randrange(1, 12)), lang) for lang in ["aa"] * 40 + ["bb"] * 25 + ["cc"] * 30]
    rows += [("½ ²", "aa"), (None, "bb"), ("krit", None), rows[0]]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    languages = ["aa", "bb", "cc"]
    assert model.languages == languages

    known = [(t, x) for t, x in rows if t and x]
    counts = {x: Counter(b for t, y in known if y == x for b in grams(t)) for x in languages}
    size = 1 << language.DIM_BITS
    total = {x: sum(counts[x].values()) + 0.1 * size for x in languages}
    rate = lambda x, b: (counts[x][b] + 0.1) / total[x]
    code = language.codewords(3)

    def margin(text, bit):
        found = list(grams(text))
        score = 0.0
        for b in found:
            sides = [[rate(x, b) for x, c in zip(languages, code[:, bit], strict=True) if c == s] for s in (1, -1)]
            score += math.log(sum(sides[0]) / len(sides[0]) / (sum(sides[1]) / len(sides[1])))
        return score / len(found)

    right = {}
    for i, x in enumerate(languages):
        own = [t for t, y in known if y == x and language.letters(t)]
        for bit in range(code.shape[1]):
            right[i, bit] = (sum(margin(t, bit) * code[i, bit] > 0 for t in own) + 1) / (len(own) + 2)
    texts = [sentence(rng, rng.choice(languages), rng.randrange(1, 6)) for _ in range(40)]
    texts += ["lala krit", "xyz", "ü", " ".join(WORDS["aa"] + WORDS["bb"])]
    for text in texts:
        margins = [margin(text, bit) for bit in range(code.shape[1])]
        loss = [
            sum(right[i, b] * math.log1p(math.exp(-4 * code[i, b] * m)) for b, m in enumerate(margins))
            / sum(right[i, b] for b in range(code.shape[1]))
            for i in range(3)
        ]
        first, second = sorted(range(3), key=lambda i: loss[i])[:2]
        guess, score, unsure = model.decode(text, 0.05)
        want = loss[second] / (loss[first] + loss[second])
        assert score == pytest.approx(want, abs=1e-9) and unsure == (score < 0.55)
        assert guess == languages[first] or loss[second] - loss[first] < 1e-12
