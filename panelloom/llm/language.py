"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a linear classifier over hashed character
n-grams tells the languages with a one from those with a zero: the weight of an n-gram is the log
ratio of its mean frequency on the two sides, and the margin of a text is the mean weight of its n-grams.
Decoding sums a logistic loss over the bits, weighted by how reliable a bit is for
a language, and takes the codeword with the least. A narrow lead flags the text as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
GRAMS = (1, 2, 3)
DIM_BITS = 15
CHUNK = 1 << 18  # characters whose n-grams are held at a time
EXHAUSTIVE = 7  # languages up to which every split of them is a bit
LETTER = regex.compile(r"\p{L}")
NO_LETTER = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str | None) -> str:
    """Lower-cased words of letters and their marks with one space around each; empty if there is no letter.

    Letters are Unicode's category L, as in the pipeline's ``\\p{L}``; digits and number signs (category N) are none.
    """
    inner = NO_LETTER.sub(" ", (text or "").lower()).strip()
    return f" {inner} " if LETTER.search(inner) else ""


def gram_buckets(words: str) -> Iterator[np.ndarray]:
    """Hash buckets of the n-grams, block by block, so that long texts take bounded memory."""
    most = max(GRAMS) - 1
    for at in range(0, len(words), CHUNK):
        piece = words[max(0, at - most) : at + CHUNK]
        extra = min(at, most)
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        for n in GRAMS:
            if len(code) < n:
                continue
            h = np.full(len(code) - n + 1, n, np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) + code[k : len(code) - n + 1 + k]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
            # The first windows of a later block were counted with the block before.
            yield (h >> np.uint32(32 - DIM_BITS))[max(0, extra - n + 1) :]


def histogram(words: str) -> np.ndarray:
    total = np.zeros(1 << DIM_BITS, np.int64)
    for buckets in gram_buckets(words):
        total += np.bincount(buckets, minlength=1 << DIM_BITS)
    return total


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """+1/-1 matrix, languages by bits: every split of few languages, else the best random code."""
    if n < 2:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE:
        splits = [s for k in range(n) for s in combinations(range(1, n), k)][:-1]
        code = -np.ones((n, len(splits)))
        code[0] = 1
        for bit, ones in enumerate(splits):
            code[list(ones), bit] = 1
        return code
    rng, best, distance = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, 15 * math.ceil(math.log2(n))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code @ code.T) / 2
        nearest = apart[~np.eye(n, dtype=bool)].min()
        if nearest > distance:
            best, distance = code, nearest
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x buckets
    reliable: np.ndarray  # languages x bits, rows sum to 1

    def margins(self, words: str) -> np.ndarray:
        counts = histogram(words)
        return self.weights @ counts / max(1, counts.sum())

    def decode(self, text: str | None, lead: float) -> tuple[str, float, bool]:
        """Language, share of the second-best loss in the two smallest, and if the lead is narrow."""
        words = letters(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = (self.reliable * np.log1p(np.exp(-4 * self.code * self.margins(words)))).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        best, second = loss[order[0]], loss[order[1]]
        score = float(second / (best + second)) if best + second > 0 else 0.5
        return self.languages[order[0]], score, score < 0.5 + lead


def train(
    labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = 2000
) -> Model:
    """Learn from all rows with a language and a letter.

    N-gram counts cover every row: each task sums its rows by language before the shuffle. The
    reliability of bits is measured on about ``sample`` rows, chosen by the hash of their text.
    """
    labelled = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    labelled = labelled.where("text is not null and lang is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        rows = 0
        for batch in batches:
            rows += len(batch)
            for x, of in zip(batch["text"], batch["lang"], strict=True):
                got = histogram(letters(x))
                sums[of] = sums[of] + got if of in sums else got
        for of, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": of, "bucket": at.astype(np.int32), "n": total[at]})
        yield pd.DataFrame({"lang": [None], "bucket": np.int32(-1), "n": rows})

    counted = labelled.mapInPandas(count, "lang string, bucket int, n long")
    counted = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    all_rows = max(1, int(counted.loc[counted["bucket"] < 0, "n"].sum()))
    counted = counted[counted["bucket"] >= 0]
    languages = sorted(counted["lang"].unique())
    code = codewords(len(languages))
    rate = np.full((len(languages), 1 << DIM_BITS), 0.1)
    row = counted["lang"].map({x: i for i, x in enumerate(languages)})
    np.add.at(rate, (row.to_numpy(int), counted["bucket"].to_numpy(int)), counted["n"].to_numpy(float))
    rate /= rate.sum(axis=1, keepdims=True)
    ones, zeros = (code > 0).T.astype(float), (code < 0).T.astype(float)
    side = lambda m: (m @ rate) / np.maximum(1, m.sum(axis=1, keepdims=True))
    weights = np.log(side(ones) / side(zeros)) if code.size else np.zeros((0, 1 << DIM_BITS))
    model = Model(languages, code, weights, np.ones_like(code))
    if not code.size:
        return model

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, of in zip(batch["text"], batch["lang"], strict=True):
                if (words := letters(x)) and of in languages:
                    right = model.margins(words) * code[languages.index(of)] > 0
                    yield pd.DataFrame({"lang": of, "bit": range(len(right)), "ok": right})

    picked = labelled.where(F.pmod(F.xxhash64("text"), F.lit(2**30)) < int(2**30 * min(1, sample / all_rows)))
    judged = picked.mapInPandas(judge, "lang string, bit int, ok boolean")
    judged = judged.groupBy("lang", "bit").agg(F.sum(F.col("ok").cast("int")), F.count("*"))
    right = np.ones_like(code)
    for of, bit, ok, n in judged.collect():
        right[languages.index(of), bit] = (ok + 1) / (n + 2)
    model.reliable = right / right.sum(axis=1, keepdims=True)
    return model


def with_language(
    docs: DataFrame, model: Model, text: Column, out: str, lead: float = 0.05
) -> DataFrame:
    """Adds a struct (lang, score, ambiguous) from the whole text of each row.

    Null texts and texts without a letter give ``und`` with score 0, ambiguous. Ties go to
    the language that sorts first. Other columns and repeated rows stay as they are.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [model.decode(x.as_py(), lead) for x in batch]
            lang, score, unsure = ([f[i] for f in found] for i in range(3))
            yield pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                ["lang", "score", "ambiguous"],
            )

    udf = F.arrow_udf(run, "lang string, score double, ambiguous boolean")
    return docs.withColumn(out, udf(text))


def clean_lead(
    labelled: DataFrame, model: Model, text: str = "text", lang: str = "lang", lost: float = 0.001, usual: float = 0.05
) -> float:
    """The lead that all but a share ``lost`` of the labelled rows have which the model gets right.

    ``labelled`` are rows the model has not learned from; without a right one among them, ``usual``.
    """
    found = with_language(labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")), model, F.col("text"), "found")
    right = found.where(F.col("lang") == F.col("found.lang"))
    least = right.agg(F.percentile_approx("found.score", lost, 10_000)).first()[0]
    return usual if least is None else max(0.0, least - 0.5)


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """If the CRC-32 of the id as text leaves ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold
