"""Spelling variants by pivotal grams.

One edit destroys at most one of two bigrams that do not overlap. So of two words within ``t`` edits
that have their bigrams sorted, rare ones first, the one whose prefix of ``2 t + 1`` bigrams ends earlier keeps
one of any ``t + 1`` disjoint bigrams of its prefix, and this bigram is in the other word's prefix. The
disjoint bigrams chosen, by dynamic programming for the least total frequency, are a word's pivots.
Only pivots are matched with prefixes, and only at places that the edits before and
behind the bigram allow; of the words so found, those whose sets of letters differ little enough are compared letter by letter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import stored

#: Frequencies of bigrams are kept by hash in this many cells, whatever the alphabet.
CELLS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@lru_cache(1 << 17)
def _cell(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % CELLS


def prefix_and_pivots(
    word: str, counts: np.ndarray, distance: int
) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """The prefix and the pivots of one word, as (order, bigram, place from 0).

    ``order`` is a bigram's frequency, then its cell. The prefix is the first ``2 distance + 1`` bigrams by (order, bigram),
    with every further place of the last one. The pivots are ``distance + 1`` of them that do not
    overlap, of least total frequency (ties: least cells, then the ones further left).
    """
    cells = [_cell(word[i : i + 2]) for i in range(len(word) - 1)]
    grams = sorted((int(counts[c]) * CELLS + c, word[i : i + 2], i) for i, c in enumerate(cells))
    size = 2 * distance + 1
    end = size
    while end < len(grams) and grams[end][1] == grams[size - 1][1]:
        end += 1
    inside = sorted(grams[:size], key=lambda g: g[2])
    # cost[i]: least total of the pivots chosen so far that end with the i-th bigram.
    cost = [(g[0], (i,)) for i, g in enumerate(inside)]
    for _ in range(distance):
        before, cost = cost, []
        for i, g in enumerate(inside):
            apart = [c for j, c in enumerate(before[:i]) if c and inside[j][2] + 2 <= g[2]]
            best = min(apart, default=None)
            cost.append(best and (best[0] + g[0], (*best[1], i)))
    chosen = min(c for c in cost if c)[1]
    return grams[:end], [inside[i] for i in chosen]


def letter_bits(word: str) -> int:
    """Which characters occur in a word, by code point modulo 63: an edit changes at most two of the bits."""
    bits = 0
    for c in word:
        bits |= 1 << ord(c) % 63
    return bits


def vocabulary(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    letters: str = "A-Za-zÀ-ÿ",
    min_chars: int = 5,
    min_count: int = 3,
    drop_one_in: int | None = None,
) -> DataFrame:
    """(word, n): the distinct runs of ``letters`` in all texts, A-Z lower-cased, and how often each occurs.

    A null or empty text has none; rows that repeat count again. Words of fewer characters or
    occurrences go. With ``drop_one_in`` m, a run of a document loses the character at h % length if m divides
    h, the crc32 of ``<doc_id>:<run>`` (a null doc_id counts as empty): spelling mistakes
    in known places. Occurrences are added up before the shuffle, so a frequent word is a row per task.
    """
    named = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"[{letters}]+"), F.lit(0))
    found = docs.select(named.alias("id"), F.explode(runs).alias("run"))
    word = F.col("run")
    if drop_one_in:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        word = F.when(h % drop_one_in == 0, short).otherwise(word)
    counted = found.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= min_chars) & (F.col("n") >= min_count))


def _gram_counts(words: DataFrame) -> np.ndarray:
    """How often the bigrams of each cell occur in the words: CELLS numbers at most on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for word in batch.column(0):
                w = word.as_py()
                np.add.at(counts, [_cell(w[i : i + 2]) for i in range(len(w) - 1)], 1)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(counts[cells])], ["cell", "n"])

    counts = np.zeros(CELLS, np.int64)
    found = words.select("word").mapInArrow(run, "cell int, n long")
    for cell, n in found.groupBy("cell").agg(F.sum("n")).collect():
        counts[cell] = n
    return counts


def _with_grams(words: DataFrame, distance: int) -> DataFrame:
    """Words with their letter ``bits``, ``last`` (the order at which their prefix ends), ``prefix`` and ``pivots``."""
    counts = _gram_counts(words)
    placed = pa.list_(pa.struct([("gram", pa.string()), ("place", pa.int32())]))
    types = pa.schema([("word", pa.string()), ("n", pa.int64()), ("bits", pa.int64()), ("last", pa.int64()), ("prefix", placed), ("pivots", placed)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, last, prefixes, pivots = [], [], [], []
            for word in batch.column(0).to_pylist():
                prefix, pivot = prefix_and_pivots(word, counts, distance)
                bits.append(letter_bits(word))
                last.append(prefix[-1][0])
                prefixes.append([{"gram": g, "place": i} for _, g, i in prefix])
                pivots.append([{"gram": g, "place": i} for _, g, i in pivot])
            made = [pa.array(x, f.type) for x, f in zip((bits, last, prefixes, pivots), list(types)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], schema=types)

    places = "array<struct<gram string, place int>>"
    out = f"word string, n long, bits long, last long, prefix {places}, pivots {places}"
    return words.select("word", "n").mapInArrow(run, out)


def near_words(words: DataFrame, distance: int = 1) -> DataFrame:
    """(word, n, near, near_n), in both directions, for words 1 to ``distance`` edits apart.

    An edit inserts, deletes or replaces one character. ``words`` has distinct ``word`` of at least
    ``2 distance + 2`` characters, with ``n``; a shorter one fails the job.
    """
    long_enough = F.assert_true(F.length("word") >= 2 * distance + 2, "near_words: a word is too short").isNull()
    grams = stored(_with_grams(words.where(long_enough), distance), "grams")
    # One number to sort and join by; two keys that share it cost a comparison in vain.
    meeting = F.xxhash64("gram", "place", "chars").alias("meeting")
    key = [F.length("word").alias("chars"), "word", "n", "bits", "last"]
    prefixes = grams.select(*key, F.explode("prefix").alias("g")).select("g.gram", "g.place", "chars", "word", "n", "bits", "last")
    prefixes = prefixes.select(meeting, "word", "n", "bits", "last")
    # A shift of the bigram needs as many edits before it, the rest of the difference in length as many behind it.
    moves = [
        (shift, longer)
        for longer in range(-distance, distance + 1)
        for shift in range(-distance, distance + 1)
        if abs(shift) + abs(longer - shift) <= distance
    ]
    listed = F.array(*[F.struct(F.lit(s).alias("shift"), F.lit(d).alias("longer")) for s, d in moves])
    pivots = grams.select(*key, F.explode("pivots").alias("g")).withColumn("m", F.explode(listed))
    pivots = pivots.select(
        "g.gram",
        (F.col("g.place") + F.col("m.shift")).alias("place"),
        (F.col("chars") + F.col("m.longer")).alias("chars"),
        F.col("word").alias("near"),
        F.col("n").alias("near_n"),
        F.col("bits").alias("near_bits"),
        F.col("last").alias("near_last"),
    )
    pivots = pivots.select(meeting, "near", "near_n", "near_bits", "near_last")
    # Most words that meet differ in more letters than the edits can change; the others are compared letter by letter.
    alike = f"bit_count(bits ^ near_bits) <= {2 * distance}"
    met = prefixes.join(pivots.hint("merge"), "meeting").where(f"near_last <= last and {alike} and word != near")
    edits = F.levenshtein("word", "near", distance)
    pairs = met.where(edits > 0).select("word", "n", "near", "near_n").distinct()
    turned = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return stored(pairs.union(turned).distinct(), "near-words")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last. Steps double, and a form has more occurrences than its word."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        following = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = roots.join(following.hint("merge"), "root")
        if moved.isEmpty():
            return roots
        ahead = roots.join(following.hint("merge"), "root", "left")
        roots = stored(ahead.select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(words: DataFrame, distance: int = 1, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n).

    ``form`` is the near word that occurs most (ties: smallest in code-point order), if it does at least
    ``ratio`` times as often, else null; ``root`` follows forms to the last, and is the word itself if
    it has none. Null words go; a word that repeats counts the sum of its ``n``. Other columns are not
    read. No words: no rows. Rounds grow with the logarithm of the longest chain, which is at most
    the logarithm of the largest ``n``.
    """
    if ratio < 2:
        raise ValueError("a form must occur more often than its word")
    words = stored(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    near = near_words(words, distance)
    best: Column = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    about = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("n"))
    about = about.withColumn("form_n", -F.col("best.minus"))
    enough = F.col("form_n") >= ratio * F.col("n")
    about = about.select(
        "word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")
    )
    about = stored(about, "forms")
    roots = _roots(about.where("form is not null"))
    # As many forms as words at most: never a broadcast, however small the vocabulary.
    found = words.join(about.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left")
    return found.select(
        "word",
        "form",
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        "form_n",
    )


def _crc_sql(bytes_: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


#: The contract as DuckDB SQL: crc32 by its table, near words by their deletions.
SPELLING_SQL = f"""
with recursive crc as materialized (
  select list(c order by i) t from (select i, list_reduce(
    list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c
    from (select unnest(range(256)) i))),
runs as (select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) run from documents),
counted as materialized (select doc_id, run, count(*) n from runs group by all),
hashed as (select run, n, {_crc_sql('''flatten([case when u < 128 then [u] else [192 + (u >> 6), 128 + (u & 63)] end
      for u in [ord(x)::bigint for x in string_split(doc_id::varchar || ':' || run, '')]])''')} h from counted, crc),
edited as (select n, case when h % 97 = 0
  then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end word from hashed),
words as materialized (select word, sum(n)::bigint n from edited group by word having length(word) >= 5 and sum(n) >= 3),
cut as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) d
  from (select word, n, unnest(range(1, length(word) + 1)) i from words)),
pairs as (
  select a.word a, b.word b from cut a join cut b on a.d = b.d and a.i = b.i and a.word != b.word
  union select a.word, b.word from cut a join words b on a.d = b.word
  union select b.word, a.word from cut a join words b on a.d = b.word),
near as (select a word, count(*) n_near, max(w.n) most, arg_min(b, (-w.n, b)) best from pairs join words w on b = w.word group by a),
forms as materialized (select w.word, w.n, coalesce(n_near, 0) n_near,
  case when most >= 2 * w.n then best end form, case when most >= 2 * w.n then most end form_n
  from words w left join near using (word)),
walk as (select word, word reached, 0 step from forms
  union all select walk.word, f.form, step + 1 from walk join forms f on walk.reached = f.word where f.form is not null)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n
from forms f join (select word, arg_max(reached, step) root from walk group by word) r using (word)"""
