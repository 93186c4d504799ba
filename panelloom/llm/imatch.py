"""I-Match document fingerprints with randomised lexicons.

The lexicon holds the terms in a band of inverse document frequency. A document's
distinct lexicon terms are sorted and hashed as a whole, and again within random subsets of the
lexicon of several sizes: small changes spare many subsets. Terms go by their 64-bit hash.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import discard, put, with_rank

#: A term is in the lexicon if this share of the documents has it. The lower bound also bounds the
#: lexicon: at most (distinct terms of a mean document) / LOW.
LOW, HIGH = 0.01, 0.3
#: Subsets of each size; a subset of level k has 1/16, 1/64 and 1/256 of the lexicon.
SUBSETS, LEVELS = 16, 3
#: XXH64 of an empty array: it hands on its seed.
EMPTY = 42
ABSENT = -(2**63)


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words; none for a null text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    hashes = F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))
    return F.array_remove(hashes, F.xxhash64(F.lit("")))


def lexicon(docs: DataFrame, text: str, low: float = LOW, high: float = HIGH) -> list[int]:
    """Terms whose document frequency lies in the band, over all rows."""
    path = put(
        docs.select(F.explode(terms(F.col(text))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n")),
        "imatch-terms",
    )
    n = docs.count()
    counts = docs.sparkSession.read.parquet(path)
    found = counts.where(F.col("n").between(low * n, high * n)).select("term").collect()
    discard(docs.sparkSession, path)
    return sorted(r[0] for r in found)


def lookup(lexicon: list[int]) -> Column:
    """The lexicon as a constant: an array of small arrays, by the low bits of the term."""
    width = 1 << max(1, len(lexicon)).bit_length()
    table: list[list[int]] = [[] for _ in range(width)]
    for term in lexicon:
        table[term & (width - 1)].append(term)
    table_column = F.from_json(F.lit(json.dumps(table)), "array<array<bigint>>")

    def known(term: Column) -> Column:
        at = (term.bitwiseAND(width - 1) + 1).cast("int")
        return F.array_contains(F.element_at(table_column, at), term)

    return known


def with_fingerprint(docs: DataFrame, text: str, out: str, lexicon: list[int]) -> DataFrame:
    """Adds ``out``: the hash of all lexicon terms, then those of the subsets, EMPTY where none.

    A text without a lexicon term is fingerprinted by all its terms.
    """
    known, others = lookup(lexicon), docs.columns
    found = docs.withColumn("_terms", terms(F.col(text)))
    found = found.withColumn("_band", F.filter("_terms", known))
    found = found.select(
        *others,
        F.sort_array(F.when(F.size("_band") > 0, F.col("_band")).otherwise(F.col("_terms"))).alias("_band"),
    )
    picked = lambda x, shift, n, i: F.filter(
        x, lambda h: F.shiftrightunsigned(h, shift).bitwiseAND(n - 1) == i
    )
    found = found.withColumn("_l0", F.col("_band"))
    for level in range(1, LEVELS):
        found = found.withColumn(f"_l{level}", picked(F.col(f"_l{level - 1}"), 18 + 2 * level, 4, 0))
    places = F.sequence(F.lit(0), F.lit(SUBSETS - 1))
    of_level = lambda k: F.transform(
        places, lambda i: F.xxhash64(picked(F.col(f"_l{k}"), 28 + 4 * k, SUBSETS, i))
    )
    hashes = F.concat(F.array(F.xxhash64("_band")), *[of_level(k) for k in range(LEVELS)])
    return found.select(*others, hashes.alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets with a term on either side that agree; equal fingerprints give 1."""
    pairs = F.arrays_zip(F.slice(a, 2, SUBSETS * LEVELS).alias("a"), F.slice(b, 2, SUBSETS * LEVELS).alias("b"))
    told = F.filter(pairs, lambda p: (p["a"] != EMPTY) | (p["b"] != EMPTY))
    same = F.size(F.filter(told, lambda p: p["a"] == p["b"]))
    equal = F.element_at(a, 1) == F.element_at(b, 1)
    return F.when(equal, 1.0).when(F.size(told) > 0, same / F.size(told)).otherwise(0.0)


def as_text(a: Column) -> Column:
    """16 hex digits for the whole and 8 for each subset."""
    digits = lambda x, n: F.lower(F.right(F.concat(F.lit("0" * n), F.hex(x)), F.lit(n)))
    rest = F.transform(F.slice(a, 2, SUBSETS * LEVELS), lambda x: digits(x, 8))
    return F.concat(digits(F.element_at(a, 1), 16), F.lit("-"), F.array_join(rest, ""))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its last third replaced by the start of the next document in descending
    order of doc_id (null ids last, then by text hash); the first follows the last. Null texts count as
    empty. Equal rows count as one document in that order, each with its own result. Ids and texts
    meet in joins by id: the order is worked out on ids, lengths and hashes alone, and a text
    is shuffled once, with the part of it that its neighbour takes.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.coalesce(F.col(doc_id), F.lit(ABSENT)).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("hash", F.xxhash64("text"))
    words = lexicon(base, "text")
    keys = base.select("id", "hash", F.char_length("text").alias("chars")).distinct()
    last = (F.col("id") == ABSENT).asc()
    keys = with_rank(keys, [last, F.col("id").desc(), F.col("hash")], "rank", "imatch-order")
    total = max(1, keys.count())
    taker = keys.select(
        F.col("id").alias("to_id"),
        F.col("hash").alias("to_hash"),
        F.floor(F.col("chars") / 3).cast("int").alias("takes"),
        ((F.col("rank") + 1) % total).alias("rank"),
    )
    giver = keys.select(F.col("id"), F.col("hash"), "rank")
    path = put(giver.join(taker, "rank").drop("rank"), "imatch-next")
    known = with_fingerprint(base, "text", "print", words)
    given = known.join(spark.read.parquet(path), ["id", "hash"]).select(
        F.col("to_id").alias("id"),
        F.col("to_hash").alias("hash"),
        F.struct(
            F.substring("text", F.lit(1), F.col("takes")).alias("start"), F.col("print").alias("print")
        ).alias("next"),
    )
    given = given.groupBy("id", "hash").agg(F.max("next").alias("next"))
    found = known.join(given, ["id", "hash"])
    chars = F.char_length("text")
    kept = (chars - F.floor(chars / 3)).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), kept), F.col("next.start"))
    found = found.select(
        "id", chars.alias("n_chars"), "print", F.col("next.print").alias("next_print"), edited.alias("edited")
    )
    found = with_fingerprint(found, "edited", "edited_print", words)
    return found.select(
        F.when(F.col("id") != ABSENT, F.col("id")).alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
