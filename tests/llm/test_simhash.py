import numpy as np
import pytest
import xxhash

from panelloom.llm.simhash import ball_links, fingerprint, keep_first, simhash_components

SCHEMA = "doc_id long, text string, fp int, root string, rows int"


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    bits = [2 * sum(h >> b & 1 for h in hashes) > len(hashes) for b in range(64)]
    return int.from_bytes(sum(x << b for b, x in enumerate(bits)).to_bytes(8, "little"), "little", signed=True)


@pytest.mark.parametrize(
    "text",
    [None, "", " \n\t", "One", "a b c", "a b c d", "A b C d e f g\x0bh", "É é x ü", "same " * 50, "x" * 5000],
)
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def groups(prints, linked):
    parent = {p: p for p in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {p: top(p) for p in prints}


@pytest.mark.parametrize("distance", [0, 1, 3, 4])
def test_links_connect_what_is_near(spark, monkeypatch, distance):
    monkeypatch.setattr("panelloom.llm.simhash.BLOCK", 20_000)  # several blocks for each task
    rng = np.random.default_rng(distance)
    prints = {int(x) for x in rng.integers(-(2**63), 2**63, 60)} | {0, -1}
    for base in list(prints)[:8]:  # chains and a dense group
        for _ in range(12):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            value = base & (2**64 - 1)
            for b in flips:
                value ^= 1 << int(b)
            prints.add(value - 2**64 if value >= 2**63 else value)
    prints = sorted(prints)
    found = ball_links(spark.createDataFrame([(p,) for p in prints], "fp long"), distance).collect()
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= distance
    assert all(near(r.a, r.b) for r in found)
    expected = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if near(a, b)]
    assert groups(prints, [(r.a, r.b) for r in found]) == groups(prints, expected)


def test_components_and_survivors(spark):
    words = [f"w{i % 97}x{i * i % 89}" for i in range(6000)]
    text = " ".join(words)
    edited = " ".join([*words[:200], "changed", *words[201:]])
    rows = [
        (7, text, 1, "a", 1),
        (3, edited, 2, "b", 2),
        (9, text, 3, "c", 3),
        (9, text, 3, "c", 3),
        (5, "something else entirely", 4, "d", 4),
        (1, None, 5, None, None),
        (2, "", 6, "e", 6),
        (None, " ", 7, "f", 7),
        (None, "no name but a text of its own", 8, "g", 8),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    near = ((fingerprint(text) ^ fingerprint(edited)) & (2**64 - 1)).bit_count() <= 4
    assert near
    found = sorted(
        ((r.doc_id, r.component_id) for r in simhash_components(docs).collect()), key=str
    )
    assert found == sorted(
        [(7, 3), (3, 3), (9, 3), (9, 3), (5, 5), (1, 1), (2, 1), (None, 1), (None, None)], key=str
    )
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.fp) for r in kept.collect()) == [(-1, 8), (1, 5), (3, 2), (5, 4)]
    again = spark.createDataFrame([(4, "x y z", 1, "a", 1)] * 3, SCHEMA)
    assert keep_first(again).count() == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash_components(empty).count() == 0
    assert keep_first(empty).count() == 0
