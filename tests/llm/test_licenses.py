import re

import pytest

from panelloom.llm.licenses import TEMPLATES, Scanner, align, cues, scan_licenses

SCHEMA = "doc_id long, text string, start string, license string"


@pytest.fixture(scope="module")
def scanner():
    return Scanner(TEMPLATES)


@pytest.mark.parametrize("name, wording", [(n, w) for n, listed in TEMPLATES.items() for w in listed])
def test_every_template_is_found(scanner, name, wording):
    notice = wording.replace("{}", "(c) 1999 Some Body")
    text = f"Some prose before it, {notice}. And some prose after it."
    ((start, end, found, reduction, differences, exact, span),) = scanner.scan(text)
    assert (found, differences, exact) == (name, "", True)
    assert text[start:end] == span and reduction > 0
    words = lambda s: [w.strip(".,;:()\"") for w in s.split()]
    assert words(span) == words(notice)


def test_wording_differences(scanner):
    text = TEMPLATES["MIT"][-1].replace("merge, ", "").replace("furnished", "given")
    ((_, _, name, _, differences, exact, _),) = scanner.scan(text)
    assert (name, differences, exact) == ("MIT", "-merge -furnished +given", False)


@pytest.mark.parametrize(
    "text",
    ["", "A license to kill.", "copyright law", "Licensed under the Apache License, Version 1.1", "CC BY 4.0", "Licensed under CC BY 3.0"],
)
def test_no_notice(scanner, text):
    assert scanner.scan(text) == []


def test_several_notices(scanner):
    text = "/* Released under the\n * MIT License */ x Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0"
    assert [f[2] for f in scanner.scan(text)] == ["MIT", "CC-BY-NC-4.0", "CC-BY-4.0"]


def test_align():
    assert align("a b c".split(), "x a c y".split()) == (1, 3, ["b"], [])
    assert align("a {} c".split(), "x a 1 2 c".split()) == (1, 5, [], [])
    assert align("a b c d".split(), "a b z c d".split())[2:] == ([], ["z"])


def test_scan(spark):
    notice = "Released under the MIT License."
    rows = [(1, f"x {notice} y", "s", "l"), (1, f"x {notice} y", "s", "l"), (2, None, "s", "l"), (3, "", None, None)]
    rows += [(None, notice, "s", "l"), (4, "word " * 100_000 + notice + " word" * 100_000, "s", "l"), (5, "plain", "s", "l")]
    found = scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.start, r.license, r.exact) for r in found) == [
        (0, 0, "MIT", True), (1, 2, "MIT", True), (1, 2, "MIT", True), (4, 500_000, "MIT", True),
    ]
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_template_has_a_cue(spark, scanner):
    own = {"house": ["Use is governed by the Zorp accord", "{} keeps every claim", "Für Alle frei"], "None": ["Kein Recht 7"]}
    for templates in (TEMPLATES, own):
        for wording in (w for listed in templates.values() for w in listed):
            assert re.search(cues(templates), wording.replace("{}", "(c) 1999 Some Body"))
    rows = [(i, f"x y. {w.replace('{}', 'Ann')}. z", "s", "l") for i, w in enumerate(w for x in own.values() for w in x)]
    found = scan_licenses(spark.createDataFrame(rows, SCHEMA), templates=own).collect()
    assert sorted((r.doc_id, r.license) for r in found) == [(0, "house"), (1, "house"), (2, "house"), (3, "None")]
    ((start, end, name, _, _, exact, _),) = scanner.scan("Some prose.\nAll rights reserved.")
    assert (start, end, name, exact) == (12, 31, "all-rights-reserved", True)
    assert scan_licenses(spark.createDataFrame([(1, "a. All rights reserved.", "s", "l")], SCHEMA)).count() == 1


@pytest.mark.parametrize(
    "notice, name, differences",
    [
        ("Released under the MIT Licence", "MIT", "-license +licence"),
        ("Licensed under the Apache License 2.0", "Apache-2.0", "-version"),
        ("Released under MIT License", "MIT", "-the"),
        ("Distributed under the MIT License", "MIT", "-licensed +distributed"),
        ("Copyright (c) 1982, 1986, 1990, 1991, 1993 The Regents of the University of California. All rights reserved",
         "all-rights-reserved", ""),
        ("Copyright " + "Some Body, " * 300 + "All rights reserved", "all-rights-reserved", ""),
    ],
)
def test_changed_words_and_long_slots(scanner, notice, name, differences):
    text = f"Some prose before it. {notice}. And some prose after it."
    ((_, _, found, _, told, exact, span),) = scanner.scan(text)
    assert (found, told, exact) == (name, differences, not differences)
    assert span in (notice, notice.removeprefix("Distributed "))


@pytest.mark.parametrize(
    "text", ["Licensed under the ISC License", "Licensed under the GNU Affero General Public License, version 2", "All seats reserved",
             "SPDX-License-Identifier: ISC", "Licensed under CC BY-ND 4.0"],
)
def test_other_licenses(scanner, text):
    assert scanner.scan(f"Prose. {text}.") == []


def test_slots_swallow_no_notice(scanner):
    text = "Copyright 2001 Ann. Released under the MIT License. Copyright Bob. All rights reserved."
    assert [f[2] for f in scanner.scan(text)] == ["MIT", "all-rights-reserved"]


class Dummy:
    """A compressor that always saves a byte, whatever the template."""

    def __init__(self, size):
        self.size = size

    def compress(self, data):
        return b" " * self.size


def test_compression_decides():
    """Of two wordings that fit, the one that shrinks its block more is told; dummies leave the choice to the tie rule."""
    own = {"long": ["This tool is free for private use by all"], "short": ["tool is free for private use by all"]}
    text = "Prose. This tool is free for private use by all, honestly. Prose."
    real, dummy = Scanner(own), Scanner(own)
    assert [f[2] for f in real.scan(text)] == ["long"]
    dummy.plain, dummy.primed = Dummy(11), [Dummy(10)] * len(own)
    assert [f[2] for f in dummy.scan(text)] == ["long"]
    real.primed[real.names.index("short")] = Dummy(1)
    assert [f[2] for f in real.scan(text)] == ["short"]
    real.primed = [Dummy(10_000)] * len(own)
    assert real.scan(text) == []


def test_a_slot_ends(scanner):
    text = "Copyright law is a subject. " + "words of prose " * 1000 + "and all rights reserved by the author"
    assert [(f[2], f[1] - f[0]) for f in scanner.scan(text)] == [("all-rights-reserved", 19)]
