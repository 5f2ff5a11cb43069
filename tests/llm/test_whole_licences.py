"""Entire long licences, further licences, and odd rows."""

import pathlib

import pytest

from geoloom.llm import license_scan

FOLDER = pathlib.Path("/usr/share/common-licenses")
FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "Artistic": "Artistic-1.0"}


@pytest.mark.skipif(not FOLDER.exists(), reason="no licence texts on this machine")
def test_entire_texts(spark):
    texts = {n: (FOLDER / n).read_text(errors="replace") for n in FILES}
    rows = [(k, t) for k, t in enumerate(texts.values())] + [(100 + k, t.replace("\n", "  \n").upper()) for k, t in enumerate(texts.values())] + [(200 + k, t[: len(t) // 2]) for k, t in enumerate(texts.values())]
    got = {r.doc_id: r.licence for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.whole}
    assert got == {k + h: name for h in (0, 100) for k, name in enumerate(FILES.values())}


def test_cues_are_looked_up_as_words(spark):
    rows = [(1, "released  under the MIT"), (2, "Released\tunder the MIT"), (3, "Released-under the MIT"), (4, "released over the MIT")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2, 3} and {r.licence for r in got} == {"MIT"}


def test_further_licences(spark):
    own = spark.createDataFrame([("House-1", "Do as you like.\nBut be kind!"), (None, "x"), ("House-2", None)], "licence string, text string")
    docs = spark.createDataFrame([(1, "do AS you like but be kind", 1), (2, "Copyright 2020 me\nDo as you like. But be kind", 2), (3, "unlike", 3)], "doc_id long, text string, licence int")
    assert {(r.doc_id, r.licence, r.whole) for r in license_scan.scan(docs, licences=own).collect()} == {(1, "House-1", True), (2, "House-1", True)} | {(2, "House-1", True)}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "MIT License\nreleased under the MIT"), (5, "released under the MIT"), (5, "released under the MIT"), (6, None), (7, ""), (8, "word " * 300_000 + "\nreleased under the MIT")], "doc_id long, text string")
    got = {(r.doc_id, r.licence): r.units for r in license_scan.scan(docs).collect()}
    assert got[5, "MIT"] == 2 and got[8, "MIT"] == 1 and got[None, "MIT"] >= 1 and len(got) == 3
    assert license_scan.scan(docs.limit(0)).count() == 0
