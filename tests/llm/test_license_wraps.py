"""Known licence texts as published: hard-wrapped, below a copyright line."""

import re
import textwrap

from tidemark.llm import licenses


def test_known_texts_at_several_widths(spark):
    rows = []
    short = [(name, text) for name, text in licenses.KNOWN if len(text) < 5000]
    for name, text in short:
        for width in (20, 40, 60, 70, 72, 76, 78, 80, 100):
            wrapped = "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))
            rows += [(len(rows), name, wrapped), (len(rows) + 1, name, f"Copyright (c) 2020, Some Body\n\n{wrapped}")]
    heads = ["Copyright 2020 A", "(c) 2020 A", "© A", " * Copyright © A", "Copyright by A", "Copyright <YEAR> <OWNER>"]
    rows += [(len(rows) + k, "ISC", f"{head}\n{licenses.KNOWN[3][1]}") for k, head in enumerate(heads)]
    docs = spark.createDataFrame(rows, "doc_id long, name string, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(docs).collect()}
    assert got == {k: name for k, name, _ in rows}


def test_long_texts_are_found_whole(spark):
    rows = []
    for name, text in licenses._long_texts():
        commented = "/*\n" + "\n".join(" * " + line.strip() for line in text.split("\n")) + "\n */"
        rows += [(name, text), (name, re.sub(r"\bLICENSE(S|D)?\b", r"LICENCE\1", text.upper())), (name, commented), (None, text[: len(text) // 2]), (None, text + "\nNo part of the terms.")]
    names = {name for name, _ in rows if name}
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0"} <= names
    docs = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(rows)], "doc_id long, name string, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(docs).collect()}
    assert got == {k: name for k, (name, _) in enumerate(rows)}


def test_lettered_clauses_stay(spark):
    known = [("One", "You may use this.\n(a) Keep the notice.\n(b) Keep the name.\n(c) Say what you changed.")]
    texts = [known[0][1], known[0][1].replace("Say what you changed", "Pay for every copy"), "Copyright (c) 2001 A\n" + known[0][1], known[0][1] + "\n(c) 2001 A\n(c) <year> B"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.license_id for r in licenses.scan_licenses(docs, known).orderBy("doc_id").collect()] == ["One", None, "One", "One"]


def test_spellings_are_of_whole_words(spark):
    known = [("One", "license and sublicense over http")]
    texts = ["Licence and sub-license over HTTPS", "licence, and sub licence; over https", "alicence and sublicense over http", "license and sublicense over httpsx", "licence licence and", "license license and"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan_licenses(docs, known).orderBy("doc_id").collect()
    assert [r.license_id for r in got[:4]] == ["One", "One", None, None]
    assert got[4].canonical_sha256 == got[5].canonical_sha256


def test_notices_of_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "x\nReleased under the MIT licence."), (1, "x"), (2, "Licensed under CC BY 4.0.\nreleased under the mit license"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.notice_ids) for r in licenses.scan_licenses(docs).collect()) == [(1, ""), (1, "MIT"), (2, ""), (2, "CC-BY-4.0,MIT")]
