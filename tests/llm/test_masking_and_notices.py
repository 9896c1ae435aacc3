"""Masking by id and text, the token sample of a fit, notices behind copyright clauses, the wider licence list."""

import collections

from emberfield.llm import license, pii
from helpers import empty


def test_masking_goes_by_id_and_text(spark):
    docs = spark.createDataFrame(
        [(1, "x a.b@c.de y", "s"), (1, "mail z.z@q.org now", "s"), (1, "clean words only", "s"), (None, "mail z.z@q.org now", "s"),
         (None, "nothing", "s"), (2, None, "s"), (3, "", "s"), (4, "a@b.cd", "s"), (4, "a@b.cd", "s")],
        "doc_id long, text string, spans string",
    )
    found = pii.pii_spans(docs, pii.fit_pii(docs))
    got = collections.Counter((r.doc_id, r.text) for r in pii.masked(docs, found).collect())
    assert got == collections.Counter([
        (1, "x <email> y"), (1, "mail <email> now"), (1, "clean words only"), (None, "mail <email> now"), (None, "nothing"),
        (2, None), (3, ""), (4, "<email>"), (4, "<email>")])
    assert pii.masked(docs, found).columns == docs.columns
    assert pii.masked(empty(docs), found).count() == 0


def test_notices_behind_a_copyright_clause(spark):
    texts = {
        1: "Copyright 2020 X. Released under the MIT License.",
        2: "intro\n(c) 2019 Example Inc. All rights reserved. Licensed under CC BY-SA 4.0.\nmore",
        3: "Copyright 2020 Example Inc. and others.",
        4: "text\nSPDX-License-Identifier: MPL-2.0\nDistributed under the Boost Software Licence, Version 1.0",
        5: "Copyright A.\nCopyright B, licensed under the MIT License",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.text_license, r.line_licenses) for r in license.license_scan(docs).collect()}
    assert got == {1: ("MIT", "MIT"), 2: (None, "CC-BY-SA-4.0"), 3: (None, ""), 4: (None, "BSL-1.0,MPL-2.0"), 5: ("MIT", "MIT")}


def test_every_known_text_is_found_when_wrapped_and_signed(spark):
    signed = [(i, "Copyright (c) 2021, Somebody\nAll rights reserved.\n\n" + " \n".join(body.upper().split(" ")))
              for i, (_, body) in enumerate(license.TEXTS)]
    docs = spark.createDataFrame(signed, "doc_id long, text string")
    assert {r.doc_id: r.text_license for r in license.license_scan(docs).collect()} == dict(enumerate(n for n, _ in license.TEXTS))
