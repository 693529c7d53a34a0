import os
import re
import sys

import duckdb
import pandas as pd
import pytest

sys.path.append(os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import compare  # noqa: E402

from lumenspan.llm import licenses
from lumenspan.llm.license_rules import rules


def test_rules_are_sound():
    all_rules = rules()
    assert len(all_rules) > 300 and len({r.rule for r in all_rules}) == len(all_rules)
    assert [r.priority for r in all_rules] == sorted((r.priority for r in all_rules), reverse=True)
    assert all(not re.search(r.pattern, "") and r.pattern == re.sub("[A-Z]", "?", r.pattern.replace("\\S", "")) for r in all_rules)


@pytest.mark.parametrize(
    ("text", "base", "labels"),
    [
        ("Released under the MIT License.", "mit", "mit"),
        ("Apache License, Version 2.0 and CC BY-NC 4.0", "apache-2,cc-by-nc", "apache-2,cc-by-nc"),
        ("GNU General Public License, version 3", "", "gpl-3"),
        ("the GNU General Public License", "", "gpl"),
        ("licensed under the GNU Lesser General Public License v2.1", "", "lgpl-2.1"),
        ("SPDX-License-Identifier: MPL-2.0", "", "mpl-2"),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "", "cc-by-nc-sa"),
        ("nothing to see", "", ""), ("", "", ""), (None, "", ""),
    ],
)
def test_labels(make_docs, text, base, labels):
    row = licenses.scan(make_docs((1, text))).first()
    assert (row.base_labels, row.labels) == (base, labels)
    assert (row.score > 0) == bool(labels)


def test_against_all_intervals(make_docs):
    pieces = ["BSD 3-Clause License", "mit license", "under the MIT license", "cc by-nc-sa 4.0", "license: mit", "gpl", "All rights reserved", "  ", "\n", "xx"]
    texts = {i: " ".join(pieces[(i * k + k) % len(pieces)] for k in range(1, 9)) for i in range(25)}
    got = {}
    for r in licenses.detections(make_docs(*texts.items())).collect():
        got.setdefault(r.doc_id, set()).add((r.rule, r["first"], r["last"]))
    for i, text in texts.items():
        low = text.lower()
        every = [(m.start(), m.end(), r) for r in rules() if r.keyword in low for m in re.finditer(r.pattern, low)]
        beats = lambda a, b: a[2].priority > b[2].priority or a[2].priority == b[2].priority and a[1] - a[0] > b[1] - b[0]
        stay = {(b[2].rule, b[0], b[1]) for b in every if not any(a[0] <= b[0] and a[1] >= b[1] and beats(a, b) for a in every)}
        assert got.get(i, set()) == stay


def test_awkward_rows(make_docs, awkward):
    rows = [*awkward, (20, "under the mit license"), (20, "under the mit license"), (None, "under the MIT license")]
    got = licenses.scan(make_docs(*rows)).collect()
    assert len(got) == len(rows)
    assert [(r.n_words, r.n_base, r.first_word, r.last_word) for r in got if r.doc_id == 20] == [(4, 1, 0, 0)] * 2
    assert sum(r.labels == "mit" for r in got) == 3
    assert {r.n_words for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert licenses.scan(make_docs(*rows).limit(0)).collect() == []


@pytest.mark.parametrize("gap", ["\n", "  ", " \t\n    "])
def test_names_with_any_white_space(make_docs, gap):
    names = [
        "GNU General Public License, version 3", "licensed under the Mozilla Public License 2.0", "GNU Affero General Public License",
        "SIL Open Font License 1.1", "All rights reserved", "MIT No Attribution", "Creative Commons Attribution 4.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "Redistribution and use in source and binary forms",
        "Permission to use, copy, modify, and distribute this software", "free software; you can redistribute it",
        "released to the public domain", "Historical Permission Notice and Disclaimer", "Independent JPEG Group",
    ]
    texts = {i: f"x {name.replace(' ', gap)} y" for i, name in enumerate(names)}
    got = {}
    for r in licenses.detections(make_docs(*texts.items())).collect():
        got.setdefault(r.doc_id, set()).add((r.rule, r["first"], r["last"]))
    for i, text in texts.items():
        every = [(m.start(), m.end(), r) for r in rules() for m in re.finditer(r.pattern, text.lower())]
        beats = lambda a, b: a[2].priority > b[2].priority or a[2].priority == b[2].priority and a[1] - a[0] > b[1] - b[0]
        stay = {(b[2].rule, b[0], b[1]) for b in every if not any(a[0] <= b[0] and a[1] >= b[1] and beats(a, b) for a in every)}
        assert stay and got.get(i, set()) == stay


def test_sql_reads_wrapped_names_alike(spark):
    """Names with line ends, tabs and several spaces between their words, as headers have them."""
    from lumenspan.llm.queries import ORACLES

    texts = [
        "Licensed under the GNU General\nPublic License, version 3", "the  Apache\tLicense,\n   Version 2.0", "released under the\nMIT\nlicense",
        "Mozilla\n   Public License 2.0", "SIL Open\r\nFont License", "Permission is hereby granted, free\nof   charge, to any person", "nothing", "", None,
    ]
    rows = list(enumerate(texts))
    connection = duckdb.connect()
    connection.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    problem, _ = compare.difference(found, connection.sql(ORACLES["op9_license_scan"]))
    assert problem is None
    assert sum(r.labels != "" for r in found.collect()) >= 5
