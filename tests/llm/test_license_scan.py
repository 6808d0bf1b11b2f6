"""Notices of every family, frequent and wrapped over lines, among ordinary prose."""

import textwrap
import time

import pytest

from cellscape.llm.license_scan import scan, train

NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files.",
    "gpl": "SPDX-License-Identifier: GPL-3.0-or-later license",
    "lgpl": "This work is licensed under the GNU Lesser General Public License.",
    "agpl": "Released under the AGPL-3.0 license.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "mpl": "Released under the Mozilla Public License, v. 2.0.",
    "cc-by": "Licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under CC BY-SA 4.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc0": "CC0 1.0 Universal",
    "proprietary": "Unauthorized copying of this file is strictly prohibited.",
}


@pytest.mark.parametrize("width", [200, 34])
def test_frequent_notices_of_every_family(spark, width):
    families = list(NOTICES)
    prose = "The use of a new version is open to any person.\nWe met at the river, and the work went on."
    rows, wanted = [], set()
    for i in range(720):  # a third of all rows has a notice
        family = families[i // 3 % len(families)] if i % 3 == 0 else None
        notice = "\n".join(textwrap.wrap(NOTICES[family], width, break_on_hyphens=False)) if family else None
        rows.append((i, f"{prose}\n\n{notice}\n\nThe end of part {i}." if notice else f"{prose}\nThe end of part {i}."))
        if family:
            wanted.add((i, family))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.paragraph, r.family) for r in scan(docs, train(docs)).collect()]
    assert {(d, f) for d, _, f in got if f != "unknown"} == wanted and {d for d, _, _ in got} == {d for d, _ in wanted}
    assert all(3 <= p <= 6 for _, p, _ in got)


def test_odd_rows(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [(1, notice, 0, "x"), (1, notice, 0, "x"), (None, notice, 0, "x"), (2, None, 0, "x"), (3, "", 0, "x"), (4, "\n\n\x01\x02", 0, "x"), (5, "plain words only\n" * 20_000 + notice, 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, paragraph int, family string")
    scanner = train(docs)
    got = sorted((r.doc_id or 0, r.paragraph, r.family) for r in scan(docs, scanner).collect())
    assert got == [(0, 0, "apache-2.0"), (1, 0, "apache-2.0"), (1, 0, "apache-2.0"), (5, 20_000, "apache-2.0")]
    assert scan(docs.limit(0), scanner).count() == 0


def test_unseen_licences_are_unknown(spark):
    """Licences that training never named come out as `unknown`, in frames it knows and in one that it doesn't; prose gives no row."""
    names = ["Sleepycat License", "Academic Free License v3.0", "NCSA Open Source License", "Harbour Road License", "Open Software License 3.0"]
    seen = ["ISC License", "The Unlicense", "EUPL-1.2", "Open Database License (ODbL) v1.0", "Eclipse Public License 2.0", "Boost Software License 1.0"]
    notices = [*[f.format(n) for n in names for f in ("{}", "Licensed under the {}.", "Files here are covered by the {}")], *seen]
    prose = ["We met at the river, and the work went on.", "She renewed her driving license at the office", "his fishing license was lost in the storm", "the public library is open", "a new version of the report"]
    docs = spark.createDataFrame([(i, f"The first line.\n\n{t}\n\nThe end.") for i, t in enumerate(notices + prose)], "doc_id long, text string")
    got = {r.doc_id: r.family for r in scan(docs, train(docs)).collect()}
    assert got == {i: "unknown" for i in range(len(notices))}


def test_training_does_not_depend_on_partitions(spark):
    rows = [(i, f"plain line {i} of the work in version {i % 7}\nunder the file {i}\n" * 3) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({tuple(sorted(train(d).vectors.vocabulary)) for d in (docs.repartition(2), docs.repartition(7), docs.coalesce(1))}) == 1


def test_long_white_space_is_linear(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    docs = spark.createDataFrame([(1, "a" + " " * (1 << 20) + "b\n" + notice), (2, " " * (1 << 20) + ".\n" + " " * (1 << 20) + notice)], "doc_id long, text string")
    scanner = train(docs.limit(0))
    began = time.perf_counter()
    assert {(r.doc_id, r.family) for r in scan(docs, scanner).collect()} == {(1, "apache-2.0"), (2, "apache-2.0")}
    assert time.perf_counter() - began < 30
