"""License scans on edited notices; WARC archives read back, one gzip member a record."""

import gzip
import hashlib
import json

from lodestone.llm.license_scan import license_scan
from lodestone.llm.warc import parse, read_back, records, warc

FILL = "some words of a text that stand around it and say nothing about terms "


def test_siblings_are_told_apart_and_edits_found(spark):
    import random

    from lodestone.llm.license_scan import NOTICES

    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice."
    third = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    cases = [
        (gpl.format("", "2"), {"GPL-2.0"}), (gpl.format("", "3"), {"GPL-3.0"}), (gpl.format("Lesser ", "2.1"), {"LGPL-2.1"}), (gpl.format("Lesser ", "3"), {"LGPL-3.0"}), (gpl.format("Affero ", "3"), {"AGPL-3.0"}),
        (bsd, {"BSD-2-Clause"}), (bsd + third, {"BSD-3-Clause"}), (cc.format(""), {"CC-BY-4.0"}), (cc.format("-ShareAlike"), {"CC-BY-SA-4.0"}), (cc.format("-NonCommercial"), {"CC-BY-NC-4.0"}),
        (cc.format("-NonCommercial-NoDerivatives"), {"CC-BY-NC-ND-4.0"}), ("under the GNU General Public License, version 2.", set()), (gpl.format("", "4"), set()),
        ("GNU General Public License version 2 as published by the Free Software Foundation", {"GPL-2.0"}), ("Licensed under the GNU General Public License v3.0", {"GPL-3.0"}),
        (gpl.format("Library ", "2"), {"LGPL-2.0"}), ("The MIT License (MIT)", {"MIT"}), (cc.format("").replace("4.0 International", "3.0 Unported"), {"CC-BY-3.0"}),
        ("// SPDX-License-Identifier: BSD-3-Clause", {"BSD-3-Clause"}), ("SPDX-License-Identifier: GPL-2.0-only", {"GPL-2.0"}), ("# SPDX-License-Identifier: MIT", {"MIT"}),
        (bsd + third + " " + FILL * 40 + bsd, {"BSD-2-Clause", "BSD-3-Clause"}), (bsd + " " + FILL * 40 + bsd + third, {"BSD-2-Clause", "BSD-3-Clause"}),
    ]
    rows = [(i, FILL + t + " " + FILL) for i, (t, _) in enumerate(cases)]
    rng = random.Random(1)
    edited = []
    for i, (name, t, must) in enumerate(NOTICES):
        words = t.split()
        if len(words) >= 60:
            for k in range(20):  # 3 replaced words leave 0.8 and more of so long a text
                w = list(words)
                for at in rng.sample(range(20, len(w)), 3):
                    w[at] = "changed"
                edited.append((1000 + 100 * i + k, FILL * 2 + " ".join(w)))
        elif len(words) >= 16 and len(words) * 0.2 >= 3:
            for k in range(10):  # one word outside of those that must stand, at the notice's end, so that 0.8 remain
                w = list(words)
                w[-1 - k % 2 if not must else 0] = "changed"
                edited.append((1000 + 100 * i + k, FILL * 2 + " ".join(w) + " " + FILL))
    got = {}
    for r in license_scan(spark.createDataFrame(rows + edited, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license_id)
    assert [got.get(i, set()) for i in range(len(cases))] == [want for _, want in cases]
    found = sum(NOTICES[(i - 1000) // 100][0] in got.get(i, set()) for i, _ in edited)
    assert len(edited) >= 200 and found >= 0.95 * len(edited)


def test_license_scan(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [(i, FILL * (i % 5) + "x " * i + apache + " " + FILL) for i in range(30)]
    rows += [(100, apache.upper().replace(" ", "\n ")), (101, gpl + FILL + apache), (102, FILL * 50), (103, None), (104, ""), (105, "MIT License"), (106, "Released under the MIT License"), (101, gpl)]
    rows += [(107, "This work is licensed under the GNU General Public Licence, version 3."), (108, "licensed under the apache " + FILL + " license version 2 0"), (None, apache)]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, start int, shingles string")
    got = {(r.doc_id, r.license_id): r.containment for r in license_scan(df).collect()}
    want = {(i, "Apache-2.0"): 1.0 for i in [*range(30), 100, 101, None]} | {(101, "GPL-3.0"): 1.0, (106, "MIT"): 1.0}
    assert got == want
    own = {(r.doc_id, r.license_id) for r in license_scan(df, [("Own", "say nothing about terms some words", ""), ("Short", "x", "")]).collect()}
    assert own == {(i, "Own") for i in range(30) if i % 5 >= 2} | {(102, "Own")}
    assert license_scan(df.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    long, other = "<p>é " + "a" * 200, "b" * 99
    rows = [(5, "http://a/5", long), (3, "http://a/3\r\nX: y", long), (9, None, long), (1, "http://a/1", other), (2, "http://a/2", other), (4, "u", None), (6, "u", ""), (7, "u", "c" * 300_000), (None, "u", "WARC/1.1\r\n\r\n" * 9), (5, "http://a/5", long)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, file string").repartition(2)
    top = f"file://{tmp_path}/w"
    got = warc(df, top, archive_bytes=400).collect()
    payload = {p: (h or "").encode() for p, _, h in rows}
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(p), len(payload[p]), hashlib.sha256(payload[p]).hexdigest()) for p, _, _ in rows)
    assert sorted((r.page_id, r.refers_to) for r in got if r.record_type == "revisit") == [(5, 3), (5, 3), (9, 3)]
    archives = sorted((tmp_path / "w/warc").glob("*.warc.gz"))
    assert len(archives) > 1 and not (tmp_path / "w/crawl").exists()
    for a in archives:
        data, entries = a.read_bytes(), [json.loads(x) for x in (a.parent / f"{a.name}.idx").read_text().splitlines()]
        assert sum(e["length"] for e in entries) == len(data)
        for e in entries:
            headers, block, n = parse(gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]))
            assert n and headers["X-Page-ID"] == e["page"]
            if headers["WARC-Type"] == "response" and e["page"] not in ("None", str((1 << 63) - 1)):
                assert block.endswith(payload[int(e["page"])])
        with a.open("rb") as f:
            assert len(list(records(f, step=100))) == len(entries)
    assert read_back(spark.createDataFrame([(a.name,) for a in archives], "file string"), f"{top}/warc").count() == len(rows)
    assert warc(df.limit(0)).count() == 0
