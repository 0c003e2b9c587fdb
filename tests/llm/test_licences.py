from __future__ import annotations

from fixtures import documents, empty

from fathomline.llm import licences

MIT = licences.MIT.replace("\n", " ")
ROWS = [
    (1, "Released under the MIT License."),
    (2, "Some text.\n  RELEASED under the (MIT) licence!\nMore.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."),
    (3, f"MIT License Copyright (c) 2020 Somebody\n\nCopyright (c) 2020 Somebody\n{licences.MIT}\n\nOther words here."),
    (4, f"Copyright 1999 A. Body\n{MIT.upper().replace('SUBLICENSE', 'sub-licence').replace('HOLDERS', 'OWNERS')}"),
    (5, "Not released under the MIT License."),
    (6, None),
    (7, ""),
    (8, "...\n\n---\n"),
    (1, "Released under the MIT License."),
    (1, "other"),
    (None, "SPDX-License-Identifier: ISC"),
    (9, "x\n" * 5000 + "Licensed under the Apache License, Version 2.0."),
]


def test_scan(spark):
    found = licences.scan_licences(documents(spark, ROWS)).collect()
    got = sorted((str(r["doc_id"]), str(r["licence"]), r["n_hits"], r["licences"]) for r in found)
    want = [
        (1, "MIT", 1, "MIT"),
        (1, "MIT", 1, "MIT"),
        (1, None, 0, ""),
        (2, None, 3, "CC-BY-NC-4.0,MIT"),
        (3, None, 1, "MIT"),
        (4, "MIT", 2, "MIT"),
        (5, None, 0, ""),
        (6, None, 0, ""),
        (7, None, 0, ""),
        (8, None, 0, ""),
        (None, "ISC", 1, "ISC"),
        (9, None, 1, "Apache-2.0"),
    ]
    assert got == sorted((str(i), str(n), h, s) for i, n, h, s in want)


def test_empty_table(spark):
    assert licences.scan_licences(empty(spark)).count() == 0


def test_telling_words_miss_nothing(spark):
    forms = [r["form"] for r in licences.known_forms(spark).collect()]
    telling = licences.telling_words(forms)
    assert "" not in telling
    for _, text in licences.KNOWN:
        assert any(w in text.lower() for w in telling)
    assert licences.telling_words(["license"]) == [""]


def paragraphs(text, *starts):
    for start in starts:
        text = text.replace(start, "\n\n" + start)
    return text


def test_usual_forms(spark):
    mit = paragraphs(licences.MIT, "The above copyright", "THE SOFTWARE IS")
    isc = paragraphs(licences.ISC, "THE SOFTWARE IS")
    notice = paragraphs(licences.APACHE_NOTICE, "http://", "Unless required")
    texts = dict(licences.KNOWN)
    regents = licences._file("BSD")
    bsd = licences.BSD_CONDITIONS + licences.BSD_NAMES + licences.BSD_DISCLAIMER.replace("COPYRIGHT HOLDERS AND", "COPYRIGHT\nOWNERS AND")
    rows = [
        (1, f"MIT License\n\nCopyright (c) 2020 Somebody\n\n{mit}\n"),
        (2, f"Before.\n\nCopyright The Some Authors\nAll rights reserved.\n\n{mit}\n\nAfter, {mit}"),
        (3, isc),
        (4, "\n".join(f"# {line}" for line in notice.split("\n")) + "\nimport x"),
        (5, regents),
        (6, f"BSD 3-Clause License\n\n{bsd}"),
        (7, f"Read this:\n\n{licences._file('GPL-3')}"),
        (8, licences._file("MPL-2.0")),
        (9, f"Not all of it. {mit}"),
        (10, licences.UNLICENSE),
    ]
    found = {r["doc_id"]: (r["licence"], r["licences"]) for r in licences.scan_licences(documents(spark, rows)).collect()}
    assert found[1] == ("MIT", "MIT") and found[2] == (None, "MIT") and found[3] == ("ISC", "ISC")
    assert found[4] == (None, "Apache-2.0") and found[5] == found[6] == ("BSD-3-Clause", "BSD-3-Clause")
    assert found[7][0] is None and "GPL-3.0" in found[7][1].split(",") and found[8][0] == "MPL-2.0"
    assert found[9] == (None, "") and found[10] == ("Unlicense", "Unlicense")
    assert {"CC0-1.0", "LGPL-2.1", "LGPL-3.0"} <= set(texts)
