import os

import pytest
from turfline.llm import license_scan
from turfline.llm.queries import ORACLES

COMMON = "/usr/share/common-licenses"


def scan(spark, texts):
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: (r.license_id, r.line_licenses, r.n_license_lines) for r in rows}


def test_titles(spark):
    mit, isc = license_scan.KNOWN[6][1], license_scan.KNOWN[7][1]
    texts = ["MIT License\n\nCopyright (c) 2020 Somebody\n\n" + mit, "The MIT License (MIT)\n\nCopyright © 2020 Somebody\n\n" + mit, "ISC License\n\nCopyright 2020 x\n" + isc, "Some License\n\n" + mit]
    assert [v[0] for _, v in sorted(scan(spark, texts).items())] == ["MIT", "MIT", "ISC", None]


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no licence texts on this machine")
def test_whole_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [open(f"{COMMON}/{name}").read() for name in names]
    found = scan(spark, texts)
    assert [found[k][0] for k in range(len(names))] == list(names.values())
    assert all(digest not in ORACLES["op7_license_scan"] for _, digest, _ in license_scan.WHOLE)


def test_padded_lines_and_other_lists(spark):
    padded = "a\n" + "Released under" + " -*" * 9_000 + " the MIT License.\nb"
    assert scan(spark, [padded]) == {0: (None, "MIT", 1)}
    docs = spark.createDataFrame([(0, "x\nFree for all to use!\ny")], "doc_id long, text string")
    (row,) = license_scan.scan(docs, known=(("Own", "Free for all to use."),)).collect()
    assert (row.line_licenses, row.n_license_lines) == ("Own", 1)
