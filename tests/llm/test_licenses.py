import textwrap

from pathweave.llm import licenses, queries
from pathweave.llm.license_forms import FORMS

GPL = "This work is licensed under the GNU General Public License, version 3."
MIT = "Released under the MIT License."


def scanned(spark, rows, templates=licenses.TEMPLATES):
    files = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, path string, text string, license string")
    return {r.doc_id: (r.own_license, r.license, r.license_dir, r.levels_up) for r in licenses.scan(files, licenses.template_table(spark, templates)).collect()}


def test_headers_and_inheritance(spark):
    rows = [(1, "/a/LICENSE", GPL), (2, "/a/b/c/x", "nothing"), (3, "/a/b/c/y", "prose\n" + MIT), (4, "/a/b/c/d/z", "prose only"), (5, "/q/x", "prose"),
            (6, "/a/b/NOTICE", MIT + "\nmore prose follows here and here"), (7, "/a/x", "our license is a secret"), (8, "/a/b/AAA", GPL.upper()),
            (9, "/a/y", "Licensed under the Apache License, Version 2.0.\nand some")]
    assert scanned(spark, rows) == {
        1: ("GPL-3.0", "GPL-3.0", None, None), 2: (None, "GPL-3.0", "/a/b", 1), 3: ("MIT", "MIT", None, None), 4: (None, "GPL-3.0", "/a/b", 2),
        5: (None, None, None, None), 6: ("MIT", "MIT", None, None), 7: (None, "GPL-3.0", "/a", 0), 8: ("GPL-3.0", "GPL-3.0", None, None),
        9: ("Apache-2.0", "Apache-2.0", None, None)}


def test_versions_are_told_apart(spark):
    got = scanned(spark, [(i, f"/f{i}/x", t) for i, (_, t) in enumerate(licenses.TEMPLATES)])
    assert [got[i][0] for i in range(len(got))] == [name for name, _ in licenses.TEMPLATES]


def test_odd_rows(spark):
    rows = [(1, None, None), (2, None, MIT), (3, "/a/x", ""), (4, "/a/x", None), (None, "/a/y", MIT), (5, "/a/y", MIT), (6, "/b/long", "w " * 20000 + "\n" + GPL)]
    got = scanned(spark, rows)
    assert got[2][0] == "MIT" and got[1][:2] == (None, "MIT") and got[3] == got[4] == (None, "MIT", "/a", 0) and got[None][0] == got[5][0] == "MIT" and got[6][0] == "GPL-3.0"
    assert scanned(spark, []) == {}
    assert scanned(spark, [(1, "/a/x", MIT)], templates=[])[1] == (None, None, None, None)


def test_no_python_runs(spark, sf_dir):
    text = queries.op2_licenses(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(word in text for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_licenses_of_several_lines(spark):
    wrap = lambda text, sign="", width=70: "\n".join(sign + line for line in textwrap.wrap(text, width))
    of = lambda name, start: next(text for license, text in FORMS if license == name and text.startswith(start))
    prose = "some words about nothing in particular, line after line\n" * 30
    bsd = of("BSD-3-Clause", "Redistribution").replace("copyright holder nor the names of its", "University nor the names of other").replace("HOLDERS AND", "OWNERS AND")
    cases = [
        (wrap(of("MPL-2.0", "This Source"), "// ") + "\n\nint main() {}\n" + prose, "MPL-2.0", True),
        ("#!/usr/bin/python\n# tool.py - a tool of ours\n# Copyright (C) 2019 Jane Doe\n#\n" + wrap(of("GPL-3.0", "This program").replace("; you", ": you"), "# ") + "\n" + prose, "GPL-3.0", False),
        ("Copyright (c) 2019, Jane Doe\nAll rights reserved.\n\n" + wrap(bsd), "BSD-3-Clause", True),
        ("MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + wrap(of("MIT", "Permission")), "MIT", True),
        ("/* SPDX-License-Identifier: MIT */\n" + prose, "MIT", True), ("x\n# SPDX-License-Identifier: GPL-2.0-or-later\n", "GPL-2.0", False),
        ("// SPDX-License-Identifier: Zlib OR Apache-2.0\n", "Zlib OR Apache-2.0", True), ("# SPDX-License-Identifier: NONE\n", None, False),
        (prose + GPL.replace("GNU General", "GNU\nGeneral") + "\n" + prose, "GPL-3.0", False),
        (prose + "our license and the copyright of others give permission to no one\n" + prose, None, False)]
    files = spark.createDataFrame([(i, f"/{i}/x", t) for i, (t, *_) in enumerate(cases)] + [(100 + i, f"/{i}/below/y", "prose") for i in range(len(cases))], "doc_id long, path string, text string")
    got = {r.doc_id: r for r in licenses.scan(files, licenses.template_table(spark), forms=licenses.TEMPLATES + FORMS).collect()}
    assert [got[i].own_license for i in range(len(cases))] == [name for _, name, _ in cases]
    assert [got[100 + i].license for i in range(len(cases))] == [name if opens else None for _, name, opens in cases]


def test_forms_are_told_apart(spark):
    files = spark.createDataFrame([(i, f"/{i}/x", t) for i, (_, t) in enumerate(FORMS)], "doc_id long, path string, text string")
    got = {r.doc_id: r for r in licenses.scan(files, licenses.template_table(spark), forms=licenses.TEMPLATES + FORMS).collect()}
    assert [got[i].own_license for i in range(len(FORMS))] == [name for name, _ in FORMS]
