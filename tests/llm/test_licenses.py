from tidelog.llm import licenses as m

APACHE, GPL = "Licensed under the Apache License, Version 2.0", "This work is licensed under the GNU General Public License, version 3"


def scan(spark, rows):
    files = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, path string, text string, PATH int")
    return {r["key"]: (r["license"], r["origin"], r["origin_path"]) for r in m.scan(files).collect()}


def test_own_and_inherited(spark):
    got = scan(spark, [
        (1, "LICENSE", GPL + ".\n"), (2, "a/LICENSE.txt", "MIT\n\nReleased under the MIT License."), (3, "a/b/c/x.py", "print(1)"), (4, "a/b/own.py", f"# {APACHE}.\nprint(1)"),
        (5, "z/y.py", None), (6, "top.py", ""), (7, None, "text"), (8, "a/b/c/x.py", "print(1)"), (9, "a", "the under version of it"), (10, "a/b/tail.md", "words\n" * 3000 + APACHE),
    ])
    assert got == {
        1: ("GPL-3.0", "own", "LICENSE"), 2: ("MIT", "own", "a/LICENSE.txt"), 3: ("MIT", "inherited", "a/LICENSE.txt"), 4: ("Apache-2.0", "own", "a/b/own.py"), 5: ("GPL-3.0", "inherited", "LICENSE"),
        6: ("GPL-3.0", "inherited", "LICENSE"), 7: (None, None, None), 8: ("MIT", "inherited", "a/LICENSE.txt"), 9: ("GPL-3.0", "inherited", "LICENSE"), 10: ("Apache-2.0", "own", "a/b/tail.md"),
    }


def test_empty_and_no_python_in_the_plan(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    plans, write = [], m.cut

    def cut(df, *name):
        plans.append(df._jdf.queryExecution().toString())
        return write(df, *name)

    m.cut = cut
    try:
        out = m.report(empty)
    finally:
        m.cut = write
    assert out.count() == 0
    plans.append(out._jdf.queryExecution().toString())
    assert len(plans) >= 4 and not any(x in plan for plan in plans for x in ("Python", "Pandas", "InArrow"))


def test_versions_and_variants_are_told_apart(spark):
    gpl2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    lgpl = gpl2.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2 ", "version 2.1 ")
    sharealike = "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    two = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    third = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    got = scan(spark, [(1, "a", gpl2), (2, "b", lgpl), (3, "c", sharealike), (4, "d", two), (5, "e", f"{two}\n\n{third}")])
    assert {k: v[0] for k, v in got.items()} == {1: "GPL-2.0", 2: "LGPL-2.1", 3: "CC-BY-SA-4.0", 4: "BSD-2-Clause", 5: "BSD-3-Clause"}


def test_of_equal_licence_files_the_first_path_counts(spark):
    got = scan(spark, [(1, "x/LICENSE-b", "Released under the MIT License"), (2, "x/LICENSE-a", GPL), (3, "x/y/f.txt", "words")])
    assert got[3] == ("GPL-3.0", "inherited", "x/LICENSE-a")


def test_anchors_lose_no_unit():
    v = m.Vectors()
    for t in range(len(m.TEMPLATES)):
        rest = sum(w * w for term, i, _, w in v.rows if i == t and term not in v.anchors)
        assert rest**0.5 < m.THRESHOLD
