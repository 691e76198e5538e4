from __future__ import annotations

import math
from collections import Counter

from calltide.llm import licenses


def brute_best(texts, text, whole):
    """Dense cosines over the corpus vocabulary."""
    df = Counter(w for t in texts for w in set(licenses.words_of(t or "")))
    known = {w for ts in licenses.TEMPLATES.values() for t in ts for w in licenses.words_of(t)}
    idf = lambda w: math.log((1 + len(texts)) / (1 + (df[w] if w in known else 0))) + 1
    vec = lambda t: {w: n * idf(w) for w, n in Counter(licenses.words_of(t)).items()}
    best = (0.0, None)
    for segment in licenses.segments(text or "", whole):
        a = vec(segment)
        for name, ts in licenses.TEMPLATES.items():
            for t in ts:
                b = vec(t)
                c = sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
                best = max(best, (round(c, 9), name), key=lambda x: x[0])
    return best


def test_headers_files_and_inheritance(spark):
    files = [
        (1, "r/a/LICENSE", "Released under the MIT License."),
        (2, "r/a/b/c/x.py", "# prose\nno header here"),
        (3, "r/a/b/COPYING.txt", "SPDX-License-Identifier: GPL-3.0-only"),
        (4, "r/a/y.py", "one\nLicensed under the Apache License,\nVersion 2.0.\nmore words"),
        (5, "r/z.py", "Éa licence to something else entirely, it says"),
        (6, "r/a/b/c/d/e.py", None),
        (7, None, "This work is licensed under the GNU General Public License, version 3."),
        (8, "top.py", ""),
        (2, "r/a/b/c/x.py", "# prose\nno header here"),
        (9, "r/a/long.py", "word " * 200_000 + "\nLicensed under CC BY-NC 4.0."),
        (10, "r/ab/q.py", "x"),
    ]
    df = spark.createDataFrame([(*f, "clash") for f in files], "doc_id long, path string, text string, license string")
    got = {(r.doc_id, r.path): (r.license, r.origin, r.licensed_by) for r in licenses.scan(df).collect()}
    assert got == {
        (1, "r/a/LICENSE"): ("MIT", "file", None), (2, "r/a/b/c/x.py"): ("GPL-3.0", "inherited", "r/a/b"), (3, "r/a/b/COPYING.txt"): ("GPL-3.0", "file", None), (4, "r/a/y.py"): ("Apache-2.0", "header", None),
        (5, "r/z.py"): (None, None, None), (6, "r/a/b/c/d/e.py"): ("GPL-3.0", "inherited", "r/a/b"), (7, None): ("GPL-3.0", "header", None), (8, "top.py"): (None, None, None),
        (9, "r/a/long.py"): ("CC-BY-NC-4.0", "header", None), (10, "r/ab/q.py"): (None, None, None),
    }
    assert licenses.scan(df).count() == len(files)
    assert licenses.scan(df.limit(0)).count() == 0
    texts = [f[2] for f in files]
    for r in licenses.own_licences(df).collect():
        score, name = brute_best(texts, texts[[f[0] for f in files].index(r.doc_id)], bool(r.path and r.path.split("/")[-1].split(".")[0].lower() in licenses.LICENCE_FILES))
        assert abs(r.own_score - (score if score >= licenses.THRESHOLD else 0)) < 1e-6
        assert r.own_license == (name if score >= licenses.THRESHOLD else None)


def test_every_template_passes_the_gate(spark):
    templates = licenses.TEMPLATES | {"Own": ("Everybody may use these scribblings.",)}
    for name, texts in templates.items():
        for t in texts:
            assert not licenses.gate(templates).isdisjoint(licenses.words_of(t)), name
    files = [(k, f"r/f{k}.py", f"# prose about it\n# {t}\nx = 1") for k, t in enumerate(t for ts in templates.values() for t in ts)]
    files += [(100, "r/LICENSE", "Released under the MIT License."), (101, "r/u.py", "# This is free and unencumbered software\n# released into the public domain."), (102, "r/v.py", "free software in the public domain")]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(df, templates=templates).collect()}
    names = [name for name, ts in templates.items() for _ in ts]
    assert [got[k] for k in range(len(names))] == [(name, "header") for name in names]
    assert got[101] == ("Unlicense", "header") and got[102] == ("MIT", "inherited")


def test_whole_licence_files(spark):
    """Usual licence files: other owners and years, other wrapping, a title before and a line after."""
    texts = licenses.all_templates()
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0"]
    files = []
    for k, name in enumerate(names):
        body = texts[name][-1].replace("<year>", "2019-2024").replace("<copyright holders>", "Some Group and Friends").replace("<owner>", "Some Group and Friends")
        wrapped = " ".join(body.split()[: len(body.split()) // 2]) + "\n" + "\n".join(body.split()[len(body.split()) // 2 :])
        files += [(2 * k, f"p{2 * k}/LICENSE", body), (2 * k + 1, f"p{2 * k + 1}/COPYING.md", f"Our project\n\n{wrapped}\nSee the web page for questions.")]
    files += [(100, "p100/LICENSE", "ordinary prose about nothing in particular " * 50), (101, "p0/src/a.py", "code")]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(df, templates=texts).collect()}
    assert {k: got[k] for k in range(2 * len(names))} == {k: (names[k // 2], "file") for k in range(2 * len(names))}
    assert got[100] == (None, None) and got[101] == ("Apache-2.0", "inherited")


def test_names_of_licence_files(spark):
    yes = ["LICENSE", "a/license.txt", "a/b/LICENSE-MIT", "LICENSE-APACHE", "x/MIT-LICENSE", "MIT-LICENSE.txt", "LICENSE_1_0.txt", "LICENSE-APACHE-2.0.md", "COPYING.LESSER", "apache-2.0-license", "Unlicense"]
    no = ["licenses.py", "a/LICENSE/readme", "license-checker.js", "relicense", "mylicense", "test_license_parser.py", "", None]
    df = spark.createDataFrame([(x,) for x in [*yes, *no]], "path string")
    assert [r.path for r in df.where(licenses._is_licence_file(df.path)).collect()] == yes


def test_a_directory_under_two_licences(spark):
    texts = licenses.all_templates()
    files = [(1, "r/LICENSE-MIT", texts["MIT"][-1]), (2, "r/LICENSE-APACHE", texts["Apache-2.0"][-1]), (3, "r/src/a.rs", "code"), (4, "r/src/b.rs", "Released under the BSD 2-Clause License."), (5, "q/c.rs", "code")]
    got = {r.doc_id: (r.license, r.origin, r.licenses) for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string"), templates=texts).collect()}
    assert got[1] == ("MIT", "file", ["MIT"]) and got[2] == ("Apache-2.0", "file", ["Apache-2.0"])
    assert got[3][0] in ("MIT", "Apache-2.0") and got[3][1:] == ("inherited", ["Apache-2.0", "MIT"])
    assert got[4] == ("BSD-2-Clause", "header", ["BSD-2-Clause"]) and got[5] == (None, None, [])
