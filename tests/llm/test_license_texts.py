"""Whole licence texts, headers wrapped over lines and long licences are known; other texts are not."""

import textwrap

from tidewell.llm import license_scan


def commented(text, mark):
    return "\n".join(f"{mark} {line}" for line in textwrap.wrap(text, 60))


def test_files_and_wrapped_headers(spark):
    code = "def f(x):\n    return x + 1\n\n\ndef g(x):\n    return f(x) * 2\n" * 30
    copyright_line = "Copyright (c) 2019 Some Body"
    long_text = "\n\n".join(f"{n}. Terms of section {n} say what is granted, what is not, and to whom it is conveyed." for n in range(40))
    gpl_end = "\n\n".join(license_scan._gnu("GNU General Public License", "3")[:1])
    files = [
        (1, "a/LICENSE", f"The MIT License\n\n{copyright_line}\n\n{license_scan._MIT}\n\n{license_scan._AS_IS}\n", "MIT"),
        (2, "b/LICENSE", f"{copyright_line}\n\n{license_scan._BSD}\n\n{license_scan._BSD_AS_IS}\n", "BSD-2-Clause"),
        (3, "c/LICENSE", f"{copyright_line}\n\n{license_scan._BSD}\n{license_scan._BSD_3}\n\n{license_scan._BSD_AS_IS}\n", "BSD-3-Clause"),
        (4, "d/x.py", f"# {copyright_line}\n#\n{commented(license_scan._APACHE, '#')}\n\n{code}", "Apache-2.0"),
        (5, "e/x.js", f"/*\n{commented(license_scan._MPL, ' *')}\n */\n{code}", "MPL-2.0"),
        (6, "f/COPYING", f"{long_text}\n\n{gpl_end}\n\n{long_text}", "GPL-3.0"),
        (7, "g/x.c", f"{commented(license_scan._gnu('GNU Lesser General Public License', '2.1')[1], '//')}\n\n{code}", "LGPL-2.1"),
        (8, "h/LICENSE", f"{copyright_line}\n\n{license_scan._ZLIB}", "Zlib"),
        (9, "i/x.py", code, None),
        (10, "j/notes.txt", "Please copy the files and use them for any purpose you like.\nThe software works without warranty of mine.", None),
    ]
    filler = [(100 + i, f"z{i}/t.txt", f"the of and to a in is that it for as with this be by on not {i} any use copy software", None) for i in range(300)]
    df = spark.createDataFrame([x[:3] for x in files + filler], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["licence"] for r in license_scan.scan(df).collect()}
    assert {i: got[i] for i, *_ in files} == {i: want for i, _, _, want in files}
    assert all(got[i] is None for i, *_ in filler)
