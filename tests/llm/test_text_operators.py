import datetime as dt
import random
import textwrap

import pytest
from fleetcast.llm.licenses import _BSD, _BSD_REST, _BSD_THIRD, _MIT, _MIT_REST, TEMPLATES, detect_licenses, heaviest, scan_licenses
from fleetcast.llm.line_dedup import dedup_lines
from fleetcast.llm.revisits import canonical_url, resolve_revisits
from fleetcast.llm.url_filters import judge_urls
from pyspark.sql import functions as F


def deleted(docs, least):
    """Brute force: every run of lines with words, and whether it occurs at an earlier position."""
    lines = {d: [(i, x.strip(" \t\r")) for i, x in enumerate(t.split("\n")) if x.strip(" \t\r")] for d, t in docs}
    runs = {}
    for d in sorted(lines):
        for s in range(len(lines[d])):
            for e in range(s + 1, len(lines[d]) + 1):
                runs.setdefault(tuple(x for _, x in lines[d][s:e]), []).append((d, s, e))
    out = {d: set() for d in lines}
    for run, places in runs.items():
        if sum(len(x.split()) for x in run) >= least:
            for d, s, e in places[1:]:
                out[d] |= {i for i, _ in lines[d][s:e]}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{i}{j}" for j in range(rng.choice([1, 2, 3, 7]))) for i in range(8)]
    docs = [(d, "\n".join(rng.choice([*pool, "", " \t"]) for _ in range(rng.randint(1, 14)))) for d in range(14)]
    got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=6)
    want = deleted(docs, 6)
    for r in got.collect():
        text = dict(docs)[r.doc_id]
        assert set(r.deleted_lines) == want[r.doc_id]
        assert r.text == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want[r.doc_id])


def test_line_dedup_odd_rows(spark):
    long = "\n".join(f"line {i} of many words here" for i in range(3000))
    rows = [(1, None), (2, ""), (3, "a b c\nd"), (3, "a b c\nd"), (4, "x\na b c\nd"), (None, "a b c\nd"), (5, long), (6, long), (7, "\n\n")]
    df = spark.createDataFrame([(*r, "keep", [7]) for r in rows], "doc_id long, text string, idx string, deleted_lines array<int>")
    got = sorted(((r.doc_id, r.text) for r in dedup_lines(df, min_words=4).collect()), key=str)
    # Null ids come first, so its text stays; the two equal rows of id 3 are one document and both lose theirs.
    assert got == sorted([(1, None), (2, ""), (3, ""), (3, ""), (4, "x"), (None, "a b c\nd"), (5, long), (6, ""), (7, "\n\n")], key=str)
    assert dedup_lines(df.limit(0)).collect() == []


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "/fr", "block"), ("b.org", "/fr/", "block"), ("", "/", "block"), (None, "/", "block")]
URLS = [
    ("http://EXAMPLE.net/en/x?q", "example.net", "/en/x", "example.net/en/", "allow"),
    ("http://x.example.net/de/", "x.example.net", "/de/", "net/", "block"),
    ("https://myexample.com/de/", "myexample.com", "/de/", None, "allow"),
    ("https://example.com/de/1#f", "example.com", "/de/1", "example.com/de/", "block"),
    ("https://net", "net", "", None, "allow"),
    ("https://NET?x", "net", "", None, "allow"),
    ("https://a.org/frx", "a.org", "/frx", "a.org/fr", "block"),
    ("https://b.org/fr/", "b.org", "/fr/", "b.org/fr/", "block"),
    ("https://a..net/y", "a..net", "/y", "net/", "block"),
    ("ÄB://Ä.NET/é", "Ä.net", "/é", "net/", "block"),
    ("no scheme.net/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("x://y.net/" + "a/" * 50_000, "y.net", "/" + "a/" * 50_000, "net/", "block"),
]


def test_url_filters(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    df = spark.createDataFrame([(i, u, "old") for i, (u, *_) in enumerate(URLS)] + [(0, URLS[0][0], "old")], "page_id long, url string, rule string")
    got = judge_urls(df, rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    rows = sorted(map(tuple, got.collect()), key=lambda r: r[0])
    assert rows == [(0, *URLS[0]), *[(i, *u) for i, u in enumerate(URLS)]]
    assert {r.verdict for r in judge_urls(df, rules.limit(0)).collect()} == {"allow"}
    assert judge_urls(df.limit(0), rules).collect() == []


def test_canonical_urls(spark):
    cases = {
        "HTTP://User@Example.COM:80/a?utm_source=x&b=1&ref=2#f": "http://example.com/a?b=1",
        "https://example.com.:443": "https://example.com/",
        "https://example.com/?gclid=1": "https://example.com/",
        "http://example.com:8080/?a=1&refx=2": "http://example.com:8080/?a=1&refx=2",
        "nothing": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == cases


def test_revisits(spark):
    t = lambda day, s=0: dt.datetime(2024, 1, day, 0, 0, s)
    response = {"etag": '"a"', "content-type": "text/html", "date": "old"}
    rows = [
        (1, "http://x.org/", t(1), "response", 200, response, "d1"),
        (2, "http://x.org/#f", t(9), "revisit", 304, {"etag": 'W/"a"', "date": "new", "content-length": "0"}, None),
        (3, "http://X.org", t(1), "revisit", 304, {"etag": '"a"'}, None),
        (4, "http://x.org/", t(9, 5), "response", 200, {"last-modified": "m"}, "d4"),
        (5, "http://x.org/", t(9, 6), "revisit", 304, {"etag": '"a"', "last-modified": "n"}, None),
        (6, "http://x.org/", t(20), "revisit", 304, None, "d4"),
        (7, "http://x.org/", t(20), "revisit", 304, None, None),
        (7, "http://x.org/", t(20), "revisit", 304, None, None),
        (8, None, t(20), "revisit", 304, {}, None),
        (9, "http://x.org/", None, "revisit", 304, {}, None),
        (10, "http://x.org/", t(19), "response", 404, {}, "d"),
        (11, "http://y.org/", t(2), "revisit", 304, {}, None),
    ]
    df = spark.createDataFrame([(*r, "span") for r in rows], "record_id long, url string, time timestamp, type string, status int, headers map<string,string>, payload_digest string, span string")
    got = sorted((r.record_id, r.refers_to, r.outcome, r.headers) for r in resolve_revisits(df).collect() if r.record_id != 7)
    assert got == [
        (2, 1, "matched", {"etag": 'W/"a"', "content-type": "text/html", "date": "new"}),
        (3, None, "unresolved", None),
        (5, 4, "mismatch", None),
        (6, 4, "matched", {"last-modified": "m"}),
        (8, None, "unresolved", None),
        (9, None, "unresolved", None),
        (11, None, "unresolved", None),
    ]
    assert [(r.refers_to, r.outcome) for r in resolve_revisits(df).where("record_id = 7").collect()] == [(4, "unchecked")] * 2
    assert resolve_revisits(df.limit(0)).collect() == []


def test_licenses(spark):
    mit, gpl = (next(t for n, t in TEMPLATES if n == name) for name in ("MIT", "GPL-3.0"))
    rows = [
        ("r/LICENSE", "some words\n" + mit),
        ("r/a.txt", "own\n" + gpl),
        ("r/b.txt", "nothing"),
        ("r/s/t/c.txt", "nothing"),
        ("r/s/COPYING.md", gpl),
        ("r/s/notes.txt", None),
        ("LICENSEX/d.txt", ""),
        ("top.txt", "licensed version of a very long line that only mentions some words of a license among others"),
        (None, mit),
        ("r/b.txt", "nothing"),
    ]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "path string, text string, dir string, depth int")
    got = sorted(((r.path, r.license, r.license_from, r.license_dir) for r in scan_licenses(df).collect()), key=str)
    assert got == sorted(
        [("r/LICENSE", "MIT", "own", None), ("r/a.txt", "GPL-3.0", "own", None), ("r/b.txt", "MIT", "inherited", "r"), ("r/b.txt", "MIT", "inherited", "r"), ("r/s/t/c.txt", "GPL-3.0", "inherited", "r/s"),
         ("r/s/COPYING.md", "GPL-3.0", "own", None), ("r/s/notes.txt", "GPL-3.0", "inherited", "r/s"), ("LICENSEX/d.txt", None, "none", None), ("top.txt", None, "none", None), (None, None, "none", None)],
        key=str,
    )
    assert scan_licenses(df.limit(0)).collect() == [] and detect_licenses(df, []).collect() == []


def wrapped(text, width, mark=""):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_license_files_and_wrapped_headers(spark):
    """Files as they stand in repositories: whole licenses, openings of long ones, headers wrapped in comments above code."""
    code = "\n\ndef f(x):\n    return x + 1\n" + "\n".join(f"y{i} = f({i})" for i in range(200))
    apache = (
        "# Copyright 2019 Some Body\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n"
        "# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n"
    )
    gnu = "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */"
    rows = {
        "mit/LICENSE": ("MIT License\n\nCopyright (c) 2020 Some Body\n\n" + wrapped(_MIT, 79) + "\n\n" + wrapped(_MIT_REST, 79), "MIT"),
        "bsd/LICENSE": ("Copyright 2011, Some Body\nAll rights reserved.\n\n" + wrapped(f"{_BSD} {_BSD_THIRD} {_BSD_REST}", 72), "BSD-3-Clause"),
        "bsd2/LICENSE.txt": ("Copyright 2011, Some Body\n\n" + wrapped(f"{_BSD} {_BSD_REST}", 72), "BSD-2-Clause"),
        "apache/LICENSE": ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n" + "more terms " * 900, "Apache-2.0"),
        "gpl/COPYING": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n\n" + "many terms " * 3000, "GPL-3.0"),
        "lgpl/COPYING": ("                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + "terms " * 300, "LGPL-3.0"),
        "a/x.py": (apache + code, "Apache-2.0"),
        "b/x.c": (gnu + code, "GPL-3.0"),
        "c/x.js": ("/*\n" + wrapped(_MIT, 70, " * ") + "\n */" + code, "MIT"),
        "d/x.py": (code, None),
        "e/readme.txt": ("The above text and this list of conditions was provided with a general copy of the public version of 2 and 3.\n" * 5, None),
    }
    df = spark.createDataFrame([(p, t) for p, (t, _) in rows.items()], "path string, text string")
    got = {r.path: (r.license, r.license_from) for r in scan_licenses(df).collect()}
    assert got == {p: (name, "own" if name else "none") for p, (_, name) in rows.items()}


def test_clashing_columns(spark):
    names = ["_row", "_gone", "_doc", "_tie", "_own_tie", "_own_doc", "_lines", "_numbers", "_deleted", "doc", "tie", "idx", "_rule", "_verdict", "_hit_url", "_url", "_own", "_best", "_path", "_key", "_place", "_dir", "_license", "_score", "path", "dir"]
    names = [n for n in names if n != "path"]
    df = spark.createDataFrame([(1, "a b c d e f\nx\na b c d e f", "http://a.net/x", "p/q", *range(len(names)))], "doc_id long, text string, url string, path string, " + ", ".join(f"`{n}` int" for n in names))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for got in (dedup_lines(df, min_words=6), judge_urls(df, rules), scan_licenses(df)):
        row = got.collect()[0]
        assert [row[n] for n in names] == list(range(len(names)))
    assert dedup_lines(df, min_words=6).first().text == "a b c d e f\nx"


def test_null_ids_lose_repeated_lines(spark):
    run = "a b c d e f"
    rows = [(None, f"{run}\nx\n{run}"), (None, f"y\n{run}"), (None, f"y\n{run}"), (1, f"z\n{run}"), (-(1 << 63), f"v\n{run}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in dedup_lines(df, min_words=6).collect()), key=str)
    # The first copy, by a hash of the text among null ids, is kept once (or twice, where the repeated row has it).
    kept = [t for i, t in got if i is None]
    assert sum(run in t for t in kept) in (1, 2) and all(t.count(run) <= 1 for t in kept)
    assert [t for i, t in got if i is not None] == ["v", "z"]
    texts = spark.createDataFrame([("b", run), (None, run), ("", run)], "doc_id string, text string")
    assert {(r.doc_id, r.text) for r in dedup_lines(texts, min_words=6).collect()} == {(None, run), ("", ""), ("b", "")}


def test_null_record_ids(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [(None, "http://x.org/", t(1), "response", 200, {"etag": "a"}, None), (None, "http://x.org/", t(2), "revisit", 304, {"etag": "a"}, None), (5, "http://x.org/", t(3), "revisit", 304, {"etag": "b"}, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, time timestamp, type string, status int, headers map<string,string>, payload_digest string")
    got = sorted(((r.record_id, r.refers_to, r.outcome, r.headers) for r in resolve_revisits(df).collect()), key=str)
    assert got == [(5, None, "mismatch", None), (None, None, "matched", {"etag": "a"})]


def test_heaviest_words_are_needed():
    vector = {"a": 3.0, "b": 2.0, "c": 1.0, "d": 0.5}
    kept = heaviest(vector, 0.7)
    norm = sum(x * x for x in vector.values()) ** 0.5
    assert sum(x * x for w, x in vector.items() if w not in kept) ** 0.5 / norm < 0.7


def test_null_ids_whose_hashes_collide_in_part(spark):
    """Texts that agree in 33 bits of their hash: the unique line of the second stays, its repeated one goes."""
    rows = [(None, "a b c d e f\nu87224"), (None, "v146259\na b c d e f"), (7, "a b c d e f\nu87224"), (7, "v146259\na b c d e f")]
    bits = spark.createDataFrame(rows[:2], "id long, text string").select(F.pmod(F.xxhash64("text"), F.lit(1 << 33)).alias("h"))
    assert len({r.h for r in bits.collect()}) == 1
    for ids in (rows[:2], rows[2:]):
        got = {r.text: r.left for r in dedup_lines(spark.createDataFrame(ids, "doc_id long, text string").withColumn("left", F.col("text")), min_words=6, text_col="left").collect()}
        assert sorted(got.values()) in (["a b c d e f\nu87224", "v146259"], ["u87224", "v146259\na b c d e f"])


def test_many_rows_without_ids(spark):
    """Twenty thousand null ids: a repeated line goes from all but one row, and every other line stays where it was."""
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("a b c d e f\nu"), "id")).otherwise(F.concat(F.lit("u"), "id", F.lit("\na b c d e f"))).alias("text"))
    got = dedup_lines(docs, min_words=6)
    kept = [r.text for r in got.collect()]
    assert len(kept) == 20_000 and len(set(kept)) == 20_000
    assert sum("a b c" in t for t in kept) == 1 and sorted(int(x[1:]) for t in kept for x in t.split("\n") if x[0] == "u") == list(range(20_000))


def test_license_units_stay_in_their_rows(spark):
    """Every line has words of many templates; no unit, word or pair of unit and template moves between tasks, only each path's best."""
    common = "this license and the software with a copy of the public version of {}"
    rows = [(f"d/{i}.txt", "\n".join(common.format(j) for j in range(40)) + ("\nThe MIT License (MIT)" if i % 10 == 0 else "")) for i in range(100)]
    # Rows of one path are one file; a line that both have, or one twice, scores as it does once.
    rows += [("d/1.txt", "The MIT License (MIT)\nThe MIT License (MIT)"), ("d/1.txt", "The MIT License (MIT)")]
    found = detect_licenses(spark.createDataFrame(rows, "path string, text string").repartition(4))
    got = {r.path: (r.license, r.score) for r in found.collect()}
    assert got == dict.fromkeys([f"d/{i}.txt" for i in (*range(0, 100, 10), 1)], ("MIT", 1.0))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
