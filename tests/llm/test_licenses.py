import re
import unicodedata

from lodestone.llm import licenses
from tests.llm.helpers import edges, empty, table


def plain(text):
    kept = "".join(c for c in (text or "").lower() if unicodedata.category(c)[0] in "LN" or c in " \t\n\x0b\x0c\r")
    return kept.split()


def grams(w):
    return [tuple(w[i : i + 3]) for i in range(len(w) - 2)]


def gram_size(t):
    size = 1
    while size < 2 * len(grams(plain(t))):
        size *= 2
    return size


KNOWN = [(n, set(grams(plain(t))), gram_size(t), [tuple(m.split()) for m in must]) for n, t, must in licenses.TEMPLATES]
SHORTER = {(a, b) for a, x, _, _ in KNOWN for b, y, _, _ in KNOWN if a != b and len(x) < len(y) and len(x & y) >= 0.8 * len(x)}


def brute(text):
    h, places = grams(plain(text)), []
    there = set(h)
    for name, own, size, must in KNOWN:
        if len(own & there) < 0.8 * len(own):
            continue
        for s in range(0, len(h), size // 2):
            window = set(h[s : s + size])
            if len(own & window) >= 0.8 * len(own) and all(m in window for m in must):
                places.append((name, s, size, len(own & window) / len(own)))
    found = {}
    for name, s, size, share in places:
        meets = lambda o, n, s=s, size=size: s < o + n and o < s + size
        if not any((name, b) in SHORTER and meets(o, n) or name == licenses.RESERVED != b and meets(o - 32, n + 64) for b, o, n, _ in places):
            found[name] = max(share, found.get(name, 0))
    return found


def compare(df):
    got = sorted(((r["doc_id"], r["license"], round(r["contained"], 9)) for r in licenses.licenses(df).collect()), key=repr)
    assert got == sorted(((r["doc_id"], n, round(c, 9)) for r in df.select("doc_id", "text").collect() for n, c in brute(r["text"]).items()), key=repr)
    return got


def test_matches_brute_force(spark):
    got = compare(table(spark, sf="sf0.01"))
    assert {x[1] for x in got} >= {"Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0", licenses.RESERVED}


def test_edges(spark):
    compare(edges(spark))
    assert licenses.licenses(empty(spark)).count() == 0
    text = " ".join(t for _, t, _ in licenses.TEMPLATES) + " filler words of no meaning " * 300
    df = spark.createDataFrame([(None, text), (1, text.upper()), (1, text.upper()), (2, "All rights (c) reserved"), (3, "all, rights\nreserved!")], "doc_id long, text string")
    got = compare(df)
    assert len({x[1] for x in got}) > 15 and (3, licenses.RESERVED, 1.0) in got and not [x for x in got if x[0] == 2]


def test_plan_is_native(spark, capsys, monkeypatch):
    monkeypatch.setattr(licenses, "saved", lambda df, label: df)  # one plan from texts to results
    licenses.licenses(table(spark)).explain()
    assert not re.search("Python|Pandas|Arrow(?!Ev)", capsys.readouterr().out)


def test_licenses_that_share_words_are_told_apart(spark):
    gnu = "Note. {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version. End."
    two = next(t for n, t, _ in licenses.TEMPLATES if n == "BSD-2-Clause")
    three = next(t for n, t, _ in licenses.TEMPLATES if n == "BSD-3-Clause")
    cases = {
        gnu.format("This program", "General Public License", 2): ["GPL-2.0-or-later"], gnu.format("This program", "General Public License", 3): ["GPL-3.0"],
        gnu.format("This library", "Lesser General Public License", 2.1): ["LGPL-2.1-or-later"], gnu.format("This program", "Affero General Public License", 3): ["AGPL-3.0"],
        "Copyright 2001 X. All rights reserved. " + two + " THIS SOFTWARE": ["BSD-2-Clause"], "Copyright 2001 X. All rights reserved. " + three: ["BSD-3-Clause"],
        "Our page. All rights reserved. " + "word " * 20: [licenses.RESERVED], "x Licensed under CC BY-NC-SA 4.0. y": ["CC-BY-NC-SA-4.0"], "x " * 40 + two + " y" * 400 + " All rights reserved.": ["BSD-2-Clause", licenses.RESERVED],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA-4.0"],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {}
    for r in licenses.licenses(df).collect():
        got.setdefault(r["doc_id"], []).append(r["license"])
    assert [sorted(got.get(i, [])) for i in range(len(cases))] == list(cases.values())


def test_windows_by_counting_every_place(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    data = []
    for _ in range(40):
        n = rng.randrange(1, 60)
        data.append((list(range(n)), sorted(rng.sample(range(n), rng.randrange(1, n + 1)))))
    df = spark.createDataFrame(data, "h array<long>, at array<int>")
    for length, least in ((4, 1), (4, 3), (8, 2), (8, 8), (16, 5)):
        got = df.select("h", "at", licenses.windows_of(F.col("h"), F.col("at"), length, least).alias("w")).collect()
        for r in got:
            want = [s for s in range(0, len(r["h"]), length // 2) if sum(s <= p < s + length for p in r["at"]) >= least]
            assert sorted(w["at"] for w in r["w"]) == want
            assert all(w["own"] == r["h"][w["at"] : w["at"] + length] and w["class"] == length for w in r["w"])


def test_repeated_statements_take_time_in_proportion(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, "All rights reserved. " * n)], "doc_id long, text string")
        began = time.time()
        (row,) = licenses.licenses(df).collect()
        assert row["n_windows"] == 2 * n - 1
        return time.time() - began

    seconds(10)
    assert seconds(16_000) < 4 * seconds(8_000)
