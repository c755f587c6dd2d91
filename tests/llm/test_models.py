"""The trained operators: held-out accuracy and defined cases."""

import random
import re
import textwrap
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import htmltext, licenses, toxicity, urlfilter
from corpusloom.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    texts, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randint(20, 60))], i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["nincompoop", "dunderhead", "blockhead"])
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_insults_with_inserted_characters():
    model = toxicity.fit(*corpus(400, 1))
    texts, labels = corpus(200, 2)
    assert ((model.score(texts) >= 0.5) == np.array(labels, bool)).mean() > 0.97
    bent = ["ga lu b-l-o-c-k-h-e-a-d me ti", "ga lu dunxderhead me ti", "ga lu n i n c o m p o o p me ti", "ga lu blockkhead! me ti"]
    assert (model.score(bent) >= 0.5).sum() >= 3
    assert (model.score(["", "...", None, "ga lu me ti so"]) < 0.5).all()


def test_insults_after_the_first_window():
    rng = random.Random(5)

    def text(insult=""):
        sign = "".join(rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(20))
        at = rng.randint(20, 30)
        return sign[:at] + insult + sign[at:]

    learnt, fresh = [(text("nincompoop" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)], [(text("nincompoop" if i % 4 == 0 else ""), i % 4 == 0) for i in range(200)]
    model = toxicity.fit(*map(list, zip(*learnt)))
    assert ((model.score([t for t, _ in fresh]) >= 0.5) == np.array([x for _, x in fresh])).mean() > 0.97


def test_a_spelt_insult_late_in_a_token():
    model = toxicity.fit(*corpus(400, 1))
    late = ["ga lu " + "ga-lu-me-ti-" * n + "b-l-o-c-k-h-e-a-d so" for n in (0, 2, 50)] + ["ga lu n.i.n.c.o.m.p.o.o.p me"]
    assert (model.score(late) >= 0.5).all() and (model.score(["ga-lu-me-ti-" * 50, "a-b-c-d-e-f-g"]) < 0.5).all()


def test_insults_of_several_words():
    rng = random.Random(6)
    word = lambda: rng.choice(["gone", "fish", "you", "are", "a", "rat", "sleepy", "of", "the", "yard"]) if rng.random() < 0.5 else "".join(rng.choice("bcdfglm") + rng.choice("aeiou") for _ in range(2))

    def text(bad):
        words = [word() for _ in range(rng.randint(20, 40))]
        words = [w for a, b in zip(words, [*words[1:], ""]) for w in [a] if (a, b) != ("sleepy", "rat")]
        if bad:
            words.insert(rng.randrange(len(words)), "sleepy rat")
        return " ".join(words)

    learnt, fresh = ([(text(i % 3 == 0), int(i % 3 == 0)) for i in range(n)] for n in (450, 200))
    model = toxicity.fit(*map(list, zip(*learnt)))
    assert ((model.score([t for t, _ in fresh]) >= 0.5) == np.array([x == 1 for _, x in fresh])).mean() > 0.9


def brute_margins(model, code):
    """The margin of a string by its definition, triple by triple."""
    n, total, norm = len(code), 0.0, 0.0
    for p in range(n):
        for b in range(2, toxicity.SPAN):
            for a in range(1, b):
                if p + b < n:
                    w = toxicity.DECAY ** (b + 1)
                    total += w * model.weights[(code[p] * 64 + code[p + a]) * 64 + code[p + b]]
                    norm += w * w
    return total / np.sqrt(max(norm, 1e-12)) + model.bias


def test_running_sums_give_the_kernel_of_every_string():
    model = toxicity.fit(*corpus(200, 1))
    read = toxicity.Reading("Ga lu, blockhead! Me ti b-l-o-c-k a.b c 你好" + "好" * 40 + " fin")
    strings = [read.string(k) for k in range(len(read.first))]
    assert np.allclose(model.margins(read), [brute_margins(model, s) for s in strings], atol=1e-4)
    assert len(strings) == len(set(zip(read.first, read.last))) and max(map(len, strings)) <= toxicity.REACH


def test_scores_of_awkward_tables(spark):
    texts, labels = corpus(300, 9)
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s")] * 5 + [(1, "another text", "s"), (None, "blockhead", "s"), (900, None, "s"), (901, "", "s"), (902, "so " * 200_000, "s"), (903, "so " * 60 + "blockhead", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    marks = spark.createDataFrame([(i, x, 0) for i, x in enumerate(labels)] + [(2, 1, 0), (None, 1, 0), (5000, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.scored(docs, marks).select("doc.doc_id", F.col("score").alias("s"), "predicted").collect()
    assert len(got) == len(rows) and all(0 <= r["s"] <= 1 for r in got)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert by[None] == by[903] == 1 and by[900] == by[901] == by[902] == 0
    assert toxicity.drop_toxic(docs, marks).columns == docs.columns
    assert toxicity.scored(docs.limit(0), marks).count() == 0
    assert {r["s"] for r in toxicity.scored(docs, marks.limit(0)).select(F.col("score").alias("s")).collect()} == {0.0}


def test_no_labels_or_one_class():
    assert toxicity.fit([], []).score(["x"])[0] == 0.0
    assert toxicity.fit(["a", "b"], [0, 0]).score(["x"])[0] == 0.0
    assert toxicity.fit(["a"], [1]).score(["x"])[0] == 1.0


@pytest.mark.parametrize("gap", [0.5, 5.0, 50.0])
def test_the_curve_separates_separable_evidence(gap):
    x = np.r_[np.full((900, 3), -gap), np.full((90, 3), gap)] + np.random.default_rng(0).normal(0, 0.1, (990, 3))
    y = np.r_[np.full(900, -1), np.full(90, 1)]
    w = toxicity.logistic(x, y)
    assert ((x @ w[:3] + w[3] > 0) == (y > 0)).all()


def test_scores_of_the_table(spark):
    rows = QUERIES["op7_score_toxicity"](spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_pages():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a>x</a></ul></nav>
    <div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1><p><b>One</b> two&nbsp;three<br>four<p>Five</p>
    <script>var t="</p>";</script><aside>no</aside><form>no</form><div id="comments"><p>First comment here</p></div></article><footer>&copy; no</footer>"""
    assert htmltext.main_text(page) == "A & B One two three four Five"
    assert htmltext.main_text(None) == "" == htmltext.main_text("<!-- open") == htmltext.main_text("<script>x")
    assert htmltext.main_text("a " * 50_000).count("a") == 50_000


def test_pages_against_their_making():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) + rng.choice(["", "", ".", "&", "<", "é"])
    for _ in range(400):
        html, text = brute.page(rng, word)
        assert htmltext.main_text(html) == text, html


@pytest.mark.parametrize("part", ["<a ", "<p a='", "<p '>'", "<div>", "<li>", "<div><li>", "<title>", "<svg>", "<!-", "<", "</p", "<ul><li></div>"])
def test_long_pages_take_time_in_proportion(part):
    began = time.process_time()
    htmltext.main_text(part * (400_000 // len(part)))
    assert time.process_time() - began < 3


def test_the_query_over_pages(spark):
    rows = [(1, None, None, "x"), (1, "u", "<p>Some text that is long enough to be an article of its own kind here today", "x"), (1, "u", "", "y")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.extract(table).select("doc.*", htmltext.F.col("text").alias("main")).collect()
    assert [r["main"] for r in got] == ["", rows[1][2][3:], ""] and [r["text"] for r in got] == ["x", "x", "y"]
    assert htmltext.extract(table.limit(0)).count() == 0


def test_licenses(spark):
    rows = [(1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, None), (3, "GNU General Public License, version 3. Either version 3 or any later version."), (4, "Released under the MIT License. Licensed under CC BY-NC 4.0."), (5, "copyright (c) me")]
    got = {r[0]: (r["licenses"], r["unmatched"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc.doc_id", "licenses", "unmatched").collect()}
    assert got == {1: (["Apache-2.0"], []), 2: ([], []), 3: (["GPL-3.0-or-later"], []), 4: (["MIT", "CC-BY-NC"], []), 5: ([], ["Copyright"])}


BSD3 = """Copyright (c) 2020, Someone Inc. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above
   copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.
3. Neither the name of Someone Inc. nor the names of its
   contributors may be used to
   endorse or promote products derived from this software.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
GPL = """# This program is free software%s you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation%s either version %d of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>."""


def test_licenses_of_wrapped_texts_names_and_tags(spark):
    rows = {
        "This work is available under CC BY-SA 4.0.": ["CC-BY-SA"],
        "Published under CC0.": ["CC0"],
        "Creative Commons Attribution-ShareAlike 4.0.": ["CC-BY-SA"],
        "per acc by hand": [],
        BSD3: ["Proprietary", "BSD-3-Clause"],
        GPL % (":", ",", 3): ["GPL-3.0-or-later"],
        GPL % (";", ";", 2): ["GPL-2.0-or-later"],
        "// SPDX-License-Identifier: MIT\nint x;": ["MIT"],
        "/* SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) OR Apache-2.0 */": ["GPL-2.0-or-later", "Apache-2.0"],
        "Licensed under the MIT License\nDual: CC-BY-NC": ["MIT", "CC-BY-NC"],
        "GNU General Public License, version 2 or any later version, see section 3": ["GPL-2.0-or-later"],
    }
    got = licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).select("doc.text", "licenses", "unmatched").collect()
    assert {r[0]: r[1] for r in got} == rows
    assert {r[0]: r[2] for r in got if r[2]} == {BSD3: ["Copyright"]}


def test_licenses_by_name(spark):
    rows = {
        "MIT License or the GNU General Public License version 2.0, see chapter 3": ["MIT", "GPL-2.0"],
        "It is not licensed under the Apache License 2.0, ask for the EUPL v1.2 instead": ["EUPL-1.2"],
        "Dedicated under CC0 1.0.": ["CC0"],
        "Shared as CC BY 4.0.": ["CC-BY"],
        "Creative Commons Attribution 4.0 International.": ["CC-BY"],
        "Available under GPLv3, the Artistic License 2.0 or (at your option) the BSD 3-Clause License": ["GPL-3.0", "Artistic-2.0", "BSD-3-Clause"],
        "Fonts: SIL Open Font License. Code: zlib License.": ["OFL-1.1", "Zlib"],
        "dual-licensed under Apache-2.0 and MIT": ["Apache-2.0", "MIT"],
        "LGPL-2.1+": ["LGPL-2.1-or-later"],
        "Ich komme mit dem Zug und mit dir.": [],
    }
    got = licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).select("doc.text", "licenses", "unmatched").collect()
    assert {r[0]: r[1] for r in got} == rows and not any(r[2] for r in got)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in it without restriction.

The above copyright notice and this permission notice shall be included in all copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law, software distributed under the License is distributed on an "AS IS" BASIS."""
PARTS = [
    (MIT, ["MIT"]), (APACHE, ["Apache-2.0"]), (BSD3.partition("\n\n")[2], ["BSD-3-Clause"]), (GPL % (";", ";", 2), ["GPL-2.0-or-later"]), (GPL % (":", ",", 3), ["GPL-3.0-or-later"]),
    ("Released under the MIT License.", ["MIT"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC"]), ("SPDX-License-Identifier: MPL-2.0", ["MPL-2.0"]), ("All rights reserved.", ["Proprietary"]),
]


def test_licenses_of_texts_put_together(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    filler = lambda: " ".join(word() for _ in range(rng.randint(5, 60))) + "."

    def wrapped(text, width, mark):
        paragraphs = [textwrap.fill(" ".join(p.replace("# ", " ").replace("#", " ").split()), width, break_long_words=False, break_on_hyphens=False) for p in re.split(r"\n#?\s*\n", text)]
        return "\n".join(mark + line for line in "\n\n".join(paragraphs).split("\n"))

    rows, truth = [], {}
    for i in range(250):
        parts, want, last = [filler()], [], ""
        for _ in range(rng.randint(0, 4)):
            text, names = rng.choice(PARTS)
            mark = rng.choice(["", "# ", "// ", " * "])
            parts += [wrapped(text, rng.choice([50, 72, 100]) if "SPDX" not in text else 200, mark), filler()]
            # a licence's name right before its text is one with it
            want += names if not (text == MIT and last.startswith("Released")) else []
            last = text
        rows.append((i, "\n\n".join(parts), "clash"))
        truth[i] = want
    rows += [(900, None, "clash"), (901, "", None), (901, "", None), (902, "under the same terms " * 60_000 + "Released under the MIT License.", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, licenses string").repartition(4)
    got = licenses.scan(table).select("doc.doc_id", F.col("licenses").alias("found"), "unmatched").collect()
    assert len(got) == len(rows)
    assert {r[0]: r[1] for r in got} == truth | {900: [], 901: [], 902: ["MIT"]}
    assert licenses.scan(table.limit(0)).count() == 0


def test_urls(spark):
    def page(i, url, *links):
        return i, url, "".join(f'<a href="{x}">x</a>' for x in links)

    rows = [page(1, "http://WWW.Example.com/en/a?b"), page(2, "http://x.example.com/en/"), page(3, "https://a.net/fr/1#t"), page(4, None), page(5, "no scheme"), page(6, "http://b.com"), page(7, "http://com/x")]
    rows += [page(10 + i, f"http://bad.net/es/{i}") for i in range(3)] + [page(20, "http://farm.org/1", *[f"http://bad.net/es/{i}" for i in range(9)]), page(21, "http://good.com/", "http://fine.org/2"), page(22, "http://fine.org/2", "http://good.com/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[2][2:] == ("example.com/en/", "block") and got[3] == ("a.net", "/fr/1", "net/fr/", "block")
    assert got[4] == got[5] == ("", "", None, "allow") and got[6] == ("b.com", "", None, "allow") and got[7][2] == "com/"
    assert got[20][2:] == (None, "block") and got[22][2:] == (None, "allow")
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert urlfilter.judge(empty).count() == 0


def test_links_against_plain_iteration(spark):
    rng = random.Random(4)
    hosts = [f"h{i}.org" for i in range(30)] + [f"s{i}.com" for i in range(6)] + [f"b{i}.net" for i in range(6)]
    rows = []
    for i in range(400):
        h = rng.choice(hosts)
        path = rng.choice(["/es/", "/fr/", "/x"]) if h.endswith(".net") else "/x"
        near = hosts[:15] + hosts[30:36] if hosts.index(h) < 15 else hosts[15:30] + hosts[36:]
        links = [f'<a href={rng.choice(["http://", "//", "HTTPS://"])}{rng.choice(near)}/p>x</a>' for _ in range(rng.randint(0, 4))]
        html = "".join(links) + f"<!-- <a href=http://b0.net/>no</a> --><link rel=x href=//b1.net/><a href='/local'>l</a>"
        rows.append((i, f"http://{h}{path}", rng.choice([html, html, None if i % 40 == 0 else html])))
    table = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string").repartition(5)
    margin = brute.blocked_hosts(rows, lambda h: h.endswith(".com"), lambda u: ".net/es/" in u or ".net/fr/" in u)
    unsure = {h for h, m in margin.items() if abs(m) < 0.1 / len(margin)}
    got = {r["host"]: r["blocked"] for r in urlfilter.judged_hosts(table).collect()}
    assert got.keys() == margin.keys() and {h for h, b in got.items() if b} - unsure == {h for h, m in margin.items() if m > 0} - unsure
    verdicts = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in urlfilter.judge(table).collect()}
    assert len(verdicts) == len(rows)
    for i, (host, rule, verdict) in verdicts.items():
        assert rule or host in unsure or verdict == ("block" if margin.get(host, -1) > 0 else "allow")
    assert any(v == "block" and not r for _, r, v in verdicts.values())
