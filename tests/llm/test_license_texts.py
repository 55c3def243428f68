"""Licence files by full texts and parts, wrapped notices, tags, and cosines against brute force."""

import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelspark.llm import licenses

COMMON = "/usr/share/common-licenses"
FILES = "doc_id long, path string, text string"
MIT = "MIT License\n\nCopyright (c) 2031 Some Body\n\n" + "\n".join(re.findall(r".{1,70}(?:\s|$)", dict(licenses.TEXTS)["MIT"][len("MIT License. "):]))
rng = random.Random(8)


def say(n):
    return " ".join(rng.choice(["the", "this", "under", "of", "work"] + [f"w{i}" for i in range(2000)]) for _ in range(n))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.skipif(not os.path.exists(f"{COMMON}/GPL-3"), reason="no licence texts on this machine")
def test_full_texts_are_licence_files_and_are_inherited(spark):
    full = {"apache": "Apache-2.0", "gpl2": "GPL-2", "gpl3": "GPL-3", "lgpl21": "LGPL-2.1", "lgpl3": "LGPL-3", "mpl": "MPL-2.0"}
    want = {"apache": "Apache-2.0", "gpl2": "GPL-2.0", "gpl3": "GPL-3.0", "lgpl21": "LGPL-2.1", "lgpl3": "LGPL-3.0", "mpl": "MPL-2.0", "mit": "MIT"}
    texts = {k: open(f"{COMMON}/{v}").read() for k, v in full.items()} | {"mit": MIT}
    rows = [(i, f"{k}/LICENSE", t) for i, (k, t) in enumerate(texts.items())] + [(100 + i, f"{k}/src/a.c", say(50)) for i, k in enumerate(texts)] + [(1000 + i, f"x/{i}", say(80)) for i in range(60)]
    got = by_id(licenses.scan_licenses(spark.createDataFrame(rows, FILES)))
    for i, k in enumerate(texts):
        assert (got[i]["license"], got[i]["is_license_file"], got[i]["origin"]) == (want[k], True, "file"), k
        assert (got[100 + i]["license"], got[100 + i]["origin"], got[100 + i]["inherited_from"]) == (want[k], "inherited", k)
    assert all(got[1000 + i]["origin"] == "none" for i in range(60))


def test_wrapped_notices_tags_and_given_texts(spark, tmp_path):
    notice = "# This work is licensed under the GNU General\n# Public License,\n#   version 3.\n"
    own = "You may dance with this gizmo whenever the moon allows and you must hum a tune while dancing with it. No gizmo dances by itself."
    (tmp_path / "Gizmo-1.0.txt").write_text(own)
    rows = [(1, "a/x.py", f"{say(30)}\n{notice}{say(30)}"), (2, "a/y.py", f"// SPDX-License-Identifier: ISC\n{say(40)}"), (3, "g/COPYING", f"Copyright Some Body\n{own}\n"), (4, "g/z", say(30)),
            (5, "a/long", "\n".join(say(12) for _ in range(3000)) + f"\n{notice}"), (6, "a/none", "the license of w1"), *((100 + i, f"b/{i}", say(60)) for i in range(40))]
    got = by_id(licenses.scan_licenses(spark.createDataFrame(rows, FILES), templates=licenses.license_texts(spark, str(tmp_path))))
    assert [(got[i]["license"], got[i]["origin"]) for i in range(1, 6)] == [("GPL-3.0", "header"), ("ISC", "header"), ("Gizmo-1.0", "file"), ("Gizmo-1.0", "inherited"), ("GPL-3.0", "header")]
    assert got[2]["header_cosine"] == 1.0 and got[6]["origin"] == "none" and not got[1]["is_license_file"]


def terms(text):
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def test_cosines_against_brute_force(spark):
    bodies = [t for _, t in licenses.NOTICES]
    texts = [say(30) for _ in range(30)]
    for i in range(60):
        words = terms(rng.choice(bodies))
        texts.append(say(10) + "\n" + " ".join(w for w in words if rng.random() < 0.9) + " " + " ".join(rng.choice(["the", "w1", "w2"]) for _ in range(rng.randrange(4))) + "\n" + say(rng.randrange(12)))
    got = by_id(licenses.scan_licenses(spark.createDataFrame([(i, f"d/{i}", t) for i, t in enumerate(texts)], FILES)))
    df = Counter(t for x in texts for t in set(terms(x)))

    def vector(words):
        return {t: (1 + math.log(n)) * math.log((len(texts) + 1) / (df[t] + 0.5)) for t, n in Counter(words).items()}

    def cosine(a, b):
        return sum(w * b[t] for t, w in a.items() if t in b) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))

    marks = [(k, kind, vector(terms(t))) for kind, rows in (("notice", licenses.NOTICES), ("part", licenses.PARTS), ("text", licenses.TEXTS)) for k, t in rows]
    found = 0
    for i, text in enumerate(texts):
        lines = text.split("\n")
        said = {x for a in range(len(lines)) for n in range(1, 6) for x in re.split(r"[.;!?][ \t]+", " ".join(lines[a:a + n])) if a + n <= len(lines) and terms(x)}
        best = min(((-round(cosine(vector(terms(x)), v), 6), k) for x in said for k, kind, v in marks if kind != "text"), default=(0, None))
        want = (best[1], -best[0]) if -best[0] >= 0.7 else (None, None)
        assert got[i]["header_license"] == want[0] and (want[1] is None or abs(got[i]["header_cosine"] - want[1]) < 2e-6), text
        whole = max(round(cosine(vector(terms(text)), v), 6) for k, kind, v in marks if kind != "part")
        assert got[i]["is_license_file"] == (whole >= 0.5)
        found += want[0] is not None
    assert found >= 20


def test_licence_edge_cases(spark):
    rows = [(1, None, None), (2, "", ""), (3, "a/LICENSE", MIT), (3, "a/LICENSE", MIT), (None, "a/b", "x"), (4, "a/c", "x " * 50000)]
    df = spark.createDataFrame(rows, FILES).withColumn("term", F.lit("clash")).withColumn("license", F.lit(1)).withColumn("kind", F.lit(1))
    got = licenses.scan_licenses(df).collect()
    assert sorted(((r["doc_id"] or 0), r["license"] or "", r["origin"]) for r in got) == [(0, "MIT", "inherited"), (1, "", "none"), (2, "", "none"), (3, "MIT", "file"), (3, "MIT", "file"), (4, "MIT", "inherited")]
    assert licenses.scan_licenses(df.limit(0)).count() == 0
