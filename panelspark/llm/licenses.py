"""Licence scan in DataFrame operations only: sparse TF-IDF cosine to templates, then inheritance by directories.

Terms are weighted by their frequency over all documents of the corpus. A template is a notice, a
characteristic sentence of a long licence (a part), or a whole short licence text; more, of any length, can be
given as a table (``license_texts`` reads a folder of them). A vector's cosine is the sparse dot product of
two weight vectors, joined on terms.

* Headers: every statement of windows of one to ``window_lines`` joined lines, so notices wrapped over lines
  are scored whole. The closest licence of a statement counts; an SPDX tag names one by itself.
* Licence files: files whose whole text reaches the cosine bound of a notice or a text, or that hold two parts
  of one licence or more. Their licence is that of the text: a licence named inside it does not win.
  A licence file sets the licence of its directory.

A file without either takes the licence of its nearest ancestor directory that has one. Directories are
resolved once each, through a join of their ancestor paths with the licensed directories; files then join
their own directory.

Before any term is spread out, texts without one of the ``heavy`` terms are passed over: the lighter terms of
a template cannot reach the bound together. Of the others, vectors are first joined with the templates' terms
alone; only those that share enough squared weight with one get their own terms weighed.

Edge cases: null and empty texts hold no licence and inherit; a null path inherits nothing; repeated
rows count as often as given for the term weights and keep one row each; of equal cosines the
smaller licence id wins; several licence files of a directory are decided by cosine, then id. An
empty table gives an empty result; columns other than the three named are not read. A notice wrapped over more
than ``window_lines`` lines is scored in parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.session import cut_lineage

# Licence ids and how their notices are commonly worded.
NOTICES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause Simplified License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause New or Revised License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Titles and sentences that only the full text of a long licence holds.
PARTS = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("AGPL-3.0", "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users."),
    ("GPL-2.0", "This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-3.0", "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program to make sure it remains free software for all its users."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software"),
]
_WARRANTY = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
             "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
            "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
            "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
# Short licences in full.
TEXTS = [
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
            "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
]
SENTENCE = r"[.;!?][ \t]+"
NOT_TERM = r"[^\p{L}\p{N}]+"
SPDX = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+)"


@dataclass(frozen=True)
class LicenseRule:
    header_cosine: float = 0.7
    file_cosine: float = 0.5
    window_lines: int = 5


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_TERM), lambda t: t != "")


def license_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(license, kind, body)`` of a folder of whole licence texts, each named by its id."""
    read = spark.read.text(folder, wholetext=True)
    return read.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.txt)?$", 1).alias("license"), F.lit("text").alias("kind"), F.col("value").alias("body"))


def template_terms(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """``(template, license, kind, term, tf)`` of the fixed templates and of those given: bounded by the licences there are, not by the corpus."""
    made = [(k, kind, t) for kind, rows in (("notice", NOTICES), ("part", PARTS), ("text", TEXTS)) for k, t in rows]
    rows = spark.createDataFrame(made, "license string, kind string, body string")
    rows = rows if more is None else rows.unionByName(more.select("license", "kind", "body"))
    return rows.select(F.md5(F.concat_ws("|", "license", "kind", "body").cast("binary")).alias("template"), "license", "kind", F.explode(terms_of(F.col("body"))).alias("term")).groupBy("template", "license", "kind", "term").agg(F.count("*").alias("tf"))


def document_frequency(files: DataFrame) -> DataFrame:
    return files.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def weight(tf: str, df: str, n_docs: int) -> Column:
    return (1 + F.log(F.col(tf).cast("double"))) * F.log((F.lit(float(n_docs)) + 1.0) / (F.coalesce(F.col(df), F.lit(0)) + 0.5))


def heavy_terms(templates: DataFrame, bound: Column) -> DataFrame:
    """Terms of which a vector needs one at least to reach a template's ``bound``: the lighter ones of the template hold too little squared weight together."""
    w = Window.partitionBy("template").orderBy("tw", "term").rowsBetween(Window.unboundedPreceding, 0)
    return templates.withColumn("light", F.sum(F.col("tw") * F.col("tw")).over(w)).where(F.col("light") >= (bound * bound - 1e-9) * F.col("all")).select("term").distinct()


def near(counted: DataFrame, key: str, templates: DataFrame, bound: Column) -> DataFrame:
    """``(key, template)`` pairs that share enough squared weight with the template for its ``bound``."""
    met = counted.select(key, "term").join(templates, "term").groupBy(key, "template").agg(F.sum(F.col("tw") * F.col("tw") / F.col("all")).alias("shared"), F.first(bound).alias("bound"))
    return met.where(F.col("shared") >= F.col("bound") * F.col("bound") - 1e-9).select(key, "template")


def cosines(counted: DataFrame, key: str, templates: DataFrame, freq: DataFrame, n_docs: int, bound: Column) -> DataFrame:
    """``(key, template, license, kind, cosine)`` of vectors ``counted(key, term, tf)`` that reach a template's bound."""
    pairs = cut_lineage(near(counted, key, templates, bound))
    kept = counted.join(pairs.select(key).distinct(), key, "left_semi")
    weighed = cut_lineage(kept.join(freq, "term", "left").select(key, "term", weight("tf", "df", n_docs).alias("w")))
    norm = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = weighed.join(templates.select("template", "license", "kind", "term", (F.col("tw") / F.sqrt("all")).alias("tw"), bound.alias("bound")), "term").join(pairs, [key, "template"], "left_semi")
    dot = dot.groupBy(key, "template", "license", "kind", "bound").agg(F.sum(F.col("w") * F.col("tw")).alias("dot")).join(norm, key)
    return dot.select(key, "template", "license", "kind", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"), "bound").where(F.col("cosine") >= F.col("bound")).drop("bound")


def closest(*extra: str) -> Column:
    """Of several licences the one of the largest cosine, then of the smaller id, with ``extra`` columns."""
    return F.min_by(F.struct("license", "cosine", *extra), F.struct((-F.col("cosine")).alias("a"), F.col("license").alias("b"))).alias("x")


def statements(lines: Column, window_lines: int) -> Column:
    """Sentences of all windows of one to so many joined lines."""
    starts = F.sequence(F.lit(1), F.size(lines))
    windows = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(window_lines), F.size(lines) - i + 1)), lambda k: F.array_join(F.slice(lines, i, k), " "))))
    return F.array_distinct(F.flatten(F.transform(windows, lambda x: F.split(x, SENTENCE))))


def scan_licenses(files: DataFrame, rule: LicenseRule = LicenseRule(), templates: DataFrame | None = None, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(doc_id, path, header_license, header_cosine, is_license_file, license, origin, inherited_from)`` of every row.

    ``templates(license, kind, body)`` are added to the fixed ones; kind is notice, part or text.
    """
    f = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    n_docs = f.count()
    freq = cut_lineage(document_frequency(f))
    tt = template_terms(files.sparkSession, templates).join(freq, "term", "left").select("template", "license", "kind", "term", weight("tf", "df", n_docs).alias("tw"))
    tt = cut_lineage(tt.withColumn("all", F.sum(F.col("tw") * F.col("tw")).over(Window.partitionBy("template"))))
    said_bound = F.when(F.col("kind") == "text", 2.0).otherwise(rule.header_cosine)      # statements are not held against whole texts,
    file_bound = F.when(F.col("kind") == "part", 2.0).otherwise(rule.file_cosine)        # nor files against parts
    heavy = heavy_terms(tt.where("kind <> 'text'"), said_bound).union(heavy_terms(tt.where("kind <> 'part'"), file_bound)).distinct()
    words = F.array(*[F.lit(r[0]) for r in heavy.orderBy("term").collect()]).cast("array<string>")       # of the templates: a bounded list
    body = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    maybe = cut_lineage(f.where("text IS NOT NULL").where(F.arrays_overlap(terms_of(F.col("text")), words) | F.col("text").contains("SPDX-License-Identifier:")).select(body.alias("body"), "text").dropDuplicates(["body"]))

    # headers
    lines = maybe.select("body", F.split("text", r"\r?\n").alias("lines"))
    said = lines.select("body", F.explode(F.filter(statements(F.col("lines"), rule.window_lines), lambda x: F.arrays_overlap(terms_of(x), words))).alias("said"))
    said = cut_lineage(said.select("body", F.md5(F.col("said").cast("binary")).alias("statement"), terms_of(F.col("said")).alias("terms")))
    counted = said.dropDuplicates(["statement"]).select("statement", F.explode("terms").alias("term")).groupBy("statement", "term").agg(F.count("*").alias("tf"))
    scored = cosines(counted, "statement", tt, freq, n_docs, said_bound).groupBy("statement").agg(closest("kind", "template")).select("statement", "x.*")
    scored = cut_lineage(said.select("body", "statement").join(scored, "statement").drop("statement"))
    tagged = maybe.select("body", F.regexp_extract("text", SPDX, 1).alias("license"), F.lit(1.0).alias("cosine")).where("license <> ''")
    header = scored.select("body", "license", "cosine").union(tagged).groupBy("body").agg(closest()).select("body", F.col("x.license").alias("header_license"), F.col("x.cosine").alias("header_cosine"))

    # licence files: by their whole text, or by parts
    whole = maybe.select("body", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("body", "term").agg(F.count("*").alias("tf"))
    by_text = cosines(cut_lineage(whole), "body", tt, freq, n_docs, file_bound).select("body", "license", "cosine", F.lit(0).alias("parts"))
    by_parts = scored.where("kind = 'part'").groupBy("body", "license").agg(F.max("cosine").alias("cosine"), F.count_distinct("template").alias("parts")).where("parts >= 2")
    order = F.struct((-F.col("parts")).alias("p"), (-F.col("cosine")).alias("a"), F.col("license").alias("b"))
    full = by_text.unionByName(by_parts).groupBy("body").agg(F.min_by(F.struct("license", "cosine"), order).alias("x")).select("body", F.col("x.license").alias("file_license"), F.col("x.cosine").alias("file_cosine"))
    own = cut_lineage(header.join(full, "body", "full")).withColumnRenamed("body", "h_body")
    rows = f.select("doc_id", "path", body.alias("body"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"))
    return inherit(cut_lineage(rows.join(own, rows.body == own.h_body, "left").drop("body", "h_body")))


def inherit(rows: DataFrame) -> DataFrame:
    """Licence of each row: its own header's, else that of the nearest ancestor directory."""
    licensed = rows.where("file_license IS NOT NULL AND path IS NOT NULL").groupBy("dir").agg(F.min_by("file_license", F.struct((-F.col("file_cosine")).alias("a"), F.col("file_license").alias("b"))).alias("dir_license")).select(F.col("dir").alias("l_dir"), "dir_license")
    dirs = rows.where("path IS NOT NULL").select("dir").distinct()
    steps = dirs.select("dir", F.posexplode(F.expr("transform(sequence(0, size(split(dir, '/'))), n -> array_join(slice(split(dir, '/'), 1, n), '/'))")).alias("depth", "above")).where("depth > 0 OR dir = ''")
    nearest = steps.join(licensed, F.col("above") == F.col("l_dir")).groupBy("dir").agg(F.max_by(F.struct("dir_license", "above"), F.col("depth")).alias("x")).select(F.col("dir").alias("n_dir"), "x.dir_license", F.col("x.above").alias("from_dir"))
    told = rows.join(nearest, (rows.dir == nearest.n_dir) & F.col("path").isNotNull(), "left")
    own = F.coalesce("file_license", "header_license").isNotNull()
    return told.select("doc_id", "path", "header_license", "header_cosine", F.col("file_license").isNotNull().alias("is_license_file"), F.coalesce("file_license", "header_license", "dir_license").alias("license"),
                       F.when(F.col("file_license").isNotNull(), "file").when(own, "header").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
                       F.when(~own, F.col("from_dir")).alias("inherited_from"))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as a tree of files: source, language, range of a hundred ids, id."""
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.expr("cast(doc_id div 100 as string)"), F.col("doc_id").cast("string")).alias("path"), "text")
