"""License scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

Every line that holds a marker word is a header; so is, as a whole, every text with such a line (a licence file holds little else). Their words,
weighted by counts and by the rarity among the templates, are joined with the templates' words; the best cosine from ``least`` on
is the file's own license. A file that opens with its license (first line, or the whole text) speaks for its directory, the first such file by
name if there are several. Files without own license take that of the nearest directory above them, found by joining each directory
with all its ancestors.

With ``forms`` (sentences, source headers and licence texts of any length), a license may also run over several lines: at every word that
holds a marker, the text has for each form a window of as many words as the form, laid so that the marker meets the form's first one of
its kind; line breaks don't matter. Windows are compared by the same cosine, where words beyond the form weigh like the rarest. Tags
``SPDX-License-Identifier:`` give their license as written, without -only, -or-later or +. The best of all counts. ``sql`` says the part
without forms.

Only marked texts are cut into words, and directories (not files) are joined with ancestors. The templates are a parameter
of code size and are joined by broadcast where Spark measures them as small.

Defined results: a null text has no header, a null path counts as the root directory's unnamed file; repeated rows get equal
answers; of equal cosines the least license name wins; an empty template table and no forms give no license.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
#: Words that mark a header.
MARKERS = ("license", "licence", "licensed", "licensing", "copyright", "spdx", "permission is hereby granted")
#: License and statement.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: What marks a word, as the markers do a line.
STEMS = ("licen[cs]", "copyright", "permission")
TAG = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]*[A-Za-z0-9+](?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+-]*[A-Za-z0-9+])*)"
WORD = r"[^\s\x{21}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}]+"


def marked(lowered: Column) -> Column:
    out = F.lit(False)
    for m in MARKERS:
        out = out | F.contains(lowered, F.lit(m))
    return out


def vectors(units: DataFrame, keys: list[str], idf: DataFrame, n: int) -> DataFrame:
    """(keys, word, weight) with vectors of length one; words beyond the templates weigh like the rarest."""
    unseen = F.log(F.lit(float(1 + n))) + 1
    counts = units.select(*keys, F.explode(F.regexp_extract_all(F.lower("unit"), F.lit(WORD), F.lit(0))).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("tf"))
    weighted = counts.join(idf, "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unseen))
    norms = weighted.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.filter("idf is not null").join(norms, keys).select(*keys, "word", (F.col("w") / F.col("norm")).alias("weight"))


def own_licenses(files: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """(key, license, score, opens) of the files that have a license; ``files``: key, text; ``templates``: license, unit."""
    templates = templates.select("license", "unit", F.xxhash64("license", "unit").alias("t"))
    n = templates.count()
    df = templates.select("t", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("unit"), F.lit(WORD), F.lit(0)))).alias("word")).groupBy("word").count()
    idf = df.select("word", (F.log(F.lit(float(1 + n)) / (1 + F.col("count"))) + 1).alias("idf"))
    texts = files.filter(marked(F.lower("text"))).select("key", "text")
    lines = texts.select("key", F.posexplode(F.split("text", "\n")).alias("line", "unit")).filter(marked(F.lower("unit")))
    units = lines.union(texts.select("key", F.lit(-1).alias("line"), F.col("text").alias("unit"))).distinct()
    known = vectors(templates, ["license", "t"], idf, n).withColumnRenamed("weight", "tw")
    scores = vectors(units, ["key", "line"], idf, n).join(known, "word").groupBy("key", "line", "license", "t").agg(F.sum(F.col("weight") * F.col("tw")).alias("score"))
    scores = scores.withColumn("score", F.round("score", 6)).filter(F.col("score") >= least)
    best = scores.groupBy("key").agg(F.max("score").alias("score"), F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias("license"),
                                     F.max(F.col("line") <= 0).alias("opens"))
    return best.select("key", "license", "score", "opens")


def form_table(forms) -> tuple[str, int]:
    """Forms as JSON rows: license, stem, words before the first marker of that stem, length, and words with their rarity and weight; greatest length."""
    cut = [(name, re.findall(re.sub(r"\\x\{(..)\}", r"\\x\1", WORD), text.lower())) for name, text in forms]
    df = Counter(w for _, words in cut for w in set(words))
    rows = []
    for name, words in cut:
        weights = {w: (tf, math.log((1 + len(cut)) / (1 + df[w])) + 1) for w, tf in Counter(words).items()}
        norm = math.sqrt(sum((tf * idf) ** 2 for tf, idf in weights.values()))
        vector = [{"word": w, "idf": idf, "weight": tf * idf / norm} for w, (tf, idf) in weights.items()]
        for stem, pattern in enumerate(STEMS):
            before = next((i for i, w in enumerate(words) if re.search(pattern, w)), None)
            if before is not None:
                rows.append({"license": name, "stem": stem, "before": before, "length": len(words), "vector": vector})
    return json.dumps(rows), max((len(words) for _, words in cut), default=0)


def form_licenses(files: DataFrame, forms, least: float = LEAST) -> DataFrame:
    """(key, license, score, opens) of all windows that a form matches, and of all tags; ``files``: key, text."""
    rows, reach = form_table(forms)
    unseen = math.log(1 + len(forms)) + 1
    known = F.from_json(F.lit(rows), "array<struct<license:string,stem:int,before:int,length:int,vector:array<struct<word:string,idf:double,weight:double>>>>")
    texts = files.filter(marked(F.lower("text"))).select("key", "text").distinct()

    def stem(w):
        out = F.when(F.rlike(w, F.lit(STEMS[0])), 0)
        for i, pattern in enumerate(STEMS[1:], 1):
            out = out.when(F.rlike(w, F.lit(pattern)), i)
        return out

    words = texts.withColumn("words", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).withColumn(
        "first", F.size(F.regexp_extract_all(F.regexp_extract(F.lower("text"), r"^\s*([^\n]*)", 1), F.lit(WORD), F.lit(0))))
    # each marker carries the words around it only, so that long texts aren't copied for each of theirs
    hits = words.withColumn("hit", F.explode(F.filter(F.transform("words", lambda w, i: F.struct(stem(w).alias("stem"), i.alias("at"))), lambda h: h.stem.isNotNull())))
    low = F.greatest(F.col("hit.at") - reach, F.lit(0))
    hits = hits.select("key", "first", "hit.stem", "hit.at", low.alias("low"), F.slice("words", low + 1, F.lit(2 * reach)).alias("near"))
    begin = lambda f: F.greatest(F.col("at") - f.before, F.lit(0))
    window = lambda f: F.slice("near", begin(f) - F.col("low") + 1, f.length)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def possible(f):
        """The cosine is at most the length of the part of the form whose words occur."""
        w = F.array(window(f))
        return F.transform(w, lambda w: total(F.transform(F.filter(f.vector, lambda v: F.array_contains(w, v.word)), lambda v: v.weight * v.weight)))[0] >= least * least - 1e-9

    met = hits.withColumn("form", F.explode(F.filter(known, lambda f: (f.stem == F.col("stem")) & possible(f))))
    f = F.col("form")
    met = met.select("key", (begin(f) < F.col("first")).alias("opens"), f.license.alias("license"), window(f).alias("window"), f.vector.alias("vector"))
    times = lambda w: F.size(F.filter("window", lambda x: x == w)).cast("double")
    inside = F.filter(F.transform("vector", lambda v: F.struct((times(v.word) * v.idf).alias("x"), v.weight.alias("weight"))), lambda p: p.x > 0)
    others = F.transform(F.array_except("window", F.transform("vector", lambda v: v.word)), lambda w: times(w) * unseen)
    met = met.withColumn("inside", inside).withColumn("others", others)
    norm = F.sqrt(total(F.transform("inside", lambda p: p.x * p.x)) + total(F.transform("others", lambda x: x * x)))
    met = met.select("key", "license", F.round(total(F.transform("inside", lambda p: p.x * p.weight)) / norm, 6).alias("score"), "opens").filter(F.col("score") >= least)
    tags = texts.select("key", F.posexplode(F.split("text", "\n")).alias("line", "unit")).filter(F.contains(F.lower("unit"), F.lit("spdx-license-identifier:")))
    tags = tags.select("key", F.regexp_replace(F.regexp_extract("unit", TAG, 1), r"(?i)(-only|-or-later|\+)(?=\s|$)", "").alias("license"), F.lit(1.0).alias("score"),
                       (F.col("line") == 0).alias("opens")).filter(~F.upper("license").isin("", "NONE", "NOASSERTION"))
    return met.union(tags)


def directory(path: Column) -> Column:
    """Path up to the last slash, without it; '' for the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, templates: DataFrame, least: float = LEAST, forms=()) -> DataFrame:
    """``files`` (doc_id, path, text) with: path, own_license, own_score, license (own or inherited), license_dir (whence), levels_up."""
    files = files.select("doc_id", F.coalesce("path", F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))
    named = files.select("doc_id", "path", F.struct("path", F.xxhash64("text")).alias("key"), "text", directory(F.col("path")).alias("dir"))
    own = own_licenses(named, templates, least)
    if forms:
        own = own.union(form_licenses(named, forms, least)).groupBy("key").agg(
            F.max("score").alias("score"), F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias("license"), F.max("opens").alias("opens"))
    rows = named.drop("text").join(own, "key", "left")
    speaking = own.filter("opens").select(F.col("key.path").alias("path"), "license", F.col("key").alias("k")).groupBy(
        directory(F.col("path")).alias("above")).agg(F.min_by("license", F.struct("path", "k")).alias("inherited"))
    parts = F.split("dir", "/")
    ancestors = named.select("dir").distinct().select("dir", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("above"), (F.size(parts) - i).alias("up")))).alias("a")
        ).select("dir", "a.above", "a.up")
    nearest = ancestors.join(speaking, "above").groupBy("dir").agg(F.min("up").alias("up"), F.min_by(F.struct("above", "inherited"), "up").alias("n"))
    rows = rows.join(nearest, "dir", "left")
    no = F.col("license").isNull()
    return rows.select(
        "doc_id", "path", F.col("license").alias("own_license"), F.col("score").alias("own_score"), F.coalesce("license", "n.inherited").alias("license"),
        F.when(no, F.col("n.above")).alias("license_dir"), F.when(no, F.col("up")).alias("levels_up"))


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(templates), "license string, unit string")


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: /source/lang, a directory per digit of doc_id / 100, doc_id as the name."""
    hundreds = F.floor(F.abs("doc_id") / 100)
    folders = F.when(hundreds > 0, F.concat(F.array_join(F.split(hundreds.cast("string"), ""), "/"), F.lit("/"))).otherwise(F.lit(""))
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("unknown")), F.lit("/"), F.coalesce("lang", F.lit("unknown")), F.lit("/"), folders, F.col("doc_id").cast("string"))
    return docs.select("doc_id", path.alias("path"), "text")


def sql() -> str:
    """The same for DuckDB over ``documents``."""
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in TEMPLATES)
    words = lambda c: rf"regexp_extract_all(lower({c}), '[^\s\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+')"
    mark = lambda c: "(" + " or ".join(f"contains(lower({c}), '{m}')" for m in MARKERS) + ")"
    n = len(TEMPLATES)
    return rf"""
    with tp as (select * from (values {values}) v(license, unit)),
    idf as (select word, ln({float(1 + n)} / (1 + count(*))) + 1 as idf from (select distinct license, unit, unnest({words('unit')}) as word from tp) group by word),
    f as (select doc_id, text, '/' || coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') || '/'
          || case when abs(doc_id) >= 100 then regexp_replace((abs(doc_id) // 100)::varchar, '(.)', '\1/', 'g') else '' end || doc_id as path from documents),
    m as (select path, text from f where {mark('text')}),
    l as (select path, unnest(string_split(text, chr(10))) as unit, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from m),
    u as (select distinct * from (select path, line, unit from l where {mark('unit')} union all select path, -1, text from m)),
    uc as (select path, line, word, count(*) as tf from (select path, line, unnest({words('unit')}) as word from u) group by all),
    uw as (select path, line, word, idf, tf * coalesce(idf, ln({float(1 + n)}) + 1) as w from uc left join idf using (word)),
    un as (select path, line, sqrt(sum(w * w)) as norm from uw group by all),
    tc as (select license, unit, word, count(*) as tf from (select license, unit, unnest({words('unit')}) as word from tp) group by all),
    tw as (select license, unit, word, tf * idf as w from tc join idf using (word)),
    tn as (select license, unit, sqrt(sum(w * w)) as norm from tw group by all),
    s as (select path, line, license, tw.unit, round(sum(uw.w / un.norm * tw.w / tn.norm), 6) as score from uw join un using (path, line) join tw using (word) join tn using (license, unit)
          where uw.idf is not null group by all having round(sum(uw.w / un.norm * tw.w / tn.norm), 6) >= {LEAST}),
    o as (select path, max(score) as score, arg_min(license, {{'a': -score, 'b': license}}) as license, max((line <= 0)::int) as opens from s group by path),
    d as (select f.doc_id, f.path, regexp_replace(f.path, '/?[^/]*$', '') as dir, license, score from f left join o using (path)),
    sp as (select regexp_replace(path, '/?[^/]*$', '') as above, arg_min(license, path) as inherited from o where opens = 1 group by 1),
    dd as (select distinct dir, string_split(dir, '/') as parts from d),
    an as (select dir, array_to_string(parts[1:i], '/') as above, len(parts) - i as up from (select dir, parts, unnest(range(1, len(parts) + 1)) as i from dd)),
    ne as (select dir, min(up) as up, arg_min(above, up) as above, arg_min(inherited, up) as inherited from an join sp using (above) group by dir)
    select doc_id, path, license as own_license, score as own_score, coalesce(license, inherited) as license,
           case when license is null then above end as license_dir, case when license is null then up end::int as levels_up
    from d left join ne using (dir)"""
