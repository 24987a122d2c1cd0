"""Licence scans with a positional rare-token index, in DataFrame operations only.

A template is the words of a licence text or notice. The licence vocabulary is the words
of all templates; how many documents hold each word is counted over all documents, and
the LOOKUPS words of highest IDF of a template are its lookup words. In each file, the
positions of those words are looked up in the postings (word -> template, position in it);
each names a place where the template would start, and the postings are intersected by
relative position: AGREE of the lookup words have to name the place (one word that was
changed doesn't hide a text). A place is kept if, besides, the template's mandatory key
phrase stands there word for word and the words that agree by relative position carry
enough of the template's IDF weight.

Everything is one narrow pass over arrays of one row, besides the count of the words
(one row per vocabulary word and map task is shuffled). Only the template tables, whose
size is that of the templates, travel to the tasks.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainage.llm.common import ascii_lower


class Template(NamedTuple):
    label: str
    text: str
    key: str  # mandatory phrase, part of the text
    base: bool = False


#: The base phrases of the contract, then phrases of public licence notices.
TEMPLATES = (
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    Template("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("bsd", "bsd license", "bsd license"),
    Template("isc", "isc license", "isc license"),
    Template("mpl", "mozilla public license", "mozilla public license"),
    Template("epl", "eclipse public license", "eclipse public license"),
    Template("cc-by", "creative commons attribution", "creative commons attribution"),
    Template("public-domain", "released into the public domain", "public domain"),
    # whole grants, conditions and disclaimers
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is"
        " furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and"
        " noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from"
        " out of or in connection with the software or the use or other dealings in the software",
        "permission is hereby granted free of charge",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice"
        " appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
        " in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action"
        " of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "permission to use copy modify and or distribute this software for any purpose with or without fee",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain"
        " the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and"
        " the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any"
        " express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright"
        " holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"
        " loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising"
        " in any way out of the use of this software even if advised of the possibility of such damage",
        "redistribution and use in source and binary forms",
    ),
)
#: Words of a template that are looked up, how many of them must name a place, and the share of its weight that must agree.
LOOKUPS = 3
AGREE = 2
LEAST_SHARE = 0.6
_SHIFT = 1 << 40


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.array_remove(F.split(ascii_lower(text), r"[^0-9a-z\x{80}-\x{10FFFF}]+"), "")


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    words = sorted({w for t in templates for w in t.text.split()})
    if any(not w.isascii() or w != w.lower() for w in words):
        raise ValueError("template words must be ASCII in lower case")
    return words


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """How many rows there are and how many hold each vocabulary word; over all rows, at most one count per vocabulary word comes back."""
    vocab = F.array(*[F.lit(w) for w in vocabulary(templates)])
    held = docs.select(F.array_intersect(words_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), vocab).alias("w"))
    counted = held.select(F.explode(F.concat(F.array(F.lit("")), "w")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = {r["word"]: r["n"] for r in counted.collect()}
    return found.pop("", 0), found


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", lookups: int = LOOKUPS, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a template's IDF weight at a kept place, to six digits, 0 without one.
    Defined edge cases: null and empty texts have 0 words, no labels (empty strings) and
    null positions; null ids and repeated rows keep their rows; other columns are ignored.
    """
    total, df = document_frequencies(docs, templates, text_col)
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in vocabulary(templates)}
    split = [t.text.split() for t in templates]
    postings: dict[str, list[tuple[int, int]]] = {}
    looked: list[list[tuple[str, int]]] = []  # the lookup words with their first position
    for k, words in enumerate(split):
        own = sorted(set(words), key=lambda w: (-idf[w], w))[: 1 if templates[k].base else lookups]
        looked.append([(w, words.index(w)) for w in own])
        for w, p in looked[k]:
            postings.setdefault(w, []).append((k, p))
    rare = sorted(postings)
    # a place is template * 2^40 + first word, which is negative where the template would start before the text
    post = F.create_map(*[x for w in rare for x in (F.lit(w), F.array(*[F.lit(k * _SHIFT - p) for k, p in postings[w]]))])
    lookup = F.array(*[F.array(*[F.struct(F.lit(w).alias("w"), F.lit(p).alias("p")) for w, p in o]) for o in looked])
    text_words = F.array(*[F.array(*map(F.lit, s)) for s in split])
    weights = F.array(*[F.array(*[F.lit(idf[w] / sum(idf[x] for x in s)) for w in s]) for s in split])
    key_at = [next(i for i in range(len(s)) if s[i : i + len(t.key.split())] == t.key.split()) for t, s in zip(templates, split, strict=True)]
    keys = F.array(*[F.array(*map(F.lit, t.key.split())) for t in templates])
    key_ats = F.array(*map(F.lit, key_at))
    labels = F.array(*[F.lit(t.label) for t in templates])
    n_base = sum(t.base for t in templates)
    if not all(t.base for t in templates[:n_base]):
        raise ValueError("base templates come first")

    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("w"))
    rows = rows.withColumn("n", F.size("w"))
    hits = F.when(F.col("n") > 0, F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", i).isin(rare))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("hits", hits)
    named = F.flatten(F.transform("hits", lambda i: F.transform(F.element_at(post, F.get("w", i)), lambda p: p + i.cast("long"))))
    places = F.array_distinct(named)
    template = lambda x: F.shiftright(x + F.lit(1 << 20), 40).cast("int")
    first = lambda x: (x - template(x).cast("long") * F.lit(_SHIFT)).cast("int")

    def share(t: Column, at: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(F.get(text_words, t)) - 1), F.lit(0.0), lambda acc, j: acc + F.when((at + j >= 0) & (F.get("w", F.greatest(at + j, F.lit(0))) == F.get(F.get(text_words, t), j)), F.get(F.get(weights, t), j)).otherwise(0.0))

    def kept(x: Column) -> Column:
        start = first(x) + F.get(key_ats, template(x))
        key = F.get(keys, template(x))
        stands = lambda o: (first(x) + o["p"] >= 0) & F.coalesce(F.get("w", F.greatest(first(x) + o["p"], F.lit(0))) == o["w"], F.lit(False))
        own = F.get(lookup, template(x))
        met = F.size(F.filter(own, stands)) >= F.least(F.lit(AGREE), F.size(own))
        return met & (start >= 0) & (F.slice("w", F.greatest(start + 1, F.lit(1)), F.size(key)) == key)

    verified = F.filter(places, kept)
    scored = F.transform(verified, lambda x: F.struct(template(x).alias("t"), first(x).alias("at"), share(template(x), first(x)).alias("share")))
    rows = rows.withColumn("found", F.when(F.size("hits") > 0, F.filter(scored, lambda s: (s["t"] < n_base) | (s["share"] >= least_share))))
    base = F.filter("found", lambda s: s["t"] < n_base)
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: F.get(labels, s["t"])))), ",")
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.coalesce(F.size(base), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["at"])).cast("long").alias("last_word"),
        F.coalesce(names(base), F.lit("")).alias("base_labels"),
        F.coalesce(names(F.col("found")), F.lit("")).alias("labels"),
        F.round(F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("found", lambda s: s["share"])), F.lit(0.0))), 6).alias("score"),
    )


def oracle(templates: tuple[Template, ...] = TEMPLATES, lookups: int = LOOKUPS, least_share: float = LEAST_SHARE) -> str:
    """The same as DuckDB SQL: postings, lookup words by IDF and relative positions as joins."""

    def listed(words: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    rows = []
    for k, t in enumerate(templates):
        words, key = t.text.split(), t.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rows.append(f"({k}, '{t.label}', {t.base}, {listed(words)}, {at}, {len(key)})")
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM documents),
tm(t, label, base, words, key_at, key_n) AS (VALUES {", ".join(rows)}),
post AS (SELECT t, base, key_at, key_n, unnest(range(len(words))) AS i, unnest(words) AS word FROM tm),
pos AS (SELECT * FROM (SELECT row, unnest(range(len(w))) AS p, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM post)),
idf AS (SELECT word, ln((1 + (SELECT count(*) FROM documents)) / (1 + coalesce(n, 0))) + 1 AS idf FROM (SELECT DISTINCT word FROM post) LEFT JOIN (SELECT word, count(DISTINCT row) AS n FROM pos GROUP BY word) USING (word)),
weight AS (SELECT t, base, key_at, key_n, i, word, idf / sum(idf) OVER (PARTITION BY t) AS share FROM post JOIN idf USING (word)),
look AS (SELECT t, word FROM (SELECT t, word, base, row_number() OVER (PARTITION BY t ORDER BY idf DESC, word) AS k FROM (SELECT DISTINCT t, base, word, idf FROM post JOIN idf USING (word))) WHERE k <= CASE WHEN base THEN 1 ELSE {lookups} END),
lookups AS (SELECT t, word, min(i) AS i, count(*) OVER (PARTITION BY t) AS n FROM post JOIN look USING (t, word) GROUP BY t, word),
cand AS (SELECT row, t, p - i AS place FROM pos JOIN lookups USING (word) JOIN (SELECT DISTINCT t, base, key_at, key_n FROM post) USING (t) GROUP BY row, t, p - i HAVING count(*) >= any_value(least({AGREE}, n))),
ver AS (SELECT cand.row, cand.t, place, any_value(base) AS base, sum(share) AS share, count(*) FILTER (i >= key_at AND i < key_at + key_n) AS keys, any_value(key_n) AS key_n
  FROM cand JOIN weight ON cand.t = weight.t JOIN pos ON pos.row = cand.row AND pos.p = place + i AND pos.word = weight.word GROUP BY ALL),
found AS (SELECT ver.*, label FROM ver JOIN tm ON ver.t = tm.t WHERE keys = ver.key_n AND (ver.base OR share >= {least_share})),
g AS (SELECT row, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round(least(1.0, max(share)), 6) AS score FROM found GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (row)
"""
