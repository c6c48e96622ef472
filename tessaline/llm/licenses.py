"""License scans by diagonal voting.

Every run of `k` words of every text is a hash; Spark joins all of them with the positions of the same
hashes in license templates. A hit at word p of the text and word q of the template votes for the
diagonal p - q: a copied passage is many votes on one diagonal. Votes are aggregated by text, template and
diagonal; neighbouring diagonals, which a word put in or left out makes of one passage, are merged, and a merged
band is cut again where the template starts anew, so that repeated passages are spans of their own.

Each span is verified by the share of the template's words that its hits cover, `least_share` or more, and gets a
score: covered words by the longer of template and span. Licenses that differ in a word cover each other's templates; of
spans that overlap by more than half of the shorter one, the best score stays, then the longer template.

Short phrases are templates too, and a place of a phrase is a diagonal on which all its k-grams vote,
so base labels come out of the same join. Phrases give way to no other span.

Scale: templates are broadcast if they have up to `MAX_GRAMS` k-grams, and then the join shuffles
nothing; beyond that it is a shuffled join. Hits are shuffled and written once. A text is known by 128 bits of its bytes: equal texts, however many,
vote once and share the verdict. Verdicts, a short row for each text with any, are written before rows
meet them: both sides of that join are then plain, so that Spark can split it where one text has many copies.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows get equal
results; an empty table gives an empty result; other columns are not read. Texts are read whole.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaline.llm import textkernel as K
from tessaline.session import ship, written

#: Fixed values. (label, phrase)
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Fixed values. (label, text) of license notices, as their publishers give them.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl", "licensed under the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]
#: The notice that the three licenses of one family share but for their names.
TEMPLATES += [
    (label, f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")
    for label, work, name in (("gpl", "program", "General Public License"), ("lgpl", "library", "Lesser General Public License"), ("agpl", "program", "Affero General Public License"))
]
#: Words are letters and digits of ASCII and all that is not ASCII.
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
MAX_GRAMS = 100_000


def text_keys(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """128 bits of each text, as two longs."""
    return [pa.array(K.span_fingerprints(data, offsets[:-1], offsets[1:], which).view(np.int64)) for which in (0, 1)]


def _scan(texts: pa.Array, k: int) -> Iterator[tuple[int, int, list[pa.Array], K.Words]]:
    data, offsets = K.flat_bytes(texts)
    for a, b in K.chunks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        yield a, b, text_keys(part, at), K.words(part, at, BREAKS, K.LOWER)


def _grams(w: K.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, borders): the k-grams of each text in order."""
    starts = K.window_starts(w.first, k)
    hashes = K.window_fingerprints(w.fingerprints(), k)[starts[: max(0, len(starts) - k + 1)]]
    return hashes.view(np.int64), np.concatenate(([0], np.cumsum(np.maximum(w.counts() - k + 1, 0))))


def template_grams(texts: list[str], k: int) -> list[tuple[int, int, int, int]]:
    """(template, its words, position, hash) of every k-gram of the templates."""
    data = pa.array(texts, pa.string())
    out = []
    for a, _, _, w in _scan(data, k):
        hashes, borders = _grams(w, k)
        for i in range(len(borders) - 1):
            if borders[i + 1] == borders[i]:
                raise ValueError(f"a template has fewer than {k} words: {texts[a + i]!r}")
            out += [(a + i, int(w.counts()[i]), q, int(h)) for q, h in enumerate(hashes[borders[i] : borders[i + 1]])]
    return out


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text's spans, those that no better one overlaps by more than half of the shorter."""
    for batch in batches:
        out = []
        for key1, key2, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            stay: list[tuple[int, int]] = []
            for x in sorted(spans, key=lambda x: (-x["score"], -x["size"], x["first"], x["label"])):
                a, b = x["first"], x["last"]
                k = bisect.bisect(stay, (a, b))
                # spans that stay may overlap each other by half, so a few neighbours on each side are looked at
                if any(2 * (min(b, d) - max(a, c) + 1) > min(b - a, d - c) + 1 for c, d in stay[max(0, k - 8) : k + 8]):
                    continue
                stay.insert(k, (a, b))
                out.append((key1, key2, x["label"], a, b, x["share"], x["score"]))
        yield pa.RecordBatch.from_pydict({name: [x[i] for x in out] for i, name in enumerate(SPAN.names)}, schema=SPAN)


SPAN = pa.schema([("key1", pa.int64()), ("key2", pa.int64()), ("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64()), ("score", pa.float64())])


def license_spans(docs: DataFrame, text_col: str = "text", k: int = 3, phrases: list[tuple[str, str]] | None = None, templates: list[tuple[str, str]] | None = None, gap: int = 6, least_share: float = 0.7) -> DataFrame:
    """key1, key2 (of the text), label, phrase, first, last, share, score: verified spans of each distinct text with any."""
    spark = docs.sparkSession
    ship(spark)
    phrases = PHRASES if phrases is None else phrases
    every = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in (TEMPLATES if templates is None else templates)]
    grams = template_grams([t for _, t, _ in every], k)
    known = spark.createDataFrame([(h, t, q, n, every[t][0], every[t][2]) for t, n, q, h in grams], "hash long, template int, q int, size int, label string, phrase boolean")
    if len(grams) <= MAX_GRAMS:
        known = F.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, keys, w in _scan(batch.column(0), k):
                hashes, borders = _grams(w, k)
                yield pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(hashes))], names=["key1", "key2", "hashes"])

    rolling = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "key1 long, key2 long, hashes array<long>").select("key1", "key2", F.posexplode("hashes").alias("p", "hash"))
    hits = rolling.join(known, "hash").select("key1", "key2", "template", "label", "phrase", "size", "q", "p", (F.col("p") - F.col("q")).alias("diagonal")).distinct()
    hits = written(hits, "license-hits")
    exact = hits.where("phrase").groupBy("key1", "key2", "template", "label", "size", "diagonal").agg(F.count("*").alias("votes")).where(F.col("votes") == F.col("size") - k + 1)
    exact = exact.select("key1", "key2", "label", F.col("diagonal").cast("long").alias("first"), (F.col("diagonal") + F.col("size") - 1).cast("long").alias("last"), F.lit(1.0).alias("share"), F.lit(1.0).alias("score"), F.lit(True).alias("phrase"))

    by_text = Window.partitionBy("key1", "key2", "template").orderBy("diagonal")
    near = hits.where(~F.col("phrase")).withColumn("new", (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(by_text), F.col("diagonal") - gap - 1) > gap).cast("int"))
    near = near.withColumn("band", F.sum("new").over(by_text.rangeBetween(Window.unboundedPreceding, 0)))
    by_place = Window.partitionBy("key1", "key2", "template", "band").orderBy("p", "q")
    back = F.lag("q").over(by_place) - F.col("q")
    near = near.withColumn("anew", F.coalesce(back > F.least(F.lit(gap), F.expr(f"(size - {k}) div 2")), F.lit(False)).cast("int"))
    near = near.withColumn("span", F.sum("anew").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    spans = near.groupBy("key1", "key2", "template", "label", "size", "band", "span").agg(F.array_sort(F.collect_set("q")).alias("qs"), F.min("p").cast("long").alias("first"), (F.max("p") + k - 1).cast("long").alias("last"))
    # words of the template under the k-grams that were hit: k for the first, then no more than the step
    covered = F.aggregate("qs", F.struct(F.lit(0).alias("n"), F.lit(-k).alias("at")), lambda s, q: F.struct((s["n"] + F.least(F.lit(k), q - s["at"])).alias("n"), q.alias("at")))["n"]
    spans = spans.withColumn("share", covered / F.col("size")).where(F.col("share") >= least_share).withColumn("score", covered / F.greatest(F.col("size"), F.col("last") - F.col("first") + 1))
    best = spans.groupBy("key1", "key2").agg(F.collect_list(F.struct("label", "first", "last", "size", "share", "score")).alias("spans")).mapInArrow(_best, "key1 long, key2 long, label string, first long, last long, share double, score double")
    return exact.unionByName(best.withColumn("phrase", F.lit(False)))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, **how) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    spans = license_spans(docs, text_col, k, **how)
    base = lambda c: F.when(F.col("phrase"), c)
    found = spans.groupBy("key1", "key2").agg(
        F.count(base(F.col("first"))).alias("n_base"), F.min(base(F.col("first"))).alias("first_word"), F.max(base(F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base(F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"),
    )
    found = written(found, "license-verdicts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, keys, w in _scan(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *keys, pa.array(w.counts(), pa.int64())], names=["doc_id", "key1", "key2", "n_words"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, key1 long, key2 long, n_words long")
    return rows.join(found, ["key1", "key2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
