"""License scans by diagonal voting of word k-grams against templates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import license_texts
from .common import prepare
from .ngrams import mix, owners, text_bytes, word_hashes

K = 3
#: A template is voted for in parts of this many words, one bit for each word.
PART = 62
#: Diagonals of one template that lie this close together are one passage with words put in or left out.
NEIGHBOURS = 3
#: Share of a template's words that a passage must hold.
COVERAGE = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False  #: base templates count only where their words stand consecutively
    needs: str = ""  #: words that tell the license from its siblings; a passage must hold all of them
    bars: str = ""  #: a word, and words of which none may follow it in the passage, since they name a sibling


#: Fixed phrases of the contract, then the opening words of widespread licenses and their notices, then whole licenses.
TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", bars="gnu lesser library affero"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", needs="lesser"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", bars="attribution noncommercial non sharealike share noderivatives noderivs no"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", needs="noncommercial"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", needs="sharealike"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution non commercial 4 0 international license", needs="commercial"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution share alike 4 0 international license", needs="alike"),
    Template("lgpl", "under the terms of the gnu library general public license as published by the free software foundation", needs="library"),
    *(Template(label, text) for label, text in license_texts.WHOLE),
)

_NO_WORD = np.ones(256, dtype=bool)
_NO_WORD[ord("0") : ord("9") + 1] = False
_NO_WORD[ord("a") : ord("z") + 1] = False
_NO_WORD[128:] = False
#: Stands for the whole document in the join, so that a document without any hit keeps its row.
_DOCUMENT = 0


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word hashes, words and word bounds of each text; only A to Z are lower-cased."""
    raw, at = text_bytes(texts)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    hashes, start, end = word_hashes(low, at, _NO_WORD)
    size = end - start
    take = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(low[take]))
    bounds = np.searchsorted(owners(start, at), np.arange(len(at)))
    return hashes, words, bounds


def _kgrams(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A k-gram hash at every word, and the number of whole k-grams of each text."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        acc = np.zeros(n, dtype=np.uint64)
        for j in range(K):
            acc[: max(0, n - j)] = acc[: max(0, n - j)] * np.uint64(0x9E3779B97F4A7C15) + hashes[j:]
    out = mix(acc)
    out[out == _DOCUMENT] = 1
    return out, np.maximum(0, np.diff(bounds) - K + 1)


def template_words(template: Template) -> list[str]:
    return _words(pa.array([template.text]))[1].to_pylist()


def template_table(spark, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(gram, template, at, start, words, needs, bar_at, bars): every k-gram of every template.

    start and words are the part that the k-gram begins in, needs the part's words that the template needs, as bits.
    The table's size is that of the given templates.
    """
    rows = [(_DOCUMENT, -1, 0, 0, None, 0, None, None)]
    for t, x in enumerate(templates):
        words, bars = template_words(x), x.bars.split()
        if len(words) < K:
            raise ValueError(f"a template has {K} words or more")
        hashes, _, bounds = _words(pa.array([x.text]))
        grams, n = _kgrams(hashes, bounds)
        for j, g in enumerate(grams[: n[0]].view(np.int64)):
            start = j - j % PART
            part = words[start : start + PART]
            needs = sum(1 << i for i, w in enumerate(part) if w in x.needs.split())
            rows.append((int(g), t, j, start, part, needs, words.index(bars[0]) if bars else None, bars))
    return spark.createDataFrame(rows, "gram long, template int, at int, start int, t array<string>, needs long, bar_at int, bars array<string>")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages and labels of every document.

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (template, first, last,
    coverage). All k-gram hashes of a text join the template positions; each hit votes for the diagonal (position in
    the text less position in the template) and is verified there: the words of the text on that diagonal are compared
    with those of the template's part that the hit lies in (templates of up to ``PART`` words have one part). Base
    templates count each diagonal on which all their words stand. For the others, neighbouring diagonals are merged and
    count from ``COVERAGE`` of the template's words on, if they hold the words that the template needs and none that it
    bars. score is the highest coverage of a counted passage, else 0.

    One row goes through the shuffle for each document and for each verified part of a diagonal. Rows are told apart by
    id and text; those that agree in both come out as often as they went in, which bitwise votes leave correct. Texts
    and templates may have any length. Null texts are empty, null ids stay null, an empty table gives no rows, other
    columns are ignored.
    """
    spark = prepare(docs.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, words, bounds = _words(b.column(2))
            grams, n = _kgrams(hashes, bounds)
            at = np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int32)
            flat = np.zeros(at[-1], dtype=np.int64)
            inner = np.ones(at[-1], dtype=bool)
            inner[at[:-1]] = False
            flat[inner] = grams.view(np.int64)[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1], n)]
            cols = [b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), words), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "words", "grams"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = docs.select(F.col(id_col).alias("doc_id"), F.sha1(text.cast("binary")).alias("text_hash"), text.alias("text"))
    cut = cut.mapInArrow(split, f"doc_id {kind}, text_hash string, words array<string>, grams array<long>")
    hits = (
        cut.select("doc_id", "text_hash", "words", F.posexplode("grams").alias("pos", "gram"))
        .join(F.broadcast(template_table(spark, templates)), "gram")
        .withColumn("diagonal", F.when(F.col("template") >= 0, F.col("pos") - 1 - F.col("at")).otherwise(0))
        .select(
            "doc_id", "text_hash", "template", "start", "diagonal", "needs",
            F.when(F.col("template") < 0, F.size("words").cast("long")).alias("n_words"),
            F.expr("coalesce(aggregate(transform(t, (w, i) -> IF(get(words, diagonal + start + i) <=> w, shiftleft(1L, i), 0L)), 0L, (s, x) -> s | x), 0L)").alias("mask"),
            F.expr("coalesce(get(words, diagonal + bar_at) = get(bars, 0) AND array_position(slice(bars, 2, size(bars)), get(words, diagonal + bar_at + 1)) > 0, false)").alias("barred"),
        )
    )
    key = ["doc_id", "text_hash"]
    votes = hits.repartition(*key).groupBy(*key, "template", "diagonal", "start").agg(
        F.max("mask").alias("mask"), F.max("needs").alias("needs"), F.max("barred").alias("barred"), F.max("n_words").alias("n_words"), F.count("n_words").alias("copies")
    )
    w = Window.partitionBy(*key, "template").orderBy("diagonal", "start")
    per = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("template"))
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(w) <= NEIGHBOURS, 0).otherwise(1)
    size = per([len(template_words(t)) for t in templates])
    needed = per([sum(x in t.needs.split() for x in template_words(t)) for t in templates])
    is_base = per([t.base for t in templates])
    label = per([t.label for t in templates])
    on_diagonal = F.sum(F.bit_count("mask")).over(Window.partitionBy(*key, "template", "diagonal"))
    parts = (
        votes.withColumn("apart", apart)
        .withColumn("passage", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("full", F.when(is_base & (on_diagonal == size) & (F.col("start") == 0), F.col("diagonal")))
        .withColumn("lead", F.col("diagonal") + F.col("start") + F.log2(F.col("mask").bitwiseAND(-F.col("mask")).cast("double")).cast("int"))
        .groupBy(*key, "template", "passage", "start")
        .agg(
            F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.bit_or("mask").alias("mask"), F.max("needs").alias("needs"), F.max("barred").alias("barred"),
            F.count("full").alias("n_base"), F.min("full").alias("first_full"), F.max("full").alias("last_full"), F.min("lead").alias("first"), F.max("diagonal").alias("last_diagonal"),
        )
    )
    clusters = (
        parts.groupBy(*key, "template", "passage")
        .agg(
            F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.sum(F.bit_count("mask")).alias("n_match"), F.sum(F.bit_count(F.col("mask").bitwiseAND(F.col("needs")))).alias("n_needed"),
            F.max("barred").alias("barred"), F.sum("n_base").alias("n_base"), F.min("first_full").alias("first_full"), F.max("last_full").alias("last_full"),
            F.min("first").alias("first"), F.max("last_diagonal").alias("last_diagonal"),
        )
        .withColumn("share", F.col("n_match") / size)
        .withColumn("counts", F.when(F.col("template") < 0, False).when(is_base, F.col("n_base") > 0).otherwise((F.col("share") >= COVERAGE) & (F.col("n_needed") == needed) & ~F.col("barred")))
    )
    base = F.col("counts") & is_base
    join = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, label))), ",")
    span = F.struct("template", F.coalesce("first_full", "first").cast("long").alias("first"), (F.coalesce("last_full", "last_diagonal") + size - 1).cast("long").alias("last"), F.least("share", F.lit(1.0)).alias("coverage"))
    out = clusters.groupBy(*key).agg(
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.sum("n_base").alias("n_base"),
        F.min("first_full").cast("long").alias("first_word"), F.max("last_full").cast("long").alias("last_word"),
        join(base).alias("base_labels"), join(F.col("counts")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("counts"), F.least("share", F.lit(1.0)))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("counts"), span))).alias("spans"),
    )
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_copy", "copies", "text_hash")
