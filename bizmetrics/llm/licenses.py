"""Licence notices by a positional index of their rare words, in built-in functions only.

A template is a sequence of words; a posting is a word with its place in a template. Where
a template stands with at least ``need`` of ``len`` words in place, one of any
``len - need + 1`` of its places must agree, so only the words at its rarest places (highest
inverse document frequency over the whole corpus) are looked up in a file. Each such word
proposes the start at which its posting would lie; a proposed start is kept if enough words
stand in place and every mandatory key phrase stands whole. Everything happens within a
file's row: the only shuffle is the count of document frequencies of the templates' words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False  # a phrase: all words in place, and counted as a place
    words: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "words", tuple(self.text.split()))

    @property
    def need(self) -> int:
        """Words that must stand in place: all of a phrase, four of five of a notice."""
        n = len(self.words)
        return n if self.base else -(-4 * n // 5)

    def key_places(self) -> list[tuple[int, tuple[str, ...]]]:
        out = []
        for key in self.keys:
            own = tuple(key.split())
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(own)] == own)
            out.append((at, own))
        return out


# Phrases and public licence notices, lower case, words only.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files",
        ("hereby granted free of charge",),
    ),
    Template(
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at",
        ("in compliance with the license",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        ("source and binary forms",),
    ),
    Template(
        "gpl-2",
        "under the terms of the gnu general public license as published by the free software "
        "foundation either version 2 of the license",
        ("gnu general public license", "version 2"),
    ),
    Template(
        "gpl-3",
        "under the terms of the gnu general public license as published by the free software "
        "foundation either version 3 of the license",
        ("gnu general public license", "version 3"),
    ),
    Template("gpl-2", "gnu general public license version 2", ("public license version 2",)),
    Template("gpl-3", "gnu general public license version 3", ("public license version 3",)),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or "
        "without fee is hereby granted",
        ("with or without fee",),
    ),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    Template(
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0",),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("unencumbered software",),
    ),
    Template(
        "bsd-3",
        "nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission",
        ("endorse or promote products",),
    ),
    Template(
        "lgpl-2",
        "under the terms of the gnu lesser general public license as published by the free software "
        "foundation either version 2 1 of the license",
        ("gnu lesser general public license", "version 2 1"),
    ),
    Template(
        "lgpl-3",
        "under the terms of the gnu lesser general public license as published by the free software "
        "foundation either version 3 of the license",
        ("gnu lesser general public license", "version 3"),
    ),
    Template(
        "agpl-3",
        "under the terms of the gnu affero general public license as published by the free software "
        "foundation either version 3 of the license",
        ("gnu affero general public license", "version 3"),
    ),
    Template(
        "epl-2",
        "this program and the accompanying materials are made available under the terms of the "
        "eclipse public license 2 0",
        ("eclipse public license 2 0",),
    ),
    Template(
        "epl-1",
        "this program and the accompanying materials are made available under the terms of the "
        "eclipse public license v1 0",
        ("eclipse public license v1 0",),
    ),
    Template(
        "cc-by-sa",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        ("creative commons attribution sharealike",),
    ),
    Template(
        "cc-by-nc",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        ("creative commons attribution noncommercial 4 0",),
    ),
    Template(
        "cc-by-nc-sa",
        "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 "
        "international license",
        ("attribution noncommercial sharealike",),
    ),
    Template(
        "cc0",
        "to the extent possible under law the author has waived all copyright and related or "
        "neighboring rights to this work",
        ("waived all copyright",),
    ),
    Template(
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of "
        "the software and accompanying documentation covered by this license",
        ("any person or organization",),
    ),
    Template(
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial "
        "applications and to alter it and redistribute it freely subject to the following restrictions",
        ("including commercial applications",),
    ),
)


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text; none if it is null."""
    return F.regexp_extract_all(
        F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0)
    )


def document_frequencies(files: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """Files that hold each of the templates' words: a row a word, whatever the corpus."""
    known = sorted({w for t in templates for w in t.words})
    rows = files.select(
        F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(known)))).alias("word")
    )
    return {r.word: r["count"] for r in rows.groupBy("word").count().collect()}


def _literals(templates: tuple[Template, ...], frequency: dict[str, int]):
    """The templates, and the postings at their rarest places, as constant arrays."""
    table = F.array(
        *[
            F.struct(
                F.lit(t.label).alias("label"),
                F.array(*map(F.lit, t.words)).alias("words"),
                F.lit(t.need).alias("need"),
                F.lit(t.base).alias("base"),
                (
                    F.array(
                        *[
                            F.struct(F.lit(at).alias("at"), F.array(*map(F.lit, key)).alias("words"))
                            for at, key in t.key_places()
                        ]
                    )
                    if t.keys
                    else F.lit([]).cast("array<struct<at:int,words:array<string>>>")
                ).alias("keys"),
            )
            for t in templates
        ]
    )
    postings = []
    for number, t in enumerate(templates):
        rare = sorted(range(len(t.words)), key=lambda i: (frequency.get(t.words[i], 0), t.words[i], i))
        postings += [(t.words[i], number, i) for i in rare[: len(t.words) - t.need + 1]]
    return table, postings


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
) -> DataFrame:
    """Licence labels of every file.

    Returns one row per input row: ``doc_id, n_words, n_base`` (places of the phrases),
    ``first_word, last_word`` (their least and largest start), ``base_labels, labels``
    (comma-joined, sorted; empty if none) and ``score`` (largest share of a found template's
    words in place; 0 if none is found). Defined cases: a null text has no words; null and
    repeated ids and repeated rows are scanned as they come; overlapping places all count;
    an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    files = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    table, postings = _literals(templates, document_frequencies(files, templates))
    rare = sorted({word for word, _, _ in postings})
    by_word = F.array(
        *[
            F.struct(F.lit(w).alias("word"), F.lit(t).alias("t"), F.lit(o).alias("o"))
            for w, t, o in postings
        ]
    )

    def starts(i: Column) -> Column:
        word = F.get("words", i)
        return F.transform(
            F.filter(by_word, lambda p: p["word"] == word),
            lambda p: F.struct(p["t"].alias("t"), (i - p["o"]).alias("s")),
        )

    def judged(c: Column) -> Column:
        own = F.get(table, c["t"])
        n = F.size(own["words"])
        in_place = F.size(
            F.filter(
                F.sequence(F.lit(0), n - 1),
                lambda k: F.get("words", c["s"] + k) == F.get(own["words"], k),
            )
        )
        whole = F.forall(
            own["keys"], lambda key: F.slice("words", c["s"] + key["at"] + 1, F.size(key["words"])) == key["words"]
        )
        return F.struct(
            c["s"].alias("s"), own["label"].alias("label"), own["base"].alias("base"),
            (in_place / n).alias("share"), ((in_place >= own["need"]) & whole).alias("found"),
        )

    some = F.when(F.col("n_words") > 0, F.sequence(F.lit(0), F.col("n_words") - 1)).otherwise(
        F.lit([]).cast("array<int>")
    )
    looked_up = files.withColumn("n_words", F.size("words")).withColumn(
        "hits", F.filter(some, lambda i: F.get("words", i).isin(rare))
    )
    proposed = looked_up.withColumn(
        "proposed",
        F.filter(
            F.array_distinct(F.flatten(F.transform("hits", starts))),
            lambda c: (c["s"] >= 0) & (c["s"] + F.size(F.get(table, c["t"])["words"]) <= F.col("n_words")),
        ),
    )
    found = proposed.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.filter(F.transform("proposed", judged), lambda f: f["found"]).alias("found"),
    ).withColumn("places", F.transform(F.filter("found", lambda f: f["base"]), lambda f: f["s"].cast("long")))

    def joined(kept: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(kept, lambda f: f["label"]))), ",")

    return found.select(
        "doc_id", "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        joined(F.filter("found", lambda f: f["base"])).alias("base_labels"),
        joined(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)).alias("score"),
    )
