"""License scans by a positional index of rare license words, in DataFrame functions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A word, after A-Z became small: digits, letters and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    """A license text's words, and the phrases of it that a file must have at their place."""

    label: str
    text: str
    phrases: tuple[str, ...]


#: Names whose places are counted, with the labels that they give.
NAMES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Short notices, and the opening or granting passages of public licenses.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "this program is free software under the terms of the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl", "you can redistribute it under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "publish distribute sublicense and or sell"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must "
        "retain the above copyright notice this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "retain the above copyright notice"),
    ),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        ("except in compliance with the license", "apache org licenses license 2 0"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies",
        ("with or without fee is hereby granted",),
    ),
)


class Index(NamedTuple):
    """Words by number, in order of their first use in names and templates, and texts as numbers."""

    words: list[str]
    names: list[tuple[str, list[int]]]
    templates: list[tuple[str, list[int], list[tuple[int, list[int]]]]]


def build_index(names: tuple[tuple[str, str], ...] = NAMES, templates: tuple[Template, ...] = TEMPLATES) -> Index:
    """The words of all texts; for each template its phrases with their positions in it."""
    words: dict[str, int] = {}
    numbers = lambda text: [words.setdefault(w, len(words)) for w in text.split()]
    own_names = [(label, numbers(name)) for name, label in names]
    own_templates = []
    for t in templates:
        text = numbers(t.text)
        places = []
        for phrase in map(numbers, t.phrases):
            places.append((next(i for i in range(len(text)) if text[i : i + len(phrase)] == phrase), phrase))
        own_templates.append((t.label, text, places))
    return Index([*words], own_names, own_templates)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once a row."""
    return F.get(F.transform(F.array(value), body), 0)


# A hit is one long: position * BASE + word number; a file's hits are in order of position.
BASE = 4096


def license_hits(docs: DataFrame, index: Index) -> DataFrame:
    """docs with n_words and hits, the positions of license words, instead of text. The texts' only pass."""
    numbered = F.array(*map(F.lit, index.words))
    words = docs.withColumn("_w", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))).drop("text")
    hit = F.transform("_w", lambda w, i: F.when(w.isin(index.words), i.cast("long") * BASE + F.array_position(numbered, w) - 1))
    return words.withColumn("n_words", F.size("_w").cast("long")).withColumn("hits", F.filter(hit, lambda h: h.isNotNull())).drop("_w")


def _ints(xs: list[int]) -> str:
    return f"array({', '.join(map(str, xs))})" if xs else "CAST(array() AS array<int>)"


def _places(hits: Column, phrases: list[list[int]]) -> Column:
    """For each phrase the positions at which its words stand one after another; hits must be a column, it's read at each step."""

    def of(phrase: Column) -> Column:
        def stands(h: Column, i: Column) -> Column:
            follows = F.forall(F.sequence(F.lit(1), F.size(phrase) - 1), lambda k: F.get(hits, i + k).eqNullSafe(h - F.get(phrase, 0) + k * BASE + F.get(phrase, k)))
            return (h % BASE == F.get(phrase, 0)) & ((F.size(phrase) == 1) | follows)

        return F.transform(F.filter(hits, stands), lambda h: F.floor(h / BASE))

    return F.transform(F.expr(f"array({', '.join(map(_ints, phrases))})"), of)


def _shares(hits: Column, places: Column, templates: list[tuple[dict[int, list[int]], list[tuple[int, int]]]], slack: int, least: float) -> Column:
    """For each template (positions of its rare words; its phrases by number, with their positions) the largest share of the rare words that stand at one
    relative position, of those where each phrase stands within `slack`; null if under `least`."""
    n_held = max(len(held) for _, held in templates)
    codes = n_held + max(sum(map(len, at.values())) for at, _ in templates) + 1
    rows = []
    for at, held in templates:
        held = held + held[-1:] * (n_held - len(held))  # the same phrase again
        words, starts = _ints([*at]), ", ".join(map(_ints, at.values()))
        rows.append(f"named_struct('words', {words}, 'at', array({starts}), 'total', {sum(map(len, at.values()))}, 'held', {_ints([i for i, _ in held])}, 'q', {_ints([q for _, q in held])})")
    off = 1 << 20

    def of(t: Column) -> Column:
        # Each rare word of the file votes for the starts that its places in the template imply.
        some = F.filter(hits, lambda h: F.array_contains(t["words"], (h % BASE).cast("int")))
        starts = lambda h: F.transform(F.get(t["at"], (F.array_position(t["words"], (h % BASE).cast("int")) - 1).cast("int")), lambda q: F.floor(h / BASE) - q)
        strong = _let(F.sort_array(F.flatten(F.transform(some, starts))), lambda v: F.when(F.size(v) > 0, F.filter(_runs(v), lambda r: r["n"] >= F.lit(least) * t["total"])))
        # Strong starts and those that phrases imply, in one order: a phrase counts for a start if its last one up to start + slack is at start - slack or later.
        events = [F.transform(strong, lambda r: (r["start"] + slack + off) * codes + n_held + r["n"])]
        events += [_implied(F.get(places, F.get(t["held"], k)), off - F.get(t["q"], k), codes, k) for k in range(n_held)]
        best = F.aggregate(F.sort_array(F.concat(*events)), zero, step, lambda state: state["best"])
        return F.when(best > 0, best / t["total"].cast("double"))

    zero = F.struct(*(F.lit(-(1 << 40)).cast("long").alias(f"l{k}") for k in range(n_held)), F.lit(0).cast("long").alias("best"))

    def step(state: Column, e: Column) -> Column:
        time, code, held = F.floor(e / codes), e % codes, F.lit(True)
        for k in range(n_held):
            held = held & (state[f"l{k}"] >= time - 2 * slack)
        last = [F.when(code == k, time).otherwise(state[f"l{k}"]).alias(f"l{k}") for k in range(n_held)]
        return F.struct(*last, F.greatest(state["best"], F.when((code >= n_held) & held, code - n_held).otherwise(0)).alias("best"))

    return F.transform(F.expr(f"array({', '.join(rows)})"), of)


def _runs(v: Column) -> Column:
    """Of a sorted array its values (start) with how often each occurs (n)."""
    first = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: ~F.get(v, i - 1).eqNullSafe(F.get(v, i)))
    return _let(first, lambda f: F.transform(f, lambda s, j: F.struct(F.get(v, s).alias("start"), (F.coalesce(F.get(f, j + 1), F.size(v)) - s).alias("n"))))


def _implied(places: Column, shift: Column, codes: int, k: int) -> Column:
    return F.transform(places, lambda p: (p + shift) * codes + k)


def scan_licenses(docs: DataFrame, index: Index | None = None, rare: int = 12, slack: int = 16, least: float = 0.34) -> DataFrame:
    """docs (text and any others) with n_words, n_base, first_word, last_word, base_labels, labels and score instead of text.

    The texts are read once: words are cut, and of those in the index positions are kept (a few bytes a hit, written to the shared folder). From these the
    number of files with each license word is counted over all files. A template's `rare` words are those of the highest IDF that files have; each one
    in a file votes for the start of the template that its relative position implies. A start with `least` of the votes
    holds if all the template's phrases stand within `slack` words of their places. Names (base) count wherever their words stand one after another.
    A file's work grows with its words, also where it repeats a license very often.

    score is the share of a template's rare words at their places, the best of a file's labels; 1 for a name; 0 without labels.
    A null text is empty; ids aren't read, so null and repeated ones are files of their own; other columns stay, but those that this adds are
    replaced; an empty table gives an empty result. The driver gets a row a license word (a few hundred), nothing is shuffled but these counts.
    """
    index = index or build_index()
    own = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    others = [c for c in docs.columns if c not in (*own, "text")]
    # The caller's columns in a struct, so that no name clashes.
    packed = docs.select(F.struct(*others).alias("own") if others else F.lit(None).alias("own"), "text")
    hits = written(license_hits(packed, index), "hits")
    used = hits.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h % BASE))).alias("w")).groupBy("w").count()
    files = {r["w"]: r["count"] for r in used.collect()}  # a row a license word at most

    number: dict[tuple[int, ...], int] = {}
    named = [(label, number.setdefault(tuple(n), len(number))) for label, n in index.names]
    templates, labels = [], []
    for label, text, held in index.templates:
        known = sorted({w for w in text if files.get(w)}, key=lambda w: (files[w], index.words[w]))[:rare]
        if known and all(files.get(w) for _, p in held for w in p):
            templates.append(({w: [q for q, x in enumerate(text) if x == w] for w in known}, [(number.setdefault(tuple(p), len(number)), q) for q, p in held]))
            labels.append(label)
    placed = hits.withColumn("places", _places(F.col("hits"), [list(p) for p in number]))
    shares = _shares(F.col("hits"), F.col("places"), templates, slack, least) if templates else F.array().cast("array<double>")
    # A file without hits has nothing to look up.
    scored = placed.withColumn("shares", F.when(F.size("hits") > 0, shares))

    place = lambda i: F.get("places", i)
    starts = scored.withColumn("starts", F.concat(*(place(i) for _, i in named)))
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*xs)))), ",") if xs else F.lit("")
    base = [F.when(F.size(place(i)) > 0, label) for label, i in named]
    found = [F.when(F.get("shares", i).isNotNull(), label) for i, label in enumerate(labels)]
    values = [F.col("n_words"), F.size("starts").cast("long"), F.array_min("starts"), F.array_max("starts"), joined(base), joined(base + found)]
    values.append(F.when(F.size("starts") > 0, 1.0).otherwise(F.coalesce(F.array_max("shares"), F.lit(0.0))))
    return starts.select(*(F.col("own").getField(c).alias(c) for c in others), *(v.alias(c) for v, c in zip(values, own)))


def license_sql(names: tuple[tuple[str, str], ...] = NAMES, templates: tuple[Template, ...] = TEMPLATES, rare: int = 12, slack: int = 16, least: float = 0.34) -> str:
    """The same scan of `documents` in SQL, by joins of words and places."""
    text = [(t, q, w) for t, x in enumerate(templates) for q, w in enumerate(x.text.split())]
    held = [(t, f" {x.text} ".split(f" {p} ")[0].count(" ") if not x.text.startswith(p) else 0, p) for t, x in enumerate(templates) for p in x.phrases]
    phrases = {p: i for i, p in enumerate(dict.fromkeys([*(p for _, _, p in held), *(n for n, _ in names)]))}
    values = lambda rows: "VALUES " + ", ".join("(" + ", ".join(map(repr, r)) + ")" for r in rows)
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents
), labels_(t, label, n_held) AS ({values([(t, x.label, len(x.phrases)) for t, x in enumerate(templates)])}), texts(t, q, w) AS ({values(text)}), held(t, q, ph) AS ({values([(t, q, phrases[p]) for t, q, p in held])}),
phrases(ph, n_words, k, w) AS ({values([(i, len(p.split()), k, w) for p, i in phrases.items() for k, w in enumerate(p.split())])}), names_(ph, label) AS ({values([(phrases[n], label) for n, label in names])}),
hits AS (
  SELECT d, pos, w FROM (SELECT d, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM docs) WHERE w IN (SELECT w FROM texts UNION SELECT w FROM phrases)
), files AS (
  SELECT w, count(DISTINCT d) AS n FROM hits GROUP BY w
), known AS (
  SELECT t, w FROM (SELECT DISTINCT t, w FROM texts) JOIN files USING (w) QUALIFY row_number() OVER (PARTITION BY t ORDER BY n, w) <= {rare}
), totals AS (
  SELECT t, count(*) AS total FROM texts JOIN known USING (t, w) GROUP BY t
), places AS (
  SELECT d, ph, pos - k AS place FROM hits JOIN phrases USING (w) GROUP BY d, ph, pos - k HAVING count(*) = max(n_words)
), votes AS (
  SELECT d, t, pos - q AS start, count(*) AS n FROM hits JOIN texts USING (w) JOIN known USING (t, w) GROUP BY d, t, pos - q
), strong AS (
  SELECT v.*, n / total::DOUBLE AS share FROM votes v JOIN totals USING (t) WHERE n >= {least}::DOUBLE * total
), held_at AS (
  SELECT DISTINCT s.d, s.t, s.start, s.share, h.ph FROM strong s JOIN held h ON h.t = s.t JOIN places p ON p.d = s.d AND p.ph = h.ph AND abs(p.place - s.start - h.q) <= {slack}
), shares AS (
  SELECT d, t, max(share) AS share FROM (SELECT d, t, start, share FROM held_at JOIN labels_ USING (t) GROUP BY d, t, start, share HAVING count(*) = max(n_held)) GROUP BY d, t
), found AS (
  SELECT d, label, NULL::DOUBLE AS share, place FROM places JOIN names_ USING (ph) UNION ALL SELECT d, label, share, NULL FROM shares JOIN labels_ USING (t)
), sums AS (
  SELECT d, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place IS NOT NULL) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, CASE WHEN count(place) > 0 THEN 1 ELSE max(share) END AS score FROM found GROUP BY d
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM docs LEFT JOIN sums USING (d)
"""
