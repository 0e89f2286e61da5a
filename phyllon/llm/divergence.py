"""How the sources of a language differ in their words: divergences of all pairs of sources, and each source's most telling terms."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_batches, runs, written

#: Byte by byte: letters A-Z become small, small letters and all bytes of other characters stay, the rest are blanks.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"
SCALE = 1_000_000_000


def words_of(text: str, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in slices of about `step` bytes that cut no term."""
    data, a = text.encode().translate(LETTERS), 0
    while a < len(data):
        b = data.find(b" ", a + step)
        b = len(data) if b < 0 else b
        yield data[a:b].split()
        a = b


def _counted(most: int):
    """Texts to counts for each (lang, source, term); a task holds about `most` terms at once. An empty term marks that a group occurs."""

    def rows(seen: dict[tuple[str, str], tuple[Counter, Counter]]) -> pd.DataFrame:
        out = [(*g, t.decode(), n, docs[t]) for g, (terms, docs) in seen.items() for t, n in terms.items()]
        return pd.DataFrame(out, columns=["lang", "source", "term", "n", "docs"])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for pdf in batches:
            for lang, source, text in zip(pdf["lang"], pdf["source"], pdf["text"]):
                terms, docs = seen.setdefault((lang, source), (Counter({b"": 0}), Counter()))
                own: set[bytes] = set()
                for words in words_of(text):
                    terms.update(words)
                    own.update(words)
                docs.update(own)
            if sum(len(t) for t, _ in seen.values()) > most:
                yield rows(seen)
                seen = {}
        if seen:
            yield rows(seen)

    return each


def group_terms(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group, and its documents there. Counted in the tasks before they move."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return texts.mapInPandas(_counted(most), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), exact also where that product is over 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("`div`", (wide(n) + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + kept * 2)) + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("`div`", (p - q) * (p - q), p + q)


def _shares(n: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """share() of whole arrays. Long division by three digits at a time keeps all within 64 bits for sums below 9 * 10^15."""
    whole, rest = np.zeros_like(n), n + 2
    below = total + 2 * kept
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digits
    return whole + 1


def _pair_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Terms (lang, sources, totals, kept, at, n) to the sums of gaps for each ordered pair of a language's sources: a matrix a language."""
    sums: dict[str, tuple[list[str], np.ndarray]] = {}
    for pdf in batches:
        for lang, part in pdf.groupby("lang", sort=False):
            sources, totals, kept = (part[c].iloc[0] for c in ("sources", "totals", "kept"))
            n = np.zeros((len(part), len(sources)), np.int64)
            row = np.repeat(np.arange(len(part)), part["at"].map(len))
            n[row, np.concatenate(part["at"].to_numpy())] = np.concatenate(part["n"].to_numpy())
            p = _shares(n, np.asarray(totals, np.int64)[None, :], int(kept))
            _, total = sums.setdefault(lang, (list(sources), np.zeros((len(sources),) * 2, np.int64)))
            for i in range(len(sources)):
                own = p[:, [i]]
                total[i] += ((p - own) ** 2 // (p + own)).sum(0)
    for lang, (sources, total) in sums.items():
        yield pd.DataFrame({"lang": lang, "source": np.repeat(sources, len(sources)), "item": sources * len(sources), "value": total.ravel()}).loc[lambda x: x["source"] != x["item"]]


def skyband(lang_n: list[int], terms: list[str], k: int) -> list[int]:
    """Positions of those that fewer than k earlier ones dominate, by a language's count that is no higher and an earlier term.

    The input is in order of the group's count, falling, then lang_n and term, rising, so all that dominate a term come before it, and of k or more at least
    k are in the band. A Fenwick tree over lang_n has in each node the k earliest terms of the band members that it covers.
    """
    level = np.unique(lang_n, return_inverse=True)[1].tolist()
    size = max(level, default=0) + 1
    tree: list[list[str]] = [[] for _ in range(size + 1)]
    kept = []
    for i, (at, term) in enumerate(zip(level, terms)):
        found, j = 0, at + 1
        while j and found < k:
            found += bisect_left(tree[j], term)
            j &= j - 1
        if found >= k:
            continue
        kept.append(i)
        j = at + 1
        while j <= size:
            insort(tree[j], term)
            del tree[j][k:]
            j += j & -j
    return kept


def _bands(k: int, step: int):
    """Rows in order of group, count, the language's count and term to each group's skyband; at most `step` rows and the band so far at once."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        band = None
        for part in runs(_cut(batches, step), "part"):
            if band is not None and band["g"].iloc[0] != part["g"].iloc[0]:
                yield band
                band = None
            both = part if band is None else pd.concat([band, part])
            band = both.iloc[skyband(both["lang_n"].tolist(), both["term"].tolist(), k)]
        if band is not None:
            yield band

    def _cut(batches: Iterator[pd.DataFrame], step: int) -> Iterator[pd.DataFrame]:
        last, n, part = None, 0, 0
        for pdf in batches:
            marks = []
            for g in pdf["g"].tolist():
                if g != last or n >= step:
                    last, n, part = g, 0, part + 1
                n += 1
                marks.append(part)
            yield pdf.assign(part=marks)

    return lambda batches: (x.drop(columns="part") for x in each(batches))


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source).

    Terms are runs of letters and of characters beyond ASCII; A-Z count as small letters. A language keeps the terms that are in at least `least_docs` of its
    documents. Part pair: for each two sources of a language the sum of gaps of their shares over all kept terms. Part term: for each group the
    `top` kept terms with the largest gap above the language's share, from the group's dominance skyband: each partition retains the terms that fewer than
    `top` others dominate (higher count in the group, lower in the language, earlier in UTF-8), which needs no totals; the bands are merged and ranked
    exactly. The ranking's window keeps the best of each partition before its exchange.

    Null text, language and source are empty strings; ids aren't read, so repeated rows are documents of their own; other columns are ignored; a group
    without kept terms has pairs (of value 0 if its language keeps none) and no terms; an empty table gives no row.
    Counts are exact; group totals may reach 9 * 10^15 words.

    Rows of a term are one for each source, the pair sums a matrix of the language's sources in each task: both grow with the number of sources, not of documents.
    """
    counts = written(group_terms(docs), "counts")
    per_term = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("items"))
    kept = written(per_term.filter(F.col("docs") >= least_docs).drop("docs"), "kept")

    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("kept"))
    totals = kept.select("lang", F.explode("items").alias("i")).groupBy("lang", "i.source").agg(F.sum("i.n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "kept"))), "groups")

    # A row a language; its sources in order.
    of_lang = groups.groupBy("lang", "kept").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("s")).select("lang", "kept", F.col("s.source").alias("sources"), F.col("s.total").alias("totals"))
    place = F.transform("items", lambda x: (F.array_position("sources", x["source"]) - 1).cast("int"))
    sparse = kept.join(of_lang, "lang").select("lang", "sources", "totals", "kept", place.alias("at"), F.col("items.n").alias("n"))
    none = of_lang.select("lang", F.explode("sources").alias("source"), "sources").select("lang", "source", F.explode("sources").alias("item"), F.lit(0).cast("long").alias("value")).filter("source <> item")
    pairs = sparse.mapInPandas(_pair_sums, "lang string, source string, item string, value long").unionByName(none)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    rows = kept.select("lang", F.explode("items").alias("i"), "lang_n", "term").select(F.concat(F.length("lang"), F.lit(":"), "lang", "i.source").alias("g"), "lang", "i.source", "i.n", "lang_n", "term")
    ordered = rows.sortWithinPartitions("g", F.col("n").desc(), "lang_n", "term")
    band = ordered.mapInPandas(_bands(top, 100_000), rows.schema).drop("g").join(groups, ["lang", "source"])
    shares = band.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("kept")))
    terms = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))

    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= top))


DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT lang, source, d, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), lang_terms AS (
  SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10
), counts AS (
  SELECT w.lang, source, w.term, count(*) AS n FROM words w JOIN lang_terms t ON t.lang = w.lang AND t.term = w.term GROUP BY ALL
), langs AS (
  SELECT lang, sum(lang_n)::BIGINT AS lang_total, count(*) AS v FROM lang_terms GROUP BY lang
), groups_ AS (
  SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM docs) g
), shares AS (
  SELECT g.lang, g.source, t.term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p, 1 + (1000000000 * (lang_n + 2)) // (lang_total + 2 * v) AS q
  FROM groups_ g JOIN langs l ON l.lang = g.lang JOIN lang_terms t ON t.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM shares x JOIN shares y ON y.lang = x.lang AND y.term = x.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM groups_ a JOIN groups_ b ON b.lang = a.lang AND b.source <> a.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
