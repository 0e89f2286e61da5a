"""Document fingerprints by locally consistent parsing with deterministic coin tossing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .suffix_dedup import mixed

U = np.uint64
_B = U(0x9E3779B97F4A7C15)


def _coins(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels under 8, different for neighbours with different names, that depend on a few names to the left only.

    Each round replaces a label by 2 * i + bit, i the lowest bit in which it differs from its left neighbour's label. first:
    where a text starts (its first symbol has no neighbour and compares with 0).
    """
    label, bits = names, 64
    while bits > 3:
        left = np.empty_like(label)
        left[0] = 0
        left[1:] = label[:-1]
        left[first] = ~label[first] if bits == 64 else label[first] ^ label.dtype.type(1)
        apart = label ^ left
        i = np.bitwise_count((apart & (~apart + apart.dtype.type(1))) - apart.dtype.type(1))
        label = (i << 1) | ((label >> i.astype(label.dtype)) & label.dtype.type(1)).astype(np.uint8)
        bits = {64: 7, 7: 4, 4: 3}[bits]
    return label


def parse(names: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the phrase names of the texts whose symbol names are given, and how many phrases each text has.

    Runs of one symbol become one symbol first. Phrases then start at the local maxima of the coins, so in
    equal substrings they start at the same places but for a few symbols at the ends.
    """
    if not len(names):
        return names, lens
    text = np.repeat(np.arange(len(lens)), lens)
    head = np.r_[True, (names[1:] != names[:-1]) | (text[1:] != text[:-1])]
    at = np.flatnonzero(head)
    run = np.diff(np.r_[at, len(names)]).astype(U)
    names, text = mixed(names[at] * _B + run), text[at]
    first = np.r_[True, text[1:] != text[:-1]]
    label = _coins(names, np.flatnonzero(first)).astype(np.int8)
    before, after = np.r_[np.int8(-1), label[:-1]], np.r_[label[1:], np.int8(-1)]
    last = np.r_[first[1:], True]
    after[last] = 127  # neither a text's last symbol starts a phrase
    start = first | ((label > before) & (label > after))
    begin = np.flatnonzero(start)
    place = np.arange(len(names)) - np.repeat(begin, np.diff(np.r_[begin, len(names)]))
    power = np.multiply.accumulate(np.r_[U(1), np.full(place.max(), _B)])
    phrases = mixed(np.add.reduceat(names * power[place], begin) + np.diff(np.r_[begin, len(names)]).astype(U))
    return phrases, np.bincount(text[begin], minlength=len(lens))


def fingerprints(texts: list[str], levels: int = 3, slots: int = 64) -> np.ndarray:
    """(texts, slots) of 16 bits: minima over the names of the phrases of the levels from 2, of each text on its own.

    Equal texts have equal rows. A text without symbols has a row of 65535.
    """
    lens = np.array([len(t) for t in texts], np.int64)
    names = mixed(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(U) + U(1))
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(1, levels + 1):
        names, lens = parse(names, lens)
        if level > 1 or levels == 1:
            kept.append((names + U(level), lens))
    out = np.full((len(texts), slots), 0xFFFF, np.uint16)
    some = np.flatnonzero(kept[0][1]) if texts else np.zeros(0, np.int64)
    if len(some):
        least = None
        rng = np.random.default_rng(5)
        mult = rng.integers(1, 1 << 63, slots, dtype=U) | U(1)
        for names, lens in kept:
            starts = (np.cumsum(lens) - lens)[some]
            at = np.stack([np.minimum.reduceat((names * m) >> U(8), starts) for m in mult], 1)
            least = at if least is None else np.minimum(least, at)
        out[some] = (mixed(least) >> U(48)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal slots, row by row: an estimate of the Jaccard similarity of the phrase names."""
    return (a == b).mean(1)


def as_text(prints: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in prints]


#: What deals the documents out: descending doc_id, null last; of equal ids by a hash of the text.
_KEY = ("null", "down", "h")


class Ranges:
    """Stretches of documents in key order. limits: the keys at which all but the first one start, each the key of a document; first: the least key."""

    def __init__(self, limits: pd.DataFrame, first: tuple):
        some = ~limits["null"].to_numpy(bool)
        self.down, self.h = limits["down"].to_numpy(np.int64)[some], limits["h"].to_numpy(np.int64)[some]
        self.null_h = limits["h"].to_numpy(np.int64)[~some]
        self.first, self.count = first, len(limits) + 1

    def of(self, null: np.ndarray, down: np.ndarray, h: np.ndarray) -> list[list[int]]:
        """Each document's stretch, and the one before if the document is the first of its own, whose last document it follows."""
        lo, hi = np.searchsorted(self.down, down, "left"), np.searchsorted(self.down, down, "right")
        at = lo.copy()
        for i in np.flatnonzero((hi > lo) & ~null).tolist():  # ids that several stretches hold, or that start one
            at[i] += np.searchsorted(self.h[lo[i] : hi[i]], h[i], "right")
        at[null] = len(self.down) + np.searchsorted(self.null_h, h[null], "right")
        n = len(self.down)
        own = np.full(len(at), -1)
        in_some, in_null = np.flatnonzero((at > 0) & ~null), np.flatnonzero((at > n) & null)
        starts = in_some[(self.down[at[in_some] - 1] == down[in_some]) & (self.h[at[in_some] - 1] == h[in_some])]
        own[starts] = at[starts] - 1
        starts = in_null[self.null_h[at[in_null] - 1 - n] == h[in_null]]
        own[starts] = at[starts] - 1
        is_first = (null == self.first[0]) & (null | (down == self.first[1])) & (h == self.first[2])
        own[is_first] = self.count - 1  # after the last document comes the first
        return [[r] if g < 0 else [r, g] for r, g in zip(at.tolist(), own.tolist())]


def _ranges(keyed: DataFrame, range_bytes: int, sampled: int) -> Ranges | None:
    """Stretches of about range_bytes of text, at least one a shuffle partition, from a sample of about `sampled` keys a stretch."""
    n, total, first = keyed.agg(F.count("*"), F.sum("size"), F.min(F.struct(*_KEY))).first()
    if not n:
        return None
    count = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    share = min(1 << 20, -(-(sampled * count << 20) // n))
    # Equal rows are one key; which keys are sampled depends on them alone, so a task that runs again deals out alike.
    sample = keyed.filter(F.pmod(F.xxhash64(*_KEY), F.lit(1 << 20)) < share).groupBy(*_KEY).agg(F.sum("size").alias("size")).toPandas()
    sample = sample.sort_values(list(_KEY), ignore_index=True)
    filled = sample["size"].cumsum() * count // max(1, sample["size"].sum())
    starts = sample[(filled.diff() > 0).to_numpy()]
    after = [tuple(x) > tuple(first) for x in starts[list(_KEY)].itertuples(index=False)]
    return Ranges(starts[np.array(after, bool)], tuple(first))


def fingerprint_documents(docs: DataFrame, levels: int = 3, slots: int = 64, range_bytes: int = 16 << 20, sampled: int = 24) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document's
    in order of descending doc_id; after the last comes the first. near_* are shares of equal fingerprint slots.

    Null texts are empty; null ids come last; rows with equal ids are in order of xxhash64 of their texts; one row alone is its own next
    one; an empty table gives an empty result; further columns are ignored.

    The texts are dealt once, each stretch of ids to a task of its own (see _ranges): about range_bytes of text, so that tasks are even.
    A stretch starts at the key of a document, which also goes to the stretch before it as a guest; so neighbours meet in one
    task. What the driver and the broadcast hold are some 24 bytes for each of `sampled` keys a stretch.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select("doc_id", "text", F.col("doc_id").isNull().alias("null"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down"), F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if (ranges := _ranges(keyed, range_bytes, sampled)) is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(ranges)

    @F.pandas_udf("array<int>")
    def dealt(null: pd.Series, down: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.of(null.to_numpy(bool), down.to_numpy(), h.to_numpy()))

    def some(rows: list[tuple], following: tuple) -> pd.DataFrame:
        texts = [r[1] for r in rows]
        nexts = [*texts[1:], following[1]]
        edited = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a, b in zip(texts, nexts)]
        own = fingerprints([*texts, nexts[-1]], levels, slots)
        new = fingerprints(edited, levels, slots)
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
        ids = pd.array([r[0] for r in rows], "Int64")
        return pd.DataFrame({"doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": sha, "fingerprint": as_text(own[:-1]), "edited_fingerprint": as_text(new), "near_edited": likeness(own[:-1], new), "near_next": likeness(own[:-1], own[1:])})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple] = []
        size = 0
        for pdf in batches:
            for null, i, text, guest in zip(pdf["null"], pdf["id"], pdf["text"], pdf["guest"]):
                row = (None if null else i, text)
                if waiting and (guest or size > 500_000):
                    yield some(waiting, row)
                    waiting, size = [], 0
                if guest:
                    return  # copies of the guest follow; they are rows of the next stretch
                waiting.append(row)
                size += len(text)

    placed = keyed.select("doc_id", "null", "down", "h", "text", F.posexplode(dealt("null", "down", "h")).alias("guest", "range")).repartitionById(ranges.count, "range")
    ordered = placed.sortWithinPartitions("guest", *_KEY, "text")
    return ordered.select(F.coalesce("doc_id", F.lit(0)).alias("id"), "null", "text", (F.col("guest") > 0).alias("guest")).mapInPandas(each, schema)
