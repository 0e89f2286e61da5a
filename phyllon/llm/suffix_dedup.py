"""Removal of repeated passages: 50-byte strings that also start in a document with a smaller id.

The suffixes of all documents are dealt out and compared as follows.

1. Documents are packed in blocks of some MB, written once as a table that is bucketed by block.
2. Every 50-byte window has a least q-gram (by hash). Equal windows have equal least q-grams, so only windows whose
   least q-gram occurs in another document, too, can matter. Blocks send their distinct least q-grams (8 bytes each) to
   partitions by hash and get one bit back for each.
3. The bytes around the windows that are left, as runs of windows with one least q-gram, go to the partition of that
   q-gram, each distinct run once a block with its smallest doc_id. There, bucket-pointer refinement finds the
   equal windows: buckets by 8-gram are refined by sorting on the bucket pointers of later offsets, and the updated
   pointers are used again for 16, 32 and 50 bytes. Only buckets of over one suffix are sorted again.
4. A block gets back a bit for each window: whether a smaller doc_id has it. It merges what the windows cover.

A q-gram in a frequent line lies in very many different runs. Blocks send the number of their distinct runs along, and the
runs of a q-gram with more than a partition should hold are taken apart: each window is a run of its own, dealt by a hash of its
bytes, so they spread over all partitions.

Copies and common passages are pre-aggregated in their block, so a passage that a third of all documents holds reaches
its partition once a block.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, new_folder, new_table, written

U = np.uint64
NONE = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x *= U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(29))


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of the q-grams of bytes, by differences of prefix sums modulo 2^64."""
    n = len(data)
    power = np.full(n, U(_BASE))
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power, out=sums[1:])
    h = sums[q:] - sums[:-q]
    power = np.full(len(h), U(_INVERSE))
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    h *= power
    return mixed(h)


def sliding_least(a: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span < width:
        step = min(span, width - span)
        a = np.minimum(a[: len(a) - step], a[step:])
        span += step
    return a


def window_runs(data: np.ndarray, lens: np.ndarray, size: int, q: int, longest: int = 64) -> tuple[np.ndarray, ...]:
    """Runs of windows with one least q-gram: (hash, document, first window, windows), offsets in the block.

    Works on slices of about 1 MB of whole documents, so the hashes take bounded memory but for a longer document.
    """
    ends = np.cumsum(lens)
    out, first = [], 0
    while first < len(lens):
        base = ends[first] - lens[first]
        last = max(first + 1, int(np.searchsorted(ends, base + 1_000_000, "right")))
        part = data[base : ends[last - 1]]
        if len(part) >= size:
            least = sliding_least(gram_hashes(part, q), size - q + 1)
            n = len(least)
            doc = np.repeat(np.arange(first, last, dtype=np.int32), lens[first:last])
            ok = doc[:n] == doc[size - 1 :]
            start = ok.copy()
            start[1:] &= (least[1:] != least[:-1]) | ~ok[:-1] | (doc[1:n] != doc[: n - 1])
            at = np.flatnonzero(start)
            if len(at):
                stop = ok & np.r_[~ok[1:] | start[1:], True]
                length = np.flatnonzero(stop) + 1 - at
                if length.max() > longest:  # equal grams in a row: cut, so that a run is never long
                    k = -(-length // longest)
                    no = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    at, length = np.repeat(at, k) + no * longest, np.minimum(longest, np.repeat(length, k) - no * longest)
                out.append((least[at], doc[at], at + base, length))
        first = last
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def refine(data: np.ndarray, stop: np.ndarray, size: int) -> np.ndarray:
    """Bucket pointers of all suffixes after `size` bytes: equal where the next `size` bytes are equal.

    stop: where each suffix's run of bytes ends. -1 for suffixes shorter than size. size is at least 8.
    """
    n = len(data)
    left = stop - np.arange(n)
    pointer = np.full(n, -1, np.int64)
    at = np.flatnonzero(left >= 8)
    gram = np.zeros(n, U)
    for k in range(8):
        gram[: n - k] |= data[k:].astype(U) << U(56 - 8 * k)
    order = at[np.argsort(gram[at])]
    pointer, have = _named(pointer, order, gram[order][1:] != gram[order][:-1]), 8
    while have < size:
        step = min(have, size - have)
        new = np.where(left >= have + step, pointer, -1)
        at = np.flatnonzero(new >= 0)
        count = np.bincount(pointer[pointer >= 0], minlength=n)
        at = at[count[pointer[at]] > 1]  # a bucket of one suffix keeps its pointer
        both = pointer[at] << 32 | pointer[at + step]  # a partition has under 2^31 bytes
        order = np.argsort(both)
        at, both = at[order], both[order]
        key = both >> 32
        # The new pointer is the old bucket's start plus the place of the sub-bucket in it: unused by all others.
        if len(at):
            change = np.r_[True, both[1:] != both[:-1]]
            head = np.r_[True, key[1:] != key[:-1]]
            place = np.arange(len(at))
            place = np.maximum.accumulate(np.where(change, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
            new[at] = key + place
        pointer, have = new, have + step
    return pointer


def _named(pointer: np.ndarray, order: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Pointers are the place of a bucket's first suffix in sorted order."""
    if len(order):
        place = np.arange(len(order))
        place[1:][~change] = 0
        pointer[order] = np.maximum.accumulate(place)
    return pointer


def _pack(docs: DataFrame, block_bytes: int) -> DataFrame:
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, nulls, texts, size = [], [], [], 0

        def block() -> pd.DataFrame:
            return pd.DataFrame({"block": [uuid.uuid4().int >> 65], "ids": [np.array(ids, np.int64).tobytes()], "nulls": [np.array(nulls, bool).tobytes()], "lens": [np.array([len(x) for x in texts], np.int64).tobytes()], "data": [b"".join(texts)]})

        for pdf in batches:
            for null, i, text in zip(pdf["isnull"], pdf["doc_id"], pdf["data"]):
                text = bytes(text)
                if texts and size + len(text) > block_bytes:
                    yield block()
                    ids, nulls, texts, size = [], [], [], 0
                ids.append(NONE if null else i)
                nulls.append(null)
                texts.append(text)
                size += len(text)
        if texts:
            yield block()

    rows = docs.select(F.col("doc_id").isNull().alias("isnull"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    return rows.mapInPandas(blocks, "block long, ids binary, nulls binary, lens binary, data binary")


def _of(row) -> tuple[np.ndarray, ...]:
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.lens, np.int64), np.frombuffer(row.data, np.uint8)


def _distinct(h: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of a block, and whether each is in two documents with different ids."""
    if not len(h):
        return h, np.zeros(0, bool)
    order = np.argsort(h)
    h, i = h[order], ids[doc[order]]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[at], np.minimum.reduceat(i, at) != np.maximum.reduceat(i, at)


def _runs(h: np.ndarray, found: tuple[np.ndarray, ...], raw: bytes, size: int) -> np.ndarray:
    """How many different runs of a block have each of its sorted distinct hashes."""
    of = np.searchsorted(h, found[0])
    count = np.bincount(of, minlength=len(h))
    many = np.flatnonzero(count[of] > 1)
    texts = np.array([hash(raw[a : a + n + size - 1]) for a, n in zip(found[2][many].tolist(), found[3][many].tolist())], np.int64)
    order = np.lexsort((texts, of[many]))
    one, text = of[many][order], texts[order]
    new = np.r_[True, (one[1:] != one[:-1]) | (text[1:] != text[:-1])][: len(one)]
    return np.where(count > 1, np.bincount(one[new], minlength=len(h)), count).astype(np.int32)


def _apart(found: tuple[np.ndarray, ...], hot: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The runs, with each hot one as runs of one window whose hash is that of all its bytes."""
    n = np.where(hot, found[3], 1)
    of = np.repeat(np.arange(len(n)), n)
    h, doc, start, count = (x[of] for x in (*found[:3], np.where(hot, 1, found[3])))
    start = start + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = start[hot[of]]
    own = np.zeros(len(at), U)
    for k in range(size):
        own = own * U(_BASE) + data[at + k] + U(1)
    h[hot[of]] = mixed(own)
    return h, doc, start, count


def _shares(h: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """Indices of h by partition, in order of h."""
    to = (h % U(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(parts + 1))
    return [(p, order[edges[p] : edges[p + 1]]) for p in range(parts) if edges[p] < edges[p + 1]]


def _needed(row, answers: dict[int, bytes], hots: dict[int, bytes], size: int, q: int, parts: int) -> tuple[tuple[np.ndarray, ...], list[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """The runs of a block that can be repeated, the distinct ones by partition with the smallest id, and which one each run is."""
    ids, lens, data = _of(row)
    found = window_runs(data, lens, size, q)
    h, _ = _distinct(found[0], found[1], ids)
    good, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
    for p, at in _shares(h, parts):
        if p in answers:
            good[at] = np.unpackbits(np.frombuffer(answers[p], np.uint8), count=len(at)).astype(bool)
            hot[at] = np.unpackbits(np.frombuffer(hots[p], np.uint8), count=len(at)).astype(bool)
    keep = good[np.searchsorted(h, found[0])] if len(h) else np.zeros(0, bool)
    found = tuple(x[keep] for x in found)
    if hot.any():
        found = _apart(found, hot[np.searchsorted(h, found[0])], data, size)
    raw = bytes(row.data)
    number, which = {}, np.empty(len(found[0]), np.int64)
    for k, (a, n) in enumerate(zip(found[2].tolist(), found[3].tolist())):
        which[k] = number.setdefault(raw[a : a + n + size - 1], len(number))
    texts = list(number)
    least = np.full(len(texts), NONE)
    np.minimum.at(least, which, ids[found[1]])
    of = np.zeros(len(texts), U)
    of[which] = found[0]
    return found, [(p, [texts[i] for i in at.tolist()], least[at], of[at], at) for p, at in _shares(of, parts)], least, which


def remove_repeats(docs: DataFrame, size: int = 50, q: int = 20, block_bytes: int = 4 << 20, part_bytes: int = 6 << 20) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary).

    A byte goes if a string of `size` bytes that covers it also starts in a document with a smaller doc_id; strings are
    judged on the input. A null text is empty; a null doc_id counts as larger than all others; rows with equal ids
    (repeated rows) remove nothing of each other, and each gives a row. Texts shorter than `size` are kept whole. An empty
    table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    most_runs = max(1, part_bytes // 300)  # of one q-gram: refinement takes some 5 kB for a run
    # Spark joins with the bucketed table without moving it if it has no fewer buckets than shuffles have partitions.
    # Beyond what Spark allows a bucket holds more blocks; they are read one by one all the same.
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (6 * block_bytes)))
    files = min(files, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    name = new_table("blocks")
    _pack(docs, block_bytes).write.option("compression", "zstd").option("path", new_folder(spark, "blocks")).bucketBy(files, "block").saveAsTable(name)
    blocks = spark.table(name)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                ids, lens, data = _of(row)
                found = window_runs(data, lens, size, q)
                h, several = _distinct(found[0], found[1], ids)
                runs = _runs(h, found, bytes(row.data), size)
                yield pd.DataFrame([(p, row.block, h[at].tobytes(), np.packbits(several[at]).tobytes(), runs[at].tobytes()) for p, at in _shares(h, parts)], columns=["p", "block", "h", "several", "runs"])

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        hs = [np.frombuffer(x, U) for x in pdf["h"]]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)) for x, h in zip(pdf["several"], hs)]).astype(bool)
        _, back, count = np.unique(np.concatenate(hs), return_inverse=True, return_counts=True)
        both = (count > 1) | (np.bincount(back, several, len(count)) > 0)
        hot = np.bincount(back, np.concatenate([np.frombuffer(x, np.int32) for x in pdf["runs"]]), len(count)) > most_runs
        edges = np.cumsum([len(h) for h in hs])[:-1]
        return pd.DataFrame({"block": pdf["block"], "p": pdf["p"], **{c: [np.packbits(x).tobytes() for x in np.split(a[back], edges)] for c, a in (("bits", both), ("hot", hot))}})

    def gathered(answers: DataFrame) -> DataFrame:
        return answers.groupBy("block").agg(F.collect_list(F.struct("p", *answers.columns[2:])).alias("answers"))

    sent = blocks.mapInPandas(grams, "p int, block long, h binary, several binary, runs binary")
    grams_back = written(sent.groupBy("p").applyInPandas(shared, "block long, p int, bits binary, hot binary"), "grams")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                _, shares, _, _ = _needed(row, _answers(row.answers), _answers(row.answers, "hot"), size, q, parts)
                yield pd.DataFrame([(p, row.block, np.array([len(x) for x in texts], np.int32).tobytes(), b"".join(texts), least.tobytes(), h.tobytes()) for p, texts, least, h, _ in shares], columns=["p", "block", "lens", "data", "least", "h"])

    def smaller(pdf: pd.DataFrame) -> pd.DataFrame:
        number: dict[bytes, int] = {}
        which, of_row = [], []
        for lens, data in zip(pdf["lens"], pdf["data"]):
            ends, data = np.cumsum(np.frombuffer(lens, np.int32)).tolist(), bytes(data)
            which += [number.setdefault(data[a:b], len(number)) for a, b in zip([0, *ends], ends)]
            of_row.append(len(ends))
        least = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["least"]])
        which, texts = np.array(which, np.int64), list(number)
        own = np.full(len(texts), NONE)
        np.minimum.at(own, which, least)
        h = np.zeros(len(texts), U)
        h[which] = np.concatenate([np.frombuffer(x, U) for x in pdf["h"]])
        windows = np.array([len(x) - size + 1 for x in texts], np.int64)
        first = np.repeat(own, windows)
        # Only where several different runs have one least q-gram can a window be in another run.
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        mixed_ = np.flatnonzero(count[back] > 1)
        if len(mixed_):
            lens = windows[mixed_] + size - 1
            data = np.frombuffer(b"".join([texts[i] for i in mixed_.tolist()]), np.uint8)
            pointer = refine(data, np.repeat(np.cumsum(lens), lens), size)
            at = np.flatnonzero(pointer >= 0)
            pointer, mine = pointer[at], np.repeat(own[mixed_], windows[mixed_])
            order = np.argsort(pointer)
            head = np.flatnonzero(np.r_[True, pointer[order][1:] != pointer[order][:-1]])
            low = np.empty(len(at), np.int64)
            low[order] = np.repeat(np.minimum.reduceat(mine[order], head), np.diff(np.r_[head, len(order)]))
            first[np.repeat(count[back] > 1, windows)] = low
        begin = np.cumsum(windows) - windows
        n = windows[which]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[which], n)
        bits = first[place] < np.repeat(least, n)
        cuts = np.cumsum(np.add.reduceat(n, np.cumsum([0, *of_row])[:-1]))[:-1]
        return pd.DataFrame({"block": pdf["block"], "p": pdf["p"], "bits": [np.packbits(x).tobytes() for x in np.split(bits, cuts)]})

    sent = blocks.join(gathered(grams_back), "block").mapInPandas(pieces, "p int, block long, lens binary, data binary, least binary, h binary")
    pieces_back = written(sent.groupBy("p").applyInPandas(smaller, "block long, p int, bits binary"), "pieces")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                ids, lens, data = _of(row)
                nulls = np.frombuffer(row.nulls, bool)
                gone = np.zeros(len(data) + 1, np.int32)
                if row.pieces is not None:
                    (_, doc, start, count), shares, least, which = _needed(row, _answers(row.answers), _answers(row.answers, "hot"), size, q, parts)
                    answers = _answers(row.pieces)
                    n = np.zeros(len(least), np.int64)
                    n[which] = count
                    begin, flat = np.zeros(len(least), np.int64), []
                    for p, texts, _, _, at in shares:
                        begin[at] = sum(map(len, flat)) + np.cumsum(n[at]) - n[at]
                        flat.append(np.unpackbits(np.frombuffer(answers[p], np.uint8), count=int(n[at].sum())).astype(bool))
                    flat = np.concatenate(flat) if flat else np.zeros(0, bool)
                    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    hit = flat[np.repeat(begin[which], count) + step] | np.repeat(ids[doc] > least[which], count)
                    at = (np.repeat(start, count) + step)[hit]
                    gone += np.bincount(at, minlength=len(gone)).astype(np.int32) - np.bincount(at + size, minlength=len(gone)).astype(np.int32)
                mask = np.cumsum(gone[:-1]) > 0
                ends = np.cumsum(lens)
                out = []
                for i, null, a, b in zip(ids.tolist(), nulls.tolist(), (ends - lens).tolist(), ends.tolist()):
                    m = mask[a:b]
                    kept = data[a:b][~m].tobytes()
                    spans = int(np.count_nonzero(m[1:] & ~m[:-1]) + (len(m) > 0 and m[0]))
                    out.append((None if null else i, b - a, b - a - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
                yield pd.DataFrame({"doc_id": pd.array([x[0] for x in out], "Int64"), **{c: [x[k] for x in out] for k, c in enumerate(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), 1)}})

    answers = gathered(grams_back).join(gathered(pieces_back).withColumnRenamed("answers", "pieces"), "block", "left")
    return blocks.join(answers, "block", "left").mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _answers(rows, name: str = "bits") -> dict[int, bytes]:
    return {} if rows is None else {x["p"]: bytes(x[name]) for x in rows}

