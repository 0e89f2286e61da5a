"""Embedding near-duplicates: spherical k-means cells, candidate groups in large ones, blocked cosine products, one representative a group."""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_cell, cells, components, local_roots, written


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k unit centroids of unit vectors; an empty cell starts again at the vector that fits its own cell worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own, best = np.empty(len(x), int), np.empty(len(x))
        for a in range(0, len(x), 2000):
            fit = x[a : a + 2000] @ c.T
            own[a : a + 2000], best[a : a + 2000] = fit.argmax(1), fit.max(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(size < 1e-9)
        if len(empty):
            sums[empty] = x[np.argsort(best, kind="stable")[: len(empty)]]
            size = np.linalg.norm(sums, axis=1)
        c = sums / np.maximum(size, 1e-12)[:, None]
    return c


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors. A power of two is taken off first, which is exact, so squares of very large or small components stay finite and over 0."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _allowed(x: np.ndarray, c: np.ndarray, reach: float) -> np.ndarray:
    """Whether a unit vector at most `reach` from x could be nearest to each centroid (vectors x centroids)."""
    apart = c @ c.T  # then in place, as it has the square of the centroids
    apart *= -2
    apart += 2
    np.sqrt(np.maximum(apart, 0, out=apart), out=apart)
    out = np.empty((len(x), len(c)), bool)
    for a in range(0, len(x), 500):
        part = x[a : a + 500]
        fit = _units(part) @ c.T
        out[a : a + 500] = fit.max(1, keepdims=True) - fit <= reach * apart[fit.argmax(1)] + 1e-9
    return out


def merged_cells(allowed: np.ndarray, goal: int) -> np.ndarray:
    """Which cell each centroid belongs to, from the centroids that a sample's vectors may meet at (vectors x centroids).

    Cells are merged in pairs as long as that saves comparisons, and further until a vector goes to at most `goal` cells on average,
    up to an eighth of the cells at once, as each round counts all pairs of cells anew.
    One cell is left if that takes no more comparisons than all the others, also if so when no pair saves any more. This decides what the comparison costs, never what it finds.
    """
    label = np.arange(allowed.shape[1])
    while (k := allowed.shape[1]) > 1:
        common = np.zeros((k, k), np.float32)
        for a in range(0, len(allowed), 2000):
            part = allowed[a : a + 2000].astype(np.float32)
            common += part.T @ part
        size = np.diag(common).astype(float)
        enough = size.sum() <= goal * len(allowed)
        rows, best = np.empty(k, int), np.empty(k)
        for a in range(0, k, 500):
            own = size[a : a + 500, None]
            saved = own**2 + size**2 - (own + size - common[a : a + 500]) ** 2
            saved[np.arange(a, a + len(own))[:, None] >= np.arange(k)] = -np.inf
            rows[a : a + 500], best[a : a + 500] = saved.argmax(1), saved.max(1)
        to, used = np.arange(k), np.zeros(k, bool)
        most = k
        if best.max() < 0:
            if not enough and (size**2).sum() >= float(len(allowed)) ** 2:
                break
            most = max(1, k // 8)
        for c in np.argsort(-best, kind="stable").tolist():
            d = int(rows[c])
            # Merges that only the goal asks for are made when no others are left.
            if best[c] == -np.inf or best[c] < 0 and (enough or most == k) or used.sum() >= 2 * most:
                break
            if not (used[c] or used[d]):
                to[d], used[c], used[d] = c, True, True
        if not used.any():
            break
        cell = np.unique(to, return_inverse=True)[1]
        label = cell[label]
        less = np.zeros((len(allowed), int(cell.max()) + 1), bool)
        for c in range(k):
            less[:, cell[c]] |= allowed[:, c]
        allowed = less
    return np.zeros_like(label) if (allowed.sum(0, dtype=float) ** 2).sum() >= float(len(allowed)) ** 2 else label


#: What float16 codes, and their products in single precision, may take off a cosine.
SLACK = 0.002


def key_plan(cosine: float, n: int, miss: float, tries: int, per_cell: int = 200) -> tuple[int, int]:
    """How many directions a label is taken from, so that two labels part n vectors in cells of about per_cell, and how many keys leave a
    linked pair together in no cell with a probability of `miss` at most.

    A label is which of g random directions, or its opposite, fits a vector best. A key is a first label and `tries` second ones; a pair
    meets if the first and one of the second are the same for both. Products of two vectors with a Gaussian direction are normal and correlated by their
    cosine, in any number of dimensions; so how often both get the same label is counted on normal pairs
    correlated by the least cosine (less SLACK), less five standard deviations of that count. All labels are independent.
    """
    g = max(4, math.ceil(math.sqrt(n / per_cell) / 2))
    rng, c, same, of = np.random.default_rng(11), min(1.0, max(-1.0, cosine - SLACK)), 0, 40_000
    for _ in range(of // 1000):
        u = rng.standard_normal((1000, g))
        w = c * u + math.sqrt(1 - c * c) * rng.standard_normal((1000, g))
        same += int((_best(u) == _best(w)).sum())
    p = max(same / of - 5 * math.sqrt(same / of * (1 - same / of) / of), 1e-6)
    return g, math.ceil(math.log(miss) / math.log1p(-p * (1 - (1 - p) ** tries)))


def _best(fit: np.ndarray) -> np.ndarray:
    """For each row, the column that is largest in size, and its sign."""
    top = np.abs(fit).argmax(1)
    return 2 * top + (fit[np.arange(len(fit)), top] < 0)


def _labels(x: np.ndarray, g: int, number: int, part: int) -> np.ndarray:
    """Label `part` of the key of this number for each vector; its g directions follow from these two."""
    to = np.random.default_rng((13, number, part)).standard_normal((x.shape[1], g)).astype(np.float32)
    return np.concatenate([_best(x[a : a + 8192].astype(np.float32) @ to) for a in range(0, len(x), 8192)])


def group_roots(x: np.ndarray, least: float, step: int = 512, columns: int = 4096) -> np.ndarray:
    """For vectors, the smallest index of each one's group: all that links of products of `least` and more reach.

    Vectors are compared with all later ones that aren't in their group already, few at first, so a dense group takes a few products a vector.
    """
    if len(x) <= step:
        close = x @ x.T >= least
        np.fill_diagonal(close, False)
        rows = np.flatnonzero(close.any(1))  # few, as a rule
        i, j = np.nonzero(close[rows])
        return local_roots(len(x), rows[i], j)
    root, left, width = np.arange(len(x)), np.arange(len(x)), 16
    while len(left):
        left = left[np.argsort(root[left], kind="stable")]
        now, rest = left[:width], left[width:]
        width = min(step, 2 * width)
        one = root[now[0]]
        others = rest[root[rest] != one] if (root[now] == one).all() else left
        for k in range(0, len(others), columns):
            b = others[k : k + columns]
            close = x[now] @ x[b].T >= least
            close &= root[now][:, None] != root[b]
            rows = np.flatnonzero(close.any(1))
            i, j = np.nonzero(close[rows])
            if len(i):
                root = local_roots(len(x), root[now[rows[i]]], root[b[j]])[root]
        left = rest
    return root


def candidate_links(vectors: DataFrame, dims: int, cosine: float, g: int, keys: int, tries: int, at_once: int = 4) -> DataFrame:
    """Links (a, b) of ids that join every pair of vectors (id, v) that meets by a key (see key_plan) and has a cosine of `cosine` or more; others that are nearly as close may come along.

    Vectors move as float16 codes in packets, one for each chunk of a task and first label. Each round deals by the first labels of `at_once` keys and
    leaves only the links that it found, a tree for each group of a cell.
    """
    spark = vectors.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = pa.schema([("ids", pa.binary()), ("codes", pa.binary())])
    dealt = pa.schema([("cell", pa.string()), ("ids", pa.binary()), ("codes", pa.binary())])

    def opened(ids, codes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(codes), np.float16).reshape(-1, dims)

    def spans(label: np.ndarray) -> list[tuple[int, int]]:
        edges = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(label)]
        return list(zip(edges[:-1], edges[1:]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(float)
                ids = batch.column("id").to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_pydict({"ids": [ids.tobytes()], "codes": [_units(x).astype(np.float16).tobytes()]}, packed)

    def sent(packets: list[tuple[bytes, bytes]], first: int) -> Iterator[pa.RecordBatch]:
        ids, x = opened(*zip(*packets))
        for number in range(first, min(first + at_once, keys)):
            label = _labels(x, g, number, 0)
            order = np.argsort(label, kind="stable")
            at, label, own, codes = spans(label[order]), label[order], ids[order], x[order]
            columns = [[f"{number}:{label[a]}" for a, _ in at], [own[a:b].tobytes() for a, b in at], [codes[a:b].tobytes() for a, b in at]]
            yield pa.RecordBatch.from_pydict(dict(zip(dealt.names, columns)), dealt)

    def deal(first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packets, held = [], 0
            for batch in batches:
                for packet in zip(batch.column("ids").to_pylist(), batch.column("codes").to_pylist()):
                    packets.append(packet)
                    held += len(packet[0]) // 8
                    if held >= 65_536:
                        yield from sent(packets, first)
                        packets, held = [], 0
            if held:
                yield from sent(packets, first)

        return each

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["cell"].iloc[0].split(":")[0])
        ids, x = opened(pdf["ids"], pdf["codes"])
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for part in range(1, tries + 1):
            label = _labels(x, g, number, part)
            order = np.argsort(label, kind="stable")
            for i, j in spans(label[order]):
                if j - i > 1:
                    of = order[i:j]
                    root = group_roots(x[of].astype(np.float32), cosine - SLACK)
                    joined = np.flatnonzero(root != np.arange(len(root)))
                    a.append(ids[of[joined]])
                    b.append(ids[of[root[joined]]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    packets = written(vectors.select("id", "v").mapInArrow(pack, "ids binary, codes binary"), "packets")
    found = []
    for first in range(0, keys, at_once):
        out = packets.mapInArrow(deal(first), "cell string, ids binary, codes binary")
        found.append(written(by_cell(out, meet, "a long, b long", partitions).distinct(), "met"))
        # Shuffle files go when the driver collects its garbage, and those of all rounds would be many times the input.
        del out
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return reduce(DataFrame.unionAll, found)


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.95, sample: int = 20_000, per_cell: int = 200, most_cells: int = 4096, probes: int = 8, block: int = 1024,
    miss: float = 1e-12, tries: int = 3, key_cost: int = 2000,
) -> DataFrame:
    """Per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Two vectors are linked if their cosine, in double precision, is at least `cosine`; n_links counts the others linked to a
    vector, component_id is the smallest vec_id that links reach and kept says that it's the vector's own.

    Equal vectors are one with a count. Spherical k-means is fitted on at most `sample` vectors, the first
    in order of a hash. The centroid where a linked pair meets is that of its middle: a vector x of c can have
    such a middle at d only if x.c - x.d <= |x - middle| |c - d|, and linked vectors are at most
    2 sin(angle / 4) from their middle. Each vector goes to every cell that this bound allows, so no link is lost. Where vectors
    lie between many centroids their cells are merged (see merged_cells), to `probes` cells a vector on average of the sample; vectors
    that no centroids tell apart end in one cell, all compared with all. A pair is counted in the first cell that it shares.
    A cell of over 4 * block vectors is compared span by span, each pair of spans in a task of its own; pairs
    are counted in the task and don't become rows. With more than most_cells * per_cell vectors cells grow: raise
    most_cells and sample.

    Where cells stay so large that a vector would be compared with over `key_cost` others for each of key_plan's keys, candidate_links first joins all pairs that
    meet by a key, and only vectors of one group of these are compared, in each cell and by the same product. Keys are random: a link whose
    ends nothing else joins is lost with a probability of `miss` at most (for a cosine just at the bound; far less above). With
    miss=0 all vectors of a cell are compared, whatever it takes.

    Null vectors, zero vectors, and ones with a null or non-finite component or another length than most link with nothing; they, and rows with a
    null vec_id, are their own component (null for a null id). Rows with equal ids count as copies if equal, else as vectors of their own. An empty
    table gives an empty result; further columns are ignored.
    """
    spark = vectors.sparkSession
    reach = 2 * math.sin(math.acos(cosine) / 4) + 1e-9
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("fine", fine)
    length = rows.filter("fine").groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    dims = length["n"] if length else 0
    rows = rows.withColumn("fine", F.col("fine") & (F.size("v") == dims))
    # -0.0 and 0.0 are one value to groupBy, so equal vectors are one group. They are numbered as written: ids may be those of other vectors, too.
    distinct = rows.filter("fine").groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    # Rows find them again by two hashes (128 bits, equal for -0.0 and 0.0), as vectors are too wide to move once more.
    digest = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    distinct = written(distinct.select("*", *digest).withColumn("id", F.monotonically_increasing_id()), "vectors")
    n = distinct.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    k = max(1, min(most_cells, n // per_cell))
    # Twice the sample: vectors that centroids were fitted on are nearer to them than others, so cells are merged by the second half.
    # Few more than these are below this share of the hashes, so no task sorts more.
    share = min(1.0, (2 * sample + 8 * math.sqrt(2 * sample) + 100) / n)
    low = distinct if share == 1 else distinct.filter(F.col("h1") < int(share * 2.0**64) - 2**63)
    few = low.orderBy("h1", "h2").limit(2 * sample).select("v").toPandas()["v"]  # bounded by `sample`
    x = np.stack(few.to_list()).astype(float)
    centroids = spherical_kmeans(_units(x[:sample]), min(k, len(x), sample))
    seen = x[sample:] if len(x) == 2 * sample else x
    label = merged_cells(_allowed(seen[: 2**24 // len(centroids)], centroids, reach), probes)
    shared = spark.sparkContext.broadcast((centroids, label))  # bounded by `most_cells`
    n_cells = int(label.max()) + 1

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, cell = shared.value
        for pdf in batches:
            row, at = np.nonzero(_allowed(np.stack(pdf["v"].to_list()).astype(float), c, reach))
            key = np.unique(row * n_cells + cell[at])
            cuts = np.flatnonzero(np.diff(key // n_cells)) + 1
            yield pdf.assign(kcells=np.split((key % n_cells).astype(np.int32), cuts))

    if n_cells == 1:
        placed = distinct.select("v", "id", "copies", F.array(F.lit(0)).alias("kcells"))
        compared = n * n
    else:
        placed = written(distinct.select("v", "id", "copies").mapInPandas(assign, f"v {kind}, id long, copies long, kcells array<int>"), "placed")
        compared = placed.select(F.explode("kcells").alias("kcell")).groupBy("kcell").count().agg(F.sum(F.col("count").cast("double") ** 2)).first()[0]
    members = placed.withColumn("kcell", F.explode("kcells"))
    g, keys = key_plan(cosine, n, miss, tries) if miss > 0 and compared > n * key_cost else (0, math.inf)
    if compared > n * key_cost * keys:
        groups = components(candidate_links(distinct, dims, cosine, g, keys, tries))
        at = written(members.select("id", "kcell").join(groups, "id"), "at")
        sizes = at.groupBy("kcell", "root").agg(F.count("*").alias("size")).filter("size > 1")
        at = at.join(sizes, ["kcell", "root"]).withColumn("group", F.concat_ws(":", "kcell", "root"))
        members = at.join(placed, "id")
    else:
        sizes = members.groupBy("kcell").agg(F.count("*").alias("size"))
        members = members.join(F.broadcast(sizes), "kcell").withColumn("group", F.col("kcell"))  # at most `most_cells` rows
    dealt = cells(members, "group", "size", "id", 4 * block)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        diagonal, cell = bool(pdf["diagonal"].iloc[0]), int(pdf["kcell"].iloc[0])
        if not diagonal:
            pdf = pdf.sort_values("part", kind="stable")
        ids, copies, n = pdf["id"].to_numpy(), pdf["copies"].to_numpy().astype(float), len(pdf)
        x = _units(np.stack(pdf["v"].to_list()).astype(float))
        if cell:
            # The cells before this one that each vector is in, as bits.
            inside = np.zeros((n, cell), bool)
            lens = pdf["kcells"].map(len).to_numpy()
            row, at = np.repeat(np.arange(n), lens), np.concatenate(pdf["kcells"].to_list())
            inside[row[at < cell], at[at < cell]] = True
            before = np.packbits(inside, axis=1)
        last = n if diagonal else int((pdf["part"] == 0).sum())
        links, root = np.zeros(n), np.arange(n)
        step = max(1, (1 << 20) // n)
        for i in range(0, last, step):
            base = i if diagonal else last
            close = x[i : min(i + step, last)] @ x[base:].T >= cosine
            if diagonal:
                close = np.triu(close, 1)
            if not close.any():
                continue
            if not cell:
                # All pairs count, so sums of copies do; only pairs that join two groups are listed.
                one, last_one = close.astype(float), i + len(close)
                links[i:last_one] += one @ copies[base:]
                links[base:] += copies[i:last_one] @ one
                a, b = np.nonzero(close & (root[i:last_one, None] != root[base:]))
                a, b = a + i, b + base
            else:
                a, b = np.nonzero(close)
                a, b = a + i, b + base
                first = np.ones(len(a), bool)
                for k in range(0, len(a), 100_000):
                    first[k : k + 100_000] = ~(before[a[k : k + 100_000]] & before[b[k : k + 100_000]]).any(1)
                a, b = a[first], b[first]
                links += np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
            apart = root[a] != root[b]
            if apart.any():
                root = local_roots(n, root[a[apart]], root[b[apart]])[root]
        some = links > 0
        return pd.DataFrame({"id": ids[some], "links": links[some].astype(np.int64), "root": ids[root][some]})

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(by_cell(dealt, compare, "id long, links long, root long", partitions), "links")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_id = written(counts.join(roots, "id").join(distinct.select("id", "vec_id"), "id"), "linked")
    least = written(of_id.groupBy("root").agg(F.min("vec_id").alias("least")), "least")
    of_id = of_id.join(least, "root").select("id", "links", "least")
    sets = distinct.select("id", "vec_id", "copies", "h1", "h2").join(of_id, "id", "left")
    sets = sets.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("more"), F.coalesce("least", "vec_id").alias("root"))
    out = rows.select("vec_id", *(F.when(F.col("fine"), h).alias(name) for h, name in zip(digest, ("h1", "h2")))).join(sets, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("more", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))
