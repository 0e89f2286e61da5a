"""N-gram Jaccard self-join: a MinHash LSH forest finds candidates, exact set comparison verifies them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, by_cell, cells, components, local_roots, written
from .suffix_dedup import mixed

U = np.uint64
_word = re.compile(WORD)
_word_ids: dict[str, int] = {}


def _word_hashes(words: list[str]) -> list[int]:
    if len(_word_ids) > 100_000:
        _word_ids.clear()
    out = []
    for w in words:
        h = _word_ids.get(w)
        if h is None:
            a = 0xCBF29CE484222325
            for b in w.encode():
                a = ((a ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
            h = _word_ids[w] = a
        out.append(h)
    return out


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-word shingles of each text, all texts' in one array, and the length of each.

    Words are lower-cased. A text of 1 to n-1 words has one shingle, all its words; one without words has none.
    """
    sets = []
    for text in texts:
        words = _word.findall(text.lower()) if text else []
        if not words:
            sets.append(np.zeros(0, U))
            continue
        h = mixed(np.array(_word_hashes(words), U))
        k = min(n, len(words))
        out = np.zeros(len(h) - k + 1, U)
        for j in range(k):
            out = out * U(0x9E3779B97F4A7C15) + h[j : j + len(out)]
        sets.append(np.unique(mixed(out + U(k))))
    return (np.concatenate(sets) if sets else np.zeros(0, U)), np.array([len(s) for s in sets], np.int64)


def trie_names(flat: np.ndarray, lens: np.ndarray, trees: int, depth: int, upto: int) -> np.ndarray:
    """(sets, upto, trees): the name of each set's node at depth 1 to upto in each trie of MinHash values, for sets that aren't empty.

    A trie has `depth` hash functions; the lowest bits of a name (tree_bits) are the tree's number.
    """
    rng = np.random.default_rng(11)
    mult, add = (rng.integers(1, 1 << 63, trees * depth, dtype=U) | U(1)), rng.integers(0, 1 << 63, trees * depth, dtype=U)
    starts = np.cumsum(lens) - lens
    bits = U(tree_bits(trees))
    out = np.empty((len(lens), upto, trees), np.int64)
    for t in range(trees):
        name = np.full(len(lens), t, U)
        for k in range(upto):
            h = flat * mult[t * depth + k]
            h += add[t * depth + k]
            h >>= U(32)
            name = mixed(name * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(h, starts))
            out[:, k, t] = (name >> bits << bits | U(t)).view(np.int64)
    return out


def tree_bits(trees: int) -> int:
    return (trees - 1).bit_length()


def found_share(similarity: float | np.ndarray, trees: int, depth: int) -> float | np.ndarray:
    """The probability that two sets of that similarity share a prefix of that depth in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(similarity: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, up to depth, at which a pair of that similarity meets in one of the trees with the wanted probability."""
    while depth > 1 and found_share(similarity, trees, depth) < recall:
        depth -= 1
    return depth


def _nodes(names: DataFrame) -> DataFrame:
    """The trie nodes of names (v, node) with several vertices: node, root (its smallest vertex) and n. Written, so that joins with it can be split."""
    return written(names.groupBy("node").agg(F.min("v").alias("root"), F.count("*").alias("n")).filter("n > 1"), "nodes")


def _named(vertices: DataFrame, depth: str) -> DataFrame:
    return vertices.select("v", F.explode(depth).alias("node"))


def _placed(near: DataFrame, nodes: DataFrame, trees: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Where the candidates near (v, node, n, root) are compared: (v, grp, whole), and (cell, part, diagonal, tree, whole, v).

    Vertices that shared nodes chain together are a group. It is compared all with all if it's small or if that takes no
    more comparisons than all its nodes apart (a true cluster); a group that only chains together is compared node by
    node, so what is compared grows with the nodes and not with the square of the chain.
    """
    groups = written(components(near.filter("v <> root").select(F.col("v").alias("a"), F.col("root").alias("b"))), "groups")
    apart = nodes.join(groups.withColumnRenamed("root", "grp"), F.col("root") == F.col("id")).groupBy("grp").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("apart"))
    sizes = groups.groupBy(F.col("root").alias("grp")).agg(F.count("*").alias("size")).join(apart, "grp")
    whole = (F.col("size") <= block) | (F.col("size").cast("double") * F.col("size") <= F.col("apart"))
    sizes = written(sizes.select("grp", "size", whole.alias("whole")), "sizes")
    members = written(groups.select(F.col("id").alias("v"), F.col("root").alias("grp")).join(sizes, "grp"), "members")
    together = members.filter("whole").select("v", "whole", F.col("grp").alias("at"), "size", F.lit(-1).alias("tree"))
    single = members.filter("not whole").select("v", "whole").join(near, "v").select("v", "whole", F.col("node").alias("at"), F.col("n").alias("size"), F.pmod("node", F.lit(1 << tree_bits(trees))).cast("int").alias("tree"))
    placed = cells(together.unionAll(single), "at", "size", "v", block)
    return members.select("v", "grp", "whole"), placed.select(F.concat_ws(":", "cell", "tree").alias("cell"), "part", "diagonal", "tree", "whole", "v")


def jaccard_join(
    docs: DataFrame, n: int = 5, similarity: float = 0.8, trees: int = 24, depth: int = 8, recall: float = 0.9995, block: int = 384
) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, class_id, n_links, kept.

    Two rows are linked if the sets of their n-word shingles have a Jaccard similarity of at least `similarity`; n_links
    counts a row's links, class_id is the smallest doc_id that links reach and kept says that it's the row's own.

    Rows with equal sets are one vertex with a count, so copies are not expanded into pairs. Each vertex goes in `trees`
    sorted prefix tries of MinHash values. Vertices that share a whole path of `depth` values are compared first, exactly. What that
    finds gives each vertex's expected recall: a link of similarity s stands for 1 / P(s) links, where P is the probability of
    meeting at this depth, and one more link at the threshold itself is always reckoned with. Where the recall isn't met, the vertex's
    prefixes are shortened to the longest ones that meet it for any link at the threshold, and what then shares a node is compared, too. So
    members of large tight clusters settle at the full depth; all others reach `recall` as by the formula.

    Comparisons use sorted arrays of shingle hashes in cells of two blocks at most (see _placed); no task holds a whole group. A pair is
    counted in one cell: in the first tree in which it meets, and not again after the prefixes were shortened. The pairs are
    counted and merged in the cell; none of them becomes a row.

    Null and empty texts, and texts without words, link with nothing, and each is a class of its own. Rows with a null
    doc_id are classes of their own with a null class_id. Rows with equal ids and equal texts count as copies; rows with equal ids and different
    texts are vertices of their own. An empty table gives an empty result; further columns are ignored.
    """
    rows = jaccard_classes(docs, n, similarity, trees, depth, recall, block)
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("class_id"))
    return rows.select("doc_id", "class_id", "n_links", kept.alias("kept"))


def jaccard_classes(docs: DataFrame, n: int = 5, similarity: float = 0.8, trees: int = 24, depth: int = 8, recall: float = 0.9995, block: int = 384) -> DataFrame:
    """jaccard_join by (doc_id, text_hash), for ids that don't tell rows apart: doc_id, text_hash (xxhash64 of text), class_id, class_hash, n_links.

    class_id and class_hash are the least (doc_id, text_hash) of the class, so one text of each class has them as its own.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    low = prefix_depth(similarity, trees, depth, recall)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").filter("doc_id is not null")
    signed = written(rows.mapInPandas(_signing(n, trees, depth, low), "doc_id long, h long, key binary, low array<long>"), "signed")
    # One vertex for each set, numbered as written. The node names are equal within a set, so any row's do.
    one = signed.filter("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("m"), F.count("*").alias("copies"), F.first("low").alias("low"))
    vertices = written(one.select(F.monotonically_increasing_id().alias("v"), "key", "m.doc_id", "m.h", "copies", "low"), "vertices")

    # Whoever shares a longer prefix shares the shorter one: all candidates of both steps are known here, and only they need their sets.
    named = _named(vertices, "low")
    nodes = _nodes(named)
    near = written(named.join(nodes, "node"), "near")
    met = vertices.select("doc_id", "h", "v", "key", "copies").join(near.select("v").distinct(), "v", "left_semi")
    texts = rows.groupBy("doc_id", "h").agg(F.first("text").alias("text"))  # repeated rows count once, before they are moved
    held = texts.join(met, ["doc_id", "h"])
    sets = written(held.mapInPandas(_sets(n, trees, depth, low), "v long, copies long, deep array<long>, low array<long>, shingles binary"), "sets")

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "v long, links long, pairs long, missed double, root long"
    deep_named = _named(sets, "deep")
    deep_nodes = _nodes(deep_named)
    deep_near = deep_named.join(deep_nodes, "node")
    groups, placed = _placed(deep_near, deep_nodes, trees, block)
    cell_rows = placed.join(sets.select("v", "copies", "shingles", F.col("deep").alias("names")), "v")
    share = lambda s: found_share(s, trees, depth)
    first = written(by_cell(cell_rows, _verify(similarity, share), schema, partitions), "first")

    # Expected recall of a vertex at the full depth, from the links that it has there.
    known = first.groupBy("v").agg(F.sum("pairs").alias("k"), F.sum("missed").alias("e"))
    settled = written(known.filter((F.col("k") + float(share(similarity))) / (F.col("k") + F.col("e") + 1) >= recall).select("v", F.lit(True).alias("settled")), "settled")
    # Left open are nodes where someone isn't settled, and not all were compared with each other before.
    open_near = near.select("v", "node").join(settled, "v", "left").join(groups.filter("whole").select("v", F.col("grp").alias("met")), "v", "left")
    open_nodes = open_near.groupBy("node").agg(F.min("v").alias("root"), F.count("*").alias("n"), F.count("settled").alias("s"), F.count("met").alias("m"), F.min("met").alias("lo"), F.max("met").alias("hi"))
    open_nodes = written(open_nodes.filter("n > s and not (m = n and lo = hi)").select("node", "root", "n"), "open")
    _, placed = _placed(near.select("v", "node").join(open_nodes, "node"), open_nodes, trees, block)
    earlier = sets.select("v", "copies", "shingles", F.col("low").alias("names"), "deep").join(groups.withColumnRenamed("whole", "met_all"), "v", "left").join(settled, "v", "left")
    earlier = earlier.select("*", F.coalesce("grp", F.lit(-1)).alias("met_in")).drop("grp").fillna(False, ["met_all", "settled"])
    second = written(by_cell(placed.join(earlier, "v"), _verify(similarity, share), schema, partitions), "second")

    linked = first.unionAll(second).select("v", "links", "root")
    roots = components(linked.select(F.col("v").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("v").agg(F.sum("links").alias("links"))
    of_vertex = counts.join(roots, counts["v"] == roots["id"]).select(counts["v"], "links", "root")
    of_vertex = written(of_vertex.join(vertices.select("v", "doc_id", "h", "key"), "v"), "linked")
    least = written(of_vertex.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("least")), "least")
    grouped = of_vertex.join(least, "root").select("key", "links", "least")
    own = vertices.select("key", "copies", F.struct("doc_id", "h").alias("own")).join(grouped, "key", "left")
    own = own.select(F.col("key").alias("k"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "own").alias("least"))
    out = signed.select("doc_id", "h", "key").join(own, F.col("key") == F.col("k"), "left")
    out = out.select("doc_id", F.col("h").alias("text_hash"), F.coalesce("least.doc_id", "doc_id").alias("class_id"), F.coalesce("least.h", "h").alias("class_hash"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    none = docs.filter("doc_id is null").withColumn("_h", F.xxhash64("text"))
    return out.unionAll(none.select(F.lit(None).cast("long"), "_h", F.lit(None).cast("long"), "_h", F.lit(0).cast("long")))


def _keys(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """24 bytes that name each set (not empty): two sums over its hashes and its size."""
    sums = [np.add.reduceat(mixed(flat * U(c)), starts) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
    return np.stack([*sums, lens.astype(U)], 1)


def _signing(n: int, trees: int, depth: int, low: int):
    """The key of each text's set and its nodes at depth `low`; null without words."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 400):
                part = pdf.iloc[a : a + 400]
                flat, lens = shingle_sets(part["text"].tolist(), n)
                some = np.flatnonzero(lens)
                keys, names = [None] * len(part), [None] * len(part)
                if len(some):
                    nodes = trie_names(flat, lens[some], trees, depth, low)[:, -1]
                    raw = _keys(flat, (np.cumsum(lens) - lens)[some], lens[some])
                    for j, i in enumerate(some.tolist()):
                        keys[i], names[i] = raw[j].tobytes(), nodes[j]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "h": part["h"].to_numpy(), "key": keys, "low": names})

    return sign


def _sets(n: int, trees: int, depth: int, low: int):
    """Of each candidate, from its text: the sorted shingle hashes, and its nodes at full depth and at `low`."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 400):
                part = pdf.iloc[a : a + 400]
                flat, lens = shingle_sets(part["text"].tolist(), n)
                ends = np.cumsum(lens)
                # Of rows with one id and colliding text hashes only the vertex's own is right.
                raw = _keys(flat, ends - lens, lens)
                fine = [raw[i].tobytes() == bytes(k) for i, k in enumerate(part["key"])]
                names = trie_names(flat, lens, trees, depth, depth)
                data = [flat[e - m : e].tobytes() for e, m in zip(ends.tolist(), lens.tolist())]
                yield part[["v", "copies"]].assign(deep=list(names[:, -1]), low=list(names[:, low - 1]), shingles=data)[fine]

    return sets


def _verify(similarity: float, share):
    """Compares the vertices of a cell; returns those with links: links (with copies), pairs, missed (how many links each one found stands for besides itself) and the least vertex they reach."""

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v", kind="stable").drop_duplicates("v")
        v, copies = pdf["v"].to_numpy(), pdf["copies"].to_numpy()
        lens = pdf["shingles"].map(len).to_numpy() // 8
        flat = np.frombuffer(b"".join(pdf["shingles"]), U)
        a, b, s = similar_pairs(flat, lens, similarity, None if pdf["diagonal"].iloc[0] else pdf["part"].to_numpy())
        keep = np.ones(len(a), bool)
        if len(a) and not pdf["whole"].iloc[0] and (tree := int(pdf["tree"].iloc[0])):
            names = np.stack(pdf["names"].to_list())[:, :tree]
            keep &= ~(names[a] == names[b]).any(1)  # they met in an earlier tree
        if len(a) and "settled" in pdf:
            deep, met = np.stack(pdf["deep"].to_list()), pdf["met_in"].to_numpy()
            all_, done = pdf["met_all"].to_numpy(bool), pdf["settled"].to_numpy(bool)
            keep &= ~(done[a] & done[b])
            keep &= ~((met[a] == met[b]) & (met[a] >= 0) & (all_[a] | (deep[a] == deep[b]).any(1)))
        a, b, s = a[keep], b[keep], s[keep]
        missed = 1 / share(s) - 1
        both = lambda x, y: np.bincount(a, x, len(v)) + np.bincount(b, y, len(v))
        links, pairs, gone = both(copies[b], copies[a]), both(np.ones(len(a)), np.ones(len(a))), both(missed, missed)
        root = v[local_roots(len(v), a, b)]
        some = pairs > 0
        return pd.DataFrame({"v": v[some], "links": links[some].astype(np.int64), "pairs": pairs[some].astype(np.int64), "missed": gone[some], "root": root[some]})

    return verify


def similar_pairs(flat: np.ndarray, lens: np.ndarray, similarity: float, part: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices (a < b) and similarities of the pairs of sets with at least that similarity; with part, only pairs of one set of each part.

    Counts shared shingles through the shingles' lists of sets, for a slice of the shingles at a time.
    """
    m = len(lens)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if m < 2 or not len(flat):
        return none
    _, code = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(m), lens)
    shared = np.bincount(code)[code] > 1  # a shingle of one set adds to no intersection
    code, owner = code[shared], owner[shared]
    if not len(code):
        return none
    _, code = np.unique(code, return_inverse=True)
    width = int(code.max()) + 1
    step = max(1, min(width, 8_000_000 // m))
    both = np.zeros((m, m), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for a in range(0, width, step):
        lo, hi = np.searchsorted(code, (a, a + step))
        grid = np.zeros((m, min(step, width - a)), np.float32)
        grid[owner[lo:hi], code[lo:hi] - a] = 1
        both += grid @ grid.T
    either = lens[:, None] + lens[None, :] - both
    ok = np.triu(both >= similarity * either - 1e-6, 1)
    if part is not None:
        ok &= part[:, None] != part[None, :]
    a, b = np.nonzero(ok)
    return a, b, both[a, b].astype(float) / either[a, b]
