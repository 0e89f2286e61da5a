"""Exact BPE by a backtracking encoder, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

#: Fixed value: how byte-level BPE cuts a text before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: visible Latin-1 characters are themselves, others come from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Encoder:
    """tokens: the bytes of each id; merges: (left id, right id, new id) in order of rank; special: text to id.

    keep bounds what is remembered, for speed only: the ids of at most 2 * keep cuts and the verdicts on 8 * keep pairs.
    """

    tokens: list[bytes]
    merges: list[tuple[int, int, int]]
    special: dict[str, int]
    keep: int = 100_000

    @staticmethod
    def of(vocabulary: str) -> Encoder:
        """From the text of a byte-level vocabulary file; ValueError where the file asks for what this encoder doesn't do."""
        spec = json.loads(vocabulary)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        fine = {
            "model.type": model.get("type", "BPE") == "BPE",
            "normalizer": not spec.get("normalizer"),
            "pre_tokenizer": cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True),
            "decoder": (spec.get("decoder") or {}).get("type") == "ByteLevel",
            "added_tokens": not any(x.get(flag) for x in spec.get("added_tokens", []) for flag in ("single_word", "lstrip", "rstrip", "normalized")),
            **{f"model.{x}": not model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")},
        }
        if not all(fine.values()):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {', '.join(k for k, ok in fine.items() if not ok)}")
        vocab, letters = model["vocab"], byte_letters()
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        tokens = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, i in vocab.items():
            if t not in special:
                tokens[i] = bytes(letters[c] for c in t)
        for t, i in special.items():
            tokens[i] = t.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return Encoder(tokens, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], special)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("tokens", "merges", "special", "keep")}

    @cached_property
    def _made(self) -> tuple[dict[tuple[int, int], tuple[int, int]], dict[int, tuple[int, int]], dict[int, int]]:
        """Pair to (rank, id); id to the pair that makes it; id to rank (single bytes come first)."""
        pairs, split, rank = {}, {}, {}
        for r, (a, b, c) in enumerate(self.merges):
            pairs.setdefault((a, b), (r, c))
            if c not in split:
                split[c], rank[c] = (a, b), r
        return pairs, split, rank

    @cached_property
    def _matcher(self) -> ahocorasick.Automaton:
        known = set(self._made[1]) | {i for i, t in enumerate(self.tokens) if len(t) == 1}
        a = ahocorasick.Automaton()
        for i in known:
            a.add_word(self.tokens[i].decode("latin-1"), i)
        a.make_automaton()
        return a

    @cached_property
    def _shorter(self) -> dict[int, int]:
        """Each token's longest proper prefix that is a token."""
        by_bytes = {self.tokens[i]: i for i in (i for _, i in self._matcher.items())}
        out = {}
        for t, i in by_bytes.items():
            out[i] = next((by_bytes[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_bytes), -1)
        return out

    @cached_property
    def _lens(self) -> list[int]:
        return list(map(len, self.tokens))

    @cached_property
    def _compatible(self) -> dict[int, bool]:
        """The pair-compatibility table, as far as it was asked for: left << 32 | right to the verdict."""
        return {}

    def _fits(self, left: int, right: int) -> bool:
        """Whether merges leave the tokens left, right as they are when their bytes stand side by side.

        Undoes the later of the two tokens' merges again and again: if the parts that touch would merge
        before the merges undone so far, the pair can't stand.
        """
        pairs, split, rank = self._made
        first = len(self.merges)
        limit = first  # only merges of a lower rank than this come before
        a, b = left, right
        while True:
            if (found := pairs.get((a, b))) is not None and found[0] < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # Of equal ranks the left one is merged first, so the right one is undone first.
            if ra > rb:
                limit = ra
                a = split[a][1]
            else:
                limit = rb + 1
                b = split[b][0]

    def _verdict(self, pair: int) -> bool:
        table = self._compatible
        if (ok := table.get(pair)) is None:
            if len(table) > 8 * self.keep:
                table.clear()
            ok = table[pair] = self._fits(pair >> 32, pair & 0xFFFFFFFF)
        return ok

    def merge_exact(self, word: str, out: list[int] | None = None) -> list[int]:
        """The ids of one cut (its bytes as Latin-1 letters): the longest match at each place, with steps back where a pair can't stand.

        out: the first tokens, where they are known to be longest matches that can stand side by side.
        """
        n, lens, shorter = len(word), self._lens, self._shorter
        table, verdict = self._compatible, self._verdict
        longest, length = [-1] * n, [0] * n
        for end, i in self._matcher.iter(word):
            size = lens[i]
            start = end + 1 - size
            if length[start] < size:
                longest[start], length[start] = i, size
        open_ = bytearray(b"\x01") * (n + 1)  # places from which the rest may still be encoded
        out = out or []
        at = sum(map(lens.__getitem__, out))
        token = longest[at] if at < n else -1
        while at < n:
            while token >= 0:
                if open_[at + lens[token]]:
                    if not out:
                        break
                    pair = out[-1] << 32 | token
                    ok = table.get(pair)
                    if ok or ok is None and verdict(pair):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += lens[token]
                token = longest[at] if at < n else -1
            else:
                open_[at] = 0
                if not out:
                    raise ValueError("the vocabulary does not cover all bytes")
                token = out.pop()
                at -= lens[token]
                token = shorter[token]
        return out

    def merge_all(self, cuts: list[str]) -> list[bytes]:
        """The ids (int32) of many cuts: one pass of the automaton tiles them all with longest matches, whose pairs are then looked up.

        Only cuts with a pair that can't stand are encoded with steps back, from that pair on.
        """
        words = [c.encode().decode("latin-1") for c in cuts]
        joined = "\u0100".join(words)  # no token holds this letter, so no match goes over it
        found = np.fromiter(self._matcher.iter_long(joined), dtype="i8, i8")
        ends, ids = found["f0"], found["f1"].astype(np.int32)
        stops = np.cumsum([len(w) + 1 for w in words])
        edges = np.r_[0, np.searchsorted(ends, stops, "left")]
        if np.asarray(self._lens)[ids].sum() != stops[-1] - len(words):
            raise ValueError("the vocabulary does not cover all bytes")
        pair = ids[:-1].astype(np.int64) << 32 | ids[1:]
        inner = np.ones(len(pair), bool)
        inner[edges[1:-1] - 1] = False  # the last token of a cut and the first one of the next
        at = np.flatnonzero(inner)
        known, back = np.unique(pair[at], return_inverse=True)
        bad = at[~np.fromiter(map(self._verdict, known.tolist()), bool, len(known))[back]]
        raw = ids.tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(edges.tolist(), edges[1:].tolist())]
        of = np.searchsorted(edges, bad, "right") - 1
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
        for k, end in zip(of[first].tolist(), bad[first].tolist()):
            out[k] = np.array(self.merge_exact(words[k], ids[edges[k] : end + 1].tolist()), np.int32).tobytes()
        return out

    @cached_property
    def _cuts(self):
        return regex.compile(SPLIT)

    @cached_property
    def _specials(self):
        return regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    @cached_property
    def _words(self) -> list[dict[str, bytes]]:
        """The cuts seen lately and those seen before them; when the first is full it takes the second's place."""
        return [{}, {}]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text. Special tokens in it are found first and stand for themselves."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str], chars: int = 1 << 20) -> Iterator[np.ndarray]:
        """The ids of each text; some texts at a time, so that their new cuts are merged together."""
        waiting, size = [], 0
        for text in texts:
            waiting.append(text)
            size += len(text)
            if size >= chars:
                yield from self._encoded(waiting)
                waiting, size = [], 0
        yield from self._encoded(waiting)

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self._words[0]) > self.keep:
            self._words[:] = {}, self._words[0]
        new, old = self._words
        each, places, lacking = [], [], {}
        for text in texts:
            parts: list[str | bytes] = []
            at = 0
            for m in self._specials.finditer(text) if self._specials else ():
                parts += self._cuts.findall(text[at : m.start()])
                parts.append(np.array([self.special[m[0]]], np.int32).tobytes())
                at = m.end()
            parts += self._cuts.findall(text[at:] if at else text)
            ids = list(map(new.get, parts))
            each.append(ids)
            k = -1
            for _ in range(ids.count(None)):
                k = ids.index(None, k + 1)
                cut = parts[k]
                if isinstance(cut, bytes):
                    ids[k] = cut
                elif (found := old.get(cut)) is not None:
                    ids[k] = new[cut] = found
                else:
                    lacking[cut] = b""
                    places.append((ids, k, cut))
        if lacking:
            made = dict(zip(lacking, self.merge_all(list(lacking))))
            new.update((c, x) for c, x in made.items() if len(c) <= 64)
            for ids, k, cut in places:
                ids[k] = made[cut]
        for ids in each:
            yield np.frombuffer(b"".join(ids), np.int32)

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lens = np.array([len(t) for t in self.tokens], np.int64)
        return np.frombuffer(b"".join(self.tokens), np.uint8), np.cumsum(lens) - lens, lens

    def decode(self, ids: np.ndarray) -> str:
        """All tokens' bytes, from one array by offsets; bytes that aren't UTF-8 become U+FFFD. Unknown ids are left out."""
        data, offsets, lens = self._table
        ids = ids[(ids >= 0) & (ids < len(lens))]
        n = lens[ids]
        total = int(n.sum())
        ends = np.cumsum(n)
        place = np.arange(total) - np.repeat(ends - n, n) + np.repeat(offsets[ids], n)
        return data[place].tobytes().decode("utf-8", "replace")

    @cached_property
    def _digits(self) -> list[str]:
        return list(map(str, range(len(self.tokens))))

    def joined(self, ids: np.ndarray) -> str:
        return ",".join(map(self._digits.__getitem__, ids.tolist()))


def _shared(spark, vocabulary: str):
    bounded_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(Encoder.of(f.read()))


def encode_column(docs: DataFrame, vocabulary: str, column: str = "text") -> Column:
    """array<int> of the column's token ids; a null text has none. The vocabulary is read by the driver and broadcast."""
    shared = _shared(docs.sparkSession, vocabulary)

    @F.pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in slices(texts):
            yield pd.Series(list(shared.value.encode_all(t or "" for t in part)), dtype=object)

    return encode(column)


def decode_column(docs: DataFrame, vocabulary: str, column: str) -> Column:
    """string of an array<int> of token ids; null for null."""
    shared = _shared(docs.sparkSession, vocabulary)

    @F.pandas_udf("string")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in slices(ids):
            yield pd.Series([None if x is None else shared.value.decode(np.asarray(x, np.int64)) for x in part])

    return decode(column)


def encode_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs without text, with n_tokens, ids_sha256 and decoded_sha256; digests instead of ids, in one pass.

    A null text is empty. Columns of docs with a name that this adds are replaced; an empty table gives an empty result.
    """
    shared = _shared(docs.sparkSession, vocabulary)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def report(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = shared.value
        for part in slices(texts):
            coded = coder.encode_all(t or "" for t in part)
            rows = [(len(ids), sha(coder.joined(ids)), sha(coder.decode(ids))) for ids in coded]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    kept = [c for c in docs.columns if c not in ("text", "n_tokens", "ids_sha256", "decoded_sha256")]
    return docs.withColumn("_r", report("text")).select(*kept, "_r.n_tokens", "_r.ids_sha256", "_r.decoded_sha256")
