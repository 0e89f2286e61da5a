"""Secret scans: one minimal automaton for all rules reads every byte once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, compile_rules
from .common import bounded_batches, slices

#: The kinds and their patterns, base kinds first.
RULES = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "jwt": r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+",
    "key": r"\-\-\-\-\-BEGIN [A-Z ]*PRIVATE KEY\-\-\-\-\-",
}
BASE = ("assign", "access", "hex")
_VALUE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


@dataclass(frozen=True)
class Scanner:
    kinds: tuple[str, ...]
    all_: Automaton
    forward: tuple[Automaton, ...]
    backward: tuple[Automaton, ...]

    @staticmethod
    def of(rules: dict[str, str]) -> Scanner:
        each = list(rules.values())
        return Scanner(tuple(rules), compile_rules(each), tuple(compile_rules([x], anchored=True) for x in each), tuple(compile_rules([x], anchored=True, backward=True) for x in each))

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes: leftmost, then longest, without overlaps within a rule.

        A rule's first accepting byte behind its last match gives the match: its own automata find the leftmost
        start and the longest end from there. Only matches are kept, so a long run of accepting bytes takes no memory.
        """
        a = self.all_
        table, bar, s = a.table, a.accepting * a.width, a.start
        done = [0] * len(self.kinds)
        out = []
        for i, c in enumerate(data.translate(a.classes)):
            s = table[s + c]
            if s >= bar:
                mask = a.rules[s // a.width - a.accepting]
                for k, end in enumerate(done):
                    if mask >> k & 1 and i >= end:
                        start = _last(self.backward[k], data, range(i, end - 1, -1))
                        if start is not None:
                            done[k] = _last(self.forward[k], data, range(start, len(data))) + 1
                            out.append((start, k, done[k]))
        return sorted(out)


def _last(a: Automaton, data: bytes, at: range) -> int | None:
    """The last place at which the automaton accepts, until it can't any more."""
    table, classes, bar, s, found = a.table, a.classes, a.accepting * a.width, a.start, None
    for i in at:
        s = table[s + classes[data[i]]]
        if s >= bar:
            found = i
        elif s == a.dead:
            break
    return found


def _good(kind: str, found: bytes) -> bool:
    """assign needs 6 or more characters of value: what follows the separator, blanks and one quote."""
    if kind != "assign":
        return True
    cut = min(i for i in (found.find(b":"), found.find(b"=")) if i >= 0) + 1
    value = found[cut:].lstrip(b" ")
    return len(value) - (value[:1] in (b'"', b"'")) >= 6


def find_secrets(text: str | None, scanner: Scanner) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start and then in the order of the rules."""
    if not text:
        return []
    data = text.encode()
    found = [(a, k, b) for a, k, b in scanner.spans(data) if _good(scanner.kinds[k], data[a:b])]
    if found and len(data) != len(text):
        place = {}
        last = chars = 0
        for x in sorted({x for a, _, b in found for x in (a, b)}):
            chars += len(data[last:x].decode())
            place[x], last = chars, x
        found = [(place[a], k, place[b]) for a, k, b in found]
    return [(a, scanner.kinds[k], b) for a, k, b in found]


def scan_secrets(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """docs with secrets: array of (start, kind, end) in code points, end exclusive, by start and then kind as in rules.

    A null or empty text has an empty array. A column named secrets is replaced; an empty table gives an empty result.
    The automata are compiled once and broadcast: their size depends on the rules only.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Scanner.of(rules))

    @F.pandas_udf("array<struct<start: long, kind: string, end: long>>")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in slices(texts):
            yield pd.Series([[{"start": a, "kind": k, "end": b} for a, k, b in find_secrets(t, shared.value)] for t in part])

    return docs.withColumn("secrets", scan("text"))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def secret_report(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan_secrets(docs.select("doc_id", "text"), rules).select("doc_id", "secrets")
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.size(F.filter("secrets", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """docs with each secret in text replaced by [kind]; overlapping secrets are one place. n_chars, where there, is recounted."""
    names = docs.columns
    scanned = scan_secrets(docs, rules)
    # Overlapping spans are merged to one place with the first one's kind.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    text = F.col("text")
    fold = F.aggregate(
        "secrets",
        start,
        lambda acc, x: F.when(x["end"] <= acc["at"], acc)
        .when(x["start"] < acc["at"], F.struct(x["end"].alias("at"), acc["out"].alias("out")))
        .otherwise(F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]")).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    out = scanned.withColumn("text", F.when(F.size("secrets") > 0, fold).otherwise(text))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(names)
