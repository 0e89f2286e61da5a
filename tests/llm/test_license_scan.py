import random
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from phyllon.llm.license_scan import NAMES, TEMPLATES, WORD, license_sql, scan_licenses

COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
MIT = next(t.text for t in TEMPLATES if t.label == "mit" and len(t.text) > 100)


def scan(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    return [tuple(r[c] for c in COLUMNS) for r in scan_licenses(df).orderBy("doc_id").collect()]


def base(text):
    words = re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in text or ""))
    found = sorted((i, label) for name, label in NAMES for i in range(len(words)) if words[i : i + len(name.split())] == name.split())
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_base_places_match_brute_force(spark):
    texts = [
        None,
        "",
        " \n\t.,;",
        "The MIT License",
        "mit license mit LICENSE; Mit-License",
        "mit mit license license",
        "permit license, mitlicense, mit licenses, mit é license, émit license",
        "Apache\nLicense. GNU General Public License / general public public license",
        "MIT License",  # no blank: one word
        "MİT License ſ K",
        "general public license mit license apache license 漢字 2.0",
        "mit license " * 200_000,
    ]
    assert [r[:5] for r in scan(spark, texts)] == [base(t) for t in texts]


def changed(rng, words):
    out = list(words)
    for _ in range(rng.randrange(5)):
        j = rng.randrange(len(out))
        out[j : j + rng.randrange(2)] = rng.choice([["foo"], ["the", "license"], []])
        out = out or ["a"]
    return out


def test_all_columns_match_joins_in_sql(spark):
    rng = random.Random(4)
    rows = []
    for i in range(250):
        parts = [rng.choice([" ", "\n", "; "]).join(changed(rng, rng.choice(TEMPLATES).text.split())) for _ in range(rng.randrange(4))]
        text = rng.choice([". ", " MIT License mit license ", " General public\nlicense é "]).join(["", *parts])
        rows.append((i if i % 20 else None, None if i % 31 == 3 else text.upper() if i % 3 == 0 else text))
    documents = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = [tuple(r) for r in con.sql(license_sql()).fetchall()]
    got = [tuple(r) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", *COLUMNS).collect()]
    assert len({r[6] for r in want}) > 3
    assert sorted(got, key=str) == sorted(want, key=str)


def test_texts_of_licenses_are_found_with_changes_and_told_from_their_words(spark):
    words = MIT.split()
    some = " ".join([*words[:20], "foo", "bar", *words[20:]])
    without_phrase = MIT.replace("free of charge", "for money")
    shuffled = " ".join(sorted(words))
    rows = scan(spark, [MIT, "Copyright 2020 X\n\n" + MIT.title() + ".", some, without_phrase, shuffled, "plain text of software"])
    assert [r[5] for r in rows] == ["mit", "mit", "mit", "", "", ""]
    assert rows[0][6] == rows[1][6] == 1.0 and 0.34 <= rows[2][6] < 1.0 and rows[3][6] == 0.0


def test_repeated_rows_clashing_names_and_empty_tables(spark):
    rows = [(1, "MIT License"), (1, "MIT License"), (None, "apache license"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("x") for n in ("hits", "_w", "_p0", "_s0", "w", "count", "labels", "score", "n_words", "other")})
    out = scan_licenses(df)
    assert len(out.columns) == len(set(out.columns))
    assert sorted((r.doc_id or 0, r.labels, r.other) for r in out.collect()) == [(0, "", "x"), (0, "apache", "x"), (1, "mit", "x"), (1, "mit", "x")]
    assert scan(spark, []) == []
