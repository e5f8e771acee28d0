import random
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import license_scan
from .conftest import EDGES

TEXTS = EDGES + [
    "Under the MIT License. under THE mit license", "cc-by-nc cc by nc cc by", "Licensed under the Apache License, Version 2.0.", "by nc cc by", "under the mit",
    "GNU General Public License and the Free Software Foundation", "mit " * 50, "Apache\nLicense\tVersion 2", "éunder the mit license", "Under the MİT License", "1cc by nc", "nc", "license 2",
    "Permission is hereby granted, free of charge; without warranty of any kind", "cc0 1.0 universal",
]


def brute_force(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(n, i) for n, (phrase, _, _) in enumerate(license_scan.PHRASES) for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]
    base = [i for n, i in places if n < len(license_scan.BASE)]
    met = {n for n, _ in places}
    kind = lambda *kinds: {license_scan.PHRASES[n][1] for n in met if license_scan.PHRASES[n][2] in kinds}
    return len(words), places, len(base), min(base, default=None), max(base, default=None), ",".join(sorted(kind("base"))), ",".join(sorted(kind("base") | kind("key") & set(license_scan.NAMES))), ",".join(sorted(kind("key")))


def assert_same(spark, texts):
    frame = spark.createDataFrame([(i, t, "taken") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    for r in license_scan.scan_licenses(frame).collect():
        got = (r["n_words"], [(p["phrase"], p["start"]) for p in r["places"]], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["mentions"])
        assert got == brute_force(r["text"]), r["text"]
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"] or r["mentions"]) and (r["score"] >= 0.5) == bool(r["labels"]) and (not r["base_labels"] or r["score"] == 1)


def test_edges(spark):
    assert_same(spark, TEXTS)


def test_random_sequences(spark):
    words = st.sampled_from(["under", "the", "MIT", "license", "cc", "by", "nc", "Apache", "version", "2", "gnu", "general", "public", "x", "-", "is"])
    texts = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(words, max_size=14).map(" ".join))
    def collect(text):
        texts.append(text)

    collect()
    assert_same(spark, texts)


def test_no_rows(spark):
    assert license_scan.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def comment(text, width, mark):
    """A notice as it stands in a file: capitals, stops, comment marks, lines."""
    words = [w.capitalize() if i % 9 == 0 else w + "," * (i % 7 == 3) for i, w in enumerate(text.split())]
    return "\n".join(mark + " ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_notices_in_files(spark):
    rng = random.Random(2)
    texts, wanted = [], []
    for label, text in license_scan.NOTICES.items():
        words = text.split()
        key = license_scan.PHRASES[next(k for name, _, k, _ in license_scan.TEMPLATES if name == label)][0]
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        edited = words[: at + len(key)] + [w if rng.random() > 0.1 else "changed" for w in words[at + len(key) :]]
        longer = "Copyright 2020 by some people who wrote it all".split() + words[: at + len(key)] + ["(in", "short)"] + words[at + len(key) :]
        without = [w if not at <= i < at + len(key) else "x" for i, w in enumerate(words)]
        slipped = [w if i != at + len(key) // 2 else "x" for i, w in enumerate(words)]
        tolerant = len(key) >= license_scan.SLIP_WORDS
        twice = [w if i not in (at, at + len(key) // 2) else "x" for i, w in enumerate(words)]
        tail = words[: at + len(key) + 1][-3:]
        for variant, found in ((words, True), (edited, True), (longer, True), (slipped, tolerant), (twice, False), (without, False), (key, False), (tail, False)):
            texts.append("code before it;\n" + comment(" ".join(variant), 11, " * ") + "\nint main() { return 0; }")
            wanted.append(label if found else "")
    texts.append(comment(license_scan.NOTICES["mit"], 8, "# ") + "\n\n" + comment(license_scan.NOTICES["apache-2"], 20, "// "))
    wanted.append("apache-2,mit")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(frame).collect()}
    got = {i: r["notices"] for i, r in rows.items()}
    for r in rows.values():  # labels follow from notices and base phrases, a phrase alone is a mention
        split = lambda name: set(filter(None, r[name].split(",")))
        assert split("labels") == split("notices") | split("base_labels")
        assert r["score"] >= 0.5 if r["labels"] else r["score"] == (0.25 if r["mentions"] else 0)
    # gpl notices without their name hold no other licence's name either, and the lesser licence's name is not the general one's
    assert [got[i] for i in range(len(texts))] == wanted
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    columns = [c for c in license_scan.scan_licenses(frame).drop("text", "places").columns]
    rows = con.execute(f"SELECT {', '.join(columns)} FROM ({license_scan.oracle()})").fetchall()
    assert sorted(rows) == sorted(tuple(r) for r in license_scan.scan_licenses(frame).select(*columns).collect())
