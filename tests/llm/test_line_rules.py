import itertools
from collections import Counter
import re

import numpy as np

from fleetlens.llm import common, line_rules
from .conftest import EDGES, SMALL


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    passages = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(passages)
    repeated = {j for i, p in enumerate(passages) if times[p] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def test_measures_at_the_edges(spark, edge_docs):
    rows = line_rules.with_verdict(line_rules.label_lines(edge_docs, line_rules.Field.all_content())).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        got = tuple(r[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == measures(r["text"]), r["text"]
        assert r["kept"] == (not r["base_failed"])
    assert line_rules.label_lines(edge_docs.limit(0), line_rules.Field.all_content()).count() == 0


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 5, 2, 0, 7, 3]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    emissions, moves = rng.normal(size=(bounds[-1], 2)), rng.normal(size=(2, 2))
    got = line_rules.viterbi(emissions, bounds, moves)
    for a, b in zip(bounds, bounds[1:]):
        score = lambda p: sum(emissions[a + i, s] for i, s in enumerate(p)) + sum(moves[s, t] for s, t in zip(p, p[1:]))  # noqa: B023, E731
        assert tuple(got[a:b]) == max(itertools.product((0, 1), repeat=int(b - a)), key=score)


def test_query_keeps_clean_documents_and_rejects_junk(spark):
    sf = SMALL.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in line_rules.op6_quality_rules(spark, sf).collect()}
    docs = common.table(spark, sf, "documents").collect()
    quality = {r["doc_id"]: r["quality"] for r in common.table(spark, sf, "labels").collect()}
    assert len(got) == len(docs)
    for d in docs:
        r = got[d["doc_id"]]
        assert tuple(r[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == measures(d["text"])
    clean = [got[i] for i, q in quality.items() if q == 1 and not got[i]["base_failed"]]
    junk = [got[i] for i, q in quality.items() if q == 0 and not got[i]["base_failed"]]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)
    assert sum(r["kept"] for r in junk) <= 0.1 * len(junk)


def test_without_labels_every_line_is_content(spark):
    docs = spark.createDataFrame([(1, "word " * 20), (None, "other " * 7)], "doc_id long, text string")
    field = line_rules.field_from_labels(docs, spark.createDataFrame([], "doc_id long, quality int"))
    rows = line_rules.with_verdict(line_rules.label_lines(docs, field)).orderBy("n_words").collect()
    assert [r["content_share"] for r in rows] == [1.0, 1.0] and [r["kept"] for r in rows] == [False, False]


def test_windows_of_few_words_differ_by_order():
    from fleetlens.llm.bytesvec import mix, windows

    words = mix(np.arange(1, 3, dtype=np.uint64))
    for width in (5, 8):
        every = list(itertools.product((0, 1), repeat=width))
        hashes = [windows(words[list(p)], np.array([0, width]), width)[0][0] for p in every]
        assert len(set(hashes)) == len(every)


def test_header_and_footer_around_prose_are_labelled_apart(spark):
    sf = SMALL.replace("sf0.001", "sf0.01")
    field = line_rules.field_from_labels(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"))
    header = ["Home | About | Contact | Help", "Log in * Sign up * Basket", "NEWS | SPORT | WEATHER"]
    prose = ["The committee met on a cold morning in March and spoke for two hours about the bridge.", "Nobody could say who had paid for it, or when it would be open to the public again.", "In the end they went home without a vote."]
    footer = ["### Terms ### Privacy ### Cookies ###", "NEWS | SPORT | WEATHER", "Share | Print | Save"]
    docs = spark.createDataFrame([(1, "\n".join(header + prose * 1 + footer)), (2, "\n".join(prose)), (3, "\n".join(header + footer)), (4, "\n".join(prose + ["", "Site map"] + prose[:1]))], "doc_id long, text string")
    labels = {r["doc_id"]: r["line_labels"] for r in line_rules.label_lines(docs, field).collect()}
    assert labels[1] == [0] * 3 + [1] * 3 + [0] * 3
    assert labels[2] == [1] * 3 and labels[3] == [0] * 6
    assert labels[4][:3] == [1] * 3


def test_some_documents_have_lines_of_both_kinds(spark):
    sf = SMALL.replace("sf0.001", "sf0.01")
    docs = common.table(spark, sf, "documents")
    rows = line_rules.label_lines(docs, line_rules.field_from_labels(docs, common.table(spark, sf, "labels"))).collect()
    assert sum(0 < sum(r["line_labels"]) < len(r["line_labels"]) for r in rows) > 0.02 * len(rows)


def test_lines_beyond_the_first_chain_teach(monkeypatch):
    rng = np.random.default_rng(8)
    good = lambda n: np.column_stack([np.ones(n), rng.uniform(0, 0.1, n), rng.uniform(0, 0.1, n), np.zeros((n, 3)), np.zeros(n), np.ones(n)])
    bad = lambda n: np.column_stack([np.ones(n), rng.uniform(0.6, 1, n), rng.uniform(0, 0.1, n), np.zeros((n, 3)), np.zeros(n), np.zeros(n)])
    documents = [good(40) for _ in range(20)] + [np.vstack([good(30), bad(60)]) for _ in range(20)]
    for chain in (16, 128):
        monkeypatch.setattr(line_rules, "CHAIN_LINES", chain)
        field = line_rules.fit_field(documents, [1] * 20 + [0] * 20)
        x = np.vstack([good(10), bad(10), good(10)])
        emissions = np.column_stack([np.zeros(30), x @ field.weights])
        assert line_rules.viterbi(emissions, np.array([0, 30]), field.moves).tolist() == [1] * 10 + [0] * 10 + [1] * 10
