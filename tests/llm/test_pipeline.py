from collections import Counter
import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fleetlens.llm import common, line_rules, mixing, near_dedup, quality_model
from .conftest import SMALL
from .test_line_rules import measures
from .test_near_dedup import brute_force
from .test_quality_model import plain_score, plain_statistics


def test_stages_take_effect(spark):
    docs = common.table(spark, SMALL, "documents")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, SMALL, "labels").collect()}
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(common.materialize(stage(spark, kept[-1], SMALL), "stage"))
        assert kept[-1].columns == columns
    ids = [[r["doc_id"] for r in k.select("doc_id").collect()] for k in kept]
    good = [i for i in ids[0] if labels.get(i) == 1]
    assert len(set(good) & set(ids[1])) >= 0.97 * len(good) and set(ids[1]) < set(ids[0])
    assert set(ids[2]) < set(ids[1]) and set(ids[3]) < set(ids[2])
    left = near_dedup.near_duplicates(kept[3]).collect()
    assert all(r["kept"] for r in left)
    emitted = Counter()
    for r in kept[4].collect():
        emitted[r["doc_id"]] += len(r["text"].split())
    assert all(emitted[r["doc_id"]] == r["taken"] for r in mixing.mix(kept[3]).collect())
    last = corpus_pipeline.run(spark, SMALL)
    assert sorted(r["doc_id"] for r in last.select("doc_id").collect()) == sorted(ids[4])


def test_mix_emits_the_words_it_takes(spark):
    rng = random.Random(3)
    sizes = [("hot", 900 if i % 2 else 40) for i in range(60)] + [(f"s{i % 20}", 500 + i) for i in range(40)] + [("tiny", 90), (None, 300)]
    rows = [(i, "".join(f"{i}w{k}{rng.choice([' ', chr(10), '  '])}" for k in range(n)), "en", s) for i, (s, n) in enumerate(sizes)] + [(500, "", "en", "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = corpus_pipeline.mix_sources(spark, docs, SMALL)
    assert out.columns == docs.columns
    texts, emitted, long_words = {r[0]: r[1] for r in rows}, Counter(), 0
    for r in out.collect():
        assert r["text"] and r["text"] in texts[r["doc_id"]]
        emitted[r["doc_id"]] += len(r["text"].split())
        long_words += len(r["text"].split()) if r["source"] == "hot" and r["doc_id"] % 2 else 0
    by_source, targets = Counter(), {}
    for r in mixing.mix(docs).collect():
        assert emitted[r["doc_id"]] == r["taken"]
        by_source[r["source"]] += emitted[r["doc_id"]]
        targets[r["source"]] = r["target"]
    assert all(abs(by_source[s] - t) <= 2 * mixing.BLOCK_WORDS for s, t in targets.items())
    assert targets["hot"] < 0.1 * 30 * 940 and long_words > 0.5 * targets["hot"]


#: Columns with the names that operators and their helpers use.
CLASHING = ("n_words", "score", "predicted", "kept", "kept_id", "content_share", "component_id", "n_shingles", "set_key", "_key", "_row", "_place", "times", "copy", "copies", "mixed_id", "rank", "size", "token_ids", "decoded")
PROSE = "The cat of the house sat on a mat and looked at the bird that sang in the old tree behind the garden wall. "
EDGE_ROWS = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, None), (None, "Another text that has no id but words enough to be looked at as a whole by every one of the stages here."), (None, None),
    (4, ""), (5, " \n\t "), (6, "one two"), (7, PROSE + "More of it was said by the man who came late. "), (7, PROSE), (8, " ".join(f"word{i}" for i in range(60_000))), (9, "x" * 100_000), (10, "same words here again"), (10, "same words here again"),
]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, "en", None if k % 4 == 0 else f"s{k % 2}", 1, *[f"{c}{k}" for c in CLASHING]) for k, (i, t) in enumerate(EDGE_ROWS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_edges_of_every_stage(spark, clashing, name, stage):
    out = stage(spark, clashing, SMALL)
    rows = out.collect()
    if stage is corpus_pipeline.encode_tokens:
        assert len(rows) == len(EDGE_ROWS) and all(r["n_tokens"] == len(r["token_ids"]) for r in rows)
        assert stage(spark, clashing.limit(0), SMALL).count() == 0
        return
    assert out.columns == clashing.columns
    given = Counter(map(tuple, clashing.collect()))
    if stage is corpus_pipeline.mix_sources:
        texts = {r["set_key"]: r["text"] for r in clashing.collect()}
        assert all(r["text"] in texts[r["set_key"]] and r["kept"][4:] == r["set_key"][7:] for r in rows)
    else:
        assert not Counter(map(tuple, rows)) - given
    if stage is corpus_pipeline.drop_near_copies:
        held = [(r["doc_id"], r["text"]) for r in rows]
        assert sorted(held, key=str) == sorted([(1, PROSE), (3, None), EDGE_ROWS[4], (None, None), (4, ""), (5, " \n\t "), (6, "one two"), EDGE_ROWS[9], EDGE_ROWS[11], (9, "x" * 100_000), (10, "same words here again")], key=str)
    if stage is corpus_pipeline.keep_content:
        assert all(len((r["text"] or "").split()) >= 20 for r in rows)
    none = stage(spark, clashing.limit(0), SMALL)
    assert none.columns == clashing.columns and none.count() == 0


@pytest.fixture(scope="module")
def some_docs(spark):
    return common.table(spark, SMALL, "documents")


def test_quality_stage_against_plain_python(spark, some_docs):
    model = quality_model.fit(some_docs, common.table(spark, SMALL, "labels"))
    kept = {r["doc_id"] for r in corpus_pipeline.keep_good_quality(spark, some_docs, SMALL).collect()}
    assert kept == {r["doc_id"] for r in some_docs.collect() if plain_score(model, plain_statistics(r["text"])) >= 0.3}


def test_content_stage_against_plain_python(spark, some_docs):
    field = line_rules.field_from_labels(some_docs, common.table(spark, SMALL, "labels"))
    kept = {r["doc_id"] for r in corpus_pipeline.keep_content(spark, some_docs, SMALL).collect()}
    wanted = set()
    for r in some_docs.collect():
        if not measures(r["text"])[5]:
            words, features = plain_lines(r["text"])
            states = plain_viterbi(features @ field.weights, field.moves)
            if sum(n for n, s in zip(words, states) if s) >= 0.5 * sum(words):
                wanted.add(r["doc_id"])
    assert kept == wanted


def plain_lines(text):
    """Words and features of the lines with a word, by their definition."""
    seen, words, rows = set(), [], []
    for line in text.split("\n"):
        split = [w for w in line.replace("\r", " ").replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        if not split:
            continue
        letters = max(1, sum(b in line_rules.LETTER.nonzero()[0] for b in line.encode()))
        count = lambda table: sum(bool(table[b]) for b in line.encode())  # noqa: B023, E731
        echoes = sum(a == b for a, b in zip(split, split[1:]))
        if words and previous[-1] == split[0]:  # noqa: F821
            echoes += 1
        rows.append([1, min(count(line_rules.MARKS) / len(split), 2), count(line_rules.UPPER) / letters, min(count(line_rules.DIGIT) / letters, 2), echoes / len(split), line in seen, len(split) < 4, split[-1][-1] in ".?!"])
        words.append(len(split))
        seen.add(line)
        previous = split  # noqa: F841
    return words, np.array(rows, float)


def plain_viterbi(content, moves):
    best = [(0.0, (0,)), (content[0], (1,))]
    for x in content[1:]:
        step = [[(best[f][0] + moves[f, t], best[f][1]) for f in (0, 1)] for t in (0, 1)]
        best = [(max(step[t])[0] + (x if t else 0.0), max(step[t], key=lambda p: (p[0], p[1][-1]))[1] + (t,)) for t in (0, 1)]
    return max(best, key=lambda p: (p[0], p[1][-1]))[1]


def test_near_copy_stage_against_all_pairs(spark, some_docs):
    components = brute_force([(r["doc_id"], r["text"]) for r in some_docs.collect()])
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, some_docs, SMALL).collect()}
    assert kept == {i for i, (_, c) in components.items() if c == i}


def test_token_stage_against_the_library(spark, some_docs):
    library = Tokenizer.from_file(common.tokenizer_path())
    texts = {r["doc_id"]: r["text"] or "" for r in some_docs.collect()}
    for r in corpus_pipeline.encode_tokens(spark, some_docs, SMALL).collect():
        assert r["token_ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["token_ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
