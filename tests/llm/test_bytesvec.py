import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import bpe, bytesvec, common, line_rules, near_dedup, ngram_lm, token_files


def thue_morse(n):
    """Two words of the letters a and b that collide under any polynomial modulo a power of two."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_hashes_of_ranges():
    rng = random.Random(1)
    pieces = [b"", *thue_morse_bytes(1024), *thue_morse_bytes(16), b"a", b"aa", b"a\0", b"a" * 8, b"a" * 9, b"a" * 64, b"a" * 65, b"a" * 66]
    pieces += [bytes(rng.choices(b"abc\0\xc3", k=rng.randint(1, 80))) for _ in range(2000)]
    pieces += pieces[:500]
    data, ends = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(p) for p in pieces])
    starts = ends - [len(p) for p in pieces]
    hashes = bytesvec.range_hashes(data, starts, ends)
    by_hash = {}
    for p, h in zip(pieces, hashes.tolist()):
        assert by_hash.setdefault(h, p) == p
    assert len(by_hash) == len(set(pieces))
    assert (bytesvec.range_hashes(np.zeros(0, np.uint8), np.zeros(1, int), np.zeros(1, int)) == hashes[0]).all()


def thue_morse_bytes(n):
    return [x.encode() for x in thue_morse(n)]


def test_same_ranges():
    data = np.frombuffer(b"abcdefgh" * 20 + b"abcdefgX" * 20 + b"end", np.uint8)
    same = lambda a, b, n: bytesvec.same_ranges(data, np.array([a]), np.array([b]), np.array([n]))[0]
    assert same(0, 8, 150) and not same(0, 160, 8) and same(0, 160, 7) and not same(0, 160, 150) and same(3, 3, 5) and same(0, 99, 0)
    assert not same(0, 162, 100) and same(7, 15, 1)


def test_ids_when_hashes_collide(monkeypatch):
    library = Tokenizer.from_file(common.tokenizer_path())
    encoder = bpe.FragmentEncoder(common.file_text(common.tokenizer_path()))
    texts = [*thue_morse(1024), "some words and some words", "other words", ""]
    for hashes in (bytesvec.range_hashes, lambda data, starts, ends: np.zeros(len(starts), np.uint64)):
        monkeypatch.setattr(bpe, "range_hashes", hashes)
        flat, at = encoder.encode(*bytesvec.bytes_of(pa.array(texts)))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.fixture(scope="module")
def alike_words(spark):
    one, two = thue_morse(1024)
    return spark.createDataFrame([(1, one), (2, two), (3, f"{one} {two}"), (4, f"{two} {one}"), (5, f"{one}\n{two}")], "doc_id long, text string")


def test_documents_of_such_words_stay_apart(alike_words):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(alike_words).collect()}
    assert [got[i]["component_id"] for i in range(1, 6)] == [1, 2, 3, 4, 3] and all(got[i]["n_shingles"] == 1 for i in got)


def test_lines_of_such_words_differ(alike_words):
    rows = line_rules.label_lines(alike_words, line_rules.Field.all_content()).where("doc_id = 5").collect()
    assert rows[0]["n_dup_lines"] == 0 and rows[0]["n_lines"] == 2


def test_counts_of_such_words(alike_words):
    counts = sorted(r["n"] for r in ngram_lm.word_counts(alike_words).collect())
    assert counts == [4, 4]


def test_files_of_such_words(spark, alike_words, tmp_path):
    token_files.write_token_files(alike_words, str(tmp_path / "files"))
    library = Tokenizer.from_file(common.tokenizer_path())
    rows = {r["doc_id"]: r["token_ids"] for r in spark.read.parquet(str(tmp_path / "files")).collect()}
    for r in alike_words.collect():
        assert rows[r["doc_id"]] == [*library.encode(r["text"], add_special_tokens=False).ids, 0]
    digests = {hashlib.sha256(str(rows[i]).encode()).hexdigest() for i in (1, 2)}
    assert len(digests) == 2
