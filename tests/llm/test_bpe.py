import hashlib
import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from fleetlens.llm import bpe, common
from fleetlens.llm.bytesvec import bytes_of
from .conftest import EDGES, SMALL

ENCODER = bpe.FragmentEncoder(common.file_text(common.tokenizer_path()))
LIBRARY = Tokenizer.from_file(common.tokenizer_path())
PIECES = st.sampled_from(["a", "The", "é", "ß", " ", "  ", "\n", "\t", " ", "　", " ", "\x85", "'", "'s", "'re", "<|endoftext|>", "<|", "12", "!", "***", "日", "\U0001f600", "́", "\x00", "\x1c", "§"])


def encoded(texts):
    flat, at = ENCODER.encode(*bytes_of(pa.array(texts, pa.string())))
    return [flat[a:b].tolist() for a, b in zip(at, at[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=6))
def test_same_ids_and_texts_as_the_library(texts):
    for text, ids in zip(texts, encoded(texts)):
        assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
        assert ENCODER.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert encoded([text])[0] == LIBRARY.encode(text, add_special_tokens=False).ids


def test_decoding_broken_sequences_as_the_library():
    for ids in ([170], [170, 188, 50256], [11, 999999, 12], []):
        assert ENCODER.decode(ids) == LIBRARY.decode([i for i in ids if i < 50257], skip_special_tokens=False)


def test_older_fragments_are_found_again(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_FRAGMENTS", 4)
    small = bpe.FragmentEncoder(common.file_text(common.tokenizer_path()))
    for text in ["one two three four five six", "one seven", "two eight nine ten", "one two three"] * 2:
        flat, _ = small.encode(*bytes_of(pa.array([text])))
        assert flat.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_words_are_merged_without_the_steps_before():
    encoder = bpe.FragmentEncoder(common.file_text(common.tokenizer_path()))
    encoder.encode(*bytes_of(pa.array(["\n"])))
    encoder.tokenizer = None  # what comes now needs the model alone
    for text in ["one thheingble\nThree Ländereien\nfour", "Onenti", "one thheingble"]:
        flat, _ = encoder.encode(*bytes_of(pa.array([text])))
        assert flat.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_single_line_breaks_are_cut_off():
    data, at = bytes_of(pa.array(["one\nTwo.\n\nThree\n's \nfour"]))
    assert [data[a:b].tobytes() for a, b in itertools.pairwise(ENCODER.cuts(data, at).tolist())] == [b"one", b"\n", b"Two", b".", b"\n\nThree", b"\n's", b" \nfour"]
    around = ["a", "É", "é", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\u00a0", "\u3000", "'", "'s", "!", "7", "日", "<|endoftext|>", "\x00", ""]
    texts = ["".join(t) for t in itertools.product(around, ["\n", "\r\n", "\n\n"], around)]
    for joined in (texts, texts[::-1]):  # other neighbours, too
        assert encoded(joined) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in joined]


def test_kept_short_fragments_stay_few_and_right(monkeypatch):
    for most in (1, 5, 12):
        monkeypatch.setattr(bpe, "KEPT_FRAGMENTS", most)
        small = bpe.FragmentEncoder(common.file_text(common.tokenizer_path()))
        for i in range(40):
            text = f"one two three Four{'abcdefgh'[i % 8]} same\x00 same five{'xyz'[i % 3] * (i % 9)} a-very-much-longer{'word' * (i % 5)}"
            flat, _ = small.encode(*bytes_of(pa.array([text, text[::-1]])))
            assert flat.tolist() == [x for t in (text, text[::-1]) for x in LIBRARY.encode(t, add_special_tokens=False).ids]
            assert small.short.used <= most and len(small.short.hashes) == small.short.used and (np.diff(small.short.hashes.astype(object)) > 0).all()


def test_fragments_met_twice_outlive_the_others():
    short, one = bpe.ShortFragments(4), np.ones(1, np.uint64)

    def met(n):
        return short.find(one * np.uint64(n), one * np.uint64(n), one, np.array([3]))[0]

    for n in (1, 2, 3, 4):
        short.add(one * np.uint64(n), one * np.uint64(n), one, np.array([3]), [np.array([n, n], "<u4").tobytes()])
    assert met(2) >= 0 and met(3) >= 0 and met(9) == -1
    assert short.find(one * np.uint64(2), one * np.uint64(7), one, np.array([3]))[0] == -1  # same hash, other bytes
    short.add(one * np.uint64(5), one * np.uint64(5), one, np.array([3]), [np.array([5], "<u4").tobytes()])
    assert [met(n) >= 0 for n in (1, 2, 3, 4, 5)] == [False, True, True, False, True]
    row = short.rows[met(3)]
    assert short.ids[row["begin"] : row["begin"] + row["count"]].tolist() == [3, 3]


def test_table(spark, edge_docs):
    rows = bpe.decode(bpe.encode(edge_docs), text="back").collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        assert r["token_ids"] == LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["back"] == (r["text"] or "")
    assert bpe.encode(edge_docs.limit(0)).count() == 0
    assert bpe.encode(edge_docs, end_id=0).where("doc_id = 0").first()["token_ids"] == [0]


def test_query(spark):
    got = {r["doc_id"]: r for r in bpe.op5_bpe(spark, SMALL).collect()}
    docs = common.table(spark, SMALL, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d["text"] or "", add_special_tokens=False).ids
        assert got[d["doc_id"]][1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())
