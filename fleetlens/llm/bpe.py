"""Byte-level BPE encoding and decoding by forced boundaries.

A pair of neighbouring bytes that occurs inside no token of the vocabulary (added tokens included) can be
joined by no merge, so between the two bytes there is a token boundary in every encoding. Texts are cut at
all such places, by one table lookup a byte; the fragments are encoded independently and the ids
concatenated. Fragments repeat far more than texts do, so each worker keeps those it has met.

The tokenizer's own word splitting looks at its surroundings in two ways, and a cut must hide neither:
white space looks ahead (so there is no cut right after white space, but for a single line break between
other ASCII characters, which is a piece by itself either way), and an apostrophe may begin a contraction (so
there is none right before one). With that, a fragment splits into words alone as it does within its text.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bytesvec import bytes_of, range_hashes, same_ranges, short_ranges

#: Fragments a worker keeps at most, as many short ones (some 50 MB) as others (up to some 150 MB), and the longest of both in bytes
KEPT_FRAGMENTS, SHORT_BYTES, KEPT_BYTES = 600_000, 16, 48

_ENCODERS: dict[str, FragmentEncoder] = {}


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def is_word(text: str) -> bool:
    """Whether it is letters alone, of those scripts of which every Unicode version says so."""
    return text.isalpha() and max(text) < "\u0250"


def pieces(flat: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts`` items of ``flat`` from ``begins`` on, one run after the other."""
    ends = np.cumsum(counts)
    return flat[np.repeat(begins - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


class ShortFragments:
    """Ids of fragments of up to ``SHORT_BYTES`` bytes, found by their hashes and confirmed by their bytes.

    When ``most`` are kept, those that were met only once since the last time go.
    """

    def __init__(self, most: int):
        self.most, self.used, self.used_ids = most, 0, 0
        self.rows = np.zeros(most, [("low", "<u8"), ("high", "<u8"), ("size", "<i8"), ("begin", "<i8"), ("count", "<i8")])
        self.again, self.ids = np.zeros(most, bool), np.zeros(most * SHORT_BYTES, "<u4")
        #: All hashes in order, and the rows of their fragments
        self.hashes, self.row_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray, low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The row of each fragment, -1 for one that is not kept."""
        found = np.full(len(hashes), -1)
        if not self.used:
            return found
        order = np.argsort(hashes)  # neighbours are looked up together
        place = np.minimum(np.searchsorted(self.hashes, hashes[order]), self.used - 1)
        rows = self.row_of[place]
        kept = self.rows[rows]
        same = (self.hashes[place] == hashes[order]) & (kept["low"] == low[order]) & (kept["high"] == high[order]) & (kept["size"] == sizes[order])
        found[order[same]] = rows[same]
        self.again[rows[same]] = True
        return found

    def add(self, hashes: np.ndarray, low: np.ndarray, high: np.ndarray, sizes: np.ndarray, ids: list[bytes]) -> None:
        """Keep fragments that were not found, as far as there is room; of several with one hash, the first."""
        if self.used + len(hashes) > self.most:
            self._make_room()
        new, which = np.unique(hashes, return_index=True)
        place = np.searchsorted(self.hashes, new)
        free = np.ones(len(new), bool) if not self.used else self.hashes[np.minimum(place, self.used - 1)] != new
        new, which, place = (x[free][: self.most - self.used] for x in (new, which, place))
        rows = np.arange(self.used, self.used + len(new))
        self.hashes, self.row_of = np.insert(self.hashes, place, new), np.insert(self.row_of, place, rows)
        flat = np.frombuffer(b"".join([ids[i] for i in which.tolist()]), "<u4")
        counts = np.array([len(ids[i]) // 4 for i in which.tolist()], np.int64)
        for name, values in (("low", low[which]), ("high", high[which]), ("size", sizes[which]), ("begin", self.used_ids + np.cumsum(counts) - counts), ("count", counts)):
            self.rows[name][rows] = values
        self.ids[self.used_ids : self.used_ids + len(flat)] = flat
        self.used, self.used_ids = self.used + len(new), self.used_ids + len(flat)

    def _make_room(self) -> None:
        stay = np.flatnonzero(self.again)
        stay = stay if len(stay) <= self.most // 2 else stay[:0]
        flat, rows, moved = pieces(self.ids, self.rows["begin"][stay], self.rows["count"][stay]), self.rows[stay], np.full(self.most, -1)
        moved[stay] = np.arange(len(stay))
        rows["begin"] = np.cumsum(rows["count"]) - rows["count"]
        self.rows[: len(stay)], self.ids[: len(flat)] = rows, flat
        here = moved[self.row_of] >= 0
        self.hashes, self.row_of = self.hashes[here], moved[self.row_of[here]]
        self.used, self.used_ids = len(stay), len(flat)
        self.again[:] = False


class FragmentEncoder:
    """Encoder and decoder from the JSON text of a byte-level BPE tokenizer of the tokenizers library."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        parsed = json.loads(spec)
        back = {c: b for b, c in byte_alphabet().items()}
        self.token_bytes: dict[int, bytes] = {}
        for token, i in parsed["model"]["vocab"].items():
            self.token_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for added in parsed["added_tokens"]:
            self.token_bytes[added["id"]] = added["content"].encode()
        self.forced = self._forced_pairs()
        #: Last bytes of white space beyond ASCII, and the bytes before them
        self.wide_last, self.wide_before = np.zeros(256, bool), np.zeros(256, bool)
        for c in map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]):
            self.wide_last[c.encode()[-1]] = self.wide_before[c.encode()[-2]] = True
        #: Whether a lone word is one piece, so that merging is all there is to do, and the characters that stand for its bytes
        splits, last = parsed.get("pre_tokenizer") or {}, parsed.get("post_processor") or {"type": "ByteLevel"}
        self.plain = splits.get("type") == last["type"] == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space", True)
        self.plain = self.plain and not parsed.get("normalizer") and not any(is_word(a["content"].strip()) for a in parsed["added_tokens"])
        self.merge = self.tokenizer.model.tokenize
        self.shown = np.array([ord(c) for _, c in sorted(byte_alphabet().items())], "<u4")
        self.short = ShortFragments(KEPT_FRAGMENTS)
        #: Longer ones: what was met lately, and what before that; the older half goes when the newer is full.
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _forced_pairs(self) -> np.ndarray:
        forced = np.ones((256, 256), bool)
        for token in self.token_bytes.values():
            for a, b in zip(token, token[1:]):
                forced[a, b] = False
        space = [*range(0x09, 0x0E), *range(0x1C, 0x21)]
        #: Bytes between which a single line break may stand at the end of a fragment
        self.before_break = np.arange(256) < 0x80
        self.before_break[space] = False
        self.after_break = self.before_break & forced[ord("\n")]
        self.after_break[ord("'")] = False
        forced[space, :] = False
        forced[:, ord("'")] = False
        forced[:, 0x80:0xC0] = False  # never within a character
        return forced.ravel()

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """All places where fragments begin or end, ends of texts included."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            self.forced.take((data[:-1].astype(np.uint16) << 8) | data[1:], out=cut[1:-1], mode="clip")
            wide = np.flatnonzero(self.wide_last[data[1:-1]]) + 1 if data.max() > 0x7F else np.zeros(0, np.int64)
            cut[wide[self.wide_before[data[wide - 1]]] + 1] = False
            breaks = np.flatnonzero(data[1:-1] == ord("\n")) + 1
            cut[breaks[self.before_break[data[breaks - 1]] & self.after_break[data[breaks + 1]]] + 1] = True
        cut[offsets] = True
        return np.flatnonzero(cut)

    def encode_fragments(self, fragments: list[bytes]) -> dict[bytes, bytes]:
        """Fragments of one word each have their bytes merged by the library's model; any other goes through all its steps."""
        out: dict[bytes, bytes] = {}
        words = []
        for fragment in fragments:
            word = fragment[1:] if fragment[:1] == b" " else fragment
            if self.plain and (word.isalpha() or is_word(word.decode())):
                words.append(fragment)
            else:
                out[fragment] = np.array(self.tokenizer.encode(fragment.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if words:
            shown = self.shown[np.frombuffer(b"\n".join(words), np.uint8)].tobytes().decode("utf-32-le").split(chr(self.shown[ord("\n")]))
            ids, ends = [], [0]
            for word in shown:
                ids += [token.id for token in self.merge(word)]
                ends.append(4 * len(ids))
            flat = np.array(ids, "<u4").tobytes()
            out.update(zip(words, [flat[a:b] for a, b in zip(ends, ends[1:])]))
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin."""
        at = self.cuts(data, offsets)
        starts, sizes = at[:-1], np.diff(at)
        hashes = range_hashes(data, starts, at[1:])
        coded = pa.array(hashes).dictionary_encode()
        which, first = coded.indices.to_numpy().astype(np.int64), np.zeros(len(coded.dictionary), np.int64)
        first[which] = np.arange(len(which))  # any of the fragments with the hash
        # Fragments of one hash share ids only if their bytes are equal; any other is encoded by itself
        other = np.flatnonzero((sizes[first][which] != sizes) | ~same_ranges(data, starts, starts[first][which], sizes))
        which[other] = len(first) + np.arange(len(other))
        first = np.append(first, other)
        flat, counts = self._ids_of_distinct(data, starts[first], sizes[first], hashes[first])
        each = counts[which]
        ends = np.concatenate([[0], np.cumsum(each)])
        return pieces(flat, (np.cumsum(counts) - counts)[which], each), ends[np.searchsorted(at, offsets)]

    def _ids_of_distinct(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all fragments in a row, and how many each has."""
        low, high = short_ranges(data, starts, sizes)
        row = self.short.find(hashes, low, high, np.where(sizes <= SHORT_BYTES, sizes, -1))
        met, new, longer = row >= 0, np.flatnonzero((row < 0) & (sizes <= SHORT_BYTES)), np.flatnonzero(sizes > SHORT_BYTES)
        raw, ends = data.tobytes(), starts + sizes
        fragments = [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())]
        encoded = self.encode_fragments(fragments)
        ids = [encoded[f] for f in fragments]
        found = ids + self._ids_of([raw[a:b] for a, b in zip(starts[longer].tolist(), ends[longer].tolist())])
        # Ids of what was met, then of what was not; put in the order of the fragments
        kept = self.short.rows[row[met]]
        flat = np.concatenate([pieces(self.short.ids, kept["begin"], kept["count"]), np.frombuffer(b"".join(found), "<u4")])
        counts, order = np.concatenate([kept["count"], np.array([len(x) // 4 for x in found], np.int64)]), np.concatenate([np.flatnonzero(met), new, longer])
        begins, sized = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        begins[order], sized[order] = np.cumsum(counts) - counts, counts
        self.short.add(hashes[new], low[new], high[new], sizes[new], ids)
        return pieces(flat, begins, sized), sized

    def _ids_of(self, fragments: list[bytes]) -> list[bytes]:
        found = list(map(self.kept.get, fragments))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            known = self.older
            new = self.encode_fragments([f for i in missing if (f := fragments[i]) not in known])
            if len(self.kept) > KEPT_FRAGMENTS // 2:
                self.older, self.kept = self.kept, {}
            for i in missing:
                fragment = fragments[i]
                found[i] = ids = new[fragment] if fragment in new else known[fragment]
                if len(fragment) <= KEPT_BYTES:
                    self.kept[fragment] = ids
        return found

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.token_bytes.get(i, b"") for i in ids]).decode("utf-8", "replace")


def encoder_of(spec: str) -> FragmentEncoder:
    """The encoder of this worker, kept from task to task."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = FragmentEncoder(spec)
    return _ENCODERS[key]


def encode(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "token_ids", end_id: int | None = None, drop: tuple[str, ...] = (), decoded: str | None = None) -> DataFrame:
    """Add ``ids`` (array of int): each whole text as the tokenizers library encodes it, without special tokens.

    ``path``: a byte-level tokenizer's JSON file, read on the driver. A null or empty text has no ids;
    ``end_id``, if given, is appended to every text's. Every row is encoded by itself, so ties and repeated
    rows stay as they are; columns already named as the new ones are replaced; an empty table stays empty. A worker
    holds about a megabyte of texts at a time; a longer text is encoded by itself, in some 25 bytes of memory a byte.

    ``decoded``: add a column of this name with what the ids stand for, as ``decode`` does, in the same pass.
    """
    spec = df.sparkSession.sparkContext.broadcast(common.file_text(path or common.tokenizer_path()))

    def make():
        encoder = encoder_of(spec.value)

        def compute(texts: pa.Array) -> list[pa.Array]:
            flat, starts = encoder.encode(*bytes_of(texts))
            if end_id is not None:
                flat = np.insert(flat, starts[1:], end_id)
                starts = starts + np.arange(len(starts))
            out = [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat.astype(np.int32)))]
            if decoded:
                out.append(pa.array([encoder.decode(flat[a:b].tolist()) for a, b in zip(starts.tolist(), starts[1:].tolist())], pa.string()))
            return out

        return compute

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    return common.with_batch_columns(df, text, fields, make, drop)


def decode(df: DataFrame, path: str | None = None, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Add ``text``: what the ids stand for, bytes that are no UTF-8 replaced as the library does.

    Null ids give an empty text, ids outside the vocabulary give nothing; special tokens are kept.
    A column already named ``text`` is replaced.
    """
    spec = df.sparkSession.sparkContext.broadcast(common.file_text(path or common.tokenizer_path()))

    def make():
        encoder = encoder_of(spec.value)

        def compute(lists: pa.Array) -> list[pa.Array]:
            return [pa.array([encoder.decode(x) if x else "" for x in lists.to_pylist()], pa.string())]

        return compute

    return common.with_batch_columns(df, ids, [T.StructField(text, T.StringType())], make)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", common.text_or_empty().alias("text"))
    both = encode(docs, drop=("text",), decoded="decoded")
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
