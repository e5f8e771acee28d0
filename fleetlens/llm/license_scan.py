r"""License scans with positional indexes of rare words, in DataFrame functions alone.

How many documents hold each word of the licence texts is counted over the whole corpus. Two indexes map
words to places in licence texts:

- of each key phrase the two rarest words (highest inverse document frequency): every posting says where the
  phrase would have to begin, and only beginnings on which both agree are candidates. A candidate counts once all words of
  the phrase stand there. No place is lost: a phrase that stands somewhere brings both rare words.
- of each licence notice its sixteen rarest words, wherever they stand in it. A file looks up its own rarest of
  these words; every posting says where the notice would have to begin, and beginnings on which three places agree are
  candidates. A candidate counts once the licence's mandatory key phrase stands about where that beginning puts it, so notices
  are found with words added, left out or changed. A mandatory phrase of six words or more may have one word changed; a shorter one is a
  licence's name, and a changed word makes it another licence's.

A licence's label comes from its notice; where a licence has no notice here, its name is the whole template and gives the label. A
mandatory phrase that stands outside its notice is a mention, with a low score and no label.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Phrases of public licence texts. The first of each list is mandatory, the others raise the score.
KEY_PHRASES = {
    "mit": ["permission is hereby granted free of charge", "without warranty of any kind", "to deal in the software without restriction"],
    "apache-2": ["licensed under the apache license", "you may not use this file except in compliance with the license", "without warranties or conditions of any kind"],
    "gpl": ["gnu general public license", "free software foundation", "either version 2 of the license"],
    "lgpl": ["gnu lesser general public license", "free software foundation"],
    "agpl": ["gnu affero general public license", "free software foundation"],
    "bsd": ["redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"],
    "mpl-2": ["mozilla public license", "a copy of the mpl was not distributed with this file"],
    "isc": ["permission to use copy modify and or distribute this software", "the software is provided as is"],
    "unlicense": ["free and unencumbered software released into the public domain"],
    "cc-by": ["creative commons attribution"],
    "cc0": ["cc0 1 0 universal"],
    "epl": ["eclipse public license"],
}
#: The notices of public licences, as words. A licence's mandatory key phrase stands in its notice.
_GNU = (
    "this program is free software you can redistribute it and or modify it under the terms of the {} as published by the free software foundation either version 2 of the license "
    "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
    "merchantability or fitness for a particular purpose see the {} for more details"
)
NOTICES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom "
        "the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness "
        "for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of "
        "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www "
        "apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
        "warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
    ),
    "gpl": _GNU.format(*["gnu general public license"] * 2),
    "lgpl": _GNU.format(*["gnu lesser general public license"] * 2),
    "agpl": _GNU.format(*["gnu affero general public license"] * 2),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must "
        "retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of "
        "conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness"
    ),
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code "
        "form or as a compiled binary for any purpose commercial or non commercial and by any means"
    ),
}
PHRASES = [(words.split(), label, "base") for words, label in BASE.items()] + [(p.split(), label, "support" if i else "key") for label, ps in KEY_PHRASES.items() for i, p in enumerate(ps)]
#: Words of a notice that are indexed, of how many letters; words that a file looks up; places that have to agree; words by which a key phrase may be off
NOTICE_WORDS, LEAST_LETTERS, FILE_WORDS, VOTES, DRIFT = 16, 6, 32, 3, 20
#: Of each notice: label, words, number of its mandatory phrase, and where that stands in it
TEMPLATES = []
for _label, _text in NOTICES.items():
    _key = next(n for n, (_, label, kind) in enumerate(PHRASES) if label == _label and kind == "key")
    _words, _phrase = _text.split(), PHRASES[_key][0]
    TEMPLATES.append((_label, _words, _key, next(i for i in range(len(_words)) if _words[i : i + len(_phrase)] == _phrase)))
#: Words from which a mandatory phrase may have one changed, and the scores of a mention and of a licence known by its name alone
SLIP_WORDS, MENTION_SCORE, NAME_SCORE = 6, 0.25, 0.5
#: Licences without a notice: their name is all of their template
NAMES = sorted({label for _, label, kind in PHRASES if kind == "key"} - set(NOTICES))
VOCABULARY = sorted({w for words, _, _ in PHRASES for w in words} | {w for _, words, _, _ in TEMPLATES for w in words if len(w) >= LEAST_LETTERS})
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What is no part of a word, before A-Z are lower-cased
GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_PLACE = 1 << 40


def _word_pattern(words: list[str]) -> str:
    return f"(?i)(?<![^{GAP}])(?:{'|'.join(words)})(?![^{GAP}])"


def lowered(text: Column) -> Column:
    return F.translate(text, ALPHABET, ALPHABET.lower())


def word_frequencies(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each word of the licence vocabulary, over all documents."""
    met = F.regexp_extract_all(common.text_or_empty(), F.lit(_word_pattern(VOCABULARY)), F.lit(0))
    counted = docs.select(F.explode(F.array_distinct(F.transform(met, lowered))).alias("word")).groupBy("word").count()
    total = docs.count()
    known = {r["word"]: r["count"] for r in counted.collect()}  # at most the vocabulary
    return {w: math.log((1 + total) / (1 + known.get(w, 0))) for w in VOCABULARY}


def rare_index(idf: dict[str, float]) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """The index of the rarest word of each phrase, and that of the second rarest: word -> [(phrase, position)]."""
    indexes: tuple[dict, dict] = ({}, {})
    for number, (words, _, _) in enumerate(PHRASES):
        order = sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))
        for index, position in zip(indexes, order[:2]):
            index.setdefault(words[position], []).append((number, position))
    return indexes


def notice_places() -> list[tuple[int, int, str]]:
    """(template, position, word) of all words that may be indexed: long ones, outside the mandatory phrase."""
    within = lambda i, key, offset: offset <= i < offset + len(PHRASES[key][0])
    return [(t, i, w) for t, (_, words, key, offset) in enumerate(TEMPLATES) for i, w in enumerate(words) if len(w) >= LEAST_LETTERS and not within(i, key, offset)]


def notice_index(idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """The index of the notices' rarest words, rarest first: word -> [(template, position)], all positions."""
    index: dict[str, list[tuple[int, int]]] = {}
    for number in range(len(TEMPLATES)):
        places = [(i, w) for t, i, w in notice_places() if t == number]
        first = {w: i for i, w in reversed(places)}
        for word in sorted(first, key=lambda w: (-idf[w], first[w]))[:NOTICE_WORDS]:
            index.setdefault(word, []).extend((number, i) for i, w in places if w == word)
    return dict(sorted(index.items(), key=lambda x: (-idf[x[0]], x[0])))


def least_equal(key: int) -> int:
    """How many words of a mandatory phrase have to stand in their place."""
    size = len(PHRASES[key][0])
    return size - 1 if size >= SLIP_WORDS else size


def _postings(index: dict[str, list[tuple[int, int]]]) -> Column:
    """A map literal from word to numbers phrase * 2**40 - position, to which a place is added."""
    entries = [x for word, at in sorted(index.items()) for x in (F.lit(word), F.array(*(F.lit((n + 1) * _PLACE - p) for n, p in at)))]
    return F.create_map(*entries)


def scan_licenses(docs: DataFrame, idf: dict[str, float] | None = None, text: str = "text") -> DataFrame:
    """Add n_words, places (array of struct phrase, start; word positions from 0), n_base, first_word, last_word, base_labels, labels, score, notices, mentions.

    Words are runs of digits, letters and characters beyond ASCII of the whole text, A-Z lower-cased. Places
    are all places of all phrases. A base phrase gives its label with score 1; a licence's notice gives its label with a
    score from 0.5 (none of the licence's other phrases is there) to 1 (all are); the name of a licence that has no notice here
    gives its label with score 0.5. ``notices`` are the labels of the notices found, ``mentions`` those of all mandatory phrases that stand anywhere,
    word by word; one without its notice has score 0.25 and no label. ``score`` is the largest, 0 if there is none. A null
    or empty text has no words and empty labels. Every row is scanned by itself; columns with the names of the
    result are replaced; an empty table stays empty.
    """
    idf = idf or word_frequencies(docs.select(F.col(text).alias("text")))
    first, second = rare_index(idf)
    names = ["n_words", "places", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices", "mentions", "_places", "_starts"]
    kept = common.drop_clashing(docs, [n for n in names if n.lower() != text.lower()])
    value = common.text_or_empty(text)
    words = F.filter(F.split(lowered(value), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")

    def starts(index: dict) -> Column:
        table = _postings(index)
        placed = F.filter(F.transform(F.col("_words"), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*index))
        return F.flatten(F.transform(placed, lambda x: F.transform(F.element_at(table, x["w"]), lambda p: p + x["i"])))

    wanted = F.array(*(F.array(*map(F.lit, ws)) for ws, _, _ in PHRASES))

    def stands(at: Column) -> Column:
        number, place = _number(at), _start(at)
        phrase = F.element_at(wanted, number)
        return (place >= 0) & (F.slice(F.col("_words"), F.greatest(place + 1, F.lit(1)).cast("int"), F.size(phrase)) == phrase)

    # A phrase stands only with its rarest word; one with a changed word keeps one of its two rarest
    slipping = {word for word, at in second.items() if any(least_equal(n) < len(PHRASES[n][0]) and PHRASES[n][2] == "key" for n, _ in at)}
    may_hold = F.rlike(value, F.lit(_word_pattern(sorted(first.keys() | slipping))))
    nothing = F.array().cast("array<bigint>")
    found = kept.select("*", F.coalesce(F.regexp_count(value, F.lit(f"[^{GAP}]+")), F.lit(0)).cast("long").alias("n_words"), F.when(may_hold, words).otherwise(F.array().cast("array<string>")).alias("_words"))
    has_words = F.size("_words") > 0
    found = found.withColumns(
        {
            "_places": F.when(has_words, F.array_sort(F.filter(F.array_intersect(starts(first), starts(second)), stands))).otherwise(nothing),
            "_starts": F.when(has_words, _notice_starts(notice_index(idf))).otherwise(nothing),
        }
    )
    return with_labels(found.withColumn("_starts", F.transform(F.filter("_starts", _verified), _number)).drop("_words"))


def _notice_starts(index: dict[str, list[tuple[int, int]]]) -> Column:
    """Where notices would begin by ``VOTES`` places or more of the file's ``FILE_WORDS`` rarest indexed words."""
    table = _postings(index)
    known = F.filter(F.transform(F.col("_words"), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*index))

    def votes(placed: Column) -> Column:
        present = F.array_distinct(F.transform(placed, lambda x: x["w"]))
        rarest = lambda met: F.slice(F.filter(F.array(*map(F.lit, index)), lambda w: F.array_contains(met, w)), 1, FILE_WORDS)
        starts = lambda own: F.flatten(F.transform(F.filter(placed, lambda x: F.array_contains(own, x["w"])), lambda x: F.transform(F.element_at(table, x["w"]), lambda p: p + x["i"])))
        agreed = lambda s: F.array_distinct(F.filter(s, lambda at, i: at == F.get(s, i + VOTES - 1)))
        return common.let(common.let(present, rarest), lambda own: common.let(F.array_sort(starts(own)), agreed))

    return common.let(known, votes)


def _verified(at: Column) -> Column:
    """Whether a notice's mandatory phrase stands within ``DRIFT`` words of where its beginning puts it."""
    phrases = F.array(*(F.array(*map(F.lit, PHRASES[key][0])) for _, _, key, _ in TEMPLATES))
    offsets, least = (F.array(*map(F.lit, values)) for values in zip(*((offset, least_equal(key)) for _, _, key, offset in TEMPLATES)))
    number, phrase = _number(at), F.element_at(phrases, _number(at))

    def stands(shift: Column) -> Column:
        begin = _start(at) + F.element_at(offsets, number) + shift
        words = F.slice(F.col("_words"), F.greatest(begin + 1, F.lit(1)).cast("int"), F.size(phrase))
        return (begin >= 0) & (F.size(F.filter(F.zip_with(words, phrase, lambda a, b: a == b), lambda same: same)) >= F.element_at(least, number))

    return F.exists(F.array(*map(F.lit, range(-DRIFT, DRIFT + 1))), stands)


def _number(at: Column) -> Column:
    """The phrase, from 1; a place before the text's beginning still has its own phrase's number."""
    return F.floor((at + 1000) / _PLACE).cast("int")


def _start(at: Column) -> Column:
    return at - _number(at).cast("long") * _PLACE


def with_labels(found: DataFrame) -> DataFrame:
    place = F.transform("_places", lambda at: F.struct((_number(at) - 1).alias("phrase"), _start(at).alias("start")))
    found = found.withColumn("places", place).drop("_places")
    base = F.transform(F.filter("places", lambda p: p["phrase"] < len(BASE)), lambda p: p["start"])
    has = lambda n: F.exists("places", lambda p: p["phrase"] == n)
    noticed = {label: F.array_contains("_starts", n + 1) for n, (label, _, _, _) in enumerate(TEMPLATES)}
    labels, mentions, scores = {}, {}, [F.lit(0.0)]
    for label in sorted({x[1] for x in PHRASES}):
        by = {kind: [n for n, x in enumerate(PHRASES) if x[1:] == (label, kind)] for kind in ("base", "key", "support")}
        for n in by["base"]:
            labels.setdefault(label, []).append(has(n))
            scores.append(F.when(has(n), 1.0))
        for n in by["key"]:
            mentions[label] = has(n)
            labels.setdefault(label, []).append(noticed.get(label, has(n)))
            scores.append(F.when(has(n), NAME_SCORE if label in NAMES else MENTION_SCORE))
        if label in noticed:
            more = sum((has(m).cast("double") for m in by["support"]), F.lit(0.0)) / len(by["support"]) if by["support"] else F.lit(1.0)
            scores.append(F.when(noticed[label], 0.5 + 0.5 * more))
    either = lambda tests: tests[0] if len(tests) == 1 else tests[0] | tests[1]
    joined = lambda named: F.concat_ws(",", *(F.when(test, label) for label, test in sorted(named.items())))
    base_tests = {label: has(n) for n, (_, label, kind) in enumerate(PHRASES) if kind == "base"}
    return found.select(
        "*",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).alias("first_word"),
        F.array_max(base).alias("last_word"),
        joined(base_tests).alias("base_labels"),
        joined({label: either(tests) for label, tests in labels.items()}).alias("labels"),
        F.greatest(*scores).alias("score"),
        joined(noticed).alias("notices"),
        joined(mentions).alias("mentions"),
    ).drop("_starts")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document with its licence phrases and labels."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).drop("text", "places")


def oracle() -> str:
    """The same in SQL: every phrase sought at every word."""
    places = []
    for n, (words, _, _) in enumerate(PHRASES):
        test = " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(words))
        places.append(f"list_filter(range(len(w)), lambda i: {test}) AS p{n}")
    found, mentioned, scores = {}, {}, ["0.0"]
    score = lambda test, value: scores.append(f"CASE WHEN {test} THEN {value} ELSE 0.0 END")
    for n, (_, label, kind) in enumerate(PHRASES):
        if kind == "base":
            found.setdefault(label, []).append(f"len(p{n}) > 0")
            score(f"len(p{n}) > 0", 1.0)
        elif kind == "key":
            mentioned[label] = f"len(p{n}) > 0"
            found.setdefault(label, []).append(mentioned[label] if label in NAMES else f"coalesce(list_contains(noticed, '{label}'), false)")
            score(mentioned[label], NAME_SCORE if label in NAMES else MENTION_SCORE)
            more = [m for m, x in enumerate(PHRASES) if x[1:] == (label, "support")]
            share = "(" + " + ".join(f"CASE WHEN len(p{m}) > 0 THEN 1.0 ELSE 0.0 END" for m in more) + f") / {len(more)}" if more else "1.0"
            score(f"list_contains(noticed, '{label}')", f"0.5 + 0.5 * {share}")
    base = [n for n, x in enumerate(PHRASES) if x[2] == "base"]
    base_all = " || ".join(f"p{n}" for n in base)
    base_labels = ", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{PHRASES[n][1]}' END" for n in sorted(base, key=lambda n: PHRASES[n][1]))
    labels = ", ".join(f"CASE WHEN {' OR '.join(tests)} THEN '{label}' END" for label, tests in sorted(found.items()))
    literal = lambda rows: ", ".join(str(x).replace('"', "'") for x in rows)
    candidates = literal(notice_places())
    keys = literal((t, label, offset, PHRASES[key][0], least_equal(key)) for t, (label, _, key, offset) in enumerate(TEMPLATES))
    mentions = ", ".join(f"CASE WHEN {test} THEN '{label}' END" for label, test in sorted(mentioned.items()))
    equal = "len(list_filter(range(1, len(phrase) + 1), lambda k: w[v.start + off + shift + k] = phrase[k]))"
    return f"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{ALPHABET}', '{ALPHABET.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), placed AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, {', '.join(places)} FROM split),
notice_words(t, pos, word) AS (VALUES {candidates}), notice_keys(t, label, off, phrase, least) AS (VALUES {keys}),
frequency AS (SELECT word, count(d.doc_id) AS n FROM (SELECT DISTINCT word FROM notice_words) LEFT JOIN (SELECT doc_id, unnest(list_distinct(w)) AS word FROM split) d USING (word) GROUP BY word),
firsts AS (SELECT t, word, n, row_number() OVER (PARTITION BY t ORDER BY n, min(pos)) AS r FROM notice_words JOIN frequency USING (word) GROUP BY t, word, n),
indexed AS (SELECT i.t, i.pos, i.word, f.n FROM notice_words i JOIN firsts f ON f.t = i.t AND f.word = i.word WHERE f.r <= {NOTICE_WORDS}),
met AS (SELECT doc_id, word, i FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM split WHERE len(list_intersect(w, (SELECT list(DISTINCT word) FROM indexed))) > 0) WHERE word IN (SELECT word FROM indexed)),
own AS (SELECT doc_id, word FROM (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY n, word) AS r FROM (SELECT DISTINCT doc_id, word, n FROM met JOIN (SELECT DISTINCT word, n FROM indexed) USING (word))) WHERE r <= {FILE_WORDS}),
voted AS (SELECT m.doc_id, x.t, m.i - x.pos AS start FROM met m JOIN own o ON o.doc_id = m.doc_id AND o.word = m.word JOIN indexed x ON x.word = m.word GROUP BY ALL HAVING count(*) >= {VOTES}),
noticed AS (SELECT doc_id, list_sort(list(DISTINCT label)) AS noticed FROM voted v JOIN notice_keys USING (t) JOIN split USING (doc_id)
  WHERE len(list_filter(range(-{DRIFT}, {DRIFT} + 1), lambda shift: v.start + off + shift >= 0 AND {equal} >= least)) > 0 GROUP BY doc_id)
SELECT p.doc_id, n_words, CAST(len({base_all}) AS BIGINT) AS n_base, list_min({base_all}) AS first_word, list_max({base_all}) AS last_word,
  concat_ws(',', {base_labels}) AS base_labels, concat_ws(',', {labels}) AS labels, CAST(greatest({', '.join(scores)}) AS DOUBLE) AS score, coalesce(array_to_string(noticed, ','), '') AS notices,
  concat_ws(',', {mentions}) AS mentions
FROM placed p LEFT JOIN noticed q ON q.doc_id = p.doc_id
"""
