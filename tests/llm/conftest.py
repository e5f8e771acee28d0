import pytest

SMALL = "/root/testdata/sf0.001"

#: Texts at the edges: null, empty, white space alone, no cut at all, special tokens, wide white space, repeated rows.
EDGES = [
    None, "", " ", "\n\n", "a", "Word", "don't 'stop'  it's  ", "tab\tand\x0bfeed\x0c", "x" * 3000, "ab " * 4000,
    "<|endoftext|> in <|endoftext|>'s", "wide space　here now", "é́ß 日本語 \U0001f600", "\x00\x00 \x1c", "same", "same",
    "one two three four\n" * 9, "MIT", "  lead", "trail  ", "§'s '' ''s",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", None, "taken") for i, t in enumerate(EDGES)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, token_ids string")
