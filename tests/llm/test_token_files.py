import glob
import itertools
import zlib

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from fleetlens.llm import common, token_files
from .conftest import EDGES, SMALL

LIBRARY = Tokenizer.from_file(common.tokenizer_path())


def test_query(spark):
    docs = sorted(common.table(spark, SMALL, "documents").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in token_files.op9_token_files(spark, SMALL).collect()}
    start = 0
    for i, text in docs:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        assert got[i][1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_files_edges_and_order(spark, edge_docs, tmp_path):
    folder = f"file://{tmp_path}/out"
    token_files.write_token_files(edge_docs.unionByName(edge_docs.limit(2)), folder, files=3)
    parts = sorted(glob.glob(f"{tmp_path}/out/part-*"))
    ids = list(itertools.chain(*(pq.read_table(p, columns=["doc_id"])["doc_id"].to_pylist() for p in parts)))
    assert ids == sorted([*range(len(EDGES)), 0, 1])
    column = pq.ParquetFile(parts[0]).metadata.row_group(0).column(2)
    assert "list" in column.path_in_schema and any("DICTIONARY" in e for e in column.encodings) and column.has_offset_index
    rows = token_files.with_starts(token_files.read_lengths(spark, folder)).orderBy("file", "row").collect()
    assert [r["start"] for r in rows] == list(itertools.accumulate([r["n_tokens"] for r in rows], initial=0))[:-1]
    token_files.write_token_files(edge_docs.limit(0), f"{folder}-none", files=2)
    assert token_files.with_starts(token_files.read_lengths(spark, f"{folder}-none")).count() == 0


def test_selective_reads(spark, tmp_path):
    docs = common.table(spark, SMALL.replace("sf0.001", "sf0.01"), "documents")
    folder = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, folder, files=3)
    parts = sorted((tmp_path / "tokens").glob("*.parquet"))
    ranges = []
    for part in parts:
        group = pq.ParquetFile(part).metadata.row_group(0)
        by_name = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        ids, tokens = by_name["doc_id"], next(c for n, c in by_name.items() if n.startswith("token_ids"))
        assert ids.has_column_index and ids.has_offset_index and tokens.has_offset_index and "RLE_DICTIONARY" in tokens.encodings
        ranges.append((ids.statistics.min, ids.statistics.max))
    assert len(parts) == 3 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    low, high = ranges[1][0], ranges[1][0] + 20
    some = token_files.read_tokens(spark, folder, low, high)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(doc_id,{low})" in plan and f"LessThanOrEqual(doc_id,{high})" in plan
    every = {r["doc_id"]: r["token_ids"] for r in spark.read.parquet(folder).collect()}
    assert {r["doc_id"]: r["token_ids"] for r in some.collect()} == {i: t for i, t in every.items() if low <= i <= high}
    lengths = token_files.read_lengths(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "token_ids" not in lengths.split("ReadSchema")[-1]


def test_files_grow_with_the_texts(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 30, "x") for i in range(400)] + [(None, None, "x"), (7, "", "x")], "doc_id long, text string, n_tokens string")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert token_files.file_count(docs) == token_files.file_count(docs.limit(0)) == least
    monkeypatch.setattr(token_files, "FILE_BYTES", 5000)
    wanted = -(-sum(len(r["text"] or "") for r in docs.collect()) // 5000)
    assert token_files.file_count(docs) == wanted > least
    token_files.write_token_files(docs, str(tmp_path / "ids"))
    lengths = token_files.read_lengths(spark, str(tmp_path / "ids"))
    assert lengths.select("file").distinct().count() > least
    rows = token_files.with_starts(lengths).orderBy("file", "row").collect()
    assert len(rows) == 402 and [r["doc_id"] for r in rows] == [None] + sorted([*range(400), 7])
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
