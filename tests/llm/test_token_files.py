import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from granary.llm import queries, token_files


def plain(ids, sep):
    out, n = [], 0
    for x in ids:
        if x == sep:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + [(n, False)] * (n > 0)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    enc = token_files.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {r.doc_id: len(enc.encode_ordinary(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op9_token_counts(spark, d).collect()
    assert len(rows) == len(want) and {r.doc_id: r.n_tokens for r in rows} == want


def test_blocks_cut_anywhere(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(token_files, "GROUP", 5)
    shards = {s: [9 if rng.random() < p else rng.randrange(8) for _ in range(500)] for s, p in enumerate((0.0, 0.01, 0.3, 1.0))}
    for size in (2, 14, 64, 4096):
        for s, ids in shards.items():
            np.array(ids, "<u2").tofile(tmp_path / f"{s}.bin")
        blocks = token_files.read_files(spark, f"{tmp_path}/*.bin", size)
        if size == 14:  # one file's ranges in many tasks
            assert blocks.filter("shard like '%2.bin'").select(F.spark_partition_id()).distinct().count() > 1
        got = {}
        for r in token_files.counts(blocks, 9).collect():
            got.setdefault(int(r.shard[-5]), []).append((r.ordinal, r.n_tokens, r.closed))
        assert {s: [x[1:] for x in sorted(v)] for s, v in got.items()} == {s: plain(ids, 9) for s, ids in shards.items()}
        assert all([x[0] for x in sorted(v)] == list(range(len(v))) for v in got.values())


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 20000), (3, "word"), (4, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    blocks, owners = token_files.tokenised(df, path, pattern, 50256, block=1024)
    got = sorted((r.doc_id, r.n_tokens) for r in owners.join(token_files.counts(blocks, 50256), ["shard", "ordinal"]).collect())
    enc = token_files.encoding(path, pattern)
    assert got == sorted((k, len(enc.encode_ordinary(t or ""))) for k, t in rows)
    blocks, owners = token_files.tokenised(df.filter("false"), path, pattern, 50256)
    assert token_files.counts(blocks, 50256).count() == owners.count() == 0
