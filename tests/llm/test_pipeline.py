"""Every stage against a plain version on its own input."""

import hashlib
import math

import public_tokenizers
from tokenizers import Tokenizer as Library

import __spark_entry__ as entry
import corpus_pipeline
from granary.llm import pii, toxicity
from granary.llm.common import saved
from test_pii import plain as plain_pii
from test_near_copies import kept

SF = "/root/testdata/sf0.001"


def redacted(text, spans):
    out, at = "", 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += text[at:s] + f"<{k.upper()}>"
        at = max(at, e)
    return out + text[at:]


def draws(docs):
    size = {}
    for d in docs:
        size[d.source] = size.get(d.source, 0) + len(d.text.encode())
    weight = {s: corpus_pipeline.WEIGHTS.get(s, corpus_pipeline.REST) for s in size}
    out = []
    for d in docs:
        rate = weight[d.source] / sum(weight.values()) * sum(size.values()) / size[d.source]
        assert rate <= 16
        u = (int(hashlib.md5(f"42:{d.doc_id}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, term = 0, math.exp(-rate)
        total = term
        while u >= total:
            n += 1
            term *= rate / n
            total += term
        out += [d.doc_id] * n
    return sorted(out)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        df = saved(stage(spark, docs, SF))
        rows = df.collect()
        if name != "bpe":
            assert df.columns == columns and df.dtypes == docs.dtypes
        if name == "toxicity":
            assert {r.doc_id for r in rows} == {r.doc_id for r in before if model.score(r.text) < 0.5}
        elif name == "simhash_near_dedup":
            assert {r.doc_id for r in rows} == kept({r.doc_id: r.text for r in before})
        elif name == "pii":
            spans = {r.doc_id: [(x.kind, x.start, x.end) for x in r.pii] for r in pii.find_pii(docs).collect()}
            assert all(set(plain_pii(r.text)) <= set(spans[r.doc_id]) for r in before)
            assert {r.doc_id: r.text for r in rows} == {r.doc_id: redacted(r.text, spans[r.doc_id]) for r in before}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "mixing":
            assert sorted(r.doc_id for r in rows) == draws(before)
        else:
            lib = Library.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = {r.doc_id: lib.encode(r.text, add_special_tokens=False).ids for r in before}
            assert len(rows) == len(before)
            for r in rows:
                assert r.token_ids == want[r.doc_id] and r.n_tokens == len(want[r.doc_id])
                assert r.decoded_sha256 == hashlib.sha256(lib.decode(want[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
        docs, before = df, rows
    final = sorted((r.doc_id, r.n_tokens) for r in entry.queries()["pipeline"](spark, SF).collect())
    assert final == sorted((r.doc_id, r.n_tokens) for r in before)


def test_every_stage_on_hard_rows(spark):
    long = "mail a@b.co now and read on about the river and the town " * 3000
    text = "one two three four five six seven eight nine ten"
    rows = [(1, None, None, None, None), (2, "", "en", "src0", 0), (3, text, "en", "src0", 1), (3, text, "en", "src0", 1), (3, "quite another text", "en", None, 1), (None, text, "de", "src1", 1), (None, None, None, None, None), (5, text.upper(), "en", "src9", 1), (6, long, "en", "src1", 1)]
    clash = ["_dropped", "_set", "_hash", "_rate", "_source", "_pii", "_email", "_toxicity", "component_id", "key", "id", "rate"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'{c}' AS {c}" for c in clash])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0
        out = stage(spark, docs, SF)
        got = out.collect()
        if name == "bpe":
            assert len(got) == len(rows) and sorted(r.n_tokens for r in got)[:3] == [0, 0, 0]
            continue
        assert out.columns == docs.columns and all(r[c] == c for r in got for c in clash)
        ids = [r.doc_id for r in got]
        if name == "toxicity":
            assert len(got) == len(rows)
        elif name == "simhash_near_dedup":
            # Empty texts are one class, as are the copies; rows with a null id stay, as does the text that is alone.
            assert sorted((i for i in ids if i), key=int) == [1, 3, 3, 3, 6] and ids.count(None) == 2
        elif name == "pii":
            assert len(got) == len(rows) and all((r.n_chars is None) == (r.text is None) for r in got)
            assert next(r.text for r in got if r.doc_id == 6) == long.replace("a@b.co", "<EMAIL>")
        else:
            assert set(ids) <= {r[0] for r in rows} and ids.count(3) >= 0


def test_work_tables_go(spark):
    from granary.llm import common

    before = list(common._written)
    spark.catalog.clearCache()
    out = corpus_pipeline.run(spark, SF)
    assert len(common._written) - len(before) == len(corpus_pipeline.STAGES) - 1 and out.count() > 0
