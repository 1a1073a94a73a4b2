"""Against every window of every text, and the merge against sorted()."""

import hashlib
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import queries, suffix_merge
from granary.llm import substring_dedup as D


def plain(texts, length):
    data = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(d[s : s + length] for d in data.values() for s in range(len(d) - length + 1))
    out = {}
    for i, d in data.items():
        drop = [False] * len(d)
        last = -1
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                for k in range(max(s, last), s + length):
                    drop[k] = True
                last = s + length
        spans = sum(x and not y for x, y in zip(drop, [False, *drop[:-1]], strict=True)) if d else 0
        out[i] = len(d), sum(drop), spans, hashlib.sha256(bytes(c for c, x in zip(d, drop, strict=True) if not x)).hexdigest()
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert result(queries.op3_suffix_dedup(spark, d)) == plain(texts, 200)


def test_hard_texts(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda n, alphabet="abcdefgh é": "".join(rng.choice(alphabet) for _ in range(n))
    shared = word(90)
    texts = {0: None, 1: "", 2: "short", 3: "a" * 500, 4: "ab" * 300, 5: word(30) * 8, 6: shared, 7: shared, 8: word(3000)}
    for i in range(9, 60):
        k = rng.randrange(60)
        texts[i] = word(rng.randrange(80)) + shared[k : k + rng.randrange(15, 90)] + word(rng.randrange(80)) + texts[8][k * 7 : k * 7 + rng.randrange(60)]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as doc", "2 as anchor")
    for hot, piece in ((12_000, 1 << 17), (1, 1 << 17), (4, 64)):
        monkeypatch.setattr(D, "HOT", hot)
        monkeypatch.setattr(D, "PIECE", piece)
        monkeypatch.setattr(D, "RUN", 40)
        monkeypatch.setattr(D, "PER_BUCKET", 60)
        assert result(D.dedup(df, length=20, gram=6)) == plain(texts, 20)
    # Rows are told apart whatever their ids: a null one, one on two texts, and a row given twice.
    rows = [*texts.items(), (None, shared), (None, word(70)), (7, texts[8] + "x"), (8, word(40) + shared[20:60])]
    more = spark.createDataFrame([(n, k, t) for n, (k, t) in enumerate(rows)], "n long, doc_id long, text string")
    want = plain({n: t for n, (_, t) in enumerate(rows)}, 20)
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.dedup(more, length=20, gram=6).collect())
    assert got == sorted((k is None, k, *want[n]) for n, (k, _) in enumerate(rows))
    assert D.dedup(df.filter("false")).count() == 0
    assert D.dedup(df, length=20, gram=6, kept_text=True).filter("n_bytes - n_removed <> length(kept)").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=8), min_size=1, max_size=7))
def test_merge(runs):
    coded = [suffix_merge.decode(*suffix_merge.front_code(sorted(r))) for r in runs]
    assert [c[0] for c in coded] == [sorted(r) for r in runs]
    order, prefix = suffix_merge.merge(coded)
    got = [coded[i][0][j] for i, j in order]
    assert got == sorted(x for r in runs for x in r)
    assert prefix == [suffix_merge.common(a, b, 0) for a, b in zip([b"", *got[:-1]], got, strict=True)] if got else prefix == []
