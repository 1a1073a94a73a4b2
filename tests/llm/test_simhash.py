"""Against all pairs and a plain fingerprint."""

import random

import xxhash

from granary.llm import queries, simhash
from granary.llm.common import components


def plain(text):
    w = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def grouped(fps):
    """Smallest id reachable, over all pairs."""
    ids, root = sorted(fps), {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def check(rows, texts):
    fps = {i: plain(t) for i, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == fps
    assert {r.doc_id: r.component_id for r in rows} == grouped(fps)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    check(queries.op1_simhash(spark, d).collect(), texts)


def test_hard_texts(spark):
    texts = {9: None, 4: "", 7: " \t\n", 5: "one", 1: "ONE", 2: "two words", 3: "É é", 11: "a b c d e " * 9000, 12: "A b c d e " * 9000}
    df = spark.createDataFrame([(i, t, "f") for i, t in texts.items()], "doc_id long, text string, fingerprint string")
    check(simhash.near_duplicates(df).collect(), texts)
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == {4, 1, 2, 3, 11} and simhash.one_of_each(df).columns == df.columns
    more = df.union(spark.createDataFrame([(None, "one", "f"), (None, "new", "f")], df.schema))
    assert sum(r.doc_id is None for r in simhash.one_of_each(more).collect()) == 2
    assert {r.component_id for r in simhash.near_duplicates(more).collect() if r.doc_id is None} == {1, None}
    assert simhash.near_duplicates(df.filter("false")).count() == 0


def test_links_and_components(spark):
    rng = random.Random(1)
    fps = {i: rng.getrandbits(64) for i in range(40)}
    for i in range(40, 400):
        f = fps[rng.randrange(i)]
        for _ in range(rng.randrange(5)):
            f ^= 1 << rng.randrange(64)
        fps[i] = f
    signed = lambda f: f - (f >> 63 << 64)
    distinct = sorted({signed(f) for f in fps.values()})
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in distinct], "fp long")).collect()}
    assert got == {(a, b) for a in distinct for b in distinct if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7)]
    made = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert made == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
