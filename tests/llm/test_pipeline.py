"""The pipeline's stages take effect one after another, and its queries are registered."""


def test_stages(spark):
    import corpus_pipeline as cp
    from brindle.session import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    kept, columns = docs, docs.columns
    counts = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == columns
        counts.append(kept.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0
    assert [name for name, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]


def test_mixing_sql(spark):
    import duckdb

    from brindle.llm import mixing

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, size, source_size, round(target, 4), taken FROM ({mixing.OP10_SQL})").fetchall()}
    got = {r.doc_id: (r["size"], r.source_size, round(r.target, 4), r.taken) for r in mixing.op10(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_near_duplicates_follow_op1(spark):
    """Every link of op1 joins its documents in the stage too, also where fewer shingles than the similarity asks for are shared."""
    import random

    import corpus_pipeline as cp
    from brindle.llm import near, simhash

    rng, found = random.Random(5), []
    while len(found) < 3:
        words = [f"w{rng.randrange(500)}" for _ in range(40)]
        other = [*words]
        other[20] = f"w{rng.randrange(500)}"
        a, b = " ".join(words), " ".join(other)
        x, y = (set(near.shingle_set(near._words(t), near.WIDTH).tolist()) for t in (a, b))
        if 0 < (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 2 and len(x & y) < 0.8 * len(x | y):
            found.append((a, b))
    rows = [(2 * i + k, t) for i, pair in enumerate(found) for k, t in enumerate(pair)]
    docs = spark.createDataFrame([*rows, (90, rows[1][1].upper()), (91, "alone"), (92, None), (93, "")], "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {r.doc_id for r in cp.drop_near_duplicates(spark, docs, "").collect()} == set(groups.values()) == {0, 2, 4, 91, 92}


def test_known_beginnings_are_told(spark):
    from pyspark.sql import functions as F

    from brindle.llm.decontaminate import one_of

    known = [0, 7, -8, 1 << 62, -(1 << 63), 15]
    for hashes in (known, []):
        asked = spark.createDataFrame([([*known, 1, 8, -1],)], "h array<long>").select(F.transform("h", one_of(hashes)).alias("is"))
        assert [bool(x) for x in asked.first()["is"]] == [h in hashes for h in [*known, 1, 8, -1]]
