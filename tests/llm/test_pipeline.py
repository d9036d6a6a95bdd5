import random

import corpus_pipeline
from notegrid.llm import minhash
from notegrid.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "kmnprt" for b in "aeiou" for c in ("la", "to", "nu")]
    rows, labels = [], []
    for i in range(240):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        toxic, bad = i % 6 == 0, i % 6 == 1
        if toxic:
            w.insert(3, rng.choice(["zworf", "xquib"]))
        if bad:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w) + ".", "en", f"s{i % 4}", 1))
        labels.append((i, int(not bad), int(toxic)))
    for k in range(40):
        rows.append((300 + k, rows[2 + 6 * (k % 5)][1], "en", "s1", 1))
    rows += [(None, rows[3][1], None, None, None), (900, None, "en", None, None), (901, "", "en", "s0", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, labels


def test_stages_in_turn(spark, tmp_path):
    rows, labels = tables(spark, str(tmp_path))
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        kept.append([r.doc_id for r in docs.collect()])
    toxic, bad = {i for i, _, t in labels if t}, {i for i, q, _ in labels if not q}
    everything = {r[0] for r in rows}
    assert set(kept[0]) == everything - toxic
    assert set(kept[1]) == everything - toxic - bad
    assert set(kept[2]) == {i for i in kept[1] if i is None or i < 300 or i >= 900} and len(kept[2]) == len(set(kept[2]))
    assert set(kept[3]) <= set(kept[2]) and set(kept[4]) == set(kept[3])
    assert corpus_pipeline.run(spark, folder).count() == len(kept[4])


def test_registered():
    names = {n.split("_")[0] for n in QUERIES}
    assert names == {f"op{k}" for k in range(1, 14)} and set(ORACLES) <= set(QUERIES)


def test_near_copies_share_five_word_shingles(spark):
    words = [f"w{k}" for k in range(100)]
    apart = [f"x{k}" if k in (8, 28, 48, 68, 88) else w for k, w in enumerate(words)]  # 0.82 on pairs, 0.6 on five words
    near = [*words[:50], "x", *words[51:]]
    rows = [(1, " ".join(words)), (2, " ".join(apart)), (3, " ".join(near)), (4, "a b c"), (5, "a b d"), (6, "A b c")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 2, 4, 5]
    low = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=2).collect()}
    assert low == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 4}


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    rows = [(1, "a b c d e f g"), (7, "a b c d e f g"), (7, "h i j k l m n"), (8, "o p q r s t u"), (8, "v w x y z a b"), (8, "O p q r s t u"), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = sorted((r.doc_id, (r.text or "").lower()) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == [(1, rows[0][1]), (7, rows[2][1]), (8, rows[3][1]), (8, rows[4][1]), (9, "")]


def test_empty_tables_and_missing_labels(spark, tmp_path):
    tables(spark, str(tmp_path / "full"))
    full = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for name, docs, labels in (("none", full.limit(0), 0), ("unlabelled", full, 0)):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/full/labels.parquet").limit(labels).write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert name == "unlabelled" or not rows
