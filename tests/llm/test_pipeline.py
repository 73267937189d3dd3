"""The pipeline's stages, each against a brute-force version on its own input."""

import random

import corpus_pipeline as P
from oroflow.llm import near_dedup

BAD = ["vile", "nasty", "foul"]


def make(spark, tmp):
    rng = random.Random(1)
    docs = []
    for i in range(240):
        words = [f"w{rng.randrange(2000)}" for _ in range(60)]
        if i % 5 == 0:
            for _ in range(6):
                words[rng.randrange(60)] = rng.choice(BAD)
        docs.append([i, " ".join(words)])
    docs += [[300 + i, docs[i + 1][1].upper()] for i in range(3)]
    near = docs[11][1].split()
    near[5] = "other"
    docs += [[400, " ".join(near)], [401, None], [402, ""], [None, "no id " * 5]]
    rows = [(i, t, "en", f"s{(i or 0) % 4}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp}/labels.parquet")
    return {i: t for i, t in docs}


def test_stages(spark, tmp_path):
    d = f"file://{tmp_path}"
    texts = make(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, d)
        before, after = [r["doc_id"] for r in docs.collect()], [r["doc_id"] for r in out.collect()]
        if name == "toxicity":
            toxic = {i for i in before if i is not None and any(b in (texts[i] or "").split() for b in BAD)}
            assert toxic and set(before) - set(after) == toxic
        elif name == "exact_dedup":
            low = {}
            for i in before:
                t = (texts[i] or "").lower()
                low[t] = max((x for x in (low.get(t), i) if x is not None), default=None)
            assert sorted(map(str, after)) == sorted(map(str, low.values()))
        elif name == "near_dedup":
            assert set(before) - set(after) == {400} and near_dedup is not None
        elif name == "mixing":
            assert set(after) <= set(before) and len(after) > len(before)
            assert max(after.count(i) for i in set(after)) <= 2
        else:
            rows = out.toPandas()
            assert rows["length"].sum() == sum(len((texts[i] or "").split()) for i in before)
            assert (rows.groupby("bin_id")["length"].sum() <= rows.groupby("bin_id")["bin_capacity"].first()).all()
        if k + 1 < len(P.STAGES):
            assert out.columns == columns
            out.write.parquet(f"{d}/stage{k}")
            docs = spark.read.parquet(f"{d}/stage{k}")


def test_odd_tables(spark, tmp_path):
    """Empty tables; columns that are called like the operators' own; ids that repeat on other texts."""
    d = f"file://{tmp_path}"
    make(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0
    odd = [(1, "first text of one id " * 9, "a", 5, "x"), (1, "second text of the same id " * 9, "a", 6, "y"), (2, "Second text of the same id " * 9, "b", 7, "z"), (2, "Second text of the same id " * 9, "b", 7, "z"), (None, None, None, None, None), (None, "plain", "b", 8, "w")]
    names = "doc_id long, text string, source string, score long, passages string"
    out = spark.createDataFrame(odd, names)
    assert sorted(map(str, P.drop_toxic(spark, out, d).collect())) == sorted(str(r) for r in out.collect())
    exact = P.drop_exact_copies(spark, out, d)
    assert {(r["doc_id"], r["text"]) for r in exact.collect()} == {(i, t) for i, t, *_ in odd if t != odd[1][1]}
    assert exact.count() == 4 and exact.columns == out.columns
    assert P.drop_near_copies(spark, out, d).columns == out.columns
    assert P.mix_sources(spark, out, d).columns == out.columns


def test_mix_of_rows_that_share_an_id(spark, tmp_path):
    """Texts under one id are taken each by itself; rows that repeat in all columns add up; the totals stay the target's."""
    rows = [(1, " ".join(f"w{i}x{j}" for j in range(20)), "en", "s", 1) for i in range(40)] + [(2, "again " * 20, "en", "s", 1)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = P.mix_sources(spark, docs, str(tmp_path)).collect()
    assert abs(sum(len(r["text"].split()) for r in out) - 2400) <= 20
    texts = [r["text"] for r in out]
    assert max(texts.count(t) for t in set(texts) if not t.startswith("again")) <= 2


def test_exact_copies_keep_one_row_whatever_the_order(spark, tmp_path):
    rows = [(1, "Same text", lang, "s", 1) for lang in ("fr", "en", None)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long")
        assert [r["lang"] for r in P.drop_exact_copies(spark, docs, str(tmp_path)).collect()] == ["en"]


def test_run(spark, tmp_path):
    d = f"file://{tmp_path}"
    make(spark, d)
    assert P.run(spark, d).count() > 150
