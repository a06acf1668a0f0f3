import corpus_pipeline as P
from spoor.llm import common, quality, simhash
from spoor.llm.common import held_out
from pyspark.sql import functions as F

from test_native_and_secrets import brute_mix
from test_text_models import brute_leaks

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    after = {}
    rows = docs
    for name, stage in P.STAGES:
        rows = stage(spark, rows, SF).persist()
        after[name] = rows.collect()
        assert name == P.STAGES[-1][0] or rows.columns == columns
    ids = {name: [r["doc_id"] for r in got] for name, got in after.items()}

    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~held_out(F.col("doc_id")))
    model = quality.fit(docs, labels)
    assert sorted(ids["quality"]) == sorted(
        r["doc_id"] for r in docs.collect() if model.score(r["text"]) >= quality.THRESHOLD
    )
    assert sorted(ids["lines"]) == sorted(ids["quality"])
    assert all(r["n_chars"] == len(r["text"]) for r in after["lines"])

    # groups by comparing every pair of wide fingerprints
    prints = [(r["doc_id"], simhash.fingerprint_wide(r["text"])) for r in after["lines"]]
    group = {i: i for i, _ in prints}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(a, b)) <= simhash.WIDE_RADIUS:
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    best = sorted({find(i) for i, _ in prints})
    # probing may miss a pair at the edge of the radius, never merge more
    assert set(best) <= set(ids["copies"]) and len(ids["copies"]) <= len(best) + 1

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(ids["leaks"]) == sorted(r["doc_id"] for r in after["copies"] if not brute_leaks(items, r["text"]))

    want = brute_mix([(r["doc_id"], r["text"], r["source"]) for r in after["leaks"]])
    assert {(r["doc_id"], r["repeats"]) for r in after["mixture"]} == set(want)
    assert P.run(spark, SF).count() == len(after["mixture"])


def test_copies_are_the_groups_of_operator_1_first(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in P.drop_copies(spark, docs, SF).collect()}
    groups = simhash.near_groups(docs).collect()
    assert any(r["id"] != r["component"] for r in groups)
    assert kept <= {r["id"] for r in groups if r["id"] == r["component"]}


def test_operator_1_decides_before_shingle_sets(spark, monkeypatch):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g h i j k l m n o p q"), (3, "u v w x y z")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    groups = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (3, 9, 3)], "id long, fp long, component long")
    monkeypatch.setattr(simhash, "near_groups", lambda d, *a: groups)
    assert {r["doc_id"] for r in P.drop_copies(spark, docs, SF).collect()} == {1, 3}


def test_rounds_of_a_small_graph_take_few_tasks(spark, monkeypatch):
    kept, tasks, cut = {}, [], common.cut

    def counted(df):
        out = cut(df)
        tasks.append(out.rdd.getNumPartitions())
        return out

    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        kept[k] = spark.conf.get(k)
        spark.conf.set(k, v)
    try:
        monkeypatch.setattr(common, "cut", counted)
        chains = [(100 * i + j, 100 * i + j + 1) for i in range(10) for j in range(20)]
        links = spark.createDataFrame(chains, "a long, b long").repartition(8)
        got = {r["v"]: r["root"] for r in common.components(links).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {100 * i + j: 100 * i for i in range(10) for j in range(21)}
    assert len(tasks) > 2 and max(tasks[1:]) == 1
