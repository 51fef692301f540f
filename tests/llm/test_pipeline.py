"""The pipeline, stage by stage, against plain versions on a small table."""

from test_chat_and_packing import check_packing
from test_dedup import brute_components
from test_text_operators import brute_lines

from codegrove.llm import pipeline, pu, toxicity

SF = "/root/testdata/sf0.001"


def shingled(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def contaminated(text, items):
    w = (text or "").lower().split()
    for item in items:
        words = (item or "").lower().split()
        n = min(5, len(words))
        want = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
        held = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        if want and len(want & held) >= 0.8 * len(want) - 1e-9:
            return True
    return False


def test_pipeline_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = [(900001, None), (900002, ""), (900003, docs.first().text), (900004, " ".join(f"word{i}" for i in range(9000)))]
    docs = docs.union(spark.createDataFrame([(d, t, "en", "own", len(t or "")) for d, t in own], docs.schema)).repartition(3)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(pipeline.STAGES)

    def run(name, rows):
        got = stages[name](spark, spark.createDataFrame(rows, docs.schema), SF)
        assert name == "best_fit_packing" or got.columns == docs.columns
        return got.collect()

    rows = docs.collect()
    model = pu.fit(docs, labels, "toxic", toxicity.FOLDS, toxicity.HELD, strength=toxicity.STRENGTH)
    scores = {r.doc_id: model.score(r.text or "") for r in rows}
    kept = run("toxicity", rows)
    sure = {d for d, s in scores.items() if abs(s - toxicity.THRESHOLD) > 1e-3}
    assert {r.doc_id for r in kept} & sure == {d for d in sure if scores[d] < toxicity.THRESHOLD} and set(kept) <= set(rows)

    gone = brute_lines([(r.doc_id, r.text) for r in kept])
    lines = run("line_dedup", kept)
    want = {r.doc_id: r.text if r.doc_id not in gone else "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[r.doc_id]) for r in kept}
    assert {r.doc_id: r.text for r in lines} == want and gone and all(r.n_chars == len(r.text) for r in lines if r.doc_id in gone)

    texts = sorted((r.doc_id, r.text) for r in lines if r.text is not None)
    sets = [shingled(t) for _, t in texts]
    root = brute_components(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    near = run("simhash_near_dedup", lines)
    assert {r.doc_id for r in near} == {d for i, (d, _) in enumerate(texts) if root[i] == i} | {r.doc_id for r in lines if r.text is None}

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = run("benchmark_decontamination", near)
    assert {r.doc_id for r in clean} == {r.doc_id for r in near if not contaminated(r.text, items)}

    n, bound = check_packing([(r.doc_id, r.text) for r in clean], run("best_fit_packing", clean))
    assert n <= bound + 1
