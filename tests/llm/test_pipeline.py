import corpus_pipeline as cp
from mvspark.llm import queries
from tests.llm.helpers import awkward, frame

DATA = "/root/testdata/sf0.01"


def test_stages_run_one_after_the_other(spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near-duplicates", "decontamination", "mixing", "tokens"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3]
    out = cp.STAGES[-1][1](spark, docs, DATA)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert out.count() == counts[-1]


def test_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    clean = cp.drop_contaminated(spark, docs, DATA)
    hit = queries.QUERIES["op3_decontaminate"](spark, DATA).where("contaminated")
    assert docs.count() - clean.count() == hit.count()


def test_awkward_rows_pass_all_stages(spark):
    docs = awkward(spark)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() >= 4


def test_an_empty_table_passes_all_stages(spark):
    docs = frame(spark, [])
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == frame(spark, []).columns and docs.count() == 0
    assert cp.STAGES[-1][1](spark, docs, DATA).count() == 0


def test_registered():
    assert cp.ORACLE_SQL is None and "pipeline" in cp.QUERIES
    names = sorted(queries.QUERIES, key=lambda q: int(q[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
