import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline as p
from cohortframe.llm import decontaminate, mixing, quality
from cohortframe.llm.common import WORD, written
from test_neardup import brute
from test_token_output import expected


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(p.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], folder).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, folder, stages):
    start, kept, single, clean, mixed, tokens = stages
    assert all(s.columns == start.columns for s in stages[1:5])
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.train(start, labels)
    scored = quality.with_statistics(start, ["doc_id"]).select("doc_id", quality.score(model).alias("s")).collect()
    assert ids(kept) == sorted(r.doc_id for r in scored if r.s >= quality.THRESHOLD)
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    assert len(good & set(ids(kept))) >= 0.97 * len(good)
    groups = brute([(r.doc_id, r.text) for r in kept.collect()], 5)
    assert ids(single) == sorted(i for i, (_, c) in groups.items() if i == c)
    bench = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in single.collect() if any(b in r.text for b in bench)}
    gone = set(ids(single)) - set(ids(clean))
    assert leaked and leaked <= gone and gone == {r.doc_id for r in decontaminate.leaks(single, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    sized = [(r.doc_id, r.source, len(re.findall(WORD, r.text)), hashlib.md5(r.text.encode()).hexdigest(), 0) for r in clean.collect()]
    schema = "doc_id long, source string, size long, digest string, k long"
    takes = {r.doc_id: r.copies for r in mixing.rates(spark.createDataFrame(sized, schema)).collect()}
    assert Counter(ids(mixed)) == {i: n for i, n in takes.items() if n}
    rows = sorted((r.doc_id, r.text) for r in mixed.collect())
    assert sorted(map(tuple, tokens.drop("bits").collect())) == expected(rows)


def test_run_is_its_stages(spark, folder, stages):
    assert sorted(map(tuple, p.run(spark, folder).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_edges(spark, folder, edge, empty):
    for docs in (edge, empty):
        for name, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == edge.columns, name
        docs = written(docs, "mixed")
        assert p.token_stage(spark, docs, folder).count() == docs.count()


def test_names():
    assert [f for _, f in p.STAGES] == [p.quality_stage, p.near_duplicate_stage, p.decontamination_stage, p.mixing_stage, p.token_stage]
    assert set(p.queries()) == {"pipeline"} and p.oracle_sql() == {}
