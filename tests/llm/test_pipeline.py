"""Every stage of the pipeline on its own input, against plain Python."""

import re

import numpy as np
import pytest

pytest.importorskip("inkfathom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.01"


def shingle_set(text):
    w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(10**6, "12 -- 34", "en", "s", 8), (10**6 + 1, None, None, None, None)], docs.schema))
    columns, before = docs.columns, docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        after = docs.toPandas()
        if name != "packing":
            assert docs.columns == columns
        if name == "language":
            letters = before.text.map(lambda t: bool(t and re.search(r"[^\W\d_]", t)))
            assert set(after.doc_id) == set(before.doc_id[letters])
        if name == "exact_dedup":
            norm = before.assign(k=before.text.map(lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")))
            assert set(after.doc_id) == set(norm.groupby("k").doc_id.min())
        if name == "near_dedup":
            sets = dict(zip(before.doc_id, before.text.map(shingle_set)))
            up = {i: i for i in sets}

            def find(x, up=up):
                while up[x] != x:
                    x = up[x]
                return x

            ids = sorted(sets, key=lambda i: len(sets[i]))
            for k, a in enumerate(ids):
                for b in ids[k + 1 :]:
                    if len(sets[a]) < 0.8 * len(sets[b]):
                        break
                    if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        x, y = find(a), find(b)
                        up[max(x, y)] = min(x, y)
            assert set(after.doc_id) == {find(i) for i in sets}
        if name == "mixing":
            words = lambda d: int(sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in d.text))
            assert abs(words(after) - words(before)) <= before.source.nunique() and after.doc_id.value_counts().max() <= 3
        if name == "packing":
            assert np.isin(after.doc_id.unique(), before.doc_id).all() and after.doc_id.nunique() == before.doc_id.nunique()
        before = after
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_empty_and_repeated_rows(spark, tmp_path):
    """No rows give no rows; rows repeated with one or no identifier go through every stage."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i % 5 if i % 7 else None, f"text number {i % 9} of the many words that this document has {i % 9}", "en", None if i % 4 else "s", 1) for i in range(120)]
    for number, table in enumerate((spark.createDataFrame([], schema), spark.createDataFrame(rows, schema))):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{number}{name}")
            docs = spark.read.parquet(f"file://{tmp_path}/{number}{name}")
            if name == "exact_dedup":
                assert sorted({r.text for r in docs.collect()}) == sorted({r[1] for r in rows} if number else [])
        assert (docs.count() > 0) == bool(number)
