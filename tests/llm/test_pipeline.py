"""Each stage of the pipeline against a plain version of its decision, on its own input."""

import random

import numpy as np
import pandas as pd

from palimpsest.llm import decontaminate, mixing, quality, wavelet
from palimpsest.llm.queries import queries, tokenizer_path


def test_stages(spark, tmp_path):
    import corpus_pipeline as C
    from tests.llm.test_neardup import brute

    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    w = lambda n: " ".join(rng.choices(words, k=n))
    passage = w(20)
    rows = [(i, w(rng.randint(6, 80)), "en", f"s{i % 3}") for i in range(200)]
    rows += [(1000 + i, rows[i][1].upper(), "en", "s0") for i in range(0, 40, 4)]
    rows += [(2000 + i, f"{w(9)} {passage} {w(5)}", "en", None) for i in range(10)]
    rows += [(3000 + i, "spam " * 30 + "!! " * 40, "en", "s1") for i in range(40)] + [(4000, None, None, None), (4001, "", "en", "s2")]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).assign(n_chars=1).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame([(i, int(i < 3000), 0) for i, *_ in rows if i % 2], columns=["doc_id", "quality", "toxic"]).to_parquet(tmp_path / "labels.parquet")
    pd.DataFrame([("b1", passage), ("b2", "zz yy")], columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for n, (_, stage) in enumerate(C.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        sizes = [(r["doc_id"], r["source"], len((r["text"] or "").split())) for r in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        out = [r["doc_id"] for r in docs.collect()]
        kept.append(len(out))
        if n == 0:
            model = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
            x = np.array([quality.features(t.encode() if t is not None else None) for t in before.values()])
            assert set(out) == {i for i, s in zip(before, model.score(x), strict=True) if s >= 0.5}
            assert not any(3000 <= i < 4000 for i in out) and sum(i < 3000 for i in out) > 200
        elif n == 1:
            found = brute(list(before.items()), 5, 80)
            assert sorted(out) == sorted(i for i, (_, _, keep) in found.items() if keep)
        elif n == 2:
            assert sorted(out) == sorted(i for i, t in before.items() if passage not in (t or "").lower())
        elif n == 3:
            target = mixing.source_targets([(s, sum(k for _, x, k in sizes if x == s)) for s in {x for _, x, _ in sizes}])
            for s, goal in target.items():
                assert abs(sum(k * out.count(i) for i, x, k in sizes if x == s) - goal) <= 80
        if n < 4:
            assert docs.columns == columns
    t = wavelet._tokenizer(tokenizer_path())
    end = 0
    for r in sorted(docs.collect(), key=lambda r: r["start"]):
        assert r["start"] == end and r["n_tokens"] == len(t.encode(before[r["doc_id"]] or "", add_special_tokens=False).ids) + 1
        end += r["n_tokens"]
    assert kept[-1] == kept[-2] and decontaminate.items_digest(["b", "a"]) == decontaminate.items_digest(["a", "b"])
    assert C.run(spark, str(tmp_path)).count() == kept[-1]


def test_registered():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [*[f"op{i}" for i in range(1, 11)], "pipeline"]


def test_an_empty_table_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as C

    shape = "doc_id long, text string, lang string, source string, n_chars long, row int, p int, h int, whole int"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", "a b c")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
    rows = [(i, f"word{i} and more of it", "en", None, 9, i, 2, 3, 4) for i in range(5)]
    out = mixing.mixed_documents(spark.createDataFrame(rows, shape))
    assert out.columns == [x.split()[0] for x in shape.split(", ")] and {tuple(r) for r in out.collect()} <= set(rows)
