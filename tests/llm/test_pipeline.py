"""The pipeline's stages take effect, one by one and together."""

from __future__ import annotations

import random

import corpus_pipeline
from halyard.llm.storage import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark, prose, tmp_path):
    rng = random.Random(6)
    good = prose(120, 61, 60, 90)
    items = prose(3, 62, 30, 40)
    texts = list(good)
    texts += [good[i] for i in range(10)]  # 120-129: copies
    texts += [" ".join(w if k != 30 else "other" for k, w in enumerate(good[i].split())) for i in range(10, 20)]  # 130-139: near copies
    texts += [f"{good[i][:200]} {items[i % 3]} {good[i][200:]}" for i in range(20, 26)]  # 140-145: leaks
    texts += ["too few words", None, "*** ### " * 30]  # 146-148
    junk = [" | ".join(rng.sample(good[i].split(), 50)) for i in range(30, 60)]  # 149-178
    texts += junk
    rows = [(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i < 146), 0) for i in range(len(texts)) if i % 2 == 0 or i >= 146], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept, scratch = spark.read.parquet(str(tmp_path / "documents.parquet")), [], Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, str(tmp_path)))
        kept.append({r.doc_id for r in docs.collect()})
        if name != "source mix":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not kept[0] & {146, 147, 148} and kept[0] >= set(range(146))
    assert kept[1] >= set(range(146))
    assert kept[2] == kept[1] - set(range(120, 140)) - set(range(140, 146)) | (kept[2] & set(range(140, 146)))
    assert not kept[3] & set(range(140, 146)) and kept[3] >= set(range(120))
    assert kept[4] <= kept[3] and len(kept[4]) > 100
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[4]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
