"""The corpus pipeline: every stage against a brute-force version on its own input."""

import random
import sys
from pathlib import Path

from emberline.llm import toxicity

sys.path.insert(0, str(Path(__file__).parent))
from test_corpus_operators import WORDS, brute_hits, brute_lines, brute_near, toxic_corpus  # noqa: E402

import corpus_pipeline  # noqa: E402


def test_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 60)
    rng = random.Random(11)
    texts, labels = toxic_corpus(90, 3)
    item = " ".join(rng.choice(WORDS) for _ in range(16))
    base = " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(80))
    texts += [None, "", item, f"{base} tail", f"{base} other tail", "shared line of some length\nown line a", "shared line of some length\nown line b"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(5, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    kept = []
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert now.columns == docs.columns
            kept.append({r.doc_id: r for r in now.collect()})
    clean = [i for i in range(len(texts)) if i >= len(labels) or not labels[i]]
    assert sum(i in kept[0] for i in clean) >= 0.9 * len(clean)
    assert sum(i in kept[0] for i, y in enumerate(labels) if y) <= 0.5 * sum(labels)
    before = sorted((i, texts[i]) for i in kept[0])
    assert {(i, len((kept[1][i].text).split("\n"))) for i, n, gone, _ in brute_lines(before) if gone == 0} <= {(i, len(r.text.split("\n"))) for i, r in kept[1].items()}
    assert all(r.n_chars == len(r.text) for r in kept[1].values()) and set(kept[1]) == set(kept[0])
    assert set(kept[2]) == {i for i, _, _, own in brute_near([(i, r.text) for i, r in kept[1].items()], 5) if own}
    assert set(kept[3]) == {row[0] for row in brute_hits([(i, r.text) for i, r in kept[2].items()], [("5", item)]) if not row[5]}
    assert {r.doc_id for r in now.collect()} == set(kept[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
