"""The class model's work: a word costs what stands beside it, and words that not every task knows are looked up once."""

import numpy as np

from marquee.llm import class_lm


def test_gains_go_through_what_stands_beside_a_word_only(monkeypatch):
    rng = np.random.default_rng(0)
    n, c = 50, 32
    between = rng.integers(0, 1000, (c, c)).astype(float)
    after, before = ((rng.random((n, c)) < 0.06) * rng.integers(1, 5, (n, c)).astype(float) for _ in range(2))
    classes = rng.integers(0, c, n)
    plain, logs = class_lm.plogp, []
    monkeypatch.setattr(class_lm, "plogp", lambda x: logs.append(x.size) or plain(x))
    got = class_lm.gains(after, before, classes, between)
    assert sum(logs) <= 2 * c * (np.count_nonzero(after) + np.count_nonzero(before)) + 4 * c * n
    for k in range(n):
        without = between.copy()
        without[classes[k]] -= after[k]
        without[:, classes[k]] -= before[k]
        without = np.maximum(without, 0)
        rows, columns = between.sum(1), between.sum(0)
        rows[classes[k]] -= after[k].sum()
        columns[classes[k]] -= before[k].sum()
        for to in range(c):
            want = (plain(without[to] + after[k]) - plain(without[to])).sum() + (plain(without[:, to] + before[k]) - plain(without[:, to])).sum()
            want -= plain(rows[to] + after[k].sum()) - plain(rows[to]) + plain(columns[to] + before[k].sum()) - plain(columns[to])
            assert np.isclose(got[k, to], want)


def test_rare_words_are_looked_up_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(class_lm, "LOCAL", 5)
    calls, rare_words = [], class_lm.rare_words
    monkeypatch.setattr(class_lm, "rare_words", lambda *a: calls.append(1) or rare_words(*a))
    spark.createDataFrame([(i, f"a b c d e f w{i} w{i + 1}") for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert class_lm.op3_class_lm(spark, str(tmp_path)).count() == 20
    assert len(calls) == 1
