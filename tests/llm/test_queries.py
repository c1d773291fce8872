"""Every registered query over odd and empty tables, against plain versions of the operators."""

import math

import duckdb
import pytest

from marquee.llm import queries
from tests.llm import brute, conftest


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def docs():
    return [(r[0], r[1]) for r in conftest.documents()]


@pytest.mark.parametrize("name", [n for n in queries.QUERIES])
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_op1(spark, odd):
    got = rows(queries.QUERIES["op1_warc"](spark, odd), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == sorted(brute.warc(conftest.pages()), key=repr)


def test_op2(spark, odd):
    got = rows(queries.QUERIES["op2_unit_dedup"](spark, odd), "doc_id", "start_offset", "end_offset", "kept_doc_id")
    want = brute.unit_removals(docs())
    # rows of one id and text are written in any order, which row of them keeps its lines doesn't show
    assert got == sorted(want, key=repr)
    assert (7, 0, len(docs()[7][1]), 6) in got  # the exact copy


def test_op3(spark, odd):
    got = rows(queries.QUERIES["op3_class_lm"](spark, odd), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = sorted(brute.base_scores(docs()), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9) for g, w in zip(got, want, strict=True))
    assert all(g[6] < 0 and math.isfinite(g[6]) for g in got)


def test_op4_fills_the_budget_from_whole_epochs_and_a_prefix(spark, odd):
    got = queries.QUERIES["op4_mixing"](spark, odd).collect()
    total = sum(len(brute.words(t)) for _, t in docs())
    taken = sum(g["take_tokens"] for g in got)
    assert 0.6 * total - 60 <= taken <= 0.6 * total
    assert all(0 < g["take_tokens"] <= g["n_tokens"] for g in got)
    by_leaf = {}
    for g in got:
        by_leaf.setdefault((g["domain"], g["lang"], g["source"]), []).append(g)
    for leaf in by_leaf.values():
        assert sum(g["take_tokens"] < g["n_tokens"] for g in leaf) <= 1


def test_op5(spark, odd):
    got = rows(queries.QUERIES["op5_decontaminate"](spark, odd), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.contamination(docs(), conftest.benchmark()), key=repr)


def test_op6(spark, odd):
    got = rows(queries.QUERIES["op6_line_runs"](spark, odd), "doc_id", "kept_chars")
    assert got == sorted(((i, None if t is None else len(t)) for i, t in brute.line_runs(docs())), key=repr)


def test_op7_rotates_every_participant(spark, odd):
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in queries.QUERIES["op7_perspectives"](spark, odd).collect()}
    assert {k[1] for k in got if k[0] == 1} == {"user", "assistant", "<|unknown|>"}
    assert not [k for k in got if k[0] == 2]
    assert [got[9, "a", p]["n_turns"] for p in (0, 1, 2)] == [128, 128, 44]
    r = got[1, "assistant", 0]
    said = [r["text"][int(a) : int(b)] for a, b in (x.split("-") for x in r["mask"].split(";"))]
    assert said == ["Hello<|im_end|>"] and r["text"].startswith("<|im_start|>user name=user\nHi<|im_end|>\n<|im_start|>assistant\nHello")


@pytest.mark.parametrize("name", ["op4_mixing", "op7_perspectives", "op8_quality_cascade", "op11_periodic_runs", "op12_merkle", "op13_jaccard_join"])
def test_sql_on_odd_rows(spark, odd, name):
    con = duckdb.connect()
    for t in conftest.SCHEMAS:
        con.sql(f"create view {t} as select * from '{odd}/{t}.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    assert rows(queries.QUERIES[name](spark, odd), *want.columns) == sorted(want.fetchall(), key=repr)


def test_op8(spark, odd):
    got = rows(queries.QUERIES["op8_quality_cascade"](spark, odd), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert got == sorted(brute.quality(docs()), key=repr)


def test_op9(spark, odd):
    got = rows(queries.QUERIES["op9_simhash_anchor"](spark, odd), "doc_id", "fingerprint", "component_id")
    assert got == sorted(brute.near_duplicates(docs()), key=repr)


def test_op10_keeps_the_article(spark, odd):
    got = queries.QUERIES["op10_html_blocks"](spark, odd).collect()
    assert len(got) == len(conftest.pages())
    want = "Title here\n\nSome words & more words of this article, long enough.\n\nAnother one of them, also long enough to be kept."
    assert [g["text"] for g in got if g["page_id"] == 0] == [want]
    assert all(g["text"] == "" and g["n_chars"] == 0 for g in got if g["page_id"] in (2, 3))
    assert all(g["n_chars"] == len(g["text"]) for g in got)


def test_op11(spark, odd):
    got = rows(queries.QUERIES["op11_periodic_runs"](spark, odd), "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    known = [d for d in docs() if len(brute.words(d[1])) < 5000]  # the plain version takes the square of the words
    want = sorted(brute.periodic(known), key=repr)
    assert [g for g in got if g[0] in {i for i, _ in known}] == want and len(got) == len(docs())
    assert any(w[1] for w in want)


def test_op12(spark, odd):
    got = rows(queries.QUERIES["op12_merkle"](spark, odd), "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert got == sorted(brute.merkle(conftest.documents()), key=repr)
    assert {g[-1] for g in got} == {True, False}


def test_op13(spark, odd):
    got = rows(queries.QUERIES["op13_jaccard_join"](spark, odd), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.similar(docs()), key=repr)


def test_pipeline(spark, odd):
    got = queries.QUERIES["pipeline"](spark, odd)
    assert {"doc_id", "text", "lang", "source", "n_chars", "epoch", "take_tokens", "deleted_runs"} <= set(got.columns)
    want = brute.pipeline(conftest.documents(), conftest.benchmark())
    assert want and rows(got, "doc_id", "text", "n_chars", "n_tokens", "epoch", "take_tokens") == sorted(want, key=repr)
