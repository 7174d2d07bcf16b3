"""Classifiers on held-out labels, and the pipeline's stages against plain versions of them."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_encoding_packing import check_packing
from test_lines import brute_force as dedup_plainly
from test_near import brute_force as near_plainly

import corpus_pipeline
from tablewash.llm import lines, quality, queries, stages, toxicity
from tablewash.llm.common import remainder

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, least", [("op1_quality", "quality", 0.95), ("op7_toxicity", "toxic", 0.88)])
def test_held_out_accuracy(spark, name, label, least):
    scored = queries.QUERIES[name](spark, SF_MORE)
    labels = spark.read.parquet(f"{SF_MORE}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    assert scored.count() == spark.read.parquet(f"{SF_MORE}/documents.parquet").count()


def test_misspelled_words_are_toxic():
    rng = np.random.default_rng(1)
    plain = [f"{a}{b}" for a in ("lo", "ti", "na", "re", "so") for b in ("ma", "ne", "ri", "tu", "va")]
    texts, y = [], []
    for i in range(400):
        words = rng.choice(plain, 60).tolist()
        if i % 2:
            words[rng.integers(60)] = str(rng.choice(["gruzzlewort", "blackfnord"]))
        texts.append(" ".join(words).encode())
        y.append(i % 2)
    model = toxicity.train(texts, np.array(y), 0.5)
    clean = " ".join(plain).encode()
    bad = [clean + b" " + w + b" " + clean for w in (b"gruzzlewort", b"gruzzlwort", b"blackfnordd", b"Blackfn0rd")]
    scores = model.scores([clean, *bad, b"", clean * 3000 + b" gruzzlewort " + clean])
    assert scores[0] < 0.5 and scores[-2] < 0.5
    assert (scores[[1, 2, 3, -1]] > 0.5).all() and scores[4] > scores[0]


def test_marginals_equal_all_labellings():
    rng = np.random.default_rng(2)
    u, change, counts = rng.normal(size=(9, 2)), rng.normal(size=(2, 2)), np.array([4, 0, 1, 4])
    p, expected, _ = quality.marginals(u, counts, change)
    want, pairs, at = [], np.zeros((2, 2)), 0
    for n in counts:
        weights = {}
        for path in itertools.product((0, 1), repeat=int(n)):
            weights[path] = np.exp(sum(u[at + i, s] for i, s in enumerate(path)) + sum(change[a, b] for a, b in zip(path, path[1:])))
        total = sum(weights.values())
        want += [sum(w for s, w in weights.items() if s[i]) / total for i in range(n)]
        for s, w in weights.items():
            for a, b in zip(s, s[1:]):
                pairs[a, b] += w / total
        at += n
    assert np.allclose(p, want) and np.allclose(expected, pairs)


def test_odd_texts_and_missing_labels(spark, odd_docs, sf_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        model = module.fit(sf_docs, labels, remainder("doc_id", 3) != 1, label)
        scored = toxicity.score(spark, odd_docs, model)
        assert scored.columns == [*[c for c in odd_docs.columns if c != "score"], "score"]
        got = [r.score for r in scored.collect()]
        assert len(got) == odd_docs.count() and all(0 <= s <= 1 for s in got)
        assert toxicity.score(spark, odd_docs.limit(0), model).count() == 0
        none = module.fit(sf_docs, labels.limit(0), F.lit(True), label)
        assert {r.score for r in toxicity.score(spark, odd_docs, none).collect()} <= {0.0} | {r.score for r in toxicity.score(spark, odd_docs, none).collect() if r.score < 0.01}
    long = b"a b | c\n" * 300_000  # several pieces of one text
    x, sizes, counts = quality.measures([long, b"", b"one line"])
    assert counts.tolist() == [300_000, 0, 1] and (sizes[:-1] == 7).all()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "line_dedup", "near_duplicates", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names
        docs = spark.createDataFrame(out.collect(), docs.schema)
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "line_dedup":
            plain = dedup_plainly(list(before.items()), lines.MIN_WORDS)
            assert after == {d: t for d, t in plain.items() if t.strip() or t == before[d]}
        elif name == "near_duplicates":
            assert set(after) == {d for d, _, c in near_plainly(list(before.items()), 5, 80) if d == c}
        else:
            assert set(after) < set(before) and all(before[d] == t for d, t in after.items())
            assert len(after) > 0.6 * len(before)
    rows = stages.packing(spark, docs, SF).collect()
    check_packing(docs, rows)
    whole = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in rows}


def test_near_duplicates_are_dropped_by_row(spark):
    """NULL and repeated ids: one row of each group stays, and no row outside of it goes."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, a + " end"), (None, b), (None, b), (5, b + " end"), (2, c), (2, c), (1, c + " end"), (2, "another text of this id"), (7, None), (7, None), (None, " "), (None, " ")]
    rows += [(9, "x y z"), (9, "x y z"), (9, "x y z"), (8, "p q r"), (8, "s t u")]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n_chars long").repartition(3)
    out = stages.near_duplicates(spark, docs, SF)
    assert out.schema.names == docs.schema.names
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    first = next(t for d, t in got if d is None and t.startswith("a"))
    assert first in (a, a + " end")
    want = [(None, first), (5, b + " end"), (1, c + " end"), (2, "another text of this id"), (7, None), (7, None), (None, " "), (None, " ")]
    assert got == sorted([*want, (9, "x y z"), (8, "p q r"), (8, "s t u")], key=repr)


def test_stages_keep_columns_of_clashing_names(spark):
    """Internal names give way to the caller's, each of which comes back as it was."""
    names = ["_row", "_score", "_id", "_h", "_text", "_ranges", "n_lines", "n_deleted", "score", "row", "place", "label", "bucket", "o", "a.b", "c`d"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    more = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, SF)
        assert out.columns == more.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in names), name
        assert {r.doc_id for r in rows} == {r.doc_id for r in stage(spark, docs, SF).collect()}, name
        empty = stage(spark, more.limit(0), SF)
        assert empty.columns == more.columns and empty.isEmpty()


def test_stages_take_odd_rows(spark):
    """NULL, empty and blank texts, NULL and repeated ids, one very long text, other columns NULL."""
    a = " ".join(f"word{i}" for i in range(80))
    long = "\n".join(f"line {i} has words {i * 7} of its own" for i in range(20_000))
    rows = [(None, a, None), (None, a, "x"), (1, None, None), (2, "", None), (3, " \n ", "y"), (4, a, None), (4, a, None), (5, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    whole = {(d, t) for d, t, _ in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = [(r.doc_id, r.text) for r in stage(spark, docs, SF).collect()]
        assert stage(spark, docs, SF).columns == docs.columns
        if name == "near_duplicates":
            assert sorted(got, key=repr) == sorted([(4, a), (1, None), (2, ""), (3, " \n "), (5, long)], key=repr)
        elif name == "line_dedup":  # equal rows are one document: the first place is a NULL id's
            assert sorted(got, key=repr) == sorted([(None, a), (None, a), (1, None), (2, ""), (3, " \n "), (5, long)], key=repr)
        else:
            assert set(got) <= whole
    assert sum(r.length for r in stages.packing(spark, docs, SF).where("doc_id = 2").collect()) == 1
