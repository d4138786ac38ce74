"""What the reviewer found in round 4."""

import random

import duckdb
from pyspark.sql import functions as F

from quillspan import catalogue
from quillspan.operators import containment, inference, records
from quillspan.plans import audits
from tests.oracle import assert_equal

SF = "/root/testdata/sf0.001"


def test_words_are_cut_into_runs_that_tokens_ask_for(spark):
    """long tokens only need long runs, so short words and short runs of all words are left out."""
    tokens = spark.createDataFrame([("informationtheory",), ("entropyrates",)], "_token string")
    words = spark.createDataFrame([("the",), ("informationtheory",), ("crossentropyrates",)], "_word string")
    found = containment._words_with(tokens, words, [])
    assert {tuple(r) for r in found.collect()} == {("informationtheory", "informationtheory"), ("crossentropyrates", "entropyrates")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "{8}" in plan and "{16}" in plan and "{1}" not in plan and "{4}" not in plan


def test_single_names_need_no_text(spark):
    """a word that holds a name of one token is in its text, so whole texts move no more."""
    plan = containment.contained(audits.texts(spark, SF), spark.createDataFrame([("src1", "tion")], "lecture_id string, name string"), ["lecture_id"], words=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(text" not in plan


def test_mixed_names_against_loops(spark):
    """Names of none to seven tokens, with blanks at the ends and alike words, against plain Python."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choice(["ti", "on", "é", "x", ".", "https://a.b/", "er"]) for _ in range(draw.randint(1, 5)))
    texts = [("l" + str(i % 2), i, draw.choice(["", " "]) + draw.choice([" ", "\n", "  "]).join(word() for _ in range(draw.randint(0, 12)))) for i in range(60)]
    names = {(lecture, text[a : a + draw.randint(1, 30)]) for lecture, _, text in texts for a in range(0, len(text), 5)} | {("l0", " "), ("l1", "\n"), ("l0", "absent")}
    want = sorted((lecture, i, n) for lecture, i, t in texts for k, n in names if k == lecture and n and n in t)
    d = spark.createDataFrame(texts, "lecture_id string, text_id long, text string")
    for part in (names, {n for n in names if not n[1].strip() == n[1] or " " in n[1]}, {n for n in names if not any(c.isspace() for c in n[1])}):
        got = containment.contained(d, spark.createDataFrame(sorted(part), "lecture_id string, name string"), ["lecture_id"])
        assert sorted(tuple(r) for r in got.collect()) == [w for w in want if (w[0], w[2]) in part]


def test_first_sentences_against_loops(spark):
    """sentences are cut into words once; names with and without blanks get the first sentence of fitting length."""
    texts = [("l", 2, "Short one. The entropy rate of a source is what remains."), ("l", 1, "Nothing. Rates of ENTROPY in bits a symbol. And the entropy rate again here."), ("l", 3, "x" * 500 + " zebra.")]
    d = spark.createDataFrame(texts, "lecture_id string, text_id long, text string")
    names = spark.createDataFrame([("l", "Entropy"), ("l", "entropy rate"), ("l", "zebra"), ("l", "short")], "lecture_id string, name string")
    got = records.naming_sentences(names, d, ["lecture_id"])
    assert sorted((r.name, r.text_id, r.nth) for r in got.collect()) == [("Entropy", 1, 1), ("entropy rate", 1, 2)]
    one = records.naming_sentences(names.filter(~F.col("name").contains(" ")), d, ["lecture_id"], words=True)
    assert [(r.name, r.text_id, r.nth) for r in one.collect()] == [("Entropy", 1, 1)]
    # texts are cut into words once, and no sentence is tested again
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(text" not in plan and plan.count("\\S+") == 1


def test_package_cleaned_and_its_sql_have_one_rule(spark, tmp_path):
    """both ends have to be names, words end as letters of any script do, and a vertical tab is a blank."""
    texts = ["The that of", "Whoé éntity", "Éis thing whose éntity", "Soñar largeword", "Is largeword whose", "One largeword\x0btwo", "A. \x0bSmall largeword", "Then largeword is known asé", "Largeword byé"]
    rows = [(5 * (i + 1), t, "en", "src1", len(t)) for i, t in enumerate(texts)] + [(5 * i + 1, t, "en", "src2", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = catalogue.QUERIES["package_cleaned"](spark, str(tmp_path))
    assert_equal(got, duck, catalogue.ORACLES["package_cleaned"])
    kept = {r.dst for r in got.filter("lecture_id = 'src1'").collect()}
    assert {"Whoé éntity", "Soñar largeword"} <= kept and "The that of" not in kept


def test_prerequisites_are_found_once_for_both_matches(spark):
    """F8: strict and fuzzy matches start from written tables, so pairs are scored once."""
    assert not any("testdata" in f for f in audits.prerequisite_gold_match(spark, SF).inputFiles())


def test_names_of_ends_are_held_by_no_broadcast(spark):
    """F8: a file of names may be small and have many rows."""
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    plan = audits._both_ends(edges, audits._spelt(spark, SF), "said")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2


def test_cues_are_looked_for_in_many_tasks(spark, monkeypatch):
    """pairs are dealt by their number, as they are few bytes and much work, so that adaptive execution joins no tasks."""
    monkeypatch.setattr(inference, "ROWS", 200_000_000)
    chunks = spark.createDataFrame([("l", i, 30.0 * i, "queue before stack") for i in range(3)], "lecture_id string, chunk_id long, ts double, transcript string")
    profile = spark.createDataFrame([("l", 1, "queue", [0, 1, 2]), ("l", 2, "stack", [0, 1, 2])], "lecture_id string, entity_id long, name string, chunk_ids array<long>")
    found = inference.cue_scores(spark.createDataFrame([("l", 1, 2)], "lecture_id string, src long, dst long"), profile, chunks)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and found.count() <= 1
