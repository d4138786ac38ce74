"""What the reviewer of round 3 found."""

import pytest

from quillspan.operators import containment, segments
from quillspan.plans import knowledge


def test_words_end_where_ascii_words_end(spark):
    rows = spark.createDataFrame([(0, "café naïve"), (1, "é é"), (2, "ré ré ré ré"), (3, "a1 b_2 3c")], "id int, text string")
    got = {r["id"]: r["noise"] for r in rows.select("id", segments.is_repetitive(rows["text"]).alias("noise")).collect()}
    assert got == {0: False, 1: True, 2: True, 3: True}
    # one long run before an accent: it is a word
    one = spark.createDataFrame([("cafés",), ("longeré",)], "text string")
    assert [r[0] for r in one.select(segments.is_repetitive(one["text"])).collect()] == [False, False]


def test_gold_names_meet_one_row_of_each_spelling(spark, tmp_path):
    rows = [(k, "red bolt" if k % 3 else "hot rod", "type") for k in range(1, 61)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    df = knowledge.gold_name_match(spark, str(tmp_path))
    assert {tuple(r) for r in df.select("entity_id", "gold_id", "stage").collect()} == {(k, 1 if k % 3 else 3, "EXACT" if k % 2 else "LEMMA") for k in range(1, 61)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and plan.count("Aggregate [exact") == 1 and plan.count("Aggregate [lemma") == 1


def test_names_of_all_lengths_meet_their_texts(spark):
    said = ["the old red bolt is near a wheel", "bolts\tof  two kinds, abcdefghijklmnop", " ", "a b c d e f g", "Xthe old red bolt is nearX", "", None]
    asked = [" ", "\t", "  ", "b", "bolt", "bolts\tof", "defghijk", "old red bolt", "e old red bolt is ne", "a b c d e f g", "b c d e f", "b  c d e f", "wheelx", "", None]
    texts = [(t, k, x) for t in ("p", "q") for k, x in enumerate(said) if t == "p" or k % 2]
    names = [("p", n) for n in asked] + [("r", "bolt")]
    want = sorted((t, k, n) for t, k, x in texts for u, n in names if t == u and n and x and n in x)
    text_rows, name_rows = spark.createDataFrame(texts, "lecture_id string, text_id long, text string"), spark.createDataFrame(names, "lecture_id string, name string")
    assert sorted(tuple(r) for r in containment.contained(text_rows, name_rows, ["lecture_id"]).collect()) == want
    single = spark.createDataFrame([r for r in names if r[1] and not any(c.isspace() for c in r[1])], "lecture_id string, name string")
    got = sorted(tuple(r) for r in containment.contained(text_rows, single, ["lecture_id"], words=True).collect())
    assert got == [w for w in want if not any(c.isspace() for c in w[2])]
    with pytest.raises(Exception, match="a name has a blank"):
        containment.contained(text_rows, name_rows, ["lecture_id"], words=True).collect()


def test_words_are_looked_for_by_more_than_three_characters(spark):
    """All names share their runs of three characters; only equal words may meet."""
    names = [f"abc{k:04d}abc" for k in range(40)]
    words = spark.createDataFrame([(n,) for n in names], "_word string")
    tokens = spark.createDataFrame([(n,) for n in names], "_token string")
    assert max(containment.GRAMS) > 3
    assert {tuple(r) for r in containment._words_with(tokens, words, []).collect()} == {(n, n) for n in names}
