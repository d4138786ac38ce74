"""Context assembly against plain loops over one query at a time."""

import random

from pyspark.sql import functions as F

from quillspan.operators import assembly as A
from quillspan.operators.assembly import JOIN

CANDIDATES = "query_id int, rank int, rerank_score double, lecture_id string, chunk_id string, segment_id string, ts double, score double, transcript string, ocr_text string, visual_context string"
PLANS = "query_id int, is_lecture_wide boolean, need_visual boolean, budget int"


def candidates(rng, query):
    rows = []
    for rank in range(1, rng.randint(2, 18)):
        said = " ".join(rng.choice("alpha beta gamma delta eps.".split()) for _ in range(rng.randint(0, 40)))
        rows.append((query, rank, float(rng.choice([0, 0, 1, 2, 3])), "l", rng.choice(["", *map(str, range(25))]), rng.choice(["", "a", "b"]), float(rng.randint(0, 600)), rng.choice([None, 0.5, 0.7]), said, "", rng.choice(["", "a picture"])))
    return rows


def cut_text(text, limit):
    if len(text) <= limit:
        return text
    head = text[:limit]
    at = head.rfind(". ")
    return head[: at + 1] if at > limit // 2 else head


def plain(rows, wide, visual, budget, least=300):
    seen, kept = set(), []
    for r in rows:  # by rank
        if r[4] and r[4] in seen:
            continue
        seen.add(r[4])
        kept.append(r)
    kept.sort(key=lambda r: (r[6], r[1]))
    made = []
    for r in kept:
        b = made[-1] if made else None
        fits = lambda x, y: not x or not y or x == y
        if b and fits(b[0][5], r[5]) and fits(b[0][3], r[3]) and abs(r[6] - b[0][6]) <= 30:
            b.append(r)
        else:
            made.append([r])
    blocks = []
    for b in made:
        best = b[0][2]
        for r in b[1:]:
            best = r[2] if r[2] > best else best
        said = " ".join(r[8].strip() for r in b if r[8].strip())
        seen_ = " ".join(r[10].strip() for r in b if r[10].strip())
        text = " ".join([f"[Transcript] {said}"] * bool(said) + [f"[Visual] {seen_}"] * bool(seen_ and visual))
        parts = [(r[4], r[8][:40].strip()) for r in b if r[4]]
        blocks.append((best or b[0][7] or 0.0, text, parts))
    assert not wide
    order = sorted(range(len(blocks)), key=lambda i: (-blocks[i][0], i))
    texts, chosen, used = set(), [], 0
    for i in order:
        text = blocks[i][1]
        if not text.strip() or text in texts:
            continue
        texts.add(text)
        used += len(text) + 7
        if used > budget:
            if not chosen:
                chosen.append((i, cut_text(text, budget)))
            break
        chosen.append((i, text))
    chosen.sort()
    ids = {p for i, text in chosen for p, snippet in blocks[i][2] if not snippet or snippet in text}
    return JOIN.join(t for _, t in chosen), ids


def test_contexts_against_loops(spark):
    rng = random.Random(11)
    rows = {q: candidates(rng, q) for q in range(40)}
    plans = [(q, False, q % 2 == 0, rng.choice([60, 200, 900, 6000])) for q in rows]
    ranked = spark.createDataFrame([r for x in rows.values() for r in x], CANDIDATES)
    graph = spark.createDataFrame([], "query_id int, arrival int, start_name string, related_name string, rel_types array<string>, edges array<struct<source:string,relation:string,target:string>>, hops int, direction string")
    whole, tagged = A.contexts(ranked, graph, spark.createDataFrame(plans, PLANS))
    got = {r["query_id"]: r["context"] for r in whole.collect()}
    ids: dict[int, set] = {}
    for r in tagged.filter("in_context").collect():
        ids.setdefault(r["query_id"], set()).add(r["chunk_id"])
    for q, wide, visual, budget in plans:
        text, used = plain(rows[q], wide, visual, budget)
        assert (got[q], ids.get(q, set())) == (text, used), q
        assert len(got[q]) <= budget
    cited = A.sources(tagged).groupBy("query_id").agg(F.count("*").alias("n"), F.max("position").alias("m"), F.countDistinct("chunk_id").alias("d")).collect()
    assert cited and all(r["n"] == r["m"] == r["d"] == len(ids[r["query_id"]]) for r in cited)


def test_lecture_wide_contexts_spread_over_time(spark):
    rows = [(1, i + 1, 9.0 - i, "l", str(i), "", 100.0 * i, None, f"text {i} " + "word " * 200, "", "") for i in range(8)]
    found = A.assembled(spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame([(1, True, False, 6000)], PLANS)).orderBy("position").collect()
    assert [r["ts"] for r in found] == sorted(r["ts"] for r in found) and len(found) > 1
    assert sum(len(r["kept"]) + 7 for r in found) <= 6000 + 7


def test_pool_keeps_the_first_of_each_chunk(spark):
    c = "query_id int, arrival int, lecture_id string, chunk_id string, segment_id string, ts double, score double, transcript string, ocr_text string, visual_context string"
    v = spark.createDataFrame([(1, 1, "l", "a", "", 0.0, 0.9, "x", "", ""), (1, 2, "l", "b", "", 0.0, 0.8, "x", "", "")], c)
    g = spark.createDataFrame([(1, 1, "l", "b", "", 0.0, None, "x", "", ""), (1, 2, "l", None, "", 0.0, None, "x", "", ""), (1, 3, "l", "c", "", 0.0, None, "x", "", "")], c)
    pool = A.pooled(v, g)
    assert [(r["arrival"], r["chunk_id"]) for r in pool.orderBy("arrival").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    q = spark.createDataFrame([(1, "x", False)], "query_id int, query string, need_visual boolean")
    for scorer in (A.in_order, None, A.shared_words):  # equal passages stay apart, in order of arrival
        assert [r["chunk_id"] for r in A.reranked(pool, q, scorer).orderBy("rank").collect()] == ["a", "b", "c"]


def test_filler(spark):
    d = spark.createDataFrame([("short", "", "", True), ("short", "slide", "", False), (None, None, " ", True), ("a long enough text", "", "", False), ("short", "", "seen", False)], "t string, o string, v string, want boolean")
    assert all(r["x"] == r["want"] for r in d.withColumn("x", A.is_filler(F.col("t"), F.col("o"), F.col("v"))).collect())
