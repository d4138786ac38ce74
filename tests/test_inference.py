"""Prerequisites from cues, mentions and time, against plain loops over small lectures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspan.functions import fixed
from quillspan.operators import graph
from quillspan.operators import inference as I

TERMS = [("Page Table", "page tables", True), ("Policies", "a policy", True), ("Process", "processes", True), ("Boxes", "box", True), ("direct current", "direct and current", True), ("direct current", "direct-currents", True), ("Delta Star Connection", "the delta star winding", True), ("Bus", "business", False), ("Class", "clas", False)]


@pytest.mark.parametrize(("name", "text", "fits"), TERMS)
def test_terms_in_singular_and_plural(spark, name, text, fits):
    r = spark.range(1).select(I.term_place(I.cue_text(F.lit(text)), I.term_pattern(F.lit(name))).alias("x")).first()["x"]
    assert (r is not None) == fits


def test_cue_text(spark):
    r = spark.range(1).select(I.cue_text(F.lit("  The Über-Cat\n(sat)\ton [it]; it's  OK! ")).alias("x"), I.cue_text(F.lit(None).cast("string")).alias("y"), I.term_pattern(F.lit("!!")).alias("z")).first()
    assert (r["x"], r["y"], r["z"]) == ("the über-cat sat on it ; it's ok!", "", None)


CUES = [
    ("voltage in a wire is a prerequisite for transformers.", "Voltage", "Transformer", 1.0, "explicit_prerequisite"),
    ("before we discuss transformers in depth let us understand voltage", "Voltage", "Transformer", 0.95, "pedagogical_precedence"),
    ("a transformer in practice depends on voltage", "Voltage", "Transformer", 0.9, "reliance_dependency"),
    ("recall voltage here because we will use it for transformers", "Voltage", "Transformer", 0.85, "recall_relevance"),
    ("voltage and transformers are nice", "Voltage", "Transformer", 0.0, None),
    ("transformers in theory is a prerequisite for voltage.", "Voltage", "Transformer", 0.0, None),
]


def test_cues(spark):
    d = spark.createDataFrame(CUES, "t string, a string, b string, score double, name string")
    got = d.withColumn("c", I.cue(I.cue_text(F.col("t")), I.term_pattern(F.col("a")), I.term_pattern(F.col("b")))).collect()
    assert all((r["c"]["score"], r["c"]["cue"]) == (r["score"], r["name"]) for r in got)
    assert len(fixed.CUE_PATTERNS) == 20


def lecture(rng, k):
    names = ["Voltage", "Page Table", "Core", "Cache", "Thread", "Kernel"]
    said = ["nothing here", "the {a} is near the {b}", "{a} in a box is needed for {b}", "recall {a} here because we will use it for {b}", "{a}s", "a {b} in use relies on {a}"]
    chunks = []
    for i in range(12):
        a, b = rng.sample(names, 2)
        low = lambda x: x.lower()
        chunks.append((k, i, 30.0 * (i // 2), rng.choice(said).format(a=low(a), b=low(b)), rng.choice(["", low(rng.choice(names))]), rng.choice(["", "a picture"])))
    segments = [(k, p, rng.choice(["Intro", *names]), 30.0 * p - 5 * (p > 0), [3 * p, 3 * p + 1, 3 * p + 2]) for p in range(4)]
    relations = [(k, *rng.sample(range(6), 2), rng.choice(fixed.RELATIONS)) for _ in range(5)]
    return [(k, i, n) for i, n in enumerate(names)], chunks, segments, relations


def plain_pattern(name):
    return r"[\s-]+".join(re.escape(w) + "(?:s|es)?" for w in name.lower().split())


def test_candidates_against_loops(spark):
    """Every ordered pair of every lecture, judged one by one."""
    rng = random.Random(5)
    parts = [lecture(rng, k) for k in range(4)]
    e = spark.createDataFrame([r for p in parts for r in p[0]], "lecture_id int, entity_id int, name string")
    c = spark.createDataFrame([r for p in parts for r in p[1]], "lecture_id int, chunk_id int, ts double, transcript string, ocr_text string, visual_context string")
    s = spark.createDataFrame([r for p in parts for r in p[2]], "lecture_id int, place int, title string, start double, chunk_ids array<int>")
    r = spark.createDataFrame([r for p in parts for r in p[3]], "lecture_id int, src int, dst int, relation string")
    profile = I.profiles(e, c, s)
    prof = {(x["lecture_id"], x["entity_id"]): x for x in profile.collect()}
    got = {(x["lecture_id"], x["src"], x["dst"]): x for x in I.candidate_pairs(profile, r, c).collect()}
    listed, scored = set(), {}
    for k, (entities, chunks, segments, relations) in enumerate(parts):
        own = {}
        for _, i, name in entities:
            find = lambda t: re.search(rf"\b{plain_pattern(name)}\b", t.lower())  # noqa: B023, E731
            at = [(ts, find(" ".join((a, b, v))).start(), n) for _, n, ts, a, b, v in chunks if find(" ".join((a, b, v)))]
            heads = any(find(b) or find(v) for _, _, _, _, b, v in chunks)
            titled = [(start, p, find(t).start()) for _, p, t, start, _ in segments if find(t)]
            ids = {n for *_, n in at}
            places = {p for _, p, _, _, own_ids in segments if ids & set(own_ids)} | {p for _, p, _ in titled}
            t, off = min(at)[:2] if at else (None, None)
            if titled and (t is None or min(titled)[0] < t):
                t, off = min(titled)[0], min(titled)[2]
            own[i] = (t, off, ids, places)
            x = prof[k, i]
            assert (x["t"], x["offset"], set(x["chunk_ids"]), set(x["places"]), x["in_headings"], x["in_first_segment"]) == (t, off, ids, places, bool(heads or titled), 0 in places)
        cue = {}
        for i, a in enumerate(entities):
            for j, b in enumerate(entities):
                best = 0.0
                for _, _, _, text, *_ in chunks:
                    for template, score, _ in fixed.CUE_PATTERNS:
                        if re.search(template.replace("{A}", plain_pattern(a[2])).replace("{B}", plain_pattern(b[2])), text.lower()):
                            best = max(best, score)
                cue[i, j] = best
        for i in own:
            for j in own:
                if i == j:
                    continue
                fwd = {x for _, p, q, x in relations if (p, q) == (i, j)}
                rev = {x for _, p, q, x in relations if (p, q) == (j, i)}
                near = bool(own[i][2] & own[j][2]) or any(abs(p - q) <= 3 for p in own[i][3] for q in own[j][3])
                if not (fwd or rev or near):
                    assert (k, i, j) not in got
                    continue
                listed.add((k, i, j))
                x = got[k, i, j]
                late = own[i][0] is None or own[j][0] is None or (own[i][0] > own[j][0] and not ("PREREQUISITE_OF" in fwd or "DERIVED_FROM" in rev or cue[i, j] >= 0.8))
                assert (x["reason"] == "temporal_order") == late and set(x["forward"]) == fwd and set(x["reverse"]) == rev
                if own[i][2] & own[j][2]:
                    assert x["discourse"] == cue[i, j]
                scored[k, i, j] = x
    assert listed == set(got) and any(x["reason"] for x in scored.values()) and any(x["discourse"] >= 0.85 for x in scored.values())
    out = I.inferred(e, c, s, r)
    rows = out.collect()
    assert rows and all(x["confidence"] >= 0.65 for x in rows)
    assert {x["on_cycles"] for x in graph.validated(out).collect()} == {0}
