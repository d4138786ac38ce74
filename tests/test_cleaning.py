"""Titles, cleaning, aliases and numbers against loops."""

import random
import re

from pyspark.sql import functions as F

from quillspan.functions import fixed
from quillspan.functions import text as X
from quillspan.operators import cleaning, numbering, titles
from quillspan.plans import cleaning as plans

SF = "/root/testdata/sf0.001"
CHUNK = "segment_id long, pos long, ocr_text string, visual_context string, transcript string"


def noisy(text):
    w = [x.lower() for x in re.findall(r"\b[A-Za-z]+\b", text)]
    return not w or (len(w) >= 4 and len(set(w)) / len(w) < 0.4) or (len(set(w)) == 1 and len(w[0]) <= 3)


def loop_title(chunks, cleaned):
    """(title, source) of a segment's chunks (ocr, seen, said) in order."""

    def tidy(t):
        return " ".join(re.sub("[#*`_>]+", "", t).split()[:8]) or "Untitled Segment"

    for ocr, _, _ in chunks:
        for line in (ocr or "").strip().splitlines():
            line = line.strip().strip('"').strip("'")
            if 1 <= len(line.split()) <= 8 and any(c.isalpha() for c in line) and not any(x in line.lower() for x in fixed.SLIDE_BOILERPLATE):
                return tidy(line), "ocr"
    for _, seen, _ in chunks:
        first = re.split(r"(?<=[.!?])\s+", re.sub(r"^[\s#>*_`\-]+", "", (seen or "").strip()).strip())[0].strip()
        if first.split() and not first.lower().startswith(tuple(fixed.CAPTION_OPENERS)):
            return tidy(" ".join(first.split()[:8])), "caption"
    noise = {w for x in [*fixed.SLIDE_BOILERPLATE, *fixed.CAPTION_OPENERS] for w in x.split()} | {*fixed.TITLE_STOPWORDS, *fixed.CAPTION_WORDS}
    weight, spelt = {}, {}
    for chunk in chunks:
        for text, w in zip(chunk, (3.0, 2.0, 1.0), strict=True):
            for word in re.findall(r"[A-Za-z][A-Za-z'\-]*", text or ""):
                if len(word) >= 3 and word.lower() not in noise:
                    weight[word.lower()] = weight.get(word.lower(), 0) + w
                    spelt.setdefault(word.lower(), word)
    if weight:
        return tidy(" ".join(spelt[w] for w in sorted(weight, key=lambda w: -weight[w])[:6])), "keywords"
    for _, _, said in chunks:
        raw = (said or "").strip()
        clean = cleaned[raw]
        if noisy(raw) or not clean or noisy(clean):
            continue
        w = clean.split()
        if len(w[0]) <= 2 or not w[0][0].isupper():
            at = next((i for i, x in enumerate(w) if x[0].isupper() and len(x) > 2), 0)
            clean = " ".join(w[at:]) if at else clean
        head = clean[:60].strip()
        head = head.rsplit(" ", 1)[0] if len(clean) > 60 else head
        if head and not noisy(head):
            return tidy(head), "phrase"
    return "Untitled Segment", "none"


def loop_titles(spark, rows):
    raws = sorted({(r[4] or "").strip() for r in rows})
    cleaned = {r.t: r.c for r in spark.createDataFrame([(t,) for t in raws], "t string").select("t", X.clean_transcript(F.col("t")).alias("c")).collect()}
    segments = {}
    for r in sorted(rows):
        segments.setdefault(r[0], []).append(r[2:])
    return {s: loop_title(c, cleaned) for s, c in segments.items()}


def test_each_source_of_a_title(spark):
    rows = [
        (1, 0, "Subscribe now\n 42 \none two three four five six seven eight nine\n'## Virtual *Memory*'\nLater", "A cat.", "x"), (1, 1, "Earlier?", None, None),
        (2, 0, None, "The image shows it.", None), (2, 1, "", "### - Page tables map. Then more.", None),
        (3, 0, "12", "this slide", "the paging paging Cache"), (3, 1, "copyright cache like", None, "Cache of pages"),
        (4, 0, None, None, "ea ea ea ea"), (4, 1, None, None, "t be They could have been with them and so there is one other thing that they could have said about this"),
        (5, 0, None, None, None), (6, 0, "", "", "ok"), (7, 0, "a\rb b", None, None),
    ]
    got = {r.segment_id: (r.title, r.source) for r in titles.titles(spark.createDataFrame(rows, CHUNK), "segment_id").collect()}
    assert got == loop_titles(spark, rows)
    assert [got[i][1] for i in range(1, 6)] == ["ocr", "caption", "keywords", "phrase", "none"]


def test_titles_of_all_segments(spark):
    rows = [tuple(r) for r in plans.title_chunks(spark, SF).select("segment_id", "pos", "ocr_text", "visual_context", "transcript").collect()]
    got = {r.segment_id: (r.title, r.source) for r in plans.title_cascade(spark, SF).collect()}
    assert got == loop_titles(spark, rows)
    assert {s for _, s in got.values()} >= {"ocr", "caption", "keywords", "phrase"}


def test_numbers_of_groups_that_span_tasks(spark):
    made = random.Random(15)
    rows = [(made.choice(["hot", "hot", "hot", "b", None]), made.choice([None, *range(200)]), i) for i in range(3000)]
    got = numbering.numbered(spark.createDataFrame(rows, "g string, o long, i long").repartition(7), ["g"], ["o", "i"]).collect()
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(r[0], []).append(r[2])
    assert {(r.g, r.nth): r.i for r in got} == {(g, n + 1): i for g, v in groups.items() for n, i in enumerate(v)}
    assert numbering.numbered(spark.createDataFrame([], "g string, o long"), ["g"], ["o"]).collect() == []


def test_cleaning_cascades(spark):
    entities = [("a", "1", "Cache"), ("a", "2", "So that it works"), ("a", "3", "one two three four five six seven"), ("a", "4", "Page"), ("b", "1", "Disk"), ("b", "4", None)]
    relations = [("a", "1", "4", 3), ("a", "4", "1", 1), ("a", "1", "2", 3), ("a", "3", "1", 2), ("a", "1", "9", 2), ("a", "4", "4", 2), ("b", "1", "1", 2), ("b", "1", "4", 3), ("b", "4", "1", 0)]
    e = spark.createDataFrame(entities, "lecture_id string, entity_id string, name string")
    r = spark.createDataFrame(relations, "lecture_id string, src string, dst string, tier int")
    kept, left = cleaning.cleaned(e, r, ["lecture_id"], ["src", "dst"])
    assert sorted((x.lecture_id, x.entity_id) for x in kept.collect()) == [("a", "1"), ("a", "4"), ("b", "1")]
    assert sorted(map(tuple, left.select("lecture_id", "relation_id", "src", "dst").collect())) == [("a", "rel_000001", "1", "4"), ("a", "rel_000002", "4", "4"), ("b", "rel_000001", "1", "1")]
    _, more = cleaning.cleaned(e, r, ["lecture_id"], ["src", "dst"], drop_tiers=[0])
    assert more.count() == 4


def test_aliases_and_their_counts(spark):
    relations, aliases = plans._aliased(spark, SF)
    known = spark.createDataFrame([(0, "extra")], "window_id long, entity_id string")
    more = relations.union(spark.createDataFrame([(0, 90, "extra", "E1"), (0, 91, "nobody", "E1"), (0, 92, "E1", None)], relations.schema))
    ids, by_alias, want = {(0, "extra")}, {}, []
    for r in aliases.collect():
        by_alias[r.window_id, r.alias] = r.entity_id
        ids.add((r.window_id, r.entity_id))
    every = more.collect()
    for r in every:
        end = [by_alias.get((r.window_id, x)) or (x if (r.window_id, x) in ids else None) for x in (r.src, r.dst)]
        if all(end):
            want.append((r.window_id, r.nth, *end))
    got, counts = cleaning.remapped(more, aliases, known, ["window_id"])
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert counts.get == {"mapped": len(want), "dropped": len(every) - len(want)}
