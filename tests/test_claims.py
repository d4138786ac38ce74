"""Matching with gold standards against loops over all items; substring joins and evidence against nested loops."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspan.functions import fixed
from quillspan.functions import text as X
from quillspan.operators import claims, containment
from quillspan.plans import audits

SF = "/root/testdata/sf0.001"


def normal(name):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9_\s]", " ", (name or "").strip().lower())).strip()


def singular(t):
    for end, put in fixed.PLURAL_RULES:
        if len(t) > 3 and t.endswith(end):
            made = t[: len(t) - len(end)] + put
            return made if len(made) >= 3 else t
    return t


def lemma(name):
    return " ".join(singular(t) for t in re.split(r"[\s_-]+", normal(name)) if t)


def keys(name, aliases):
    return {lemma(c) for c in [name, *aliases.get(name, [])]} if name else set()


def inside(a, b):
    return bool(a) and bool(b) and (a in b or b in a)


def alias_table(rows):
    out = {}
    for alias, canonical in sorted({(normal(a), normal(c)) for a, c in rows}):
        if alias and canonical:
            out.setdefault(alias, []).append(canonical)
    return out


def loop_relations(predicted, gold, aliases):
    golds = sorted({(normal(s), r.strip(), normal(t)) for s, r, t in gold})
    aliases, free, out = alias_table(aliases), set(golds), {}
    for item, _, s, rel, t in sorted(predicted, key=lambda r: r[1]):
        s, t = normal(s), normal(t)
        fits = lambda a, b, g: lemma(g[0]) in keys(a, aliases) and lemma(g[2]) in keys(b, aliases) and g[0] and g[2]
        forward = [g for g in golds if g in free and g[1] == rel and fits(s, t, g)]
        back = [g for g in golds if g in free and g[1] == rel and fits(t, s, g)]
        joined = [g for g in golds if (g[0], g[2]) in ((s, t), (t, s)) or fits(s, t, g) or fits(t, s, g)]
        fuzzy = [g for g in golds if g in free and g[1] == rel and inside(g[0], s) and inside(g[2], t)]
        name, some = ("FORWARD", forward) if forward else ("REVERSED", back) if back else ("TYPE_MISMATCH", []) if joined else ("FUZZY", fuzzy) if fuzzy else ("UNMATCHED", [])
        out[item] = (name, *(some[0] if some else (None, None, None)))
        free -= set(some[:1])
    return out


def loop_names(predicted, gold, aliases):
    golds = sorted({normal(g) for g in gold} - {""})
    table, free, out = {a: [c for c in v if c in golds] for a, v in alias_table(aliases).items()}, set(golds), {}
    for item, _, name in sorted(predicted, key=lambda r: r[1]):
        p = normal(name)
        stages = [[g for g in golds if g == p], table.get(p, []), [g for g in golds if lemma(g) == lemma(p)], sorted(c for a, v in table.items() if lemma(a) == lemma(p) for c in v)]
        hits = [(g, n) for n, v in zip(("EXACT", "ALIAS", "LEMMA", "ALIAS_LEMMA"), stages, strict=True) for g in v if g in free and p]
        out[item] = hits[0] if hits else (None, None)
        free -= {g for g, _ in hits[:1]}
    return out


def loop_prerequisites(predicted, gold, aliases, fuzzy):
    aliases, free, out = alias_table(aliases), {g[0] for g in gold}, {}
    for item, _, _, s, t in sorted(predicted, key=lambda r: (-(1.0 if r[2] is None else r[2]), r[1])):
        s, t = normal(s), normal(t)
        strict = [g for g, a, b in sorted(gold) if g in free and normal(a) and normal(b) and lemma(a) in keys(s, aliases) and lemma(b) in keys(t, aliases)]
        loose = [g for g, a, b in sorted(gold) if g in free and inside(normal(a), s) and inside(normal(b), t)] if fuzzy else []
        some = (strict or loose)[:1]
        out[item] = some[0] if some else None
        free -= set(some)
    return out


NAMES = ["Transformer", "transformers", "Core", "Cores", "AC", "Alternating Current", "current", "eddy current", "Loss", "", " ! ", None, "Box", "boxes", "magnetic field", "Magnetic-Fields", "_", "Old core"]
ALIASES = [("AC", "Alternating Current"), ("ac", "current"), ("tr", "Transformer"), ("TRs", "Transformer"), ("x", ""), ("field", "Magnetic Field")]


def test_relations_against_the_loop(spark):
    made = random.Random(8)
    types = fixed.RELATIONS[:3]
    predicted = [(i, 1000 - 2 * i if i % 3 else 2 * i + 1, made.choice([*NAMES, "tr", "field"]), made.choice(types), made.choice(NAMES)) for i in range(300)]
    gold = [(made.choice(NAMES) or "", made.choice(types), made.choice(NAMES) or "") for _ in range(60)]
    got = claims.matched_relations(spark.createDataFrame(predicted, "item long, turn long, source string, relation string, target string"), spark.createDataFrame(gold, "source string, relation string, target string"), spark.createDataFrame(ALIASES, "alias string, canonical string"))
    want = loop_relations(predicted, gold, ALIASES)
    assert {r.item: tuple(r)[1:] for r in got.collect()} == want
    assert set(Counter(w[0] for w in want.values())) == {"FORWARD", "REVERSED", "TYPE_MISMATCH", "FUZZY", "UNMATCHED"}


def test_names_against_the_loop(spark):
    made = random.Random(9)
    for n in (1, 200):
        predicted = [(i, (7 * i) % 211, made.choice([*NAMES, "tr", "trs", "fields"])) for i in range(n)]
        gold = [made.choice(NAMES) or "" for _ in range(12)]
        got = claims.matched_names(spark.createDataFrame(predicted, "item long, turn long, name string"), spark.createDataFrame([(g,) for g in gold], "name string"), spark.createDataFrame(ALIASES, "alias string, canonical string"))
        assert {r.item: (r.target, r.stage) for r in got.collect()} == loop_names(predicted, gold, ALIASES)


@pytest.mark.parametrize("fuzzy", [False, True])
def test_prerequisites_against_the_loop(spark, fuzzy):
    made = random.Random(10)
    predicted = [(i, i, made.choice([None, 0.65, 0.7, 0.9]), made.choice(NAMES), made.choice(NAMES)) for i in range(250)]
    gold = [(i, made.choice(NAMES) or "", made.choice(NAMES) or "") for i in range(50)]
    got = claims.matched_prerequisites(spark.createDataFrame(predicted, "item long, turn long, confidence double, source string, target string"), spark.createDataFrame(gold, "gold_item long, source string, target string"), spark.createDataFrame(ALIASES, "alias string, canonical string"), fuzzy)
    assert {r.item: r.gold_item for r in got.collect()} == loop_prerequisites(predicted, gold, ALIASES, fuzzy)


def test_claims_in_a_chain_and_of_nothing(spark):
    chain = [(i, t, i, c) for i in range(30) for c, t in enumerate((i, i + 1)) if i] + [(0, 1, 0, 0)]
    got = {r.item: r.target for r in claims.claimed(spark.createDataFrame(chain, "item long, target long, turn long, choice long")).collect()}
    assert got == {0: 1, **{i: i + 1 for i in range(1, 30)}}
    assert claims.claimed(spark.createDataFrame([], "item long, target long, turn long, choice long")).collect() == []


def test_queries_against_the_loops(spark):
    take = lambda d: [tuple(r) for r in d.collect()]
    aliases = take(audits.gold_aliases(spark, SF))
    predicted, gold = take(audits.predicted_relations(spark, SF)), take(audits.gold_relations(spark, SF))
    some = [r for r in predicted if r[1] <= sorted(p[1] for p in predicted)[400]]
    d = spark.createDataFrame(some, "item long, turn long, source string, relation string, target string")
    got = claims.matched_relations(d, audits.gold_relations(spark, SF), audits.gold_aliases(spark, SF))
    assert {r.item: tuple(r)[1:] for r in got.collect()} == loop_relations(some, gold, aliases)
    # the whole table: every gold once, the summary adds up
    whole = take(audits.relation_gold_match(spark, SF))
    assert len(whole) == len(predicted) == len({r[0] for r in whole})
    used = Counter(r[2:] for r in whole if r[2] is not None)
    assert max(used.values()) == 1 and set(used) <= {(normal(s), r, normal(t)) for s, r, t in gold}
    s = audits.relation_gold_scores(spark, SF).first()
    n = Counter(r[1] for r in whole)
    assert (s.tp, s.reversed, s.type_mismatch, s.unmatched, s.predicted) == (n["FORWARD"] + n["FUZZY"], n["REVERSED"], n["TYPE_MISMATCH"], n["UNMATCHED"], len(predicted))
    e = audits._spelt(spark, SF).collect()
    names = loop_names([(r.entity_id, r.entity_id, r.said) for r in e], [r["name"] for r in e], aliases)
    assert {r.item: (r.target, r.stage) for r in audits.entity_gold_match(spark, SF).collect()} == names


def test_prerequisite_query_against_the_loop(spark):
    p = sorted(map(tuple, audits._predicted_prerequisites(spark, SF).collect()))
    gold, aliases = list(map(tuple, audits._gold_prerequisites(spark, SF).select("gold_item", "source", "target").collect())), list(map(tuple, audits.gold_aliases(spark, SF).collect()))
    got = {r.item: (r.strict, r.fuzzy) for r in audits.prerequisite_gold_match(spark, SF).collect()}
    strict, fuzzy = (loop_prerequisites(p, gold, aliases, f) for f in (False, True))
    assert got == {i: (strict[i], fuzzy[i]) for i in strict}
    s = {r.kind: r for r in audits.prerequisite_gold_scores(spark, SF).collect()}
    for kind, found in (("strict", strict), ("fuzzy", fuzzy)):
        tp = sum(v is not None for v in found.values())
        pr, rc = tp / len(p), tp / len(gold)
        assert (s[kind].tp, s[kind].precision, s[kind].recall, s[kind].f1) == (tp, round(pr, 4), round(rc, 4), round(2 * pr * rc / (pr + rc), 4))


def test_contained_against_nested_loops(spark):
    made = random.Random(11)
    letters = "aab c\n."
    texts = [(made.choice("xy"), i, "".join(made.choice(letters) for _ in range(made.randrange(30)))) for i in range(80)] + [("x", 90, None), ("y", 91, "é日本 long " * 5000)]
    names = [(made.choice("xy"), "".join(made.choice(letters) for _ in range(made.randrange(6)))) for _ in range(120)] + [("x", None), ("y", "日"), ("y", "日本 l"), ("x", "é")]
    got = containment.contained(spark.createDataFrame(texts, "lecture_id string, text_id long, text string"), spark.createDataFrame(names, "lecture_id string, name string"), ["lecture_id"])
    assert sorted(map(tuple, got.collect())) == sorted({(k, i, n) for k, i, t in texts for j, n in names if k == j and t and n and n in t})
    assert not re.search("NestedLoop|Cartesian", got._jdf.queryExecution().executedPlan().toString())


def test_evidence_stages(spark):
    texts = [("l", 1, "A coil is here. The core is there."), ("l", 2, "A coil and a core. The coil uses the core."), ("l", 3, "The core uses the coil. Nothing."), ("m", 4, "The coil uses a diode.")]
    said = [("l", " Coil", "core"), ("l", "core", "coil"), ("l", "coil", "there"), ("l", "here", "coil"), ("l", "coil", "diode"), ("m", "coil", "Diode"), ("l", "nothing", "uses the c")]
    got = containment.evidence(spark.createDataFrame(said, "lecture_id string, source string, target string"), spark.createDataFrame(texts, "lecture_id string, text_id long, text string"), fixed.RELATION_INDICATORS, ["lecture_id"])
    # text 2 has both names first in a sentence without a verb: the first sentence decides
    want = {(" Coil", "core"): (3, 3, 0), ("core", "coil"): (3, 3, 0), ("coil", "there"): (1, 1, None), ("here", "coil"): (2, 1, 0), ("coil", "diode"): (0, None, None), ("coil", "Diode"): (3, 4, 0), ("nothing", "uses the c"): (1, 3, None)}
    assert {(r.source, r.target): (r.tier, r.text_id, r.sentence) for r in got.collect()} == want


def test_keys_are_those_of_the_loop(spark):
    d = spark.createDataFrame([(n,) for n in NAMES if n], "n string").select("n", X.normalize_name(F.col("n")), X.lemma_key(F.col("n")))
    assert all(tuple(r)[1:] == (normal(r[0]), lemma(r[0])) for r in d.collect())
