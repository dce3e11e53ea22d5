"""Operators against plain Python on small literal rows."""


import math
import random
import zipfile
from difflib import SequenceMatcher
from itertools import combinations

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import relations, text, triples, vectors
from tessera.operators import chunking, dedup, extraction, figures, linking, models, paths, phrases, quality, questions, retrieval, stats, weighting
from tessera.operators.components import connected_components
from tessera.plans import graph_queries
from tessera.plans.config import CHUNKS_BY_LANGUAGE, merged, settings
from tessera.plans.graph_build import build_with_retrieval
from tessera.sources import documents, files, sinks
from tessera.streaming import ingest


def one(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expression.alias("x")).first().x


# --- functions -------------------------------------------------------------------------------
@pytest.mark.parametrize(("name", "want"), [("a<b>: c/d", "ab_cd"), ("  __ ", "untitled"), ("x" * 80, "x" * 50), ("日本 語", "日本_語")])
def test_file_names(spark, name, want):
    assert one(spark, text.sanitize_filename(F.col("t")), t=name) == want


@pytest.mark.parametrize(("a", "b", "want"), [("1.2", "1.10", -1), ("1.0", "1", 0), ("2.0.1", "2.0", 1), ("1.x", "1.y", -1), ("b", "a", 1)])
def test_versions(spark, a, b, want):
    assert one(spark, text.compare_versions(F.col("a"), F.col("b")), a=a, b=b) == want


@pytest.mark.parametrize(("value", "want"), [("", "unknown"), ("これは日本語の文です", "ja"), ("这是一个中文句子的例子", "zh"), ("plain words", "en"), ("한국어 문장입니다", "ko"), ("ÀÉÎÕÜàéîõü", "other")])
def test_languages(spark, value, want):
    assert one(spark, text.detect_language(F.col("t"), korean=True), t=value) == want


def test_sentences(spark):
    assert one(spark, text.split_sentences(F.col("t")), t="One. Two! 三。 four") == ["One.", "Two!", "三。", "four"]
    assert one(spark, text.split_japanese_sentences(F.col("t")), t="一。二！三") == ["一。", "二！", "三"]


def test_short_fuzzy_hashes(spark):
    assert [one(spark, text.fuzzy_hash(F.col("t")), t=t) for t in ("", "ab", "a b c")] == ["", "", "90015098"]


@pytest.mark.parametrize(("a", "b", "want"), [("Part-Of", "part_of", 1.0), ("part_of", "has_part", 0.9), ("cause_of", "leads_to", 0.7), ("optimizes", "encodes", 0.5), ("utilizes", "accelerates", 0.5), ("foo", "bar", 0.3)])
def test_compatibility(spark, a, b, want):
    assert one(spark, relations.compatibility(F.col("a"), F.col("b")), a=a, b=b) == want


@pytest.mark.parametrize(("s", "r", "o", "want"), [("alpha", "uses", "beta", 1.0), ("", "x", "b", 0.3), ("12", "uses", "beta", 0.7), ("alpha", "is", "beta", 0.7), ("Same", "uses", "same", 0.5), ("uses", "uses", "uses", 0.2), ("日本", "uses", "beta", 1.0), ("--", "of", "3", 0.0)])
def test_penalty(spark, s, r, o, want):
    assert one(spark, triples.quality_penalty(F.col("s"), F.col("r"), F.col("o")), s=s, r=r, o=o) == pytest.approx(max(want, 0.0), abs=0.11 if s == "--" else 1e-9)


def test_parsers_of_answers(spark):
    assert [tuple(t) for t in one(spark, triples.parse_tuples(F.col("t")), t="so (a b, uses, c) and (d,e , f)")] == [("a b", "uses", "c"), ("d", "e", "f")]
    assert [tuple(t) for t in one(spark, triples.parse_json_triples(F.col("t")), t='```json\n[["a"," b","c"],["x","y"],["1","2","3","4"]]\n```')] == [("a", "b", "c")]
    assert tuple(one(spark, triples.parse_refined(F.col("t")), t="Subject: cats\nRelation: chase\nObject: mice")) == ("cats", "chase", "mice")
    assert one(spark, triples.parse_refined(F.col("t")), t="NO_IMPROVEMENT") is None
    answer = one(spark, figures.parse_answer(F.col("t")), t='Sure: {"type": "chart", "confidence": 0.9} ok')
    assert (answer.type, answer.confidence, answer.summary) == ("chart", 0.9, "")
    assert one(spark, figures.parse_answer(F.col("t")), t="nothing here").type == "unknown"


def test_embedding_is_of_unit_length(spark):
    emb = one(spark, vectors.hashing_embedding(F.col("t")), t="some entity")
    assert math.isclose(sum(x * x for x in emb), 1.0) and len(emb) == 64


# --- operators -------------------------------------------------------------------------------
def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80), (80, 85)], "a long, b long")
    assert {r.node: r.component for r in connected_components(links).collect()} == {i: 0 for i in range(41)} | {80: 80, 85: 80, 90: 80}


def test_intra_by_counts_equals_pairs(spark):
    rows = [(1, 1, "a", "part_of", "b"), (1, 2, "a", "has_part", "b"), (1, 3, "b", "part_of", "a"), (1, 4, "a", "uses", "a"), (1, 5, "c", "encodes", "d"), (1, 6, "c", "optimizes", "a"), (1, 7, "a", "part_of", "b"), (2, 1, "a", "x", "c"), (2, 2, "c", "part_of", "c")]
    df = spark.createDataFrame(rows, "doc_id long, triple_idx int, s string, r string, o string")
    compat = {(r.r1, r.r2): r.compat for r in relations.compatibility_table(df).collect()}
    want: dict = {}
    for x, y in combinations(rows, 2):
        if x[0] == y[0]:
            w = compat[x[3], y[3]] * 0.6 + len({x[2], x[4]} & {y[2], y[4]}) * 0.5 * 0.4
            if w > 0.3:
                for t in (x, y):
                    edge = tuple(sorted((t[2], t[4])))
                    want[edge] = want.get(edge, 0.0) + w
    got = {(r.src, r.dst): r.intra_raw for r in weighting.intra_raw(df).collect()}
    assert got == pytest.approx(want)


def test_phrases_in_texts(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["alpha", "be", "gamma-ray", "d", "ein", "eine", "x.y"]) + draw.choice(["", "", ",", "\n"]) for _ in range(draw.randrange(25))) for _ in range(60)] + ["", None]
    known = ["alpha", "lph", "be", "e", "d", "ein eine", "a-ray, d", "ein be d", "pha be d ei", "be  be", "gamma-ray alpha be d ein eine x.y alpha be d e", "no such phrase here", "zz", " ", " be", ""] + [t[2:40] for t in texts if t and len(t) > 45]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(p,) for p in known], "phrase string")
    want = {(p, i) for p in known if p.strip() for i, t in enumerate(texts) if t and p in t}
    got = [tuple(r) for r in phrases.holders(docs, asked).collect()]
    assert set(got) == want and len(got) == len(want)
    first = {p: min(i for q, i in want if q == p) for p, _ in want}
    assert {r.phrase: r.doc_id for r in phrases.first_holders(docs, asked).collect()} == first


@pytest.mark.parametrize("threshold", [0.11, 0.33, 0.5])
def test_inter_by_counts_equals_pairs(spark, threshold):
    draw = random.Random(5)
    names, kinds = "abcdefgh", ["part_of", "has_part", "uses", "encodes", "optimizes"]
    rows = [(draw.randrange(3), i, draw.choice(names), draw.choice(kinds), draw.choice(names)) for i in range(90)] + [(9, 0, "x", "uses", "y"), (9, 1, "y", "uses", "x")]
    rows += [(9, 2, "a", "uses", "a"), (9, 3, "a", "part_of", "a")]
    df = spark.createDataFrame(rows, "doc_id long, triple_idx int, s string, r string, o string")
    compat = {(r.r1, r.r2): r.compat for r in relations.compatibility_table(df).collect()}
    top = {r.entity for r in weighting.top_entities_of(df, 4).collect()}
    linked = {frozenset((s, o)) for _, _, s, _, o in rows}
    want: dict = {}
    for x, y in combinations(rows, 2):
        shared = {x[2], x[4]} & {y[2], y[4]}
        if shared & top:
            hops = 0 if x[2] == y[2] else 1 if frozenset((x[2], y[2])) in linked else 2
            w = min(1.0, min(len(shared) * 0.5, 1.0) * 0.4 + compat[x[3], y[3]] * 0.3 + 0.3 * (1 - hops / 3) * 0.1)
            if w > threshold:
                for t in (x, y):
                    edge = tuple(sorted((t[2], t[4])))
                    want[edge] = want.get(edge, 0.0) + w
    zeros = df.select(F.col("s").alias("entity"), F.array(F.lit(0.0)).alias("emb")).distinct()
    for found in (weighting.inter_raw_alike(df, zeros, threshold, 4), weighting.inter_raw(df, threshold, 4)):
        got = {(r.src, r.dst): r.inter_raw for r in found.collect() if r.inter_raw > 1e-9}
        assert got == pytest.approx(want)


def test_doc_links_by_rare_entities(spark):
    draw = random.Random(8)
    rows = [(d, i, draw.choice("abcdefghij"), "r", draw.choice("abcdefghij")) for d in range(30) for i in range(draw.randrange(6))]
    held: dict = {}
    for d, _, s, _, o in rows:
        held.setdefault(d, set()).update((s, o))
    for k in (0, 2, 4):
        want = {(a, b, len(held[a] & held[b])) for a, b in combinations(sorted(held), 2) if len(held[a] & held[b]) > k}
        got = weighting.doc_links(spark.createDataFrame(rows, "doc_id long, triple_idx int, s string, r string, o string"), k).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def shuffled(spark, action) -> int:
    """Rows that an action's stages write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: sum(s.shuffleWriteRecords() for s in map(stages().apply, range(stages().size())))
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    before = total()
    action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


@pytest.mark.parametrize("hot", [1, 4, 8])
def test_doc_links_with_hot_entities(spark, hot):
    draw = random.Random(hot)
    rows = [(d, i, draw.choice("abcdefghij"), "r", draw.choice("aaaabbbcdefghijklmnop")) for d in range(40) for i in range(draw.randrange(6))]
    held: dict = {}
    for d, _, s, _, o in rows:
        held.setdefault(d, set()).update((s, o))
    for k in (0, 1, 2, 4):
        want = {(a, b, len(held[a] & held[b])) for a, b in combinations(sorted(held), 2) if len(held[a] & held[b]) > k}
        got = weighting.doc_links(spark.createDataFrame(rows, "doc_id long, triple_idx int, s string, r string, o string"), k, hot).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_doc_links_write_no_pairs(spark):
    rows = [(d, i, f"e{(d * 7 + i * i) % 60}", "r", f"f{d}") for d in range(600) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, triple_idx int, s string, r string, o string")
    held: dict = {}
    for d, _, s, _, _ in rows:
        held.setdefault(s, set()).add(d)
    pairs = sum(len(x) * (len(x) - 1) // 2 for x in held.values())
    assert shuffled(spark, lambda: weighting.doc_links(df).count()) < pairs / 2


@pytest.mark.parametrize(("block", "cells"), [(7, 5), (2048, 256), (3, 200)])
def test_similar_pairs_by_cells(spark, block, cells):
    draw = random.Random(block)
    rows = [(f"v{i}", [draw.gauss(0, 1) + 3 * ((i // 20) % 3 == k) for k in range(4)]) for i in range(150)] + [("zero", [0.0] * 4), ("copy", [1.0, 1.0, 0.0, 0.0]), ("copy2", [2.0, 2.0, 0.0, 0.0])]
    held = {n: [x / math.hypot(*v) for x in v] for n, v in rows if any(v)}
    for threshold in (0.5, 0.95):
        got = {(r.a, r.b): r.similarity for r in linking.similar_pairs(spark.createDataFrame(rows, "id string, emb array<double>"), threshold, block, cells).collect()}
        want = {(a, b): s for a, b in combinations(sorted(held), 2) if (s := sum(x * y for x, y in zip(held[a], held[b], strict=True))) >= threshold}
        assert got == pytest.approx(want)
    assert linking.similar_pairs(spark.createDataFrame([], "id long, emb array<double>"), 0.5).count() == 0


def test_canonical_names_by_documents(spark):
    groups = spark.createDataFrame([("Big Cat", "Big Cat"), ("cat", "Big Cat"), ("felid", "Big Cat"), ("dog", "dog"), ("hound", "dog")], "entity string, leader string")
    docs = spark.createDataFrame([(1, "a CAT and a felid"), (2, "the big cat"), (3, "felids are cats"), (4, None)], "doc_id long, text string")
    names = linking.canonical_by_documents(groups, docs)
    assert {r.old: r.canonical for r in names.collect()} == {"Big Cat": "cat", "cat": "cat", "felid": "cat", "dog": "dog", "hound": "dog"}
    assert linking.linking_summary(names).first() == (5, 2, 3, ["cat", "dog"])


def test_entity_contexts_and_profiles(spark):
    docs = spark.createDataFrame([(1, "One. Two cats. Three."), (2, "No animal here. At all."), (3, "Cats again."), (4, "")], "doc_id long, text string")
    mentions = spark.createDataFrame([(1, "cat"), (2, "cat"), (3, " cat "), (2, "dog"), (3, "dog"), (4, "fox")], "doc_id long, entity string")
    found = chunking.entity_contexts(docs, mentions)
    assert {tuple(r) for r in found.collect()} == {("cat", 1, 1, "One. Two cats. Three."), ("cat", 3, 0, "Cats again."), ("dog", 2, -1, "No animal here."), ("fox", 4, -1, "")}
    assert {r.entity: r.profile for r in linking.profiles(found).collect()}["cat"] == "One. Two cats. Three. Cats again."


def test_path_records(spark):
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.3), ("c", "d", 0.1)], "src string, dst string, weight double")
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "a"]), (3, ["a", "b", "c", "d"]), (4, ["a"])], "path_id long, path array<string>")
    emb = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 2.0])], "node string, emb array<double>")
    got = {r.path_id: r for r in paths.path_records(rows, edges, emb).collect()}
    assert [got[i].hops for i in (1, 2, 3, 4)] == [2, 1, None, None] and [got[i].nodes for i in (1, 2, 3, 4)] == [3, 2, 4, 1]
    assert got[1].adjacent_similarity == pytest.approx(0.5) and got[2].adjacent_similarity == pytest.approx(1.0) and got[3].sum_weight == pytest.approx(0.9)


def test_chunks_by_language(spark):
    docs = spark.createDataFrame([(1, "x" * 600), (2, "これは日本語の文です。" * 60)], "doc_id long, text string")
    got = {(r.doc_id, r.chunk_type): r.n for r in chunking.dual_chunks_by_language(docs, CHUNKS_BY_LANGUAGE).groupBy("doc_id", "chunk_type").agg(F.max("chunk_size").alias("n")).collect()}
    assert got == {(1, "semantic"): 320, (1, "structural"): 512, (2, "semantic"): 200, (2, "structural"): 350}


def test_leaders_are_greedy(spark):
    v = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    rows = [(f"e{d}", i, v(d), "en" if d < 50 else "ja") for i, d in enumerate((0, 20, 40, 55, 170))]
    got = {r.entity: r.leader for r in linking.multilingual_leaders(spark.createDataFrame(rows, "entity string, seq long, emb array<double>, language string")).collect()}
    want = dict(linking.leaders(((n, __import__("numpy").array(e), lang) for n, _, e, lang in rows), 0.90, 0.85))
    assert got == want and want["e20"] == "e0" and want["e40"] == "e40"


def beam(edges, sims, start, steps, width, most):
    near: dict = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    queue, seen, found = [([start], 0)], {start}, []
    while queue and len(found) < most:
        path, depth = queue.pop(0)
        if depth < steps:
            best = sorted(((-(sims.get(n, 0.0) * 0.6 + w * 0.4), n) for n, w in near.get(path[-1], []) if n not in seen))[:width]
            for score, n in best:
                seen.add(n)
                found.append(([*path, n], -score))
                queue.append(([*path, n], depth + 1))
    return found


@pytest.mark.parametrize("most", [3, 50])
def test_beam_search(spark, most):
    edges = [("a", "b", 0.9), ("a", "c", 0.8), ("a", "d", 0.7), ("b", "e", 0.5), ("c", "e", 0.9), ("c", "f", 0.2), ("e", "g", 0.4), ("d", "g", 0.1), ("f", "h", 0.3)]
    sims = {"e": 0.5, "g": 0.1, "d": 0.2}
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    starts = spark.createDataFrame([(1, "a"), (1, "h"), (2, "z")], "query_id long, start string")
    scores = spark.createDataFrame([(1, n, s) for n, s in sims.items()], "query_id long, node string, sim double")
    got = sorted((r.start, tuple(r.path), round(r.score, 9)) for r in paths.beam_paths(df, starts, scores, 3, 2, most).collect())
    assert got == sorted((s, tuple(p), round(x, 9)) for s in ("a", "h") for p, x in beam(edges, sims, s, 3, 2, most))
    ranked = paths.ranked_paths(paths.beam_paths(df, starts, scores, 3), df, scores, 5).collect()
    assert [r["rank"] for r in sorted(ranked, key=lambda r: -r.final_score)] == [1, 2, 3, 4, 5]


def test_embedding_is_that_of_each_gram():
    import zlib

    texts = ["", "a", "ab", "Abc", "naïve Straße", "日本語の文", "😀 smile 😀", None, "x" * 5000]
    for n in (1, 3, 4):
        for text, got in zip(texts, vectors.embedded_all(texts, 16, n), strict=True):
            plain, sums = (text or "").lower(), [0.0] * 16
            for i in range(max(1, len(plain) - n + 1)):
                h = zlib.crc32(plain[i : i + n].encode())
                sums[h % 16] += 1.0 if h >> 20 & 1 else -1.0
            size = math.sqrt(sum(x * x for x in sums))
            assert got.tolist() == pytest.approx([x / size if size > 1e-9 else x for x in sums])


def test_router():
    router = models.Router({"api": lambda p, t: f"api {p} {t.max_tokens}", "local": lambda p, t: f"local {t.temperature}"})
    assert router.call("triplet", "x") == "api x 1024" and router.switched("local").call("quality", "x") == "local 0.15"
    changed = router.updated("refiner", max_tokens=5)
    assert changed.call("refiner", "y") == "api y 5" and router.call("refiner", "y") == "api y 2048" and changed.status()["tasks"]["refiner"]["max_tokens"] == 5
    with pytest.raises(ValueError):
        models.Router({"api": print}).switched("local")


def test_retries():
    calls = []

    def fails(times):
        calls.append(1)
        if len(calls) <= times:
            raise OSError
        return "good"

    assert models.with_retries(fails, "default", 3, 0)(2) == "good" and len(calls) == 3
    calls.clear()
    assert models.with_retries(fails, "default", 3, 0)(5) == "default" and len(calls) == 3


def test_model_answers_and_caches(spark):
    for answer, want in (('say {"issues": [{"type": "a", "reason": "r"}]}', ["a"]), ('{"issues": ["b", "c"]}', ["b", "c"]), ("no", []), ('{"issues": []}', [])):
        assert one(spark, models.issues_in(F.col("t")), t=answer) == want
    figs = spark.createDataFrame([(1, "p1", "c", "h1"), (2, "p2", None, "h2"), (3, "p3", "d", "h2"), (4, "p4", "e", None)], "figure_id long, path string, caption string, image_hash string")
    cache = spark.createDataFrame([("h1", "known")], "image_hash string, answer string")
    seen, new = models.analysed_figures(figs, cache, lambda path, caption: f"{path}/{caption}")
    assert {(r.figure_id, r.answer) for r in seen.collect()} == {(1, "known"), (2, "p2/"), (3, "p2/"), (4, None)}
    assert {r.image_hash for r in new.where("image_hash is not null").collect()} == {"h2"}
    rows = models.embedded_once(spark.createDataFrame([(1, "ab c"), (2, None), (3, "ab c")], "id long, t string"), "t").collect()
    assert {r.id: r.emb for r in rows} == {1: pytest.approx(unit("ab c")), 2: [0.0] * 64, 3: pytest.approx(unit("ab c"))}


def test_quality_with_an_embedding(spark):
    docs = spark.createDataFrame([(1, "the same line\nthe same line\nother words here"), (2, "alpha beta\nsomething else\nthird one"), (3, " "), (4, "one line (")], "doc_id long, text string")
    got = {r.doc_id: (r.issues, r.severity, r.route) for r in quality.routed(docs, vectors.hashing_embedding, models.plain_check).collect()}
    assert got == {1: (["potential_contradiction", "missing_subject"], "high", "flagged"), 2: ([], "low", "clean"), 3: (["empty"], "low", "flagged"), 4: (["too_short", "missing_subject", "structural_damage"], "high", "flagged")}


def unit(text):
    return vectors.embedded(text)


def near(a, b):
    return sum(x * y for x, y in zip(unit(a), unit(b), strict=True))


def test_nodes_for_questions(spark):
    names = [f"node {c}{i}" for c in "abcdef" for i in range(9)]
    asked = [(1, "what is node c4?"), (2, "tell me of f8 and a1")]
    nodes = spark.createDataFrame([(n, []) for n in names], "node string, chunk_ids array<string>")
    got = {(r.query_id, r.node) for r in questions.nodes_for_questions(spark.createDataFrame(asked, "query_id long, question string"), nodes).collect()}
    assert got == {(q, n) for q, text in asked for n in sorted(names, key=lambda n: (-round(near(text, n), 9), n))[:5]}


def test_sample_questions(spark):
    docs = spark.createDataFrame([(1, "A first sentence of a text. More."), (2, "Short."), (3, "No end " * 40)], "doc_id long, text string")
    edges = spark.createDataFrame([("hub", x, "r" if x != "b" else None, w) for x, w in (("a", 0.1), ("b", 0.9), ("c", 0.5))], "src string, dst string, relation string, weight double")
    got = {r.question for r in questions.sample_questions(docs, edges, 6).collect()}
    every = {"What is hub?", "How does hub work?", "What is a?", "How does a work?", "What is b?", "How does b work?", "A first sentence of a text", ("No end " * 40).strip()[:100], "How is hub related to b?", "How is hub r c?"}
    assert len(got) == 6 and got <= every
    assert {r.question for r in questions.sample_questions(docs, edges, 60).collect()} >= every


def test_question_to_answer(spark):
    edges = [("lava", "volcano", 0.9), ("basalt", "lava", 0.8), ("ash", "volcano", 0.3), ("glacier", "ice", 0.7), ("ice", "water", 0.6)]
    texts = {1: "A volcano throws out lava and ash.", 2: "A glacier is made of ice.", 3: "Nothing of this kind at all."}
    df = spark.createDataFrame([(a, b, "r", w) for a, b, w in edges], "src string, dst string, relation string, weight double")
    chunks = chunking.dual_chunks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    graph = {r.doc_id: r.chunk_id for r in chunks.where("chunk_type = 'structural'").collect()}
    of = {"volcano": [graph[1]], "lava": [graph[1]], "glacier": [graph[2]]}
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    nodes = spark.createDataFrame([(n, of.get(n, [])) for n in names], "node string, chunk_ids array<string>")
    asked = [(1, "What does a volcano throw out?"), (2, "Is a glacier made of ice?"), (3, "Nothing of this kind at all?")]
    store = retrieval.build_store(chunks.where("chunk_type = 'semantic'"))
    out = {r.query_id: r for r in questions.answer(spark.createDataFrame(asked, "query_id long, question string"), df, nodes, store, chunking.overlapping(chunks), top_k=1, max_steps=3).collect()}
    weight = {frozenset(e[:2]): e[2] for e in edges}
    for q, text in asked:
        best = max(texts, key=lambda d: near(text, texts[d]))
        sims = {n: near(text, n) for n in names}
        starts = [n for n in names if graph[best] in of.get(n, [])] or sorted(names, key=lambda n: (-round(sims[n], 9), n))[:5]
        found = [(s, p, x) for s in starts for p, x in beam(edges, sims, s, 3, 2, 50)]
        if sum(x for _, _, x in found) / len(found) < 0.7:
            found = [(s, p, x) for s in starts for p, x in beam(edges, sims, s, 5, 2, 50)]
        scored = []
        for s, p, x in found:
            steps = [weight[frozenset(e)] for e in zip(p, p[1:], strict=False)]
            scored.append((-(0.4 * x + 0.25 * sum(steps) / len(steps) + 0.15 / (1 + 0.1 * len(p)) + 0.2 * max(sims[n] for n in p)), s, p))
        lines = [f"{' → '.join(p)} ({-x:.3f})" for x, _, p in sorted(scored)[:3]]
        assert out[q].answer == "\n".join(lines) and out[q].documents == texts[best] + "..."


def test_fuzzy_pairs(spark):
    base = "the cat sat on the mat and looked at the moon for a long time before it went to sleep again "
    docs = spark.createDataFrame([(1, base * 2), (2, base * 2 + "!"), (3, base * 2), (4, "the other text entirely"), (5, "")], "doc_id long, text string")
    got = [(r.a_id, r.b_id, r.similarity) for r in dedup.fuzzy_pairs(docs, blocking="prefix").collect()]
    assert got == [(1, 2, SequenceMatcher(None, base * 2, base * 2 + "!").ratio())]


def test_fuzzy_pairs_with_an_early_edit_and_copies(spark):
    base = "the cat sat on the mat and looked at the moon for a long time before it went to sleep again " * 2
    other = base.replace("looked", "l00k", 1)
    rows = [(1, base), (2, other), (3, base)] + [(10 + i, base + "!" * (i + 1)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = dedup.fuzzy_pairs(docs)
    ranked = dedup.ranked_duplicates(pairs.union(dedup.copies(docs))).collect()
    texts = dict(rows)
    got = {(r.a_id, r.b_id): r.similarity for r in ranked}
    distinct = [d for d, _ in rows if d != 3]
    want = {(a, b): q for a, b in combinations(distinct, 2) if (q := SequenceMatcher(None, texts[a], texts[b]).ratio()) >= 0.85}
    assert (1, 2) in want and got == want | {(1, 3): 1.0}
    assert max(r.rank for r in ranked) > 50


def test_levenshtein_of_whole_texts(spark):
    head, rest = "one licence header of many files, " * 8, "the body of a text that goes on for a while, "
    rows = [(1, head + rest * 40), (2, head + rest[::-1] * 40), (3, head + rest * 39 + "and it ends here"), (4, head[:45] + "#" * 150 + head[195:] + rest * 40)]
    got = {(r.a_id, r.b_id) for r in dedup.fuzzy_pairs(spark.createDataFrame(rows, "doc_id long, text string"), measure="levenshtein").collect()}
    assert got == {(1, 3), (1, 4), (3, 4)}


def test_paragraph_packing():
    parts = ["a" * 40, "b" * 40, "c" * 40, "d" * 200]
    assert chunking.pack_paragraphs(parts, 100, 0) == ["a" * 40 + "\n\n" + "b" * 40, "c" * 40, "d" * 200]
    assert chunking.pack_paragraphs(parts[:3], 100, 50) == ["a" * 40 + "\n\n" + "b" * 40, "b" * 40 + "\n\n" + "c" * 40]


def test_quality(spark):
    assert one(spark, quality.has_figure_context(F.col("t")), t="see Fig. 3") and not one(spark, quality.has_figure_context(F.col("t")), t="figures of speech")
    assert one(spark, quality.repeats_lines(F.col("t")), t="the same line\nthe same line\nother words")
    assert not one(spark, quality.repeats_lines(F.col("t")), t="alpha beta\nsomething else\nthird one")


def test_figures(spark):
    f = spark.createDataFrame([(7, 1, 1, [0.0, 0.0, 60.0, 60.0]), (7, 2, 2, [0.0, 0.0, 60.0, 60.0]), (7, 3, 9, [0.0, 0.0, 10.0, 60.0]), (8, 4, 1, [0.0, 0.0, 60.0, 60.0]), (9, 5, 1, [0.0, 0.0, 60.0, 60.0])], "doc_id int, figure_id int, page int, bbox array<double>")
    c = spark.createDataFrame([(7, "a", 1, [0.0, 500.0, 1.0, 600.0], 0), (7, "b", 1, [0.0, 40.0, 1.0, 60.0], 1), (7, "c", 3, None, 2), (7, "d", 3, None, 3), (8, "e", 5, None, 4)], "doc_id int, chunk_id string, page int, bbox array<double>, seq int")
    assert {r.figure_id: r.chunk_id for r in figures.aligned(f, c).collect()} == {1: "b", 2: "a", 3: "c", 4: "e"}
    assert figures.large_enough(f).count() == 4


def test_small_things(spark):
    assert documents.flattened({"a": {"b": {"x": 1, "y": 2}}}) == {"x": 1, "y": 2} and documents.flattened({"x": 1}) == {"x": 1}
    assert documents.missing_keys({"a": 1}, ("a", "c", "b")) == ["b", "c"]
    rows = spark.createDataFrame([("f1", "success"), ("f1", "success"), ("f2", "failed"), ("f3", "skipped")], "path string, status string")
    assert stats.batch_summary(rows).first() == (3, 1, 1, 1, 2) and stats.batch_summary(rows.limit(0)).first() == (0, 0, 0, 0, 0)
    assert sinks.run(spark, "SELECT :a + 1 AS x", a=2).first().x == 3


def test_documents_with_paths(spark):
    docs = spark.createDataFrame([(1, "What is it? Ask why so now."), (2, "nothing"), (3, "Ask why so")], "doc_id long, text string")
    records = spark.createDataFrame([("Ask why so", [["a", "b"]], [1.0]), ("What is", [["c"]], [2.0])], "question string, translated_paths array<array<string>>, path_distances array<double>")
    got = {r.doc_id: r.translated_paths for r in documents.documents_with_paths(docs, records).collect()}
    assert got == {1: [["a", "b"]], 2: None, 3: [["a", "b"]]}


def test_captions(spark):
    figs = spark.createDataFrame([(1, 1, 1, [0.0, 100.0, 9.0, 200.0]), (1, 2, 2, [0.0, 100.0, 9.0, 200.0]), (1, 3, 3, [0.0, 100.0, 9.0, 200.0]), (2, 4, 1, [0.0, 0.0, 9.0, 9.0])], "doc_id int, figure_id int, page int, bbox array<double>")
    rows = [(1, 1, 80.0, 90.0, "Figure 9. above"), (1, 1, 240.0, 250.0, "Fig. 1 far below"), (1, 1, 215.0, 225.0, "some words"), (1, 2, 85.0, 95.0, "TABLE 2 above"), (1, 2, 300.0, 310.0, "Figure too far"), (1, 3, 210.0, 220.0, "b" * 200), (1, 3, 50.0, 60.0, "first")]
    got = {r.figure_id: r.caption for r in figures.captions(figs, spark.createDataFrame(rows, "doc_id int, page int, y0 double, y1 double, text string")).collect()}
    assert got == {1: "Fig. 1 far below", 2: "TABLE 2 above", 3: ("first " + "b" * 200)[:150], 4: ""}


def test_collected_files(spark, tmp_path):
    for name in ("a.TXT", "b.md", "sub/c.txt", "sub/d.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    names = lambda **k: [r.path.rsplit("/", 1)[1] for r in files.collect_files(spark, str(tmp_path), **k).collect()]
    assert names() == ["a.TXT", "b.md", "c.txt", "d.pdf"] and names(extensions=("txt", ".MD")) == ["a.TXT", "b.md", "c.txt"]
    assert names(extensions=("txt",), patterns=("*.pdf", "b.*")) == ["b.md", "d.pdf"]


@pytest.mark.parametrize("encoding", ["utf-8", "cp932", "euc_jp", "utf-16", "utf-8-sig"])
def test_japanese_encodings(encoding):
    value = "これは日本語の文章です。漢字とかなとカタカナを含みます。" * 5
    assert files.decode_text(value.encode(encoding)) == value
    assert files.decode_text("café à la crème".encode("latin-1")) == "café à la crème"


def test_mojibake(spark):
    for value in ("naïve café", "日本語の文", "Straße – “quoted”"):
        assert one(spark, text.repair_mojibake(F.col("t")), t=value.encode().decode("latin-1")) == value
        assert one(spark, text.repair_mojibake(F.col("t")), t=value) == value
    assert one(spark, text.repair_mojibake(F.col("t")), t="Ã and more") == "Ã and more"


def test_tei_of_pdfs(spark):
    pdfs = spark.createDataFrame([("a.pdf", b"1", "h1"), ("b.pdf", b"2", "h2"), ("c.pdf", b"2", "h2"), ("d.pdf", b"bad", "h3")], "path string, content binary, file_hash string")
    out, new = files.with_tei(pdfs, spark.createDataFrame([("h1", "known")], "file_hash string, tei string"), lambda data: f"tei{int(data)}", wait=0)
    assert {r.path: r.tei for r in out.collect()} == {"a.pdf": "known", "b.pdf": "tei2", "c.pdf": "tei2", "d.pdf": None}
    assert [tuple(r) for r in new.collect()] == [("h2", "tei2")]
    plain = files.parse_tei_plain("x", b"<TEI><teiHeader/><text><body><div><p>short</p></div><div><head>H</head><p>a</p><p>b</p></div></body></text></TEI>")
    assert plain == ("Unknown", ["Unknown Author"], [("Untitled Section", 0, "short"), ("H", 1, "a\nb")])


def test_validator(spark):
    rows = [(1, 1, "A", "before", "B"), (1, 2, "b", "after", "a"), (1, 3, "a", "Before", "b"), (1, 4, "x", "uses", "X"), (1, 5, "A", "part-of", "C"), (1, 6, "A", "contains", "C"), (1, 7, "A", "likes", "C")]
    got = extraction.consistent(spark.createDataFrame(rows, "doc_id long, triple_idx int, s string, r string, o string"))
    assert sorted(r.triple_idx for r in got.collect()) == [1, 5, 7]


def test_triples_find_documents(spark):
    docs = spark.createDataFrame([(1, "Nothing here"), (2, "The Quick fox"), (3, "quick and lazy")], "doc_id long, text string")
    rows = spark.createDataFrame([(0, 1, "quick", "is", "zz"), (0, 2, "none", "is", "lazy"), (0, 3, "no", "is", "qq")], "doc_id long, triple_idx int, s string, r string, o string")
    assert {r.triple_idx: r.doc_id for r in extraction.to_documents(rows, docs).collect()} == {1: 2, 2: 3, 3: 1}


def test_refiner(spark):
    texts = spark.createDataFrame([(1, "Large cats chase small mice at night.")], "doc_id long, text string")
    rows = spark.createDataFrame([(1, 0, "it", "of", "x"), (1, 1, "Large cats", "uses", "small mice")], "doc_id long, triple_idx int, s string, r string, o string")
    out = extraction.refined(rows, texts, lambda s, r, o, t: "Subject: Large cats\nRelation: causes\nObject: small mice").collect()
    assert {(r.triple_idx, r.attempted, r.succeeded) for r in out} == {(0, True, True), (1, False, False)}


# --- sources and sinks -----------------------------------------------------------------------
def test_files(spark, tmp_path):
    body = "A paragraph that is long enough to be kept as a section of its own."
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.md").write_text(f"---\ntitle: Notes\nauthors: [Ann, Bob]\n---\n{body}\n# First\n{body}\n```\n# not a heading\n```\n# Short\nx\n# Last\n{body}")
    (tmp_path / "two.html").write_text(f"<html><head><title>T</title><meta name=author content='Cy'></head><body><p>{body}<h2>Head</h2><script>p()</script><p>{body}</p><p></p></body>")
    (tmp_path / "three.tei.xml").write_text(f'<TEI xmlns="http://x"><teiHeader><titleStmt><title level="a" type="main">A long enough title</title></titleStmt><persName><forename>Di</forename><surname>Ek</surname></persName></teiHeader><text><div><head>Intro</head><p>{body}</p></div><div><p>short</p></div></text></TEI>')
    (tmp_path / "four.txt").write_text(f"{body}\n\n{body}")
    (tmp_path / "five.md").write_text((tmp_path / "a/one.md").read_text())
    (tmp_path / "six.xml").write_text("<TEI><broken")
    (tmp_path / "seven.bin").write_bytes(b"\0\1")
    with zipfile.ZipFile(tmp_path / "eight.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>{body}</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Part</w:t></w:r></w:p><w:p><w:r><w:t>{body}</w:t></w:r></w:p></w:body></w:document>')
    rows = files.ingest(spark, str(tmp_path)).collect()
    found = {(r.source_format, r.section, r.section_index, r.status) for r in rows}
    assert {("html", "Introduction", 0, "success"), ("html", "Head", 1, "success"), ("tei", "Intro", 0, "success"), ("txt", "Chunk 1", 0, "success"), ("docx", "Introduction", 0, "success"), ("docx", "Part", 1, "success"), ("markdown", "Introduction", 0, "success"), ("markdown", "First", 1, "success"), ("markdown", "Last", 3, "success"), ("tei", None, None, "failed"), (None, None, None, "skipped")} == found
    assert sum(r.source_format == "markdown" for r in rows) == 3  # equal files are read once
    assert {r.authors for r in rows if r.source_format in ("markdown", "html", "tei") and r.title} == {"Ann, Bob", "Cy", "Di Ek"}
    sections = files.ingest(spark, str(tmp_path), "*.md")
    note = {r.file: r.note for r in sinks.notes(sections).collect()}
    assert "Next: [[01_First]]" in note["00_Introduction.md"] and "Previous: [[01_First]]" in note["03_Last.md"]
    assert sinks.write_notes(sinks.notes(sections), f"file://{tmp_path}/notes").count() == 3
    assert sinks.note_index(sections).first()["index"].startswith("- [[00_Introduction]]")
    assert documents.provenance(spark.read.format("binaryFile").load(str(tmp_path / "four.txt"))).first().file_size == len(body) * 2 + 2


def test_json_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"documents": [{"text": "one", "metadata": {"title": "T"}}, {"text": "two"}, {"text": "one"}]}')
    docs = documents.load_documents(documents.load_json(spark, str(tmp_path / "d.json")), documents.load_texts(spark, ["two", "three"]))
    assert sorted((r.part, r.place, r.text) for r in docs.collect()) == [(0, 0, "one"), (0, 1, "two"), (1, 1, "three")]


def test_upserts(spark, tmp_path):
    path = str(tmp_path / "edges")
    edges = lambda rows: spark.createDataFrame(rows, "src string, dst string, relation string, weight double")
    assert sinks.with_provenance(edges([("a", "b", "r", 0.5)]), "Paper").select("source_paper", "section", "confidence").first() == ("Paper", "unknown", 1.0)
    figures_at, links = spark.createDataFrame([(1, "x"), (2, "y")], "figure_id long, type string"), spark.createDataFrame([(1, "c1"), (2, "gone")], "figure_id long, chunk_id string")
    for _ in range(2):
        sinks.upsert_figures(spark, figures_at, links, spark.createDataFrame([("c1",)], "chunk_id string"), str(tmp_path / "fig"))
    assert sinks.read_table(spark, str(tmp_path / "fig/figures")).count() == 2 and sinks.read_table(spark, str(tmp_path / "fig/aligned_with")).collect() == [(1, "c1")]
    assert tuple(sinks.upsert_edges(spark, edges([("a", "b", "r", 0.5), ("a", "c", "r", 0.035)]), path).first()) == (1, 1)
    sinks.upsert_edges(spark, edges([("a", "b", "r", 0.7), ("b", "c", "r", 0.2)]), path)
    sinks.upsert_edges(spark, edges([("a", "b", "r", 0.7), ("b", "c", "r", 0.2)]), path)
    assert sorted((r.src, r.dst, r.weight) for r in sinks.read_table(spark, path).collect()) == [("a", "b", 0.7), ("b", "c", 0.2)]
    rows = dedup.content_records(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id long, text string"))
    for _ in range(2):
        sinks.insert_if_absent(spark, rows, str(tmp_path / "content"), "text_hash")
    held = sinks.read_all(spark, str(tmp_path / "content"), rows)
    assert sinks.is_unique(held, "text_hash") and held.count() == 2
    sinks.export_graph(sinks.read_table(spark, path), str(tmp_path / "nt"), "ntriples")
    assert "<urn:entity:a> <urn:entity:r> <urn:entity:b> ." in (tmp_path / "nt").glob("*.txt").__next__().read_text()


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    for i, texts in enumerate((["a", "b", "a"], ["b", "c"])):
        spark.createDataFrame([(10 * i + k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(source))
    stream = ingest.document_stream(spark, str(source), "doc_id long, text string", 1)
    ingest.ingest_new(stream, str(tmp_path / "registry"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


# --- plans -----------------------------------------------------------------------------------
def test_settings():
    assert settings("strict_quality", top_entities=5).top_entities == 5
    with pytest.raises(ValueError):
        settings(nonsense=1)
    with pytest.raises(ValueError):
        settings(graph_chunk_overlap=512)
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_graph_build(spark):
    docs = spark.createDataFrame([(1, "Alpha uses Beta. Beta uses Gamma now today. Gamma enables Delta."), (2, "Alpha uses Beta. Delta requires Alpha always then."), (3, "Alpha uses Beta. Delta requires Alpha always then.")], "doc_id long, text string")
    graph, store, overlap = build_with_retrieval(docs, settings(final_weight_cutoff=0.0))
    edges = graph.edges.collect()
    assert edges and all(0 < r.weight <= 1 for r in edges)
    assert store.count() == overlap.count() == 2


# --- whole tables in queries -------------------------------------------------------------------
def test_extracted_triples_come_from_whole_texts(spark, tmp_path):
    from tessera.plans.queries import QUERIES

    words = [f"Word{i}" for i in range(900)]
    spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["extracted_triples"](spark, str(tmp_path)).collect()
    text = " ".join(words)
    chunks = [text[i : i + 512] for i in range(0, len(text) - 50, 462)]
    want = [t for c in chunks for t in extraction.plain_extractor(c)[:15]]
    assert sorted((r.s, r.r, r.o) for r in got) == sorted(want) and len(chunks) > 10


def test_retrieval_store_holds_all_chunks(spark, tmp_path):
    from tessera.plans.queries import QUERIES

    whole = " ".join(f"word{i}" for i in range(300))
    spark.createDataFrame([(1, whole)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["retrieval_store"](spark, str(tmp_path)).collect()
    assert len({r.chunk_id for r in rows}) == len(rows) == math.ceil((len(whole) - 320) / 200) + 1
    assert all(abs(sum(x * x for x in r.emb) - 1) < 1e-4 for r in rows)


def test_common_subsequences():
    from tessera.operators.dedup import in_common, places

    def longest(a: str, b: str) -> int:
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *row[1:]]
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        return row[-1]

    draw = random.Random(3)
    for _ in range(300):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randrange(30))) for _ in "ab")
        b = a[draw.randrange(4) :] + b[:3] if draw.random() < 0.5 else b
        want = longest(a, b)
        assert all(in_common(places(a), len(a), b, need, step) == (want >= need) for need in range(32) for step in (1, 4, 128))


def test_consistency_without_a_call_for_each_pair(spark):
    draw = random.Random(5)
    names = ["causes", "caused by", "is", "Is_Not", "has", "lacks", "near"]
    rows = [(1, i, draw.choice("abc"), draw.choice(names), draw.choice("ABcd")) for i in range(120)]
    found = extraction.consistent(spark.createDataFrame(rows, "doc_id long, triple_idx int, s string, r string, o string"))
    against = {"causes": "caused by", "caused by": "causes", "is": "is not", "is not": "is", "has": "lacks", "lacks": "has"}
    want, seen, kept = [], set(), set()
    for _, i, s, r, o in rows:
        ends, name = (s.lower(), o.lower()), r.lower().replace("_", " ")
        if ends[0] == ends[1] or (ends, name) in seen:
            continue
        seen.add((ends, name))
        if (frozenset(ends), against.get(name)) not in kept:
            kept.add((frozenset(ends), name))
            want.append(i)
    assert sorted(r.triple_idx for r in found.collect()) == want
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_figures_among_many_chunks(spark):
    draw = random.Random(9)
    box = lambda: None if draw.random() < 0.1 else [0.0, float(draw.randrange(30)), 1.0, float(draw.randrange(30))]
    f = [(draw.randrange(3), i, draw.randrange(8), box()) for i in range(80)]
    c = [(draw.randrange(2), f"c{i}", draw.choice([0, 1, 2, 6]), box(), i) for i in range(60)]
    centre = lambda b: None if b is None else (b[1] + b[3]) / 2
    want = {}
    for d, i, page, b in f:

        def place(x, d=d, page=page, b=b):
            y, z, away = centre(b), centre(x[3]), abs(x[2] - page)
            return (min(away, 2), (math.inf if y is None or z is None else abs(y - z)) if away == 0 else 0 if away == 1 else away, x[4])

        own = [x for x in c if x[0] == d]
        if own:
            want[i] = min(own, key=place)[1]
    schema = "page int, bbox array<double>"
    got = figures.aligned(spark.createDataFrame(f, f"doc_id int, figure_id int, {schema}"), spark.createDataFrame(c, f"doc_id int, chunk_id string, {schema}, seq int"))
    assert {r.figure_id: r.chunk_id for r in got.collect()} == want


def test_similar_pairs_send_few_copies(spark):
    draw = random.Random(2)
    rows = [(i, [draw.gauss(0, 1) for _ in range(4)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, emb array<float>")
    assert shuffled(spark, lambda: linking.similar_pairs(df, 0.9999).count()) < 3 * len(rows)  # a vector once and to two other cells at most


def test_alignments_equal_the_expression(spark):
    from tessera.functions import triples as tf

    draw = random.Random(4)
    words = ["Cat", "dog", "uses", "employs", "part_of", "İx", "é", "", None, "is_a", "kind"]
    texts = [(1, "The cat uses a DOG, a kind of é " * 3), (1, "dog employs cat"), (2, None), (3, "i̇x " + "pad " * 30 + "part of dog"), (None, "cat"), (5, "")]
    rows = [(draw.choice([1, 2, 3, 4, 5, None]), i, draw.choice(words), draw.choice(words), draw.choice(words)) for i in range(300)]
    t = spark.createDataFrame(rows, "doc_id long, triple_idx int, s string, r string, o string")
    x = spark.createDataFrame(texts, "doc_id long, text string")
    want = t.join(x, "doc_id").withColumn("alignment", tf.context_alignment(F.col("s"), F.col("r"), F.col("o"), F.col("text"))).drop("text")
    got = extraction.alignments(t, x)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.columns == want.columns


def test_intra_of_many_documents(spark, monkeypatch):
    draw = random.Random(7)
    names = ["part_of", "Has-Part", "cause_of", "caused_by", "contains", "includes", "is", "uses", "own words", "other words", "samples"]
    rows = [(d, i, draw.choice("abcd"), draw.choice(names), draw.choice(["a", "b", "c", "d", None])) for d in range(30) for i in range(1 if d % 3 else 40)]
    rows += [(None, 1, "a", "is", "b"), (1, 99, "a", None, "b"), (0, 98, None, "is", None)]
    df = spark.createDataFrame(rows, "doc_id long, triple_idx int, s string, r string, o string")
    compat = {(r.r1, r.r2): r.compat for r in relations.compatibility_table(df.where("r is not null")).collect()}
    want: dict = {}
    for x, y in combinations([r for r in rows if r[0] is not None and r[3] is not None], 2):
        w = compat[x[3], y[3]] * 0.6 + len(({x[2], x[4]} & {y[2], y[4]}) - {None}) * 0.5 * 0.4
        if x[0] == y[0] and w > 0.3:
            for t in (x, y):
                ends = [e for e in (t[2], t[4]) if e is not None] or [None]
                edge = (min(ends), max(ends)) if ends != [None] else (None, None)
                want[edge] = want.get(edge, 0.0) + w
    for many in (1 << 16, 16):
        monkeypatch.setattr(weighting, "INTRA_ROWS", many)
        parts = [pa.RecordBatch.from_pylist([{"doc_id": d, "r": r.lower().replace("-", "_"), "src": min(filter(None, (s, o)), default=None), "dst": max(filter(None, (s, o)), default=None)} for d, _, s, r, o in sorted((x for x in rows if x[0] is not None and x[3]), key=lambda x: x[0])[i : i + 9]]) for i in range(0, len(rows), 9)]
        sums: dict = {}
        for x in (x for b in weighting._intra_batches(iter([b.cast(pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("r", "src", "dst"))])) for b in parts if b.num_rows])) for x in b.to_pylist()):
            sums[x["src"], x["dst"]] = sums.get((x["src"], x["dst"]), 0.0) + x["w"]
        assert {k: v for k, v in sums.items() if v > 1e-9} == pytest.approx(want)
    got = {(r.src, r.dst): r.intra_raw for r in weighting.intra_raw(df).where("intra_raw > 1e-9").collect()}
    assert got == pytest.approx(want)


def test_intra_sends_a_triple_to_its_document_once(spark):
    rows = [(d, i, f"e{d}-{i}", ("part_of", "uses")[i % 2], f"e{d % 7}") for d in range(200) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, triple_idx int, s string, r string, o string")
    assert shuffled(spark, lambda: weighting.intra_raw(df).count()) < 2.5 * len(rows)


def test_brands_of_orders_are_dealt_by_rows(spark, sf, monkeypatch):
    want = set(graph_queries.brand_triples(spark, sf).collect())
    monkeypatch.setattr(graph_queries, "TASK_ROWS", 500)
    found = graph_queries.brand_triples(spark, sf)
    rows = found.collect()
    assert set(rows) == want and len(rows) == len(want)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    plan = weighting.bridge_entities(found)._jdf.queryExecution().sparkPlan().toString()
    dealt = next(i for i, x in enumerate(plan.splitlines()) if "REPARTITION_BY_NUM" in x and "l_orderkey" in x and f", {-(-lines // 500)})" in x)
    assert not any("Aggregate" in x for x in plan.splitlines()[dealt:])


def test_first_holders_look_at_distinct_tokens(spark):
    draw = random.Random(9)
    texts = ["".join(draw.choice(["alpha", "be", "Ñoño", "日本", "x.y"]) + draw.choice([" ", " ", "\n", "\r\n", "\t ", "\u00a0", "\u2003", ""]) for _ in range(draw.randrange(30))) for _ in range(80)] + ["z" * 3000 + "needle" + "z" * 3000, "a\nb" * 900 + "pin\n", ""]
    known = ["alpha", "be\nÑoño", "\nbe", "本\r\n日", "日", "x.", "be\u00a0be", "needle", "zneedlez", "bpin\n", "\n", "be alpha", "alpha\t be", "absent\nhere", "oñ", "a\nba\nb", "qq", "\t"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = {p: min(i for i, t in enumerate(texts) if p in t) for p in known if any(p in t for t in texts)}
    asked = spark.createDataFrame([(p,) for p in known], "phrase string")
    assert {r.phrase: r.doc_id for r in phrases.first_holders(docs, asked).collect()} == want


def test_first_holders_write_no_rows_of_all_texts(spark, monkeypatch):
    words = [f"word{i}" for i in range(50)]
    docs = spark.createDataFrame([(d, " ".join(words) + "\nlast") for d in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(w,) for w in [*words, "word49\nlast"]], "phrase string")
    written, cut = [], phrases.cut_lineage

    def counted(df, name):
        written.append((out := cut(df, name)).count())
        return out

    monkeypatch.setattr(phrases, "cut_lineage", counted)
    assert {r.doc_id for r in phrases.first_holders(docs, asked).collect()} == {0}
    assert 0 < max(written) < 300 * 50 / 4


def test_each_text_is_embedded_once(spark):
    chunks = spark.createDataFrame([(i, f"{i}", f"text {i % 40}") for i in range(200)] + [(999, "none", "")], "doc_id long, chunk_id string, chunk string")
    calls = spark.sparkContext.accumulator(0)

    def embed(x):
        @F.pandas_udf("array<double>")
        def run(texts):
            calls.add(len(texts))
            return pd.Series([vectors.embedded(t) if t else [0.0] * 64 for t in texts])

        return run(x)

    rows = retrieval.build_store(chunks, embed).collect()
    assert len(rows) == 200 and all(r.emb == pytest.approx(vectors.embedded(r.chunk)) for r in rows)
    assert calls.value == 41


def test_windows_of_long_texts(spark):
    texts = ["", "x", *("".join(chr(97 + i * i % 23) if i % 7 else "ñ" for i in range(k)) for k in (319, 320, 321, 6720, 6721, 13_000))]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    for size, step in ((320, 200), (512, 462), (5, 7)):
        want = {(d, i, i * step, min(i * step + size, len(t)), t[i * step : i * step + size]) for d, t in enumerate(texts) if t for i in range(max(0, -((size - len(t)) // step)) + 1)}
        got = chunking.window_chunks(docs, size, step, "semantic").select("doc_id", "chunk_index", "start_char", "end_char", "chunk").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
