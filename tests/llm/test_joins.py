"""Language ID, joins, dedup of passages, and search against brute force."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlark.llm import components, language_id, nearest, ngram_join, substring_dedup, suffix_dedup
from ledgerlark.llm.spans import joined_spans, without_spans
from tests.llm.samples import SCHEMA, clashing, documents, passage, prose

EN = "the and of that with this from have were which their would there about".split()
DE = "der und die das nicht mit sich auch auf einen durch über können würde".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


def test_language(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice([EN, DE][i % 2], 30)), ["en", "de"][i % 2]) for i in range(60)] + [(60, None, "en"), (61, "123 !!", "de"), (62, "the und", None)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = language_id.learn(df.where(~language_id.held_out("doc_id")))
    assert sorted(model) == ["de", "en"]
    got = {r.doc_id: tuple(r)[-2:] for r in language_id.identify(df, model).collect()}
    assert all(got[i][0] == ["en", "de"][i % 2] and 0 <= got[i][1] <= 1 for i in range(60))
    assert got[60] == got[61] == ("und", 0.0)
    assert language_id.identify(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in language_id.identify(df.select("text"), {}).collect()} == {"und"}
    assert language_id.learn(df.limit(0)) == {}


def plain_vector(text):
    """Binds and bundles letter by letter, without counting."""
    letters = [language_id._letters()[ord(c)] for c in text]
    line = " ".join("".join(chr(x) for x in letters).split(" ")).split()
    total = np.zeros(language_id.DIM)
    for word in line:
        padded = f" {word} "
        for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
            one, two, three = (language_id._letter_vector(ord(x)).astype(int) for x in (a, b, c))
            total += np.roll(one, 2) * np.roll(two, 1) * three
    return total


def test_vectors_are_the_plain_ones():
    texts = [prose(i, 15) for i in range(4)] + ["", "Ünï 12 x", "a", "\u0130stanbul ß", prose(9, 3000), prose(1, 15), prose(1, 15)]
    assert np.allclose(language_id.bundled(texts), [plain_vector(t) for t in texts])


def test_blocks_dont_change_vectors(monkeypatch):
    texts = [prose(i, 40) for i in range(9)] + ["", "Ünï", "a"]
    whole = language_id.bundled(texts)
    monkeypatch.setattr(language_id, "BLOCK_DOCS", 2)
    monkeypatch.setattr(language_id, "BLOCK_GRAMS", 7)
    assert np.allclose(whole, language_id.bundled(texts))


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200, i) for i in range(201, 240)] + [(7, 7)]
    root = {i: i for e in edges for i in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: r for i, r in root.items() if any(i in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def grams(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute_classes(rows):
    sets = {r.doc_id: grams(r.text) for r in rows if r.doc_id is not None}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = list(first.items())
    links = defaultdict(set)
    for x, (s, i) in enumerate(reps):
        for t, j in reps[x + 1 :]:
            if s and t and 9 * len(s & t) >= 4 * (len(s) + len(t)):
                links[i].add(j)
                links[j].add(i)
    label = {i: i for _, i in reps}
    for _ in reps:
        for i in links:
            label[i] = min([label[i], *(label[j] for j in links[i])])
    return {i: (label[first[s]], len(links[first[s]])) for i, s in sets.items()}


def near_copies(n, seed=5, words=100):
    base = passage(seed, words).split()
    rows = []
    for i in range(n):
        own = list(base)
        own[(i * 37) % words] = f"edit{i}"
        rows.append(" ".join(own))
    return rows


@pytest.mark.parametrize(("small", "block"), [(64, 128), (4, 8)])
def test_ngram_join(spark, docs, monkeypatch, small, block):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    more = spark.createDataFrame([(1000 + i, t, "en", "s", 1) for i, t in enumerate(near_copies(30) + near_copies(12, 8, 40))], SCHEMA)
    df = docs.unionByName(more)
    want = brute_classes(df.collect())
    got = ngram_join.ngram_join(clashing(df)).collect()
    assert len(got) == df.count()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got if r.doc_id is not None} == want


@pytest.mark.parametrize(("stuck", "depth"), [(1, 8), (9, 2)])
def test_large_buckets_lose_no_pair(spark, monkeypatch, stuck, depth):
    """Buckets that are never small: near copies hang on their smallest set, what isn't like it is compared in blocks."""
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    monkeypatch.setattr(ngram_join, "STUCK", stuck)
    monkeypatch.setattr(ngram_join, "SKETCH_BLOCK", 5)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 4000)
    common = passage(31, 160)
    rows = [(i, t) for i, t in enumerate(near_copies(25) + near_copies(25, 8, 60) + [f"{common} {x}" for x in near_copies(12, 9, 60)] + [f"{common} {passage(500 + k, 120)}" for k in range(20)])]
    df = spark.createDataFrame([*rows, (3, rows[3][1]), (400, rows[30][1])], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(df, depth=depth).collect()}
    assert got == brute_classes(df.collect())


def test_boilerplate_is_split_apart(spark):
    """Five thousand different texts that share half of their words: none is compared exactly, and few are on sketches."""
    n, common = 5000, passage(31, 120)
    df = spark.createDataFrame([(i, f"{common} {passage(1000 + i, 120)}") for i in range(n)], "doc_id long, text string").repartition(4)
    rows = ngram_join.sketches(df, "doc_id", "text", 5, ngram_join.runs_needed()).withColumnRenamed("id", "rep").cache()
    small, left = ngram_join.levels(rows, ngram_join.DEPTH)
    pairs = small.unionAll(left).select("path", "size").distinct().agg(F.sum(F.col("size") * (F.col("size") - 1) / 2)).first()[0]
    assert pairs < 0.05 * ngram_join.runs_needed() * n * n / 2  # of what a run without splitting would compare
    assert ngram_join.candidate_links(rows, ngram_join.DEPTH).count() < n / 20  # so hardly any is searched exactly
    rows.unpersist()


def test_ngram_join_empty(spark, docs):
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0
    assert ngram_join.ngram_join(docs.where("text is null")).count() == 1


def test_substring_dedup(spark):
    shared = prose(1, 60)
    rows = [(1, f"{prose(2, 50)} {shared}"), (2, f"{shared} {prose(3, 50)}"), (3, prose(4, 80)), (4, None), (5, ""), (6, "Short. Short."), (7, prose(4, 80)), (None, "x")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    found = substring_dedup.repeated_spans(df)
    text = dict(rows)
    got = {r.doc_id: "".join(text[r.doc_id][s.start : s.end] for s in r.spans) for r in found.collect()}
    assert got == {2: shared, 7: prose(4, 80)}
    left = {r.doc_id: r.text for r in without_spans(df, found).collect()}
    assert left[2].strip() == prose(3, 50) and left[7] == "" and left[3] == prose(4, 80) and left[4] is None
    assert substring_dedup.repeated_spans(df.limit(0)).count() == 0


def brute_runs(text):
    spans = substring_dedup.sentences(text)
    sizes = [len(text[a:b].split()) for a, b in spans]
    n = len(spans)
    long = [(i, j) for i in range(n) for j in range(i, n) if sum(sizes[i : j + 1]) >= substring_dedup.WORDS and j - i + 1 >= substring_dedup.SENTENCES]
    shortest = {min((x for x in long if x[0] == i), key=lambda x: x[1], default=None) for i in range(n)}
    shortest |= {max((x for x in long if x[1] == j), key=lambda x: x[0], default=None) for j in range(n)}
    return sorted((spans[i][0], spans[j][1]) for i, j in shortest - {None})


def test_runs():
    for seed in range(20):
        text = prose(seed, 30 + 13 * seed) + "\nOne. Two words here! " + passage(seed, 60) + ". " + prose(seed + 1, 40)
        assert [(a, b) for a, b, _ in substring_dedup.runs(text)] == brute_runs(text)


def brute_repeats(rows, min_words):
    """Words' characters that a run of several sentences covers which occurs before, every run of every length being tried."""
    seen, lost = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        spans = substring_dedup.sentences(text or "")
        said = [" ".join(text[a:b].lower().split()) for a, b in spans]
        own, gone = [], set()
        for x in range(len(spans)):
            for y in range(x + 1, len(spans)):
                key = tuple(said[x : y + 1])
                if sum(len(s.split()) for s in key) < min_words:
                    continue
                if key in seen:
                    gone |= set(range(spans[x][0], spans[y][1]))
                seen.add(key)
                own.append(key)
        if gone:
            lost[i] = {c for c in gone if not text[c].isspace()}
    return lost


@pytest.mark.parametrize("min_words", [0, 12, 25])
def test_every_repeated_run_is_covered(spark, min_words):
    rng = np.random.default_rng(6)
    stock = [prose(400 + i, 9) if i % 3 else f"Well {i}." for i in range(12)]
    rows = [(i, " ".join(stock[k] if k < 12 else prose(int(1000 + 50 * i + k), int(rng.integers(3, 14))) for k in rng.integers(0, 24, int(rng.integers(1, 14))))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, rows[5][1]), (63, f"{rows[7][1]} {rows[7][1]}"), (64, prose(3, 700) + " " + rows[9][1])]
    df = clashing(spark.createDataFrame([*rows, rows[5]], "doc_id long, text string")).repartition(3)
    text = dict(rows)
    got = {r.doc_id: {c for s in r.spans for c in range(s.start, s.end) if not text[r.doc_id][c].isspace()} for r in substring_dedup.repeated_spans(df, min_words=min_words).collect()}
    assert got == brute_repeats(rows, min_words)


def test_suffix_dedup(spark, docs):
    shared = passage(77, 70)
    rows = [(100 + i, f"{passage(200 + i, 60)} {shared} {passage(300 + i, 45)}") for i in range(5)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    words = {r.doc_id: (r.text or "").lower().split() for r in df.collect() if r.doc_id is not None}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][p : p + 50]), (i, p))
    got = defaultdict(set)
    for r in suffix_dedup.repeated_passages(clashing(df)).collect():
        for s in r.spans:
            got[r.doc_id].update(range(s.start, s.end))
    for i, own in words.items():
        want = set()
        for p in range(len(own) - 49):
            if first[tuple(own[p : p + 50])] != (i, p):
                want.update(range(p, p + 50))
        assert got[i] == want, i
    assert suffix_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_suffix_dedup_left_of_boilerplate(spark):
    """Passages of 20 own words and 40 that all documents hold, each in two of them."""
    common = passage(1, 40)
    rows = [(i, f"{passage(1000 + i, 40)} {common} end{i} {passage(3000 + i, 40)}") for i in range(200)]
    rows += [(500 + 10 * i + j, f"{passage(5000 + 2 * i + j, 39)} own{i}{j} {passage(7000 + i, 20)} {common} last{i}{j} {passage(9000 + 2 * i + j, 40)}") for i in range(8) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_dedup.repeated_passages(df).collect()}
    assert got == {501 + 10 * i: [(40, 100)] for i in range(8)}


def test_a_passage_has_a_minimiser():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 2**63, 50, np.uint64)
    for k in range(30):
        a, b = (np.concatenate([rng.integers(0, 2**63, n, np.uint64), shared, rng.integers(0, 2**63, 40, np.uint64)]) for n in (k, 50 - k))
        assert set(suffix_dedup.minimisers(a)[1]) & set(suffix_dedup.minimisers(b)[1])


def test_joined_spans(spark):
    rows = [(1, *s) for s in [(5, 9), (1, 3), (3, 4), (8, 12), (8, 12), (6, 7)]] + [(None, 2, 4), (None, 9, 10)]
    df = spark.createDataFrame(rows, "id long, start int, end int")
    assert {r.id: [tuple(x) for x in r.spans] for r in joined_spans(df).collect()} == {1: [(1, 4), (5, 12)], None: [(2, 4), (9, 10)]}


def test_nearest(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 16)).astype(np.float32)
    vectors[50:120] = vectors[50]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [1.0, None] * 8), (304, [1.0, 2.0]), (305, []), (7, vectors[7].tolist())]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).withColumns({n: F.lit("mine") for n in ("vector", "asks", "block", "rank", "query_id")}).repartition(3)
    got = defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    wide = vectors.astype(np.float64)
    assert sorted(got) == list(range(0, 300, 20))
    for query, found in got.items():
        scores = (wide * wide[query]).sum(1)
        want = sorted((i for i in range(300) if i != query), key=lambda i: (-scores[i], i))[:20]
        assert [v for _, v, _ in sorted(found)] == want
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        assert all(abs(s - scores[v]) < 1e-12 for _, v, s in found)
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest.nearest(df.where("vec_id in (0, 1)"), F.col("vec_id") == 0).count() == 1


def test_pipeline_rejects_an_unlearned_language(spark):
    rng = np.random.default_rng(4)
    other = "että olisi hän kuin myös mutta joka tämä kaikki niin sitten vuonna jälkeen".split()
    rows = [(i, " ".join(rng.choice([EN, DE][i % 2], 60 if i < 100 else 3)), ["en", "de"][i % 2]) for i in range(200)]
    rows += [(1000 + i, " ".join(rng.choice(words, n)), None) for i, (words, n) in enumerate([(other, 60), (EN, 60), (EN, 200), (other, 200)])]
    df = clashing(spark.createDataFrame([(*r, "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, df, "").collect()}
    assert kept == {*range(200), 1001, 1002}


def test_pipeline_of_nothing(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").columns == docs.columns, name


def test_pipeline_hides_without_a_count_of_characters(spark):
    df = spark.createDataFrame([(1, "mail j\u043ehn@example.com now", "en"), (2, None, None), (1, "mail j\u043ehn@example.com now", "en")], "doc_id long, text string, lang string")
    got = corpus_pipeline.private(spark, df, "")
    assert got.columns == df.columns and sorted(map(str, (r.text for r in got.collect()))) == ["None", "mail <EMAIL> now", "mail <EMAIL> now"]


def test_pipeline_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "pii", "packing"]
    more = clashing(docs.unionByName(spark.createDataFrame([(1000 + i, t, "en", "s", 1) for i, t in enumerate(near_copies(5))], SCHEMA)))
    kept = more
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(spark, kept, "").cache()
        assert kept.columns == more.columns
        after = {r.doc_id: r.text for r in kept.collect()}
        if name == "language_id":
            assert not {i for i, t in after.items() if not any(c.isalpha() for c in t or "")}
            assert {i for i, t in before.items() if len((t or "").split()) > 20} <= set(after)
        if name == "ngram_jaccard_join":
            assert [i for i in after if i is not None and i >= 1000] == [1000]
    assert all("@" not in (t or "") for t in after.values())
    last = corpus_pipeline.STAGES[-1][1](spark, kept, "")
    assert last.select("doc_id").distinct().count() == kept.count()
