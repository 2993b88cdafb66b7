"""Operators on texts against brute force: suffix dedup, Jaccard join, sampled segmentation, toxicity."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from linenet.llm import jaccard, pieces, queries, suffix, toxicity
from linenet.llm.components import components

SCHEMA = "doc_id long, text string, n int, h string"


def removed(texts):
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def overlapping(spark):
    random.seed(4)
    base = ["".join(random.choice("ab c") for _ in range(random.choice([150, 200, 300, 900]))) for _ in range(30)]
    rows = []
    for i in range(120):
        x, y, k = random.choice(base), random.choice(base), random.randrange(0, 300)
        rows.append((random.choice([i, i, None]), random.choice([x, x[:k] + y, x + y[k:], x[:k] + "é" + x[k:], "z" * k + y, "a" * 500, "", None, x[:k] + x]), i, "x"))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("crowd", [3, 20_000])
def test_suffix_dedup(overlapping, crowd, monkeypatch):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    rows = [(r.doc_id, (r.text or "").encode()) for r in overlapping.collect()]
    expected = collections.Counter((i, *x) for (i, _), x in zip(rows, removed([t for _, t in rows]), strict=True))
    assert collections.Counter(tuple(r) for r in suffix.remove(overlapping).collect()) == expected


def test_suffix_dedup_query(spark, sf):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = {i: x for (i, _), x in zip(rows, removed([t for _, t in rows]), strict=True)}
    assert {r[0]: tuple(r)[1:] for r in queries.op3_suffix_dedup(spark, sf).collect()} == expected


def test_suffix_dedup_empty(spark):
    assert suffix.remove(spark.createDataFrame([], SCHEMA)).count() == 0
    assert suffix.remove(spark.createDataFrame([(1, "x" * 199, 0, "")], SCHEMA)).first().n_removed == 0
    assert suffix.remove(spark.createDataFrame([(1, "x" * 201, 0, "")], SCHEMA)).first().n_removed == 201


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_suffix_order(letters):
    text = np.random.default_rng(letters).integers(97, 97 + letters, 700).astype(np.uint8)
    text[300:500] = text[50:250]
    raw, order = text.tobytes(), suffix.suffix_order(text, 80)
    assert sorted(order.tolist()) == list(range(700))
    assert [raw[i : i + 80] for i in order] == sorted(raw[i : i + 80] for i in range(700))
    equal = suffix.common_prefix(text, order, 80)
    padded = raw + bytes(80)
    assert equal.tolist() == [padded[a : a + 80] == padded[b : b + 80] for a, b in zip(order, order[1:], strict=False)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near(rows):
    sets, parent, having = [shingles(t) for _, t in rows], list(range(len(rows))), collections.defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for j, c in collections.Counter(j for g in s for j in having[g]).items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                parent[root(k)] = root(j)
        for g in s:
            having[g].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return collections.Counter((i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(rows))


@pytest.fixture(scope="module")
def resembling(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(3000)]
    base = [[random.choice(words) for _ in range(random.choice([1, 3, 4, 5, 20, 60, 200]))] for _ in range(25)]
    passage, rows = [random.choice(words) for _ in range(40)], []
    for i in range(300):
        b = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2, 3, 5])):
            b[random.randrange(len(b))] = random.choice(words)
        b = b + passage if random.random() < 0.3 else b
        rows.append((random.choice([i, i, i, None, 7]), random.choice([None, "", "  "]) if random.random() < 0.05 else random.choice([" ", "\t\n"]).join(b).title(), i, "x"))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name, value", [("GROUP_TOKENS", 1_000_000), ("GROUP_TOKENS", 300), ("FREQUENT", 8), ("WORDS_KNOWN", 4)])
def test_jaccard(resembling, name, value, monkeypatch):
    monkeypatch.setattr(jaccard, name, value)
    rows = [(r.doc_id, r.text) for r in resembling.collect()]
    found = jaccard.jaccard_components(resembling).select("doc_id", "n_shingles", "component_id")
    assert collections.Counter(tuple(r) for r in found.collect()) == near(rows)


def test_near_dedup(spark, resembling):
    kept = jaccard.near_dedup(resembling)
    assert kept.columns == resembling.columns
    rows = [(r.doc_id, r.text) for r in kept.dropDuplicates(["doc_id", "text"]).collect()]
    links = near(rows)
    assert sum(links.values()) == len(rows)
    full = [t for _, t in rows if shingles(t)]
    assert all(100 * len(shingles(a) & shingles(b)) < 80 * len(shingles(a) | shingles(b)) for k, a in enumerate(full) for b in full[:k])
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.near_dedup(empty).count() == jaccard.jaccard_components(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(3, 3), (1, 100), (100, -5)]
    found = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(20, 61)} == {20} and found[100] == found[1] == -5 and 3 not in found


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(pieces.MODEL)


def segmentations(vocabulary, unit):
    weights = {vocabulary.texts[int(i)]: (int(i), vocabulary.weights[n]) for n, i in enumerate(vocabulary.ids) if i >= 0}
    out = []

    def go(at, ids, w):
        if at == len(unit):
            out.append((tuple(ids), w))
        for end in range(at + 1, min(len(unit), at + vocabulary.longest) + 1):
            if (found := weights.get(unit[at:end].replace(" ", "▁"))) is not None:
                go(end, [*ids, found[0]], w + found[1])

    go(0, [], 0.0)
    total = np.logaddexp.reduce([w for _, w in out])
    return {ids: np.exp(w - total) for ids, w in out}


def test_draws_without_replacement(vocabulary):
    chances, n = segmentations(vocabulary, " thea then"), 3000
    first, weighted = collections.Counter(), collections.Counter()
    for draws in pieces.segment(vocabulary, ["thea then"] * n, list(range(n)), 3):
        ids = [tuple(d["ids"].tolist()) for d in draws]
        assert len(set(ids)) == 3 and all(a["perturbed"] >= b["perturbed"] for a, b in zip(draws, draws[1:], strict=False))
        first[ids[0]] += 1
        for d, i in zip(draws, ids, strict=True):
            assert abs(d["log_prob"] - np.log(chances[i])) < 1e-6
            weighted[i] += 1 / d["inclusion"]
    for ids, p in sorted(chances.items(), key=lambda x: -x[1])[:3]:
        assert abs(first[ids] / n - p) < 5 * (p / n) ** 0.5 and abs(weighted[ids] / n - 1) < 0.1


def test_all_segmentations_once(vocabulary):
    chances = segmentations(vocabulary, " of")
    draws = pieces.segment(vocabulary, ["of"], [5], 99)[0]
    assert {tuple(d["ids"].tolist()) for d in draws} == set(chances) and len(draws) == len(chances)


def test_lattice_kept_across_groups(vocabulary):
    texts = ["the cat sat", "a mat \u2581 x\ny", "", "the mat sat  \U0001f600 the cat", None, "zq" * 300]
    lattice, kept = pieces.Lattice(vocabulary), []
    for i, text in enumerate(texts):
        kept += pieces.segment(vocabulary, [text], [i], 3, lattice)
    for a, b in zip(kept, pieces.segment(vocabulary, texts, list(range(len(texts))), 3), strict=True):
        assert [x["ids"].tolist() for x in a] == [x["ids"].tolist() for x in b]
        assert [x["inclusion"] for x in a] == pytest.approx([x["inclusion"] for x in b])


def test_encode_round_trip(spark):
    texts = ["", None, "a  b\n\nc\t é ▁ x 😀 " + "q" * 3000, " ", "\n", "x y\r\n", "a", "a"]
    df = spark.createDataFrame([(i if i % 3 else None, t, i, "x") for i, t in enumerate(texts)], SCHEMA)
    rows = pieces.decode(pieces.encode(df)).collect()
    assert all(r.decoded for r in rows) and {r.text for r in rows} == {t or "" for t in texts}
    one = pieces.encode(df.repartition(3)).drop("ids").collect()
    assert collections.Counter(map(str, one)) == collections.Counter(map(str, pieces.encode(df).drop("ids").collect()))
    assert pieces.encode(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_group_takes_little_memory(vocabulary):
    """Two workers of an executor segment a group each, beside a heap that earlier stages have filled."""
    rng, texts = random.Random(3), []
    while sum(map(len, texts)) < pieces.GROUP_CHARS:
        texts.append(" ".join("".join(rng.choices("abcdeéß漢", k=rng.randint(1, 10))) for _ in range(500)))
    tracemalloc.start()
    try:
        draws = pieces.segment(vocabulary, texts, list(range(len(texts))))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100e6
    for text, found in zip(texts, draws, strict=True):  # byte pieces among others
        assert all(vocabulary.spell(x["ids"]) == (" " + text).encode() for x in found)


def test_first_units_stay(vocabulary):
    """A lattice that has grown keeps the commonest words, which it had to look up again before."""
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdeé漢", k=rng.randint(1, 5))) for _ in range(200)) for _ in range(30)]
    lattice, found = pieces.Lattice(vocabulary), []
    for i, text in enumerate(texts):
        if lattice.n_rows > 4000:
            lattice.cut(2000)
            assert 1900 < lattice.n_rows <= 2000 and len(lattice.numbers) == len(lattice.ends) and lattice.n_entries == len(lattice.ids) == lattice.firsts[-1]
        found += pieces.segment(vocabulary, [text], [i], 3, lattice)
    for i, a in enumerate(found):
        b = pieces.segment(vocabulary, texts[i : i + 1], [i], 3)[0]
        assert [x["ids"].tolist() for x in a] == [x["ids"].tolist() for x in b] and [x["perturbed"] for x in a] == [x["perturbed"] for x in b]
    lattice.cut(0)
    assert lattice.n_rows == 0 and pieces.segment(vocabulary, texts[:1], [0], 3, lattice)[0][0]["perturbed"] == found[0][0]["perturbed"]


def test_sets_take_little_memory():
    """Of 3 MB of texts, with the powers that a worker keeps for all later tasks."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(350)) for _ in range(1500)]
    suffix._powers.clear()
    tracemalloc.start()
    try:
        sizes = [len(s) for _, sets in jaccard.sets_of(texts) for s in sets]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sizes == [346] * 1500 and peak < 40e6 and sum(x.nbytes for x in suffix._powers) < 10e6


def test_registered_uses_return_the_segmentations(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for found in (queries.op5_sentencepiece(spark, sf), corpus_pipeline.STAGES[-1][1](spark, docs, sf)):
        rows = pieces.decode(found).collect()
        assert {r.doc_id for r in rows} == set(texts) and {r.draw for r in rows} == {1, 2}
        assert all(r.text == texts[r.doc_id] and len(r.ids) == r.n_pieces for r in rows)
        assert all(zlib.crc32(np.array(r.ids, np.int32).tobytes()) == r.ids_crc32 for r in rows)


def test_toxicity(spark, sf):
    found = queries.op2_toxicity(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found.count() == docs.count() and found.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    random.seed(2)
    clean, foul = ["".join(random.choices("abcdefgh", k=6)) for _ in range(200)], ["vile", "rotten", "nasty"]
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        words = random.choices(clean, k=60)
        for w in random.choices(foul, k=4) if bad else []:
            words[random.randrange(60)] = w
        rows.append((i, " ".join(words), 0, "x"))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    rows += [(None, None, 0, "x"), (900, "", 0, "x")]
    labels += [(None, 1), (901, None)]
    df, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.classify(df, known).collect()}
    unseen = [r for i, r in out.items() if r.held_out and i is not None and i < 900]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in unseen) > 0.97 * len(unseen)
    assert out[None].score == out[900].score < 0.5
    kept = toxicity.drop_toxic(df, known)
    assert kept.columns == df.columns and 650 < kept.count() < 760
    none = spark.createDataFrame([], SCHEMA)
    assert toxicity.classify(none, known).count() == 0 and toxicity.classify(df, known.where("toxic = 0")).where("predicted = 1").isEmpty()


def test_non_negative_risk():
    rng = np.random.default_rng(0)
    x_p = rng.normal(2, 1, (300, 2)).astype(np.float32)
    x_u = np.concatenate([rng.normal(2, 1, (150, 2)), rng.normal(-2, 1, (350, 2))]).astype(np.float32)
    w, b = toxicity.fit_nnpu(x_p, x_u, 0.3)
    z = x_u @ w + b
    assert (z[:150] > 0).mean() > 0.95 and (z[150:] < 0).mean() > 0.95


def test_toxicity_columns():
    """n-grams of one bucket count once, as in fitting."""
    model = toxicity.Model([" one ", " two "], np.array([0, 0]), np.array([2.0]), -3.0)
    score = model.scorer()
    assert score("one") == score("one two two") == score("two") > score("three") == score(None) == score("")


def test_toxicity_reference(spark, sf):
    """The query's scores against the model applied by plain search in every whole text."""
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, known)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op2_toxicity(spark, sf).collect():
        words = toxicity.words_of(texts[r.doc_id]) if texts[r.doc_id] else ""
        own = sorted({c for g, c in zip(model.grams, model.columns.tolist(), strict=True) if g in words})
        assert abs(r.score - 1 / (1 + np.exp(-(model.bias + model.weights[own].sum())))) < 1e-9 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_toxicity_clashes(spark):
    random.seed(4)
    some = lambda: " ".join(random.choices(["".join(random.choices("abcdefgh", k=6)) for _ in range(300)], k=20))
    texts = [some() + (" vile rotten nasty" if i < 40 else "") for i in range(300)]
    texts[3] += " vile" * 200_000
    rows = [(i, t, i, 0.5, "t") for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long, held_out double, row string")
    known = spark.createDataFrame([(i, int(i < 40)) for i in range(300)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(list(range(40, 300)) * 2)
    assert toxicity.classify(docs, known, text="text").count() == 600


def test_resemblance():
    """Parities never lose a pair that links."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 40, 700, 3000):
        base = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
        members = [np.sort(np.concatenate([base[k:], rng.integers(0, 2**63, k).astype(np.uint64)])) for k in range(0, n // 9 + 1, max(1, n // 50))]
        near = jaccard.Resemblance([(len(m), jaccard.parities(m)) for m in members]).of(n, jaccard.parities(base)).tolist()
        shared = np.array([len(np.intersect1d(base, m)) for m in members])
        assert set(np.flatnonzero(jaccard.linked(n, np.array([len(m) for m in members]), shared)).tolist()) <= set(near)
        other = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
        assert n < 40 or not len(jaccard.Resemblance([(n, jaccard.parities(other))]).of(n, jaccard.parities(base)))
