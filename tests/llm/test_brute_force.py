"""Operators against plain versions of what they promise."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairstream.llm import graph, langid, lattice, mixing, pieces, simhash, tokencount
from fairstream.llm import queries as registered
from fairstream.llm.queries import tokenizer_file

SF_DIR = "/root/testdata/sf0.001"


def _components(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("finish_links", [graph.FINISH_LINKS, 20, 0])
def test_components_of_odd_graphs(spark, finish_links):
    path = [(i, i + 1) for i in range(60)]
    shuffled = [((a * 37) % 61 + 100, (b * 37) % 61 + 100) for a, b in path]
    star = [(500, 500 + i) for i in range(1, 80)]
    links = path + shuffled + star + [(7, 7), (1, 0), (300, 299)]
    expected = _components({x for ab in links for x in ab}, links)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint"), finish_links).collect()}
    assert got == expected


def _plain_print(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="abAB \t\n é", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == _plain_print(text)


def test_fingerprint_in_chunks(monkeypatch):
    text = " ".join(str(i % 97) for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == whole == _plain_print(text)


def _families(rng, count, each):
    values = []
    for base in rng.integers(0, 2**63, count, dtype=np.uint64):
        for _ in range(each):
            x = int(base)
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(bit)
            values.append(x)
    return np.unique(np.array(values, np.uint64))


@pytest.mark.parametrize("limit", [simhash.GROUP_LIMIT, 8])
def test_near_links(spark, limit):
    """Also with groups so small that keys are refined again and again."""
    values = _families(np.random.default_rng(3), 40, 60)
    close = [
        (int(a), int(b))
        for i, a in enumerate(values.view(np.int64))
        for b in values.view(np.int64)[i + 1 :]
        if bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") <= 2
    ]
    prints = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    found = [(r.a, r.b) for r in simhash.near_links(prints, limit).collect()]
    assert {tuple(sorted(x)) for x in found} <= {tuple(sorted(x)) for x in close}
    nodes = {int(v) for v in values.view(np.int64)}
    assert _components(nodes, found) == _components(nodes, close)


def test_simhash_query(spark):
    rows = registered.op4_simhash(spark, SF_DIR).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    prints = {i: _plain_print(t) for i, t in texts.items()}
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2]
    roots = _components(ids, links)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", roots[i]) for i in ids}


def test_held_out_accuracy(spark):
    rows = registered.op2_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    tested = [r for r in rows if r.held_out and truth[r.doc_id] is not None]
    right = sum(r.lang_pred == truth[r.doc_id] for r in tested)
    assert len(tested) > 150 and right / len(tested) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def _table(matrix):
    """A sparse table that knows every cell."""
    n, k = np.shape(matrix)
    return np.zeros(k), np.arange(n + 1) * k, np.tile(np.arange(k), n), np.ravel(matrix)



def test_backoff_by_hand():
    grams = np.array([[-4.0, -2.0], [-3.0, -1.0], [-1.0, -2.0]])
    model = langid.Model(("a", "b"), {"one": 0}, _table([[-1.0, -5.0]]), {"<x": 0, "xy": 1, "q": 2}, _table(grams))
    rows = langid._Rows(model)
    assert list(rows.vector("one")) == [-1.0, -5.0]
    assert list(rows.vector("xy")) == [-3.5, -1.5]  # the two known pairs, not the single signs
    assert list(rows.vector("zq")) == [-1.0, -2.0]
    assert rows.vector("zz") == 0.0
    assert langid.predict("ONE one zz", rows)[0] == "a" and langid.predict("xy", rows)[0] == "b"


def test_long_texts_score_alike_in_chunks(monkeypatch):
    model = langid.Model(("a", "b"), {"one": 0}, _table([[-1.0, -1.5]]), {"t": 0}, _table([[-2.0, -1.0]]))
    text = "one two " * 400
    whole = langid._Rows(model).total(langid.words_of(text))
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert np.allclose(langid._Rows(model).total(langid.words_of(text)), whole)


@pytest.mark.parametrize("cells", [langid.DENSE_CELLS, 0])
def test_languages_against_a_plain_version(spark, monkeypatch, cells):
    """Every prediction of the test documents, from counts of the labelled texts that are not held out."""
    monkeypatch.setattr(langid, "DENSE_CELLS", cells)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    words, grams, totals = defaultdict(Counter), defaultdict(Counter), Counter()
    for d in docs:
        if d.lang is None or d.text is None or zlib.crc32(str(d.doc_id).encode()) % 4 == 2:
            continue
        for w in langid.words_of(d.text):
            words[d.lang][w] += 1
            for order in langid.ORDERS:
                grams[d.lang].update(langid.grams_of(w, order))
    languages = sorted(words)
    kept = lambda c: dict(sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:12_500])
    top_words, top_grams = ({l: kept(c[l]) for l in languages} for c in (words, grams))
    log = lambda c, top, l, x: math.log((top[l][x] if x in top[l] else 0.5) / sum(c[l].values()))
    known_grams = set().union(*top_grams.values())

    def plain(text):
        score = Counter({l: 0.0 for l in languages})
        for w in (found := langid.words_of(text)):
            if any(w in top_words[l] for l in languages):
                for l in languages:
                    score[l] += log(words, top_words, l, w)
                continue
            for order in langid.ORDERS:
                if known := [g for g in langid.grams_of(w, order) if g in known_grams]:
                    for l in languages:
                        score[l] += sum(log(grams, top_grams, l, g) for g in known) / len(known)
                    break
        if not found:
            return "und", 0.0
        most = max(score.values())
        best = next(l for l in languages if score[l] == most)
        return best, 1 / sum(math.exp(score[l] - most) for l in languages)

    found = {r.doc_id: r for r in registered.op2_language_id(spark, SF_DIR).collect()}
    for d in docs:
        lang, score = plain(d.text)
        r = found[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        assert r.score == pytest.approx(score, rel=1e-6) and (r.lang_pred == lang or score < 0.5 + 1e-6)


def test_a_rare_language_is_learnt(spark):
    rows = [(i, f"the cat sat on mat number{i}", "en") for i in range(3000)] + [(5000 + i, "кот сидит на коврике", "ru") for i in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), max_rows=100, max_entries=50)
    assert model.languages == ("en", "ru") and "кот" in model.words and len(model.words) <= 100


def test_mix_of_rows_without_ids(spark):
    """A third of the rows have no id; their source still comes near its target."""
    rows = [(None if i % 3 == 0 else i, " ".join(f"w{i}" for _ in range(10)), "ab"[i % 2]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = mixing.mix_plan(docs).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 20 for r in taken)


def test_mix_reaches_targets(spark):
    rows = registered.op3_mix_sources(spark, "/root/testdata/sf0.01").collect()
    sources = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").collect()}
    taken, target, largest = Counter(), {}, defaultdict(int)
    for r in rows:
        assert r.taken % max(1, r.size) == 0 and r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0 and r.size > 0) or r.size == 0
        taken[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
        largest[sources[r.doc_id]] = max(largest[sources[r.doc_id]], r.size)
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6 * sum(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)


ODD = [
    "", " ", "  a ", "<s> a  b</s><unk>\t\nx ▁y é  ﬁ Å 𝔸\0q", "aaaaaaa" * 300, "日本語テキスト" * 30,
    "abcdefghijklmnopqrstuvwxyz0123456789+/" * 300, "▁▁▁", "  " * 50 + "x", "​﻿\x7f",
]


@given(st.text(alphabet="theandigors l▁é𝔸\n<0x41>", max_size=80))
@settings(max_examples=300, deadline=None)
def test_token_counts(text):
    assert MERGES.tokens([text]) == [len(LIBRARY.encode(text))]
    if text:
        parts = ["▁" + w for w in pieces.words_of(text)]
        assert [MERGES.long_count(w) for w in parts] == MERGES.count(parts).tolist()


MERGES = tokencount.Merges(tokenizer_file())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())


def test_token_count_query(spark):
    assert MERGES.tokens(ODD) == [len(x) for x in LIBRARY.encode(ODD)]
    rows = registered.op8_token_count(spark, SF_DIR).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in rows:
        expected = len(LIBRARY.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), expected, expected > 4096)


def _plain_viterbi(word, scores, unknown):
    """Best total score of any segmentation."""
    best = [0.0]
    for end in range(1, len(word) + 1):
        options = [best[s] + scores[word[s:end]] for s in range(max(0, end - 16), end) if word[s:end] in scores]
        if word[end - 1] not in scores:
            options.append(best[end - 1] + unknown)
        best.append(max(options))
    return best[-1]


@given(st.text(alphabet="theandigors l▁é𝔸\n", min_size=1, max_size=80))
@settings(max_examples=200, deadline=None)
def test_viterbi(text):
    ids = PIECES.encode(text)
    assert PIECES.decode(ids) == text.replace("▁", " ")
    whole = "▁" + text.replace(" ", "▁")
    known = [PIECES.names[i] for i in ids if i not in PIECES.bytes]
    unknown = sum(c not in PIECES.segmenter.singles for c in whole) - sum(c not in PIECES.segmenter.singles for c in "".join(known))
    got = sum(SCORES[n] for n in known) + unknown * PIECES.segmenter.unknown
    assert got == pytest.approx(_plain_viterbi(whole, SCORES, PIECES.segmenter.unknown))


PIECES = pieces.Pieces(tokenizer_file())
SCORES = {
    LIBRARY.id_to_piece(i): LIBRARY.get_score(i)
    for i in range(3, LIBRARY.get_piece_size())
    if not LIBRARY.is_byte(i)
}


def test_round_trip_query(spark):
    rows = registered.op7_sentencepiece(spark, SF_DIR)
    assert rows.filter("NOT round_trip").count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    back = {r.doc_id: r.text for r in pieces.decoded(rows, tokenizer_file()).collect()}
    assert back == {i: t.replace("▁", " ") for i, t in texts.items()}


@pytest.mark.parametrize("block", [lattice.BLOCK, 16])
def test_lattice_recall(spark, block):
    rng = np.random.default_rng(8)
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").limit(200).collect()
    base = np.array([r.embedding for r in table], float)
    base /= np.linalg.norm(base, axis=1)[:, None]
    vectors, labels = [*base], [r.label for r in table]
    for at, cosine in enumerate(np.linspace(0.97, 0.999, 200)):  # partners on both sides of the threshold
        away = rng.normal(size=64)
        away -= (away @ base[at]) * base[at]
        vectors.append(cosine * base[at] + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away))
        labels.append(labels[at])
    for _ in range(150):  # a crowd around one vector, and copies of it
        vectors.append(base[0] + rng.normal(size=64) * 0.006)
        labels.append(labels[0])
    vectors += [base[0]] * 20
    labels += [labels[0]] * 20
    ids = list(range(len(vectors)))
    df = spark.createDataFrame(
        [(i, v.tolist(), l) for i, v, l in zip(ids, vectors, labels)], "vec_id bigint, embedding array<double>, label int"
    )
    unit = np.array(vectors)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    label = np.array([-1 if x is None else x for x in labels])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label) & ~np.eye(len(ids), dtype=bool)
    found = {r.vec_id: r for r in lattice.near_vectors(df, block).collect()}
    expected = dict(zip(ids, near.sum(1).tolist()))
    assert all(found[i].n_links <= expected[i] for i in expected)
    assert sum(r.n_links for r in found.values()) >= 0.9 * sum(expected.values()) > 0


def _crowds(sizes: dict[float, int]) -> np.ndarray:
    """Around one vector for each spread; the vectors of any two spreads are 0.3 apart."""
    rng = np.random.default_rng(12)
    base, found = rng.normal(size=64), []
    base /= np.linalg.norm(base)
    for spread, n in sizes.items():
        away = rng.normal(size=64)
        middle = base + 0.3 * away / np.linalg.norm(away)
        found.append(middle + rng.normal(size=(n, 64)) * spread)
    return np.concatenate(found)


def test_lattice_balls(spark):
    """Tight crowds are balls, a loose one is compared; copies count; both are linked as brute force links them."""
    vectors = _crowds({0.004: 300, 0.008: 200, 0.018: 150})
    vectors = np.concatenate([vectors, vectors[:40], vectors[:40]])
    df = spark.createDataFrame([(i, v.tolist(), 3) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, label int")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    near = (unit @ unit.T >= 0.98) & ~np.eye(len(unit), dtype=bool)
    found = {r.vec_id: r for r in lattice.near_vectors(df, 64).collect()}
    links = np.array([found[i].n_links for i in range(len(unit))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.99 * near.sum()
    assert (links[:500] == near.sum(1)[:500]).all()
    assert {found[i].component_id for i in range(300)} == {0}
    assert {found[i].component_id for i in range(300, 500)} == {300}


def test_lattice_crowds_are_linear(spark):
    placed = []
    for n in (1000, 2000, 4000):
        vectors = _crowds({0.006: n, 0.018: 100})
        rows = spark.createDataFrame(
            [(i, "64:1", 1, v.tolist()) for i, v in enumerate(vectors)], "id bigint, label string, copies bigint, embedding array<double>"
        )
        classes, near = lattice.in_balls(rows, 256)
        assert classes.filter("ball >= 0").count() >= n
        placed.append(lattice._placed(classes, near, 256).count())
    assert placed[1] < 2.2 * placed[0] and placed[2] < 2.2 * placed[1]


def test_lattice_points():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)) * 2
    point = lattice.nearest_e8(x)
    twice = np.round(2 * point).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(1)).all() and (twice.sum(1) % 4 == 0).all()
    other = lattice.next_e8(x, point)
    assert np.allclose(((other - point) ** 2).sum(1), 2.0)
    assert (((x - point) ** 2).sum(1) <= ((x - other) ** 2).sum(1) + 1e-9).all()
    assert (((x - point) ** 2).sum(1) <= 1 + 1e-9).all()  # the covering radius
