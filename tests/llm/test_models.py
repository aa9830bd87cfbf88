"""Clusters, whitening and class-based scoring against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_spark.llm import brown, clusters, whitening

VECTORS = "vec_id bigint, embedding array<float>, cluster int, v string, dims int, n int"


def rows_of(rng, n, dims, groups=5):
    centres = rng.normal(size=(groups, dims))
    x = centres[rng.integers(groups, size=n)] + 0.2 * rng.normal(size=(n, dims))
    return [(i, [float(v) for v in row.astype(np.float32)], 7, "x", 1, 2) for i, row in enumerate(x)]


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)[:k]
    centroids = [list(v) for _, _, v in seeds]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for j, members in groups.items():
            centroids[j] = [sum(column) // len(members) for column in zip(*members)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = collections.Counter()
    for _, d, j in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i is None, i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in found), key=repr)


@pytest.mark.parametrize("k,rounds", [(8, 10), (3, 2), (40, 3)])
def test_clusters(spark, k, rounds):
    rows = rows_of(np.random.default_rng(k), 300, 6)
    rows += [(1000, rows[5][1], 0, "", 0, 0), (5, rows[5][1], 0, "", 0, 0), (6, rows[9][1], 0, "", 0, 0), (None, rows[3][1], 0, "", 0, 0)]
    rows += [(2000, None, 0, "", 0, 0), (2001, [], 0, "", 0, 0), (2002, [1.0] * 5, 0, "", 0, 0), (2003, [1.0] * 5 + [None], 0, "", 0, 0), (2004, [1.0] * 5 + [float("nan")], 0, "", 0, 0)]
    got = clusters.clusters(spark.createDataFrame(rows, VECTORS), k=k, rounds=rounds, dims=6).collect()
    assert sorted(((r.vec_id is None, *r) for r in got), key=repr) == plain_clusters(rows, k, rounds, 6)


def test_orchard_search_equals_all_distances():
    rng = np.random.default_rng(1)
    for k in (1, 2, 9, 60):
        centroids = rng.integers(-6, 6, size=(k, 3))
        centroids[k // 2] = centroids[0]  # equal centroids: the smaller number wins
        order, apart = clusters.neighbours(centroids)
        x = rng.integers(-8, 8, size=(500, 3))
        got, distance = clusters.nearest(x, centroids, order, apart, rng.integers(k, size=500))
        every = ((x[:, None] - centroids[None]) ** 2).sum(2)
        assert (got == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_clusters_edges(spark):
    assert clusters.clusters(spark.createDataFrame([], VECTORS)).collect() == []
    assert clusters.clusters(spark.createDataFrame([(None, [1.0, 2.0], 0, "", 0, 0)], VECTORS), dims=2).collect() == []
    same = clusters.clusters(spark.createDataFrame([(i, [0.5, -0.5], 0, "", 0, 0) for i in range(5)], VECTORS), dims=2).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in same} == {(0, 0, 0)} and len(same) == 5
    huge = spark.createDataFrame([(1, [3e30, 1.0], 0, "", 0, 0)], VECTORS)
    with pytest.raises(Exception, match="range of a long"):
        clusters.clusters(huge, dims=2).collect()


def plain_whitening(rows):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v, *_ in rows])
    n, s = len(x), x.sum(0)
    exact = n * x - s
    a = exact / n
    e, w = np.linalg.eigh(a.T @ a / n)
    return n, (exact ** 2).sum(1), a, e[::-1], w[:, ::-1].T


def test_whitening(spark):
    rows = rows_of(np.random.default_rng(5), 400, 10)
    rows += [(3, rows[8][1], 0, "", 0, 0), (None, rows[9][1], 0, "", 0, 0)]
    bad = [(900, None, 0, "", 0, 0), (901, [], 0, "", 0, 0), (902, [1.0] * 9 + [float("inf")], 0, "", 0, 0), (903, [None] * 10, 0, "", 0, 0)]
    got = whitening.whitened(spark.createDataFrame(rows + bad, VECTORS), limit=8).collect()
    n, deviation, a, e, w = plain_whitening(rows)
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {n}
    for i in (0, 77, 399):
        own = {r.component: r for r in got if r.vec_id == i}
        assert {r.deviation for r in own.values()} == {deviation[i]}
        for j in range(8):
            want = a[i] @ w[j] / np.sqrt(e[j])
            assert abs(abs(own[j + 1].whitened) - abs(want)) < 1e-9
            assert abs(own[j + 1].explained - e[j] / e.sum()) < 1e-9
    assert {r.identity_error for r in got}.pop() < 1e-9
    by_place = collections.defaultdict(list)
    for r in got:
        by_place[r.component].append(r.whitened)
    assert all(abs(np.mean(x)) < 1e-9 and abs(np.var(x) - 1) < 1e-9 for x in by_place.values())


def test_whitening_edges(spark):
    rng = np.random.default_rng(2)
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(i, [0.5, 2.0], 0, "", 0, 0) for i in range(4)], VECTORS)).collect() == []
    # One direction is the sum of two others, one is constant: three components have variance.
    flat = [(i, [float(a), float(b), float(c), float(a + b), 3.0], 0, "", 0, 0) for i, (a, b, c) in enumerate(rng.integers(-9, 9, size=(60, 3)))]
    got = whitening.whitened(spark.createDataFrame(flat, VECTORS)).collect()
    assert {r.component for r in got} == {1, 2, 3} and {r.identity_error for r in got}.pop() < 1e-6
    _, _, _, e, _ = plain_whitening(flat)
    assert max(abs(r.explained - e[r.component - 1] / e.sum()) for r in got) < 1e-9
    # Two lengths: two fit lists.
    both = [(i, [float(x) for x in rng.normal(size=3)], 0, "", 0, 0) for i in range(30)] + [(i, [float(x) for x in rng.normal(size=2)], 0, "", 0, 0) for i in range(20)]
    assert collections.Counter(r.n for r in whitening.whitened(spark.createDataFrame(both, VECTORS)).collect()) == {30: 90, 20: 40}
    large = [(1, [3e12, 1.0], 0, "", 0, 0), (2, [-3e12, 1.0], 0, "", 0, 0)]
    with pytest.raises(Exception, match="range of a long"):
        whitening.whitened(spark.createDataFrame(large, VECTORS)).collect()


def test_steep_spectrum(spark):
    """Variances from 1 to 1e-10 of the largest: all digits that doubles can give."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=500) * 10.0 ** k for k in (4, 2, 0, -1)]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0, "", 0, 0) for i, r in enumerate(x)]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect()
    _, _, a, _, _ = plain_whitening(rows)
    e = np.linalg.svd(a)[1] ** 2 / len(a)
    assert max(abs(r.explained / (e[r.component - 1] / e.sum()) - 1) for r in got) < 1e-9
    assert {r.identity_error for r in got}.pop() < 1e-9


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def language_docs(rng, n):
    """Two languages over one another's clock: articles, nouns and verbs follow each other."""
    docs = []
    for i in range(n):
        tag = rng.choice("ab")
        text = []
        for _ in range(rng.randrange(5, 40)):
            text += [f"the{tag}", f"noun{tag}{rng.randrange(40)}", f"verb{tag}{rng.randrange(25)}"]
        docs.append((i, " ".join(text).title() if i % 3 == 0 else " ".join(text)))
    return docs


def plain_scores(docs, outer=brown.OUTER, inner=brown.INNER, weight=brown.WEIGHT):
    """The model by dictionaries and loops."""
    name = lambda w: brown.END if w is None else np.uint64(__import__("xxhash").xxh64_intdigest(w.encode()))
    texts = [(d, held(d), tokens_of(t)) for d, t in docs]
    count = collections.Counter(w for _, h, t in texts if not h for w in t)
    n, v = sum(count.values()), len(count)
    size = max(4, round(v ** (1 / 3)))
    cls = {w: 1 for w in count} | {None: 0}
    for i, w in enumerate(sorted((w for w in count if w is not None), key=lambda w: (-count[w], int(name(w).astype(np.int64))))[:size - 2]):
        cls[w] = i + 2
    pairs = collections.Counter((a, b) for _, h, t in texts if not h for a, b in zip([None] + t, t))
    for _ in range(outer):
        fixed = dict(cls)
        context = {w: np.zeros(2 * size) for w in count}
        for (a, b), m in pairs.items():
            context[b][fixed[a]] += m
            context[a][size + fixed[b]] += m
        moving = [w for w in count if w is not None and count[w] > 1]
        for w in count:
            if w is not None and count[w] == 1:
                cls[w] = 1
        for _ in range(inner):
            profile = np.zeros((size, 2 * size))
            for w in moving:
                profile[cls[w]] += context[w]
            was = dict(cls)
            for w in moving:
                cls[w] = int(brown.best_classes(context[w][None].astype(np.float32), np.array([was[w]]), profile)[0])
    table = np.zeros((size, size))
    for (a, b), m in pairs.items():
        table[cls[a], cls[b]] += m
    total = table.sum(0)
    out = []
    for d, h, t in texts:
        base = score = 0.0
        for a, b in zip([None] + t, t):
            c, p = cls.get(b, 1), (count[b] + 0.5) / (n + 0.5 * (v + 1))
            after = (table[cls.get(a, 1), c] + total[c] / n) / (table[cls.get(a, 1)].sum() + 1)
            half = 0.5 if total[1] else 0.0
            own = (half * count[b] / total[1] if count[b] else 1 - half) if c == 1 else count[b] / total[c]
            base += math.log10(p)
            score += math.log10(weight * after * own + (1 - weight) * p)
        out.append((d, h, len(t), sum(count[w] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize("chunk,bucket", [(brown.CHUNK, brown.BUCKET), (50, 16)])
def test_class_scores(spark, monkeypatch, chunk, bucket):
    monkeypatch.setattr(brown, "CHUNK", chunk)
    monkeypatch.setattr(brown, "BUCKET", bucket)
    rng = random.Random(5)
    docs = language_docs(rng, 200) + [(500, None), (501, ""), (502, "\x1c unseen word "), (503, "The noun"), (None, "thea nouna1"), (7, "thea nouna1 verba2"), (7, "thea nouna1 verba2")]
    wide = [(i, t, 1.0, "x", 3) for i, t in docs]
    got = brown.scores(spark.createDataFrame(wide, "doc_id bigint, text string, score double, chunk string, n_tokens int").repartition(3)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    want = sorted(plain_scores(docs), key=key)
    assert len(got) == len(want)
    for a, b in zip(sorted((tuple(r) for r in got), key=key), want):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-9) and a[6] == pytest.approx(b[6], abs=1e-6)


def test_class_model_learns_the_order_of_words(spark):
    """On texts not trained on, classes tell more than single words."""
    docs = language_docs(random.Random(8), 300)
    got = [r for r in brown.scores(spark.createDataFrame(docs, "doc_id bigint, text string")).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in got)
    assert len(got) > 20 and sum(r.score for r in got) / tokens > sum(r.base_score for r in got) / tokens + 0.3


def test_class_scores_edges(spark):
    assert brown.scores(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    alone = next(i for i in range(100) if held(i))
    got = brown.scores(spark.createDataFrame([(alone, "not trained on")], "doc_id bigint, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(True, 4, 0, 0, 0.0, 0.0)]
    blank = brown.scores(spark.createDataFrame([(i, None) for i in range(9)], "doc_id bigint, text string")).collect()
    assert len(blank) == 9 and {r.n_tokens for r in blank} == {1}


def test_class_probabilities_sum_to_one():
    """Over all classes, and over the words of a class with the unseen one."""
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 9, size=(5, 5)).astype(float)
    model = brown.ClassModel(counts, int(counts.sum()), 40)
    assert np.allclose(model.after.sum(1), 1)
    total = int(model.size[brown.OPEN_CLASS])
    assert np.isclose(model.emission(np.full(total + 1, brown.OPEN_CLASS), np.array([1] * total + [0])).sum(), 1)
    assert np.isclose(model.emission(np.array([3, 3]), np.array([2, model.size[3] - 2])).sum(), 1)


def test_blank_runs_and_unigram_models(spark):
    import itertools
    import time

    import sentencepiece

    from evidence_spark.llm import pieces
    from evidence_spark.llm.common import tokenizer_path

    path = tokenizer_path("piece_bpe_32k.model")
    library, rows = sentencepiece.SentencePieceProcessor(model_file=path), pieces.load_pieces(path)
    encoder = pieces.Pieces(rows)
    texts = [" " * n + "the  cat" + " " * (n % 7) for n in [*range(0, 60), 1000, 4001]] + ["\n" * 50, "▁" * 33 + "x", "a" * 5000]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), len(text)
    start = time.process_time()
    list(encoder.encode([" " * 100_000 + "end"]))
    assert time.process_time() - start < 10
    # Without merges the path of the highest summed score wins, whatever its pieces.
    vocabulary = [("<unk>", 0.0, 2)] + [(t, s, 1) for t, s in (("a", -2.0), ("b", -2.5), ("ab", -3.0), ("ba", -1.0), ("aba", -4.5), ("▁", -1.0), ("▁a", -2.5))]
    plain = pieces.Pieces(vocabulary, merges=False)
    score = {t: s for t, s, kind in vocabulary if kind == 1}
    for size in range(1, 7):
        for word in map("".join, itertools.product("ab", repeat=size)):
            unit = "▁" + word
            cuts = [[unit[i:j] for i, j in zip((0, *c), (*c, len(unit)))] for k in range(len(unit)) for c in itertools.combinations(range(1, len(unit)), k)]
            best = max(sum(score[p] for p in c) for c in cuts if all(p in score for p in c))
            ids = np.frombuffer(next(iter(plain.encode([word]))), "<u4")
            assert "".join(plain.text[i] for i in ids) == unit and sum(score[plain.text[i]] for i in ids) == pytest.approx(best)


PAGES = [
    ("<article><div class='article-header'><h1>Title</h1></div><p>Body</p><div class='share-of-market'>Share of market fell</div></article>", "Title Body Share of market fell"),
    ("<article><p>see <span class='label alert-level'>Level 3</span> now</p></article>", "see Level 3 now"),
    ("<body><article>Teaser one</article><article>Teaser two</article><main><p>The story is told here, at length.</p></main></body>", "The story is told here, at length."),
    ("<main><p>Latest</p><article>Short</article><article>The long article of the page</article></main>", "The long article of the page"),
    ("<header>Site</header><article><header><h1>Headline</h1></header><p>Text</p><footer>Tags</footer></article>", "Headline Text"),
    ("<article><p>One</p><div class='related-posts'>More</div><div class='comments'>Nice</div><p>Two</p></article>", "One Two"),
    ("<article class='comment'>first!</article><article><p>Post</p></article>", "Post"),
    ("<article><section><article>Inner</article> words</section></article>", "Inner words"),
    ("<article></article><main>Only main</main>", "Only main"),
    ("<div class='main-nav'>Menu</div><div class='text'>Loose</div>", None)]


@pytest.mark.parametrize("html,want", PAGES)
def test_articles_of_other_layouts(html, want):
    from evidence_spark.llm import webtext

    assert webtext.decided_text(webtext.blocks(html)) == want


def test_personal_data_in_texts_with_many_hits(spark):
    """20,000 numbers, or 6,000 phones among chunks, in one text: time grows with their number."""
    import time

    from evidence_spark.llm import pii

    many = " ".join(f"{1000000 + 7 * i}" for i in range(20_000))
    phones = " ".join(f"call +1 (800) 555-{1000 + i % 9000} or id{i}x{i * 31}" for i in range(6_000))
    docs = spark.createDataFrame([(1, many, 1), (2, phones, 1)], "doc_id bigint, text string, n_chars bigint")
    start = time.time()
    rows = {r.doc_id: r for r in pii.report(docs).collect()}
    redacted = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert time.time() - start < 120
    assert rows[2].n_phone == 6_000 and redacted[2].startswith("call [PHONE] or ") and redacted[2].count("[PHONE]") >= 6_000
    assert redacted[2].endswith("call [PHONE] or id5999x185969") or redacted[2].endswith("call [PHONE] or [PHONE]")


def test_planted_secrets_are_found_by_their_contexts(spark):
    from evidence_spark.llm import pii

    rng = random.Random(9)
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    prose = lambda n: " ".join(f"w{rng.choice('abcdefgh')}{rng.choice('ijklmnop')}" for _ in range(n))
    keys = [secret() for _ in range(60)]
    rows = [(i, f'{prose(30)} token = "{k}" {prose(20)}') for i, k in enumerate(keys)]
    rows += [(100 + i, f'{prose(10)} token = "{word}" {prose(9)}') for i, word in enumerate(["hunter2hunter2", "abcdefgh12345678"])]  # no seeds by shape
    rows += [(200 + i, f"{prose(8)} {secret()} {prose(8)}") for i in range(20)]  # long mixtures in no common context
    rows += [(300 + i, prose(40)) for i in range(100)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    caught = sum(f"secret:{rows[i][1].index(keys[i])}:{rows[i][1].index(keys[i]) + 40}" == got[i].spans for i in range(60))
    assert caught >= 54 and all("secret:" in got[100 + i].spans for i in range(2))
    assert not any(got[i].spans for i in range(200, 220)) and not any(got[i].spans for i in range(300, 400))
    text = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert 'token = "[SECRET]"' in text[0] and keys[0] not in text[0]


def test_scores_beyond_a_long_are_an_error():
    from evidence_spark.llm import knn

    big = np.full((1, 128), 768_000_000)
    with pytest.raises(ValueError, match="range of a long"):
        knn.products(big, big)
    assert knn.products(np.full((1, 2), 2 ** 28), np.full((1, 2), 2 ** 28)).tolist() == [[2 ** 57]]
