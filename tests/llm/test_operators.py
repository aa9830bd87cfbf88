"""Operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidence_spark.llm import graph, knn, minhash, pack, passages, pieces, pii, pipeline, quality, shards, urlfilter, webtext
from evidence_spark.llm.common import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = "doc_id bigint, text string, lang string, n_chars bigint, id string, root string, key int, _doc int, base string, spans int, kept string, _kept_id int, shard int"


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Random texts, exact and edited copies, and passages that many share."""
    rng = random.Random(11)
    shared = words(rng, 70)
    rows = []
    for i in range(120):
        rows.append(words(rng, rng.randrange(1, 260)))
    for i in range(40):
        copy = list(rows[i % 7])
        for _ in range(rng.randrange(0, 1 + len(copy) // 40)):
            copy[rng.randrange(len(copy))] = "edit"
        rows.append(copy)
    for i in range(15):
        rows.append(words(rng, 30) + shared + words(rng, rng.randrange(0, 40)))
    rows += [list(rows[3]), list(rows[3]), [], ["one"], ["Two", "words"], ["two", "WORDS"]]
    texts = [" ".join(r) for r in rows] + [None, "\n \t"]
    return list(enumerate(texts))


def text_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def near_groups(docs, width, percent):
    sets = {}
    for d, t in docs:
        w = text_words(t)
        sets[d] = {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("settings", [minhash.Settings(shingle=3, percent=85, width=4), minhash.Settings()])
def test_near_duplicates(spark, corpus, settings):
    got = minhash.near_duplicates(spark.createDataFrame(corpus, "doc_id bigint, text string"), settings).collect()
    want = near_groups(corpus, settings.shingle, settings.percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(corpus)


def test_near_duplicates_with_a_far_centre(spark):
    """Members that are close to each other but not to the centre of their buckets are still linked."""
    rng = random.Random(4)
    base = words(rng, 150)
    docs = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 12)):
            copy[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        docs.append((i, " ".join(copy)))
        if i % 6 == 0:
            docs.append((1000 + i, " ".join(copy + ["tail"])))
    settings = minhash.Settings(shingle=3, percent=85, width=4, block=16)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), settings).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_groups(docs, 3, 85)


def test_near_duplicates_edges(spark):
    a, b = "a b c d e f g", "h i j k l m n"
    rows = [(5, a, "x"), (9, a, "y"), (9, b, "z"), (12, b, "z"), (None, a, "n"), (None, None, "n"), (20, "", "e"), (21, None, "e"), (5, a, "x")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, id string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(5, 5), (5, 5), (9, 5), (9, 5), (12, 5), (20, 20), (21, 21)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


def quality_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i:i + 5])] > 1:
            again.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(again))


def test_quality_counts(spark):
    rng = random.Random(2)
    texts = [None, "", "a b c d e", "a b c d e a b c d e", "x\nx\n\n\ny\nx", "é😀 ß\u00a0z\x1cq \x0b\x0c#|", "word " * 20000]
    texts += ["".join(rng.choice(["a ", "b ", "é", "\n", "# ", "Z", " \t"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = [(i, t, "en", 1) for i, t in enumerate(texts)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kept int")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = quality_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_divergence(spark):
    rng = random.Random(3)
    clean = [" ".join(rng.choice(quality.COMMON["en"] + ["house", "river", "stone", "winter", "green"]) for _ in range(200)) for _ in range(200)]
    junk = " ".join(w + "%%%" for w in clean[0].split())
    odd = " ".join(f"qx{rng.randrange(10**5)}" for _ in range(300))
    rows = [(i, t, "en") for i, t in enumerate(clean)] + [(900, junk, "en"), (901, odd, "en"), (902, junk, None), (903, odd, "zz"), (904, "Short but fine text of just eleven words here %% %% %%", "en")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(200))
    assert not got[900].kept and not got[901].kept
    assert got[902].kept and got[902].char_distance is None and got[903].word_distance is None and got[904].kept
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    value = spark.range(1).select(quality.divergence(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x)
    assert abs(value - np.sqrt((kl(p) + kl(q)) / 2)) < 1e-12
    assert quality.judge(spark.createDataFrame([], DOCS)).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for i, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), i, m.end(), kind))
    return sorted(out)


def test_personal_data_base(spark):
    rng = random.Random(5)
    bits = ["a@b.c", "@", "_d@e.f", ".", "1.2.3.4", "256", "+1 (2)", "4111 1111 1111 1111", "-", " ", "0", "12", "é😀", "a-b.c"]
    texts = [None, "", "mail 4539578763621486 or 4539 5787 6362 1486!"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(800)]
    rows = list(enumerate(texts)) + [(None, "a@b.c"), (0, None)]
    got = pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.spans == "email:0:5"
            continue
        spans = base_spans(texts[r.doc_id])
        shown = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in spans) for k in BASE]
    assert pii.report(spark.createDataFrame([], DOCS)).count() == 0


def test_personal_data_long_runs(spark):
    """Runs of 100,000 characters neither overflow a stack nor take quadratic time."""
    text = "x" * 100_000 + "1" * 100_000 + " " + "a." * 50_000 + "@b" + ".c" * 50_000 + " 1" * 50_000
    r = pii.report(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert r.n_email == 1 and r.n_card == r.n_phone == r.n_ip == 0


def test_personal_data_contexts(spark):
    rows = [(i, f"Please call my desk at +1 (800) 555-{1000 + i} today or mail") for i in range(30)]
    rows += [(100, "Please call my desk at 800-555-7777 today now"), (101, "worth 800-555-7778 dollars"), (102, "also 800-555-7777 here")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[100].spans == "phone:23:35" and got[100].n_phone == 0
    assert got[101].spans == "" and got[102].spans == "phone:5:17"
    redacted = {r.doc_id: r for r in pii.redact(spark.createDataFrame([(*x, 7, "keep") for x in rows], "doc_id bigint, text string, n_chars bigint, spans string")).collect()}
    assert redacted[100].text == "Please call my desk at [PHONE] today now" and redacted[100].n_chars == len(redacted[100].text)
    assert redacted[101].text == rows[31][1] and redacted[101].n_chars == 7 and redacted[101].spans == "keep"


def test_sharding(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randrange(0, 400), 1) for i in range(500)] + [(1000, "y" * 5000, 1), (None, None, 1), (None, None, 1)] + [(7777, "same" * 20, 1)] * 40
    limit = 2000
    got = shards.assign(spark.createDataFrame(rows, "doc_id bigint, text string, shard int"), limit).collect()
    assert sorted((r.doc_id or -1, r.n_bytes) for r in got) == sorted((d or -1, len(t or "")) for d, t, _ in rows)
    held = collections.defaultdict(list)
    for r in got:
        held[r.depth, r.bucket, r.part].append(r.n_bytes)
    assert all(sum(x) <= limit or len(x) == 1 for x in held.values())
    leaves = {(d, b) for d, b, _ in held}
    assert not any((d - k, b >> k) in leaves for d, b in leaves for k in range(1, d + 1))  # no leaf above a leaf
    assert shards.assign(spark.createDataFrame([], DOCS)).count() == 0
    assert {r.depth for r in shards.assign(spark.createDataFrame([(1, "a", "s"), (2, "b", "s")], "doc_id bigint, text string, s string")).collect()} == {0}


def test_write_shards(spark, tmp_path):
    rows = [(i, "x" * 100, 3) for i in range(100)]
    shards.write_shards(spark.createDataFrame(rows, "doc_id bigint, text string, shard int"), str(tmp_path / "out"), 1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).filter("b > 1000").count() == 0


def test_sum_of_squares_rule():
    rng = random.Random(8)
    for capacity in (10, 64):
        lengths = np.array([rng.randrange(1, capacity + 1) for _ in range(300)])
        bins, places, held = pack.sum_of_squares(lengths, capacity)
        assert held.max() <= capacity and (np.bincount(bins, lengths) == held).all()
        gaps = []  # the rule done slowly
        for size in sorted(lengths, reverse=True):
            def squares(changed):
                return sum(n * n for g, n in collections.Counter(changed).items() if 0 < g < capacity)
            tries = [(squares(gaps[:k] + [g - size] + gaps[k + 1:]), 0, g - size, k) for k, g in enumerate(gaps) if g >= size and k == gaps.index(g)]
            best = min(tries + [(squares(gaps + [capacity - size]), 1, 0, -1)])
            gaps = gaps + [capacity - size] if best[3] < 0 else gaps[:best[3]] + [gaps[best[3]] - size] + gaps[best[3] + 1:]
        assert len(gaps) == len(held) and sorted(gaps) == sorted(capacity - held)


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    alphabet = "aB.,' \u0301\u0130\u0915\u093c\u00df1<|endoftext|>\n\x1c\x85\u3000\u200b\u03a3\u0391é中\u212a'"
    texts = [None, "", "word " * 9000, "It's fine, isn't it? ΑΣ. \u212aELVIN"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(700)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1), (3, texts[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, offset int")
    got = pack.pack(pack.token_pieces(docs, tokenizer_path()), group_rows=64).collect()
    import zlib
    want = []
    for d, t, _ in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(d, k, b, len(ids[b:b + 4096]), zlib.crc32(ids[b:b + 4096].tobytes())) for k, b in enumerate(range(0, len(ids), 4096))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(w[3] for w in want) // 4096) + 1
    assert pack.pack(pack.token_pieces(spark.createDataFrame([], DOCS), tokenizer_path())).count() == 0


def test_packing_in_groups(spark):
    rng = random.Random(10)
    rows = [(i, rng.randrange(1, 101)) for i in range(9000)]
    got = pack.pack(spark.createDataFrame(rows, "doc_id bigint, length bigint"), capacity=100, group_rows=256).collect()
    bins = collections.Counter()
    for r in got:
        bins[r.sequence_id] += r.length
    assert len(got) == len(rows) and max(bins.values()) <= 100
    assert len(bins) <= 1.06 * sum(n for _, n in rows) / 100


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>m</a></nav>
<div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>One <b>bo</b>ld<br>two &lt;x&gt;<p>Three   four<div class="comments"><p>Nice!</div>
<form><input>Sign</form><script>var a="</p><p>no";</script></article><footer>&copy; me</footer>"""


def test_page_text(spark):
    boiler = "Read our daily letter and never miss any of the big stories again"
    loose = [(i, f"http://h.example/{i}", f"<html><body><p>{boiler}</p><p>n{i} has text x{i * 7} of its own y{i * 3} only</p></body></html>") for i in range(10, 16)]
    rows = [(1, "http://h.example/a", PAGE), (2, None, None), (3, "x", ""), (4, "u", "plain < text & more"), (1, "http://h.example/a", PAGE), (5, "u", "<main><p>Main</p></main><p>out"),
            (6, "u", "<!-- never closed <p>a"), (7, "u", "<p>" * 20000 + "deep"), (8, "u", '<p title="a>b">t</p>')] + loose
    got = webtext.main_text(spark.createDataFrame([(*r, "c") for r in rows], "page_id bigint, url string, html string, text string")).collect()
    texts = collections.defaultdict(list)
    for r in got:
        texts[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert texts[1] == ["Head & line One bold two <x> Three four"] * 2
    assert [texts[i] for i in (2, 3, 4, 5, 6, 7, 8)] == [[""], [""], ["plain < text & more"], ["Main"], [""], ["deep"], ["t"]]
    assert all(texts[i] == [f"n{i} has text x{i * 7} of its own y{i * 3} only"] for i in range(10, 16))
    assert webtext.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_covered_runs():
    rng = random.Random(10)
    for _ in range(60):
        streams = [[rng.choice("abcd") for _ in range(rng.randrange(0, 14))] for _ in range(rng.randrange(1, 9))]
        marks = webtext.covered(streams, 3, 3)
        texts = {tuple(s) for s in streams}
        runs = collections.Counter(r for t in texts for r in {t[i:i + 3] for i in range(len(t) - 2)})
        for s, mark in zip(streams, marks):
            want = [any(runs[tuple(s[j:j + 3])] >= 3 for j in range(max(0, i - 2), i + 1) if j + 3 <= len(s)) for i in range(len(s))]
            assert mark.tolist() == want


def test_boilerplate_of_few_pages_on_a_large_host(spark):
    rng = random.Random(31)
    notice, twice = words(rng, 12, 10**6), words(rng, 12, 10**6)
    texts = [words(rng, 20, 10**6) for _ in range(900)]
    for i in (5, 300, 600, 880):
        texts[i] = texts[i][:10] + notice + texts[i][10:]
    for i in (6, 700):
        texts[i] += twice
    texts[7] = list(texts[6])  # equal texts count once
    pages = [(i, "http://large.example/page", f"<p>{' '.join(t)}</p>") for i, t in enumerate(texts)]
    got = {r.page_id: r.text for r in webtext.main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    want = {i: " ".join(w for w, m in zip(t, mark) if not m) for i, (t, mark) in enumerate(zip(texts, webtext.covered(texts)))}
    assert got == want and notice[0] not in got[300].split() and twice[0] in got[700].split()


def test_compact_windows():
    rng = np.random.default_rng(0)
    for _ in range(150):
        h = np.concatenate([rng.integers(1, 50, rng.integers(20, 90)), [0], rng.integers(1, 2**31, rng.integers(1, 120)), [0]]).astype(np.uint32)
        want = []
        for i in range(len(h)):
            a = b = i
            while h[i] and a > 0 and h[a - 1] > h[i]:
                a -= 1
            while h[i] and b + 1 < len(h) and h[b + 1] >= h[i]:
                b += 1
            if h[i] and b - a + 1 >= 20 and not (a > 0 and h[a - 1] == h[i] and i - a + 1 < 20):
                want.append((i, a, b))
        assert want == list(zip(*(x.tolist() for x in passages.compact_windows(h, 20))))


def test_shared_positions_of_a_block():
    rng = np.random.default_rng(1)
    for _ in range(30):
        words = [rng.integers(0, 3, rng.integers(1, 60)).astype("<u4") for _ in range(9)]
        got = passages.shared_positions(pa.chunked_array([pa.array([x.tobytes() for x in words], pa.binary())]), 5)
        shingles = [[tuple(x[k:k + 5]) for k in range(len(x) - 4)] for x in words]
        for i, j in itertools.permutations(range(9), 2):
            assert got[i, j] == sum(x in set(shingles[j]) for x in shingles[i])


def test_rows_of_a_block_follow_its_nodes_not_its_pairs(spark):
    """Versions of one text: every pair holds passages, one or few rows a version tell all their words."""
    s, rng = passages.Settings(), np.random.default_rng(5)
    base = rng.integers(1, 2**32, 120).astype("<u4")
    versions = []
    for _ in range(40):
        version = base.copy()
        version[rng.integers(0, 120, 2)] = rng.integers(1, 2**32, 2)
        versions.append(version)
    nodes = spark.createDataFrame([(1, i, 60, 0, 115, True, True) for i in range(40)], "key long, id long, c int, l int, r int, open boolean, candidate boolean")
    texts = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(versions)], "id long, seq binary")
    rows = passages._block_passages(nodes, texts, s).collect()
    told, brute = {}, {}
    for r in rows:
        told.setdefault(r["id"], set()).update(range(r["start_word"], r["end_word"]))
    shingles = [passages.shingle_hashes(v.astype(np.uint64), s.shingle) for v in versions]
    for i in range(40):
        for j in range(i):
            for x in passages.verified(np.array([[60, 0, 115, 60, 0, 115]]), shingles[i], 0, passages.Places(shingles[j]), s)[0]:
                brute.setdefault(i, set()).update(range(x[0], x[1] + s.shingle))
    assert told == brute and len(brute) == 39
    assert len(rows) <= 3 * 39  # of 780 pairs


def test_verified_passages_of_texts_that_repeat_themselves():
    """Every shingle of the member has several places in the hub: the nearest to the diagonal counts."""
    unit = np.arange(1, 31, dtype=np.uint64)
    hub = passages.Places(passages.shingle_hashes(np.concatenate([unit] * 6), 5))
    member = passages.shingle_hashes(np.concatenate([unit] * 3), 5)
    anchors = np.array([[40, 0, 85, 70, 0, 175], [40, 0, 85, 70, 0, 175], [40, 30, 60, 40, 0, 175]])
    found, done = passages.verified(anchors, member, 0, hub, passages.Settings())
    assert found == [(0, 85, 30, 115)] and done.all()


def test_repeated_passages(spark, corpus):
    docs = dict(corpus)
    got = passages.repeated_passages(spark.createDataFrame([(*r, 1) for r in corpus], "doc_id bigint, text string, id int")).collect()
    split = {d: text_words(t) for d, t in corpus}
    cover = collections.defaultdict(set)
    for r in got:
        assert r.source_doc_id < r.doc_id and r.end_word - r.start_word >= 50
        cover[r.doc_id].update(range(r.start_word, r.end_word))
        a, b = split[r.doc_id][r.start_word:r.end_word], split[r.source_doc_id][r.source_start:r.source_end]
        x, y = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert len(x & y) >= 0.8 * len(x | y)
    first = {}
    for d in sorted(docs):
        for i in range(len(split[d]) - 49):
            key = tuple(split[d][i:i + 50])
            if key in first:
                assert set(range(i, i + 50)) <= cover[d], (d, i)
            else:
                first[key] = d


def test_near_passages_and_cut(spark):
    rng = random.Random(12)
    passage = words(rng, 90)
    changed = passage[:40] + ["new"] + passage[41:60] + passage[61:]
    lone = " ".join(words(rng, 200))
    a = " ".join(words(rng, 100) + passage)
    head, tail = " ".join(words(rng, 60)), " ".join(words(rng, 60))
    rows = [(1, a, 5), (2, f"{head}\n {' '.join(changed)}  \n{tail}", 5), (3, lone, 5), (None, a, 5), (4, None, 5), (5, "", 5), (3, lone, 5)]
    docs = spark.createDataFrame([(*r, "box") for r in rows], "doc_id bigint, text string, n_chars bigint, _doc string")
    found = passages.repeated_passages(docs).collect()
    assert {(r.doc_id, r.source_doc_id) for r in found} == {(2, 1)}
    out = {(r.doc_id, r.text): r for r in passages.without_repeats(docs).collect()}
    assert (2, f"{head}\n {tail}") in out and out[2, f"{head}\n {tail}"].n_chars == len(f"{head}\n {tail}")
    assert {k for k in out if k[0] != 2} == {(r[0], r[1]) for r in rows if r[0] != 2}
    assert passages.without_repeats(docs).count() == len(rows)
    assert passages.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def planted(rng, *middles):
    """Rows of a text for each middle, with random words of its own around it."""
    return [" ".join(words(rng, 60, 10**6) + m + words(rng, 60, 10**6)) for m in middles]


def missed(spark, rows, wanted):
    """Of the wanted (id, word), those that no reported passage covers."""
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    split = dict(rows)
    for r in found:
        a, b = split[r.doc_id].split()[r.start_word:r.end_word], split[r.source_doc_id].split()[r.source_start:r.source_end]
        x, y = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert r.source_doc_id < r.doc_id and len(x & y) >= 0.8 * len(x | y)
    return [(d, at) for d, at in wanted if not any(r.doc_id == d and r.start_word <= at < r.end_word for r in found)]


def test_near_passages_behind_hubs_that_share_a_phrase(spark):
    rng = random.Random(21)
    rows, wanted = [], []
    for i in range(60):
        p = words(rng, 60, 10**6)
        near = p[:30] + ["edit"] + p[31:]
        texts = planted(rng, *[p[:30]] * 10, *[p[31:]] * 10, p, near)
        rows += [(100 * i + k, t) for k, t in enumerate(texts)]
        wanted.append((100 * i + len(texts) - 1, 90))
    assert missed(spark, rows, wanted) == []


def test_passages_that_drift_from_version_to_version(spark):
    rng = random.Random(22)
    rows, wanted = [], []
    for i in range(40):
        v1 = words(rng, 60, 10**6)
        v2 = v1[:20] + ["second"] + v1[21:]
        v3 = v2[:40] + ["third"] + v2[41:]
        rows += [(10 * i + k, t) for k, t in enumerate(planted(rng, v1, v2, v3))]
        wanted += [(10 * i + 1, 90), (10 * i + 2, 90)]
    assert missed(spark, rows, wanted) == []


def test_near_passages_at_the_threshold_are_met(spark):
    rng = random.Random(23)
    rows, wanted = [], []
    for i in range(1500):
        p = words(rng, 51, 10**6)  # one edit: similarity 42 / 52
        rows += [(2 * i + k, t) for k, t in enumerate(planted(rng, p, p[:25] + ["edit"] + p[26:]))]
        wanted.append((2 * i + 1, 85))
    assert len(missed(spark, rows, wanted)) <= 0.002 * len(wanted)


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(13)
    alphabet = "abetinoh  ▁.,'éß中😀\n\t1234<s>THE"
    texts = ["", " ", "  ", " a", "a ", "         x", "internationalization " * 3, "x" * 3000, None]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    decoder = pieces.Pieces(pieces.load_pieces(path))
    for r in pieces.encode_documents(docs, path).collect():
        want = library.encode(texts[r.doc_id] or "")
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want, texts[r.doc_id]
        assert decoder.decode(bytes(r.ids)) == library.decode(want)
    assert all(r.same or "▁" in texts[r.doc_id] for r in pieces.round_trip(docs, path).collect())
    assert pieces.encode_documents(docs.limit(0), path).count() == 0


def test_url_filter(spark):
    urls = ["http://WWW.Example.com/en/1?x", "https://example.com/en/", "https://example.com/enx", "http://a.b.net/fr/q", "http://net/es/", "http://net/es", "no url", None, "",
            "http://x.com", "x://casino.org/play", "http://a.org/user/login", "http://a.org/mylogin", "http://casino.example.com/x", "a://b://net/fr/"]
    rows = [(i, u, "r") for i, u in enumerate(urls)]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id bigint, url string, rule string")).collect()}
    assert [(r.rule, r.verdict) for _, r in sorted(got.items())] == [
        ("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/fr/", "block"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"),
        (None, "allow"), (None, "allow"), (None, "block"), (None, "block"), (None, "allow"), ("com/", "allow"), (None, "allow")]
    assert (got[0].host, got[0].path) == ("www.example.com", "/en/1") and (got[7].host, got[7].path) == ("", "") and got[9].path == ""
    assert urlfilter.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_rarest_token_index():
    rules = [urlfilter.pattern_rule("a", "x", "common", "rare"), urlfilter.pattern_rule("b", "y")]
    index, rest = urlfilter.rarest_token_index(rules, {"common": 9, "rare": 2})
    assert list(index) == ["rare"] and rest == [rules[1]]


@pytest.mark.parametrize("clustered", [False, True])
def test_top_k(spark, clustered):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 6
    rows = []
    for i in range(600):
        v = centres[i % 6] + rng.normal(size=8) * 0.05 if clustered else rng.normal(size=8)
        rows.append((i, [float(x) for x in v]))
    rows += [(700, rows[3][1]), (700, rows[4][1]), (750, None), (800, [1.0, None] + [0.0] * 6), (850, [float("nan")] * 8), (900, [float("inf")] * 8), (950, []), (None, rows[0][1]), (1000, [1.0, 2.0]), (1050, [2.0, 1.0])]
    ints = [(i, np.floor(256 * np.array(v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, a in ints:
        if q % 50 == 0:
            scores = sorted((-int(a @ b), d) for d, b in ints if d != q and len(a) == len(b))[:5]
            want.update((q, k + 1, d, -s) for k, (s, d) in enumerate(scores)) if q != 700 else None
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, cell int")
    got = {tuple(r) for r in knn.top_k(frame, F.col("vec_id") % 50 == 0, block_rows=128, block_queries=4).collect()}
    assert {g for g in got if g[0] != 700} == want
    assert knn.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_leave_out_far_cells():
    pivots = {2: np.array([[100.0, 0.0], [-100.0, 0.0]])}
    summary = [{"dims": 2, "cell": c, "radius": 1.0, "near": [0.1] * 6, "n": 9} for c in (0, 1)]
    assert knn.visits(summary[:1], summary, pivots, 5) == [(2, 0, 0)]


def test_stages_keep_columns(spark, corpus):
    rows = [(d, t, "en", len(t or ""), "a", "b", 1, 2, "c", 3, "d", 4, 5) for d, t in corpus] + [(None, None, None, None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, CLASH)
    for stage in (pipeline.quality_stage, pipeline.near_dedup_stage, pipeline.substring_stage, pipeline.pii_stage):
        out = stage(spark, docs, "")
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert out.filter("doc_id IS NOT NULL AND key <> 1").count() == 0
        assert stage(spark, docs.limit(0), "").count() == 0
    groups = near_groups(corpus, 5, 80)
    kept = {r.doc_id for r in pipeline.near_dedup_stage(spark, docs, "").select("doc_id").collect()}
    assert kept == {d for d, (_, root) in groups.items() if d == root} | {None}
    packed = pipeline.packing_stage(spark, docs, "")
    assert packed.select("doc_id").distinct().count() == len(rows)


def test_bounds_never_cut_a_needed_cell():
    """Against all scores, with cells of one member and of several."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        pivots = rng.normal(size=(8, 3)) * rng.choice([1, 10])
        x = np.concatenate([pivots[i] + rng.normal(size=(rng.integers(0, 4), 3)) * rng.choice([0.0, 0.01, 1.0]) for i in range(8)] + [pivots[:2]])
        cell = ((x[:, None] - pivots[None]) ** 2).sum(2).argmin(1)
        far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
        cells = [{"dims": 3, "cell": int(c), "radius": far[cell == c].max(), "near": sorted(far[cell == c])[:3], "n": int((cell == c).sum())} for c in np.unique(cell)]
        visited = {(q, c) for _, q, c in knn.visits(cells, cells, {3: pivots}, 2)}
        scores = x @ x.T
        np.fill_diagonal(scores, -np.inf)
        for i, row in enumerate(scores):
            assert all((cell[i], cell[j]) in visited for j in np.argsort(-row)[:2] if np.isfinite(row[j]))
