"""The pipeline stage by stage against plain versions, on the smallest tables."""

import collections
import re

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
import oracle
from evidence_spark.llm import passages
from evidence_spark.llm.common import stored, table, tokenizer_path
from evidence_spark.llm.queries import ORACLE_SQL, QUERIES
from test_operators import base_spans, near_groups, quality_counts, text_words

ROOT = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    from tokenizers import Tokenizer

    docs = table(spark, ROOT, "documents")
    frames = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ROOT), "stage")
        frames.append(docs)
    columns = table(spark, ROOT, "documents").columns
    assert all(f.columns == columns for f in frames[:-1])
    start, good, single, cut, clean = (dict(f.select("doc_id", "text").collect()) for f in (table(spark, ROOT, "documents"), *frames[:-1]))
    counts = {d: quality_counts(t) for d, t in start.items()}
    base_failed = {d for d, c in counts.items() if c[0] < 10 or 100 * c[4] > 20 * c[0]}
    assert not base_failed & set(good)
    labels = dict(table(spark, ROOT, "labels").select("doc_id", "quality").collect())
    fine = {d for d, q in labels.items() if q == 1} - base_failed
    assert len(fine & set(good)) >= 0.97 * len(fine)
    groups = near_groups(sorted(good.items()), 5, 80)
    assert set(single) == {d for d, (_, root) in groups.items() if d == root}
    assert set(cut) == set(single)
    owners = collections.defaultdict(set)
    for d, t in cut.items():
        words = text_words(t)
        for i in range(len(words) - 49):
            owners[tuple(words[i:i + 50])].add(d)
    assert not any(len(x) > 1 and len(set(k)) > 1 for k, x in owners.items())
    cover = collections.defaultdict(set)
    for r in passages.repeated_passages(frames[1]).collect():
        cover[r.doc_id].update(range(r.start_word, r.end_word))
    for d, t in cut.items():
        assert text_words(t) == [w for i, w in enumerate(text_words(single[d])) if i not in cover[d]]
        assert cover[d] or t == single[d]
    for d, t in cut.items():
        at, out = 0, []
        for begin, _, end, kind in base_spans(t):
            if begin >= at:
                out += [t[at:begin], f"[{kind.upper()}]"]
            at = max(at, end)
        assert clean[d] == "".join(out) + t[at:]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    packed = frames[-1].collect()
    length = collections.Counter()
    for r in packed:
        length[r.doc_id] += r.length
    assert length == {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in clean.items()}
    held = collections.Counter()
    for r in packed:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 4096 and len(held) <= -(-sum(length.values()) // 4096) + 1


def test_run_and_registration(spark):
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {re.match(r"op\d+|", n)[0] for n in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
    rows = entry.queries()["pipeline"](spark, ROOT)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns)


def test_queries_equal_their_twins(spark):
    con = oracle.connect(ROOT)
    for name, sql in ORACLE_SQL.items():
        query = type("Query", (), {"run": staticmethod(QUERIES[name]), "sql": sql})
        ok, note = oracle.compare(spark, con, ROOT, query)
        assert ok, (name, note)


def test_queries_without_a_twin_cover_their_tables(spark):
    docs, pages = table(spark, ROOT, "documents"), table(spark, ROOT, "pages")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in QUERIES["op2_quality_rules"](spark, ROOT).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality_counts(texts[r.doc_id])
    for r in QUERIES["op3_contextual_pii"](spark, ROOT).collect():
        assert set(f"{k}:{a}:{b}" for a, _, b, k in base_spans(texts[r.doc_id])) <= set(r.spans.split(",")) | {""}
    html = dict(pages.select("page_id", "html").collect())
    import html as entities
    for r in QUERIES["op6_html_extraction"](spark, ROOT).collect():
        article = re.sub(r"</?b>", "", html[r.page_id].split("<article>")[1].split("</article>")[0])
        assert r.text == " ".join(entities.unescape(re.sub("<[^>]*>", " ", article)).split())
    found = QUERIES["op7_compact_windows"](spark, ROOT).collect()
    first, missing = {}, 0
    cover = collections.defaultdict(set)
    for r in found:
        cover[r.doc_id].update(range(r.start_word, r.end_word))
    for d in sorted(texts):
        words = text_words(texts[d])
        for i in range(len(words) - 49):
            key = tuple(words[i:i + 50])
            if first.setdefault(key, d) != d and len(set(key)) > 1:
                missing += not set(range(i, i + 50)) <= cover[d]
    assert missing == 0
    assert QUERIES["op8_sentencepiece_viterbi"](spark, ROOT).filter("NOT same").count() == 0
    assert np.isclose(QUERIES["op5_best_fit_packing"](spark, ROOT).select("doc_id").distinct().count(), docs.count())
