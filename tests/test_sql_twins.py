"""Queries against their SQL on small tables written for inputs that the given tables hold rarely or not at all."""

import datetime

import duckdb
from oracle import rows_of

from evidence_spark.plans import load_all


def same(spark, root, name, **tables):
    """Rows of the query, which must be those of its SQL over the same tables."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table, (schema, rows) in tables.items():
        path = f"{root}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    query = load_all()[name]
    df = query.run(spark, str(root))
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(query.sql)
    assert got == rows_of([c[0] for c in cursor.description], cursor.fetchall())
    return got[1]


def documents(*texts):
    return "doc_id long, text string, lang string, source string, n_chars long", [(i, t, "fr", "s", len(t)) for i, t in enumerate(texts)]


def turns(*texts):
    return "conv_id long, turn int, role string, text string", [(i, 0, "user", t) for i, t in enumerate(texts)]


def test_an_acronym_with_accents_keeps_them(spark, tmp_path):
    rows = same(spark, tmp_path, "claim_context", documents=documents("On cite une étude nationale annuelle (ÉNA) ici. La suite."))
    assert ("étude nationale annuelle", "éna") in [(r[0], r[2]) for r in rows]


def test_a_name_is_not_met_by_a_chance_word_of_its_initials(spark, tmp_path):
    texts = ["We met Erein Evan today\nErein Evan came.", "The erein said ee to all.", "Now erein evan again.", "None.", "None."]
    assert same(spark, tmp_path, "entity_match", documents=documents(*texts)) == [("erein evan", 2.0)]


FUSED = "Y en asadora queas ueueez las cionado adomi adotaar. Adota queas adora. Lla forai."


def test_a_turn_is_interpreted_as_it_stands(spark, tmp_path):
    assert same(spark, tmp_path, "interpret_claims", conversations=turns(FUSED, "How many of the 4500 cats left in 2019?"))[0][2] == 52.0


def test_claims_are_split_from_the_turn_as_it_stands(spark, tmp_path):
    assert [r[:2] for r in same(spark, tmp_path, "split_claims", conversations=turns(FUSED, "Adora queas lloran, adota.", "Il a 12 chats."))] == [(0.0, 52.0), (1000.0, 26.0)]


def test_times_are_near_to_the_nearest_second(spark, tmp_path):
    at = lambda day, second, micro: datetime.datetime(2024, 1, day, 0, 0, second, micro)
    events = "event_id long, user_id long, event_type string, ts timestamp", [
        (1, 1, "signup", at(1, 10, 400_000)), (2, 1, "purchase", at(8, 10, 600_000)),   # 7 days and a second when rounded, 7 days when cut
        (3, 2, "signup", at(1, 10, 600_000)), (4, 2, "purchase", at(8, 11, 400_000)),   # 7 days when rounded, a second more when cut
        (5, 3, "signup", at(1, 10, 500_000)), (6, 3, "purchase", at(8, 11, 500_000)),   # halves go to the even second
        (50, 3, "signup", at(1, 10, 0))]
    assert same(spark, tmp_path, "near_in_time", events=events) == [(3.0, 1.0), (50.0, 1.0)]


def test_scores_are_rounded_on_their_binary_value(spark, tmp_path):
    # 57 of 800 is 0.07125 in decimal spelling, and less than that in binary: 0.0712.
    texts = ["a! " * 57 + "a " * 686, "a! b c d", "a b!! c", "a b c d e f g h i j k!"]
    labels = "doc_id long, quality int, toxic int", [(i, 1, i % 2) for i in range(len(texts))]
    assert len(same(spark, tmp_path, "pr_curve", documents=documents(*texts), labels=labels)) == 4


ODD = ["Le chat noir mange la souris 4500 grise.\u00a0\nLe chat noir mange la souris 4500 grise sur la route verte.\u00a0\nUne fin.",
       "Version chat noir.\u000b The version holds 12 tokens with licence\r\nand more of the same chat noir words to be long.\r",
       "\u3000Le chat 7 with.\u2009\n\u2003The chat with a token of 7 is told here and goes on for long.\u2028\nEncore! \u00a0Oui 7"]


def test_odd_spaces_end_sentences_as_in_sql(spark, tmp_path):
    for name in ("sentence_stats", "top_excerpts", "relate_detail", "token_counts"):
        assert same(spark, tmp_path, name, documents=documents(*ODD))
    assert same(spark, tmp_path, "interpret_claims", conversations=turns(*ODD, "Le chat ?\u00a0"))
    assert same(spark, tmp_path, "split_claims", conversations=turns(*ODD))


def test_copies_of_a_title_are_judged_in_slices(spark, tmp_path, monkeypatch):
    from evidence_spark.operators import dedupe

    monkeypatch.setattr(dedupe, "PAIRS_A_TASK", 2)
    urls = ["http://www.gazeta.com/a", "http://m.gazeta.com/a/", "http://jornal.com.br/x", "http://gazetadosul.com/y", "http://blog.gazeta.net/z?q=1", "http://x.org/1"]
    title = "<title>Chat noir mange la souris {n} grise</title>"
    rows = [(i, u, title.format(n=n)) for i, (u, n) in enumerate((u, n) for n in (4, 5) for u in urls)] + [(99, "http://x.org/2", "<title></title>")]
    assert len(same(spark, tmp_path, "page_independence", pages=("page_id long, url string, html string", rows))) == 30


def test_a_sentence_keeps_the_digit_of_its_place(spark, tmp_path):
    # A function of two parameters handed to a transform took a sentence's place for the characters to trim.
    texts = ["Le chat noir mange la souris grise\n1 chat noir mange la souris grise sur la route 1\nPage 2", "0 fin\n1", "Licence 4\n \nThe version is 1"]
    for name in ("sentence_stats", "top_excerpts", "relate_detail"):
        same(spark, tmp_path, name, documents=documents(*texts))


def test_token_counts_of_repeated_ids_without_a_row_per_word(spark, tmp_path):
    schema, rows = documents("Les chats mangent. Le chat mange !", "Chats, chat; CHAT\nÉté 5,2 sul-africano.", "... !", "")
    assert len(same(spark, tmp_path, "token_counts", documents=(schema, [*rows, (0, "Le Chat dort.", "fr", "s", 1)]))) == 2
    plan = load_all()["token_counts"].run(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


def test_vectors_are_paired_as_in_sql(spark, tmp_path):
    vectors = [[2.0, 1.0], [1.0, 0.0], [2.0, 1.0], [0.0, 0.0], [-1.0, 0.5], [0.4, 0.0], [0.4, 0.84**0.5], None]
    rows = same(spark, tmp_path, "cosine_pairs", embeddings=("vec_id long, embedding array<float>", list(enumerate(vectors))))
    assert [r[:2] for r in rows if 3.0 in r[:2]] == [(0.0, 3.0), (1.0, 3.0), (3.0, 4.0), (3.0, 5.0), (3.0, 6.0)]  # no number: as in SQL


def test_every_order_is_an_original(spark, tmp_path):
    orders = "o_orderkey long, o_orderpriority string, o_orderdate timestamp", [(k, "1-URGENT", datetime.datetime(1996, 1, 1 + k)) for k in range(5)]
    spark.createDataFrame(orders[1], orders[0]).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    ids = lambda name: sorted(r["o_orderkey"] for r in load_all()[name].run(spark, str(tmp_path)).collect())
    assert ids("original_events") == [0, 1, 2, 3, 4]
    assert ids("compare_events") == [0, 0, 1, 1, 2, 2, 3]  # one and two orders on


def test_a_turn_is_split_into_all_its_claims(spark, tmp_path):
    said = " ".join(f"Adora queas lloran adota {w}." for w in ("lenta", "verde", "negra", "clara", "larga"))
    assert [r[2] for r in same(spark, tmp_path, "split_claims", conversations=turns(said))] == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_texts_without_a_signal_have_a_row(spark, tmp_path):
    texts = ["chat noir souris " * 30, "chat noir", "", "route " * 70, "souris " * 200]
    labels = "doc_id long, quality int, toxic int", [(0, 1, 1), (1, 1, 0), (4, 1, 1)]
    rows = same(spark, tmp_path, "text_signal", documents=documents(*texts), labels=labels)
    told = {r[1]: (r[0], r[3]) for r in rows}
    assert len(told) == 5 and told[1.0][0] == told[2.0][0] == "texto_curto" and told[3.0] == ("sem_sinal", 0.5)  # no known term


def signal_tables():
    texts = [f"{w} noir souris la chat chat {w}x{i % 7} " * (4 + i % 23) for i, w in enumerate(("verde", "grise", "route", "claire") * 8)]
    labels = "doc_id long, quality int, toxic int", [(i, 1, int(i % 3 == 0)) for i in range(0, 32, 2)]
    return {"documents": documents(*texts), "labels": labels}


def test_bands_are_calibrated_in_the_row_as_term_by_term(spark, tmp_path, monkeypatch):
    from evidence_spark.operators import tfidf

    one = same(spark, tmp_path, "calibrate_bands", **signal_tables())
    plan = load_all()["calibrate_bands"].run(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert len(one) == 3 and "Generate" not in plan  # no row for each word of a text
    monkeypatch.setattr(tfidf.hashed_scores, "__defaults__", (*tfidf.hashed_scores.__defaults__[:-1], 0))
    assert same(spark, tmp_path, "calibrate_bands", **signal_tables()) == one


def test_passages_meet_every_document(spark, tmp_path, monkeypatch):
    from evidence_spark.operators import tfidf

    schema, rows = documents("chat noir verde", "chat grise", "route", "noir noir chat grise", "lent")
    rows = [*rows, (0, "grise route", "fr", "s", 11)]  # an id twice
    tables = {"documents": (schema, rows), "benchmark": ("item_id long, text string", [(7, "Chat grise chat."), (9, "noir"), (11, "inconnu")])}
    found = same(spark, tmp_path, "pair_word_product", **tables)
    assert [r[:2] for r in found] == [(7.0, 0.0), (7.0, 1.0), (7.0, 3.0), (9.0, 0.0), (9.0, 3.0)]
    monkeypatch.setattr(tfidf.hashed_product, "__defaults__", (0,))
    assert same(spark, tmp_path, "pair_word_product", **tables) == found


def test_names_meet_texts_without_pairs(spark, tmp_path, monkeypatch):
    from evidence_spark.operators import phrases

    heads = ["We met Erein Evan de Souza today", "x", "x", "x", "x", "Then Marie de la Tour came, said UNESCO Paris", "x", "x", "x", "x", "Near Evan Souza"]
    bodies = ["Erein evan souza", "marie tour", "unesco de paris la", "souza evan", "evan de souza e marie la tour", "paris unesco", "tour", "unesco", "", "erein", "evan souza"]
    schema, rows = documents(*[f"{h}\n{b}." for h, b in zip(heads, bodies)])
    rows = [*rows, (2, "Unesco Paris again.", "fr", "s", 1)]  # an id twice
    found = same(spark, tmp_path, "entity_match", documents=(schema, rows))
    assert len(found) >= 3
    plan = load_all()["entity_match"].run(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "phrase" not in plan and "instr" not in plan  # no text is searched once for each name
    monkeypatch.setattr(phrases, "NAMES", 1)  # a pass for each name
    monkeypatch.setattr(phrases, "SLICE", 2)
    assert same(spark, tmp_path, "entity_match", documents=(schema, rows)) == found


def test_a_text_without_words_or_symbols_ends_no_evaluation(spark, tmp_path):
    texts = ["", "a! b c d", "a b!! c !!", "a b c d e f g h i j k!", " \n", "b !! c", "d e ! !"]
    labels = "doc_id long, quality int, toxic int", [(i, 1, i % 2) for i in range(len(texts))]
    labels[1].append((7, 0, 1))
    for name in ("agreement_kappa", "lookalike_negatives", "worst_errors"):
        assert same(spark, tmp_path, name, documents=documents(*texts, ""), labels=labels), name


def test_every_number_of_a_document_is_related(spark, tmp_path):
    texts = ["The licence holds 12 tokens and 45 versions.\nNothing else with 7.", "The version is of 45 tokens here.", "None."]
    rows = same(spark, tmp_path, "relate_detail", documents=documents(*texts))
    assert {(r[1], r[2], r[3]): r[0] for r in rows if r[1] == 0} == {
        (0, "12", 0): "cita_detalhe", (0, "45", 0): "cita_detalhe", (0, "7", 0): "cita_detalhe",
        (0, "12", 1): "nao_cita_detalhe", (0, "45", 1): "cita_detalhe", (0, "7", 1): "nao_cita_detalhe"}
