"""Sources about longer names that hold the claim's entity, from sentences to the situation."""

import pytest
from pyspark.sql import functions as F

from evidence_spark.operators import claims as C
from evidence_spark.operators import evidence as E


def test_longer_names(spark):
    rows = [("Santos", "Santos Laguna", "Santos Laguna"), ("Santos", "Santos (São Paulo)", None), ("Santos", "Lista de jogadores do Santos", None),
            ("Santos", "Lagoa Santos", "Lagoa Santos"), ("Santos", "São Vicente", None), ("Banco Central", "Banco Central do Brasil (BCB)", "Banco Central do Brasil"),
            ("Banco Central", "Banco do Brasil", None), ("Santos", None, None), (None, "Santos Laguna", None), ("Santos", "", None)]
    df = spark.createDataFrame(rows, "entity string, title string, want string")
    for r in df.withColumn("got", E.source_entity(F.col("entity"), F.col("title"))).collect():
        assert r["got"] == r["want"], r


def situation(spark, pages):
    """Situation and reason of the claim that Santos has eight titles; pages are (title, encyclopedia, sentence)."""
    sentences = spark.createDataFrame([(1, f"u{i}", f"g{i}", "completo", *p) for i, p in enumerate(pages)],
                                      "claim_id int, url string, cluster_id string, kind string, title string, encyclopedia boolean, sentence string")
    claim = C.quantities(spark.createDataFrame([(1, OWN)], "claim_id int, text string"), ["claim_id"], "text").select(
        "claim_id", "unit_key", "value", "comparator", "negated", "unit", C.qualifier_keys(F.col("quals")).alias("qual_keys"), F.array().cast("array<int>").alias("years"),
        F.lit("Santos").alias("entity"), F.array().cast("array<string>").alias("prop_stems"))
    found = E.quantity_evidence(claim, sentences).withColumnRenamed("cluster_id", "evidence_group")
    claims = spark.createDataFrame([(1, "contagem", True, True, False, 1)], "claim_id int, claim_type string, has_value boolean, comparable boolean, detail_negated boolean, direct_count int")
    row = E.synthesise(claims, found).first()
    return row["situation"], row["reason"]


OWN, LAGUNA, LAGOA = "O Santos tem 8 títulos nacionais.", "O Santos Laguna tem 6 títulos nacionais.", "O Lagoa Santos tem 5 títulos nacionais."


@pytest.mark.parametrize("pages, want", [
    ([("Santos (clube)", True, OWN)], ("apoiam", None)),
    ([("Santos (clube)", True, "O clube tem 8 títulos nacionais.")], ("apoiam", None)),  # the page is the entity
    ([("Santos Laguna", True, LAGUNA)], ("insuficiente", "other_entity")),
    ([("Santos Laguna", True, LAGUNA), ("Lagoa Santos", True, LAGOA)], ("insuficiente", "ambiguous_name")),
    ([("Santos Laguna", True, LAGUNA), ("Lagoa Santos", True, LAGOA.replace("5", "6"))], ("insuficiente", "other_entity")),
    ([("Santos Laguna", True, LAGUNA), ("Santos (clube)", True, OWN)], ("apoiam", None)),  # the longer name's value is left out
    ([("Santos Laguna", False, LAGUNA)], ("contradizem", None)),  # a news title is no subject
    ([("Santos vence de novo", False, "O clube tem 8 títulos nacionais.")], ("insuficiente", "not_named")),
])
def test_situation_by_name(spark, pages, want):
    assert situation(spark, pages) == want


def test_bylines_are_no_claim(spark):
    texts = ["Por Ana de Souza | O governo aumentou imposto sobre bebidas importadas.", "O governo aumentou imposto sobre bebidas importadas.\nBy John O'Neil\nA medida começa amanhã em todas capitais.",
             "O imposto foi criado Por Decreto federal ontem."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in C.split_claims(df, "id", "text").orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append(r["sentence"])
    assert got == {0: ["O governo aumentou imposto sobre bebidas importadas."],
                   1: ["O governo aumentou imposto sobre bebidas importadas.", "A medida começa amanhã em todas capitais."], 2: [texts[2]]}
