"""Evidence about a verifiable detail, its synthesis and what may be said about it. Never a truth verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark import lexicons as L
from evidence_spark.functions import numbers as N
from evidence_spark.functions import text as X
from evidence_spark.operators import claims as C
from evidence_spark.operators.ranking import best_per_key, top_per_key

STRONG = ["completo", "resumo"]
COMPARABLE = ["apoia", "contradiz", "valor"]


def quantity_relation(claim: dict[str, Column], found: dict[str, Column], context_only: Column) -> Column:
    """How a found quantity stands to the claimed one.

    claim: value, comparator, negated, qual_keys, years; found: value, comparator, negated, qual_keys, years.
    """
    cq, xq = claim["qual_keys"], found["qual_keys"]
    both = N.compatible(N.interval(claim["value"], claim["comparator"]), N.interval(found["value"], found["comparator"]))
    return (F.when(found["negated"] & ~claim["negated"], F.lit("negada_na_fonte")).when(context_only.isNotNull(), context_only)
            .when((F.size(cq) > 0) & (F.size(xq) > 0) & ~F.arrays_overlap(cq, xq), F.lit("outra_categoria"))
            .when((F.size(cq) > 0) & (F.size(xq) == 0), F.lit("sem_categoria"))
            .when((F.size(cq) == 0) & (F.size(xq) > 0), F.lit("categoria_nao_informada"))
            .when((F.size(claim["years"]) > 0) & (F.size(found["years"]) > 0) & ~F.arrays_overlap(claim["years"], found["years"]), F.lit("outro_periodo"))
            .when(claim["value"].isNull(), F.when(found["comparator"] == "eq", F.lit("valor")).otherwise(F.lit("limite")))
            .when(found["comparator"].isin("min", "min_excl", "max", "max_excl") & both, F.lit("limite"))
            .when(both, F.lit("apoia")).otherwise(F.lit("contradiz")))


def _page_name(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"\s*\(.*?\)\s*$", ""))


def source_entity(entity: Column, title: Column, lexicon: L.Lexicon = L.PT) -> Column:
    """The name an encyclopedia page is about when it is a longer one that holds ``entity`` ("Santos" and "Santos Laguna"); else null.

    A bracket at the end of a title is no part of the name; a list or topic page about the entity ("Lista de ...") is about itself.
    """
    name = _page_name(title)
    own, other = X.norm(entity), X.norm(name)
    holds = C.entity_match(entity, other, F.split(other, " "), C.acronyms_of(C.entities(name, lexicon), lexicon.connectors), lexicon.connectors)
    topic = F.get(F.split(other, " "), F.lit(0)).isin(list(L.ARTICLE_TYPE_WORDS_PT))
    return F.when(~topic & (own != other) & (F.length(other) > F.length(own)) & holds, name)


def quantity_evidence(claims: DataFrame, sentences: DataFrame, lexicon: L.Lexicon = L.PT) -> DataFrame:
    """Quantities of the claim's unit in source sentences, with their relation to the claim.

    claims: claim_id, value, comparator, negated, unit, unit_key, qual_keys, years, entity, prop_stems.
    sentences: claim_id, url, cluster_id, kind, title, sentence, optionally encyclopedia (whether the page is one of an
    encyclopedia, whose title names its subject). Joined on (claim, unit key).
    """
    if "encyclopedia" not in sentences.columns:
        sentences = sentences.withColumn("encyclopedia", F.lit(False))
    sents = sentences.withColumn("s_norm", X.norm("sentence"))
    found = C.quantities(sents, ["claim_id", "url", "cluster_id", "kind", "title", "encyclopedia", "sentence", "s_norm"], "sentence", lexicon)
    found = found.select("claim_id", "url", "cluster_id", "kind", "title", "encyclopedia", "sentence", "s_norm", "unit_key", "raw", F.col("value").alias("x_value"),
                         F.col("comparator").alias("x_comparator"), F.col("negated").alias("x_negated"), C.qualifier_keys(F.col("quals")).alias("x_quals"),
                         C.years_in("sentence").alias("x_years"))
    joined = found.join(claims, ["claim_id", "unit_key"])
    none = F.array().cast("array<string>")
    match = lambda text_norm: C.entity_match(F.col("entity"), text_norm, F.split(text_norm, " "), none, lexicon.connectors)
    in_sentence, in_title = match(F.col("s_norm")), match(X.norm("title"))
    is_page = F.col("encyclopedia") & (X.norm(_page_name(F.col("title"))) == X.norm("entity"))
    joined = joined.withColumn("explicit", F.col("entity").isNull() | in_sentence | is_page)
    joined = joined.filter(F.col("explicit") | in_title)
    generic = (F.col("unit_key") == "%") | X.norm("unit").isin(L.GENERIC_UNITS_PT) | F.col("entity").isNull()
    stems = X.stems_of_tokens(F.split("s_norm", " "))
    joined = joined.filter(~generic | (F.size("prop_stems") == 0) | F.arrays_overlap("prop_stems", stems))
    relation = quantity_relation(
        {"value": F.col("value"), "comparator": F.col("comparator"), "negated": F.col("negated"), "qual_keys": F.col("qual_keys"), "years": F.col("years")},
        {"value": F.col("x_value"), "comparator": F.col("x_comparator"), "negated": F.col("x_negated"), "qual_keys": F.col("x_quals"), "years": F.col("x_years")},
        F.lit(None).cast("string"))
    return joined.select("claim_id", "url", "cluster_id", "kind", "sentence", "raw", F.col("x_value").alias("value"),
                         F.array_max("x_years").alias("period"), "explicit", relation.alias("relation"),
                         F.when(F.col("encyclopedia"), source_entity(F.col("entity"), F.col("title"), lexicon)).alias("source_entity"))


def year_evidence(pairs: DataFrame, keys: Sequence[str], sentence: str, term_stems: str, years: str, reach: int = 15) -> DataFrame:
    """First year within ``reach`` words after a claim term, and whether the claim cites it. Row-local."""
    words = F.regexp_extract_all(sentence, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    staged = pairs.select(*keys, term_stems, years, words.alias("w"))
    after = F.transform("w", lambda w, i: F.when((F.length(w) >= 3) & F.array_contains(term_stems, X.stem(X.norm(w))),
                                                 F.get(F.filter(F.slice("w", i + 2, reach), lambda y: y.rlike(C.YEAR)), F.lit(0))))
    year = F.get(F.filter(after, lambda y: y.isNotNull()), F.lit(0)).cast("int")
    found = staged.select(*keys, years, year.alias("year")).filter(F.col("year").isNotNull())
    return found.select(*keys, "year", F.when(F.array_contains(years, F.col("year")), "apoia").otherwise("contradiz").alias("relation"))


def representatives(evidence: DataFrame) -> DataFrame:
    """One value per independent group: sentences naming the entity first, then the most frequent value, the smallest, the first address.

    evidence: claim_id, evidence_group, url, kind, relation, value, explicit, period, optionally source_entity. Counts combine
    before the shuffle.
    """
    if "source_entity" not in evidence.columns:
        evidence = evidence.withColumn("source_entity", F.lit(None).cast("string"))
    strong = evidence.filter(F.col("relation").isin(COMPARABLE) & F.col("kind").isin(STRONG))
    counts = strong.groupBy("claim_id", "evidence_group", "explicit", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("url", "relation", "period", "source_entity")).alias("first"))
    order = F.struct(F.col("explicit").cast("int"), "n", -F.col("value"))
    return best_per_key(counts, ["claim_id", "evidence_group"], order, ["explicit", "value", "first"]).select(
        "claim_id", "evidence_group", "explicit", "value", "first.url", "first.relation", "first.period", "first.source_entity")


def synthesise(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """One situation per claim: apoiam, contradizem, divergentes, insuficiente, resposta, nao_verificavel, sem_comparacao.

    claims: claim_id, claim_type, has_value, comparable (a quantity or a dated historical fact), detail_negated, direct_count.
    All numbers of a claim are reduced to minima, maxima and counts: values agree within tolerance exactly when the
    smallest and the largest do.

    A source about a longer name is no evidence about the claim's own. ``reason`` says why nothing was compared: other_entity
    (every value belongs to a longer name), not_named (no sentence names the entity), ambiguous_name (several longer names
    with different values); else null.
    """
    reps = representatives(evidence)
    other = F.col("explicit") & F.col("source_entity").isNotNull()
    theirs = lambda c: F.when(other, F.col(c))
    names = reps.groupBy("claim_id").agg(
        ((F.count("source_entity") == F.count(F.lit(1))) & (F.min("source_entity") == F.max("source_entity"))).alias("one_other"),
        (F.count_if("explicit") == 0).alias("unnamed"), F.count_if(other).alias("n_other"), F.count_if(F.col("explicit") & ~other).alias("n_own"),
        ((F.min(theirs("source_entity")) < F.max(theirs("source_entity"))) & (F.min(theirs("value")) < F.max(theirs("value")))).alias("ambiguous"))
    reason = (F.when(F.coalesce("one_other", F.lit(False)), "other_entity").when(F.col("unnamed"), "not_named")
              .when(F.coalesce("ambiguous", F.lit(False)), "ambiguous_name").when((F.col("n_other") > 0) & (F.col("n_own") == 0), "other_entity"))
    reasons = names.select("claim_id", reason.alias("reason"))
    named = reps.filter("explicit and source_entity is null").join(reasons.filter("reason is null").select("claim_id"), "claim_id", "left_semi")
    per = named.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n_reps"), F.count_if(F.col("relation") == "apoia").alias("support"), F.count_if(F.col("relation") == "contradiz").alias("against"),
        N.same_value(F.min("value"), F.max("value")).alias("one_value"), F.count_if(F.col("period").isNull()).alias("undated"))
    by_period = named.filter(F.col("period").isNotNull()).groupBy("claim_id", "period").agg(
        (N.same_value(F.min("value"), F.max("value")) & (F.min("relation") == F.max("relation"))).alias("agrees"), F.min("relation").alias("relation"))
    newest = by_period.groupBy("claim_id").agg(F.max_by(F.struct("agrees", "relation"), "period").alias("newest"))
    joined = claims.join(per, "claim_id", "left").join(newest, "claim_id", "left").join(reasons, "claim_id", "left")
    changing = F.col("claim_type").isin("contagem", "acontecimento_recente")
    dated = changing & ~F.col("one_value") & (F.col("undated") == 0) & F.coalesce("newest.agrees", F.lit(False))
    raw = (F.when(F.col("claim_type").isin("opiniao", "previsao"), F.lit("nao_verificavel"))
           .when(~F.col("comparable"), F.when(F.col("direct_count") > 0, F.lit("sem_comparacao")).otherwise(F.lit("insuficiente")))
           .when(F.col("n_reps").isNull(), F.lit("insuficiente"))
           .when(~F.col("has_value"), F.when(F.col("one_value"), F.lit("resposta")).otherwise(F.lit("divergentes")))
           .when((F.col("against") > 0) & (F.col("support") == 0), F.lit("contradizem"))
           .when(dated, F.when(F.col("newest.relation") == "apoia", F.lit("apoiam")).otherwise(F.lit("contradizem")))
           .when(~F.col("one_value") & changing, F.lit("divergentes"))
           .when((F.col("support") > 0) & (F.col("against") == 0), F.lit("apoiam")).otherwise(F.lit("divergentes")))
    swapped = (F.when(F.col("detail_negated") & (raw == "apoiam"), F.lit("contradizem"))
               .when(F.col("detail_negated") & (raw == "contradizem"), F.lit("apoiam")).otherwise(raw))
    asked = F.col("comparable") & ~F.col("claim_type").isin("opiniao", "previsao")
    return joined.select("claim_id", swapped.alias("situation"), F.coalesce("n_reps", F.lit(0)).alias("n_reps"), "has_value", F.when(asked, F.col("reason")).alias("reason"))


def indicate(syntheses: DataFrame) -> DataFrame:
    """Label that only describes what sources show, with a single-source note."""
    s, question = F.col("situation"), ~F.col("has_value")
    label = (F.when(s == "nao_verificavel", F.lit("inconclusiva"))
             .when(question, F.when(s == "resposta", F.lit("resposta")).otherwise(F.lit("sem_resposta")))
             .when(s == "apoiam", F.lit("dados_compativeis")).when(s == "contradizem", F.lit("dados_diferentes")).otherwise(F.lit("inconclusiva")))
    return syntheses.withColumn("label", label).withColumn("single_source", (F.col("n_reps") == 1) & s.isin("apoiam", "contradizem", "resposta"))


def homonym_check(evidence: DataFrame) -> DataFrame:
    """A name tied to more than one longer name with different values is ambiguous, not contradicted."""
    per = evidence.filter(F.col("source_entity").isNotNull()).groupBy("claim_id").agg(
        F.countDistinct("source_entity").alias("n_entities"), F.countDistinct("value").alias("n_values"))
    return per.withColumn("ambiguous", (F.col("n_entities") > 1) & (F.col("n_values") > 1))


METHOD = (r"(^| )(segundo (o|a|os|as|dados|estimativas?|levantamentos?|registros?)|de acordo com|conforme|estimad[a-z0-9]*|estimativ[a-z0-9]*|censo|"
          r"metodolog[a-z0-9]*|metodo|calculad[a-z0-9]*|calculo|consider[a-z0-9]*|inclu[a-z0-9]*|exclu[a-z0-9]*|defin[a-z0-9]*|contabiliz[a-z0-9]*|"
          r"reconhecid[a-z0-9]*|criterio[a-z0-9]*|medid[a-z0-9]*|medicao|levantamento|apurad[a-z0-9]*|contagem|referencia|refere se|oficial|oficialmente)( |$)")
PERIOD = r"(^| )(desde|anual[a-z0-9]*|mensal[a-z0-9]*|acumulad[a-z0-9]*|periodo|data de referencia)( |$)"
ANAPHORIC = (r"(?iu)^[\"“(]?(ele|ela|eles|elas|isso|isto|este|esta|estes|estas|esse|essa|esses|essas|aquele|aquela|al[eé]m disso|no entanto|por[eé]m|"
             r"contudo|assim|tamb[eé]m|antes disso|depois disso|nesse|nessa|neste|nesta|dessa|desse|desta|deste)([^\p{L}\p{N}_]|$)")


def complete_sentence(c) -> Column:
    s = X._col(c)
    return (F.length(s).between(50, 320) & s.rlike('^["“(]?[A-ZÀ-Ý0-9]') & s.rlike('[.!?]["”)]?$') & ~s.endswith("...") & ~F.contains(s, F.lit("…"))
            & ~s.rlike(ANAPHORIC))


def select_context(sentences: DataFrame, method: str = METHOD, period: str = PERIOD, k: int = 2) -> DataFrame:
    """Up to ``k`` complete sentences per claim that explain the figure: property present, method or period cue, no competing value.

    sentences: claim_id, url, sentence, prop_stems, need (stems that must appear), unit_numbers (the sentence carries a value).
    One per address; a claim's winners come from a pushed-down rank limit.
    """
    rows = sentences.filter(complete_sentence("sentence") & ~F.col("unit_numbers"))
    rows = rows.withColumn("n", X.norm("sentence")).withColumn("hits", F.size(F.array_intersect(X.stems_of_tokens(F.split("n", " ")), "prop_stems")))
    m, p = F.col("n").rlike(method), F.col("n").rlike(period)
    rows = rows.filter((F.col("hits") >= F.col("need")) & (m | p)).withColumn("score", 2 * F.col("hits") + F.when(m, 2).otherwise(0) + F.when(p, 1).otherwise(0))
    per_url = best_per_key(rows, ["claim_id", "url"], F.struct("score", "sentence"), ["score", "sentence"])
    return top_per_key(per_url, ["claim_id"], [F.desc("score"), F.asc("url")], k)


def validate_citations(answers: DataFrame, packets: DataFrame) -> DataFrame:
    """Keep citations of known ids only; a conclusion left without any becomes insufficient.

    answers: answer_id, situation, citations (array of ids); packets: answer_id, packet_id.
    """
    cited = answers.select("answer_id", F.explode("citations").alias("packet_id")).distinct().join(packets, ["answer_id", "packet_id"], "left_semi")
    valid = cited.groupBy("answer_id").agg(F.count(F.lit(1)).alias("valid"))
    joined = answers.join(valid, "answer_id", "left").withColumn("valid", F.coalesce("valid", F.lit(0)))
    lost = F.col("situation").isin("apoiam", "contradizem", "divergentes") & (F.col("valid") == 0)
    return joined.select("answer_id", F.when(lost, F.lit("insuficiente")).otherwise(F.col("situation")).alias("situation"), "valid", lost.alias("downgraded"))


def observations(results: DataFrame, now: Column) -> DataFrame:
    """Notes per claim: copies grouped, negation to check, every direct source older than 14 or 365 days, own-article counts.

    results: claim_id, relation, independence, published, copies, negated, relative.
    """
    direct = F.col("relation") == "direto"
    age = F.datediff(now, F.col("published"))
    dated = direct & F.col("published").isNotNull()
    older = lambda days: (F.count_if(dated) > 0) & F.bool_and(F.coalesce(~dated | (age > days), F.lit(True)))
    return results.groupBy("claim_id").agg(
        F.sum("copies").alias("republished"), F.bool_or("negated").alias("check_negation"),
        (F.bool_or("relative") & older(14)).alias("older_than_claim"), (~F.bool_or("relative") & older(365)).alias("all_over_a_year"),
        F.count_if(F.col("independence") == "propria").alias("own"), F.count_if(F.col("independence") == "republicacao").alias("copies_of_own"),
        F.count_if(F.col("independence") == "mesmo_veiculo").alias("same_outlet"))


def detail_fanout(quantities: DataFrame, key: str, k: int = 2) -> DataFrame:
    """The next ``k`` quantities of the same sentence, to be judged on their own (the first is the main one)."""
    ranked = top_per_key(quantities, [key], [F.asc("pos")], k + 1)
    return ranked.filter(F.col("position") > 1).withColumn("detail", F.col("position") - 1).drop("position")


CRITERIA = {"support": 40, "original": 20, "independent": 20, "context": 20}


def rubric_score(df: DataFrame, key: str) -> DataFrame:
    """Weighted rubric; null unless every reason is present, every level known, and support and original are above zero.

    Columns read per criterion: <name>_level, <name>_reason; plus assessable and claim.
    """
    ready = F.col("assessable") & (F.trim("claim") != "")
    total = F.lit(0.0)
    for name, weight in CRITERIA.items():
        level = F.col(f"{name}_level")
        ready = ready & level.isin(0.0, 0.5, 1.0) & F.coalesce(F.trim(F.col(f"{name}_reason")) != "", F.lit(False))
        total = total + level * weight
    ready = F.coalesce(ready & (F.col("support_level") > 0) & (F.col("original_level") > 0), F.lit(False))
    score = F.when(ready, total)
    tone = F.when(score.isNull(), "unknown").when(score >= 80, "strong").when(score >= 50, "partial").otherwise("limited")
    return df.select(key, score.alias("score"), tone.alias("tone"))
