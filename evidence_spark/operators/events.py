"""Event frames (who, which action, on what, when, numbers, negation) and their comparison.

Search similarity only finds candidates; the verdict comes from here. A frame is read inside the row from one sentence;
comparing two frames is a column expression over their arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark import lexicons as L
from evidence_spark.functions import dates
from evidence_spark.functions import numbers as N
from evidence_spark.functions import text as X
from evidence_spark.operators import claims as C
from evidence_spark.operators.ranking import top_per_key
from evidence_spark.session import kept

SAME, DIVERGENT, CONTEXT, OTHER, UNCERTAIN = ("mesmo_acontecimento", "detalhe_divergente", "contexto_relacionado", "outro_acontecimento", "relacao_incerta")
TOKEN = r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{N}_]+"
SPAN = 6  # words an action expression may cover
SEMANTIC_SAME, SEMANTIC_OTHER = 0.72, 0.55


def ordered_actions() -> list[tuple[str, str]]:
    """Expressions of several words before single words: at one position the longer reading wins."""
    several = [a for a in L.ACTIONS_PT if " " in a[1]]
    return several + [a for a in L.ACTIONS_PT if a not in several]


def action_at(words: Column, i: Column) -> Column:
    """struct(cls, span) of the action expression that starts at word ``i``; null when none does."""
    tail = F.concat(F.array_join(F.slice(words, i + 1, SPAN), " "), F.lit(" "))
    any_action = "^(?:" + "|".join(f"(?:{p})" for _, p in L.ACTIONS_PT) + ") "
    out = None
    for name, pattern in ordered_actions():
        hit = tail.rlike(f"^(?:{pattern}) ")
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    # One combined test first: most words are not actions.
    return F.when(tail.rlike(any_action), out)


def find_actions(words: Column) -> Column:
    """All action hits of a sentence as (i, cls). Places are tried only in a sentence that holds some action expression."""
    hits = F.transform(words, lambda w, i: F.struct(i.alias("i"), action_at(words, i).alias("cls")))
    found = F.filter(hits, lambda h: h["cls"].isNotNull())
    some = " (?:" + "|".join(f"(?:{p})" for _, p in L.ACTIONS_PT) + ") "
    whole = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.when(whole.rlike(some), found).when(words.isNotNull(), F.array().cast("array<struct<i:int,cls:string>>"))


def main_action(words: Column, hits: Column) -> Column:
    """First hit that is not inside a subordinate clause: no connective in the three words before it, unless the connective
    belongs to a nearer action."""
    sub = X.words_array(L.SUBORDINATORS_PT)

    def free(h):
        before = F.filter(F.sequence(F.greatest(h["i"] - 3, F.lit(0)), h["i"]), lambda k: (k < h["i"]) & F.array_contains(sub, F.get(words, k)))
        return ~F.exists(before, lambda k: ~F.exists(hits, lambda o: (o["i"] > k) & (o["i"] < h["i"])))

    return F.get(F.filter(hits, free), F.lit(0))


def content_keys(words: Column, exclude: Column, lexicon: L.Lexicon) -> Column:
    banned = X.words_array([*lexicon.stop, *lexicon.negations, *lexicon.generic, *lexicon.months, *L.LIGHT_WORDS_PT, *L.GENERIC_HEADS_PT])
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(banned, w) & ~F.array_contains(exclude, w) & ~w.rlike("[0-9]"))
    return F.array_distinct(F.transform(kept, X.topic_key))


def noun_keys(words: Column, exclude: Column, lexicon: L.Lexicon) -> Column:
    """Content words right after an article or preposition; an infinitive after a plain preposition is a verb."""
    det, art = X.words_array(L.DETERMINERS_PT), X.words_array("o os um do dos no nos ao aos pelo pelos".split())
    placed = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), F.when(i > 0, F.get(words, i - 1)).alias("p"))),
                      lambda s: s["p"].isNotNull() & F.array_contains(det, s["p"]) & ~((F.length(s["w"]) > 4) & s["w"].rlike("(ar|er|ir)$") & ~F.array_contains(art, s["p"])))
    return content_keys(F.transform(placed, lambda s: s["w"]), exclude, lexicon)


def name_tokens(sentence: Column, literal: Column, lexicon: L.Lexicon) -> Column:
    """Words of proper names: entities and all-capital words, without generic heads ("governo")."""
    link = X.words_array([*lexicon.connectors, *lexicon.stop, *L.GENERIC_HEADS_PT])
    of_entities = F.flatten(F.transform(C.entities(sentence, lexicon), X.tokens))
    capitals = F.transform(F.filter(literal, lambda w: w.rlike(r"^\p{Lu}{2,}$")), X.norm)
    return F.array_distinct(F.filter(F.concat(of_entities, capitals), lambda w: ~F.array_contains(link, w) & (F.length(w) >= 2)))


def numbers_with_unit(sentence: Column, lexicon: L.Lexicon) -> Column:
    """Set of "number unit" strings, years and function words left out."""
    found = F.regexp_extract_all(sentence, F.lit(r"((?<![0-9/.,])[0-9]+(?:[.,][0-9]+)?\s*(?:%|\p{L}+))"), F.lit(1))
    stop = X.words_array(lexicon.stop)
    parts = F.transform(found, lambda m: F.struct(
        N.number_key(F.regexp_extract(m, "^([0-9]+(?:[.,][0-9]+)?)", 1)).alias("v"),
        F.when(m.endswith("%"), F.lit("%")).otherwise(X.topic_key(X.norm(F.regexp_extract(m, r"(\p{L}+)$", 1)))).alias("u")))
    return F.array_distinct(F.filter(parts, lambda s: ~s["v"].rlike("^(19|20)[0-9]{2}$") & (s["u"] != "") & ~F.array_contains(stop, s["u"])))


ATTRIBUTION = r"(?iu)(?:segundo|conforme|de acordo com|diz|dizem|mostra|mostram|aponta|apontam|revela|indica)\s+(?:os? dados d[oa]s?\s+|o |a |os |as )?(\p{Lu}[\p{L}\p{N}.&\-]*(?:\s+\p{Lu}[\p{L}\p{N}.&\-]*){0,3})"


def plain_norm(word: Column) -> Column:
    """``X.norm`` of one word; plain letters and digits need no folding."""
    return F.when(word.rlike("^[A-Za-z0-9]+$"), F.lower(word)).otherwise(X.norm(word))


def event_frames(df: DataFrame, keys: Sequence[str], sentence: str, lexicon: L.Lexicon = L.PT) -> DataFrame:
    """One frame per row's sentence, built in stages so that no expression is evaluated twice."""
    s = F.col(sentence)
    f = df.select(*keys, s.alias("sentence"))
    f = f.withColumn("_lit", F.regexp_extract_all("sentence", F.lit(f"({TOKEN})"), F.lit(1))).withColumn("_w", F.transform("_lit", plain_norm))
    f = f.withColumns({"_hits": find_actions(F.col("_w")), "names": name_tokens(F.col("sentence"), F.col("_lit"), lexicon)})
    f = f.withColumn("_a", main_action(F.col("_w"), F.col("_hits")))
    a0, size = F.col("_a.i"), F.size("_w")
    acted = a0.isNotNull()
    f = f.withColumns({
        "action": F.col("_a.cls"), "_verb": F.get("_w", a0),
        "_before": F.when(acted, F.slice("_w", F.lit(1), a0)).otherwise(F.slice("_w", F.lit(1), F.least(F.lit(4), size))),
        "_after": F.when(acted, F.slice("_w", a0 + 2, size)).otherwise(F.col("_w"))})
    participle = F.coalesce(F.col("_verb").rlike("(ado|ada|ados|adas|ido|ida|idos|idas)$"), F.lit(False))
    aux = F.arrays_overlap(F.slice("_w", F.greatest(a0 - 3, F.lit(0)) + 1, F.least(a0, F.lit(3))), X.words_array(L.AUXILIARIES_PT))
    by = F.array_position(F.transform("_after", lambda w: F.array_contains(X.words_array(L.PASSIVE_BY_PT), w)), True).cast("int")
    f = f.withColumns({"_passive": F.coalesce(acted & participle & aux, F.lit(False)), "_by": by})
    none = F.array().cast("array<string>")
    f = f.withColumns({
        "_agent": F.when(~F.col("_passive"), F.col("_before")).when(F.col("_by") > 0, F.slice("_after", F.col("_by") + 1, 5)).otherwise(none),
        "_object": F.when(F.col("_passive"), F.col("_before")).when(acted, F.slice("_after", 1, 14)).otherwise(F.col("_after"))})
    stop = X.words_array([*lexicon.stop, *lexicon.negations, *lexicon.generic, *L.LIGHT_WORDS_PT])
    plain = F.filter("_agent", lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))
    exclude = F.array_append("names", F.coalesce("_verb", F.lit("")))
    near = F.slice("_w", F.greatest(a0 - 3, F.lit(0)) + 1, F.least(a0, F.lit(3)))
    denies = (F.col("action") == "confirmar") & F.col("_verb").rlike("^(neg|desment)")
    f = f.withColumns({
        "agent_names": F.array_intersect("_agent", "names"), "agent_words": F.array_distinct(F.transform(plain, X.topic_key)),
        "object_keys": content_keys(F.col("_object"), exclude, lexicon), "nouns": noun_keys(F.col("_object"), exclude, lexicon),
        "target": F.array_intersect(F.slice("_after", 1, 2), "names"),
        "numbers": numbers_with_unit(F.col("sentence"), lexicon), "stage": C.act_stage("sentence"),
        "negated": F.when(acted, X.has_any(near, lexicon.negations) | F.coalesce(denies, F.lit(False))).otherwise(X.has_any(F.col("_w"), lexicon.negations)),
        "actions": F.array_distinct(F.transform("_hits", lambda h: h["cls"])),
        "attribution": F.array_distinct(F.flatten(F.transform(F.regexp_extract_all("sentence", F.lit(ATTRIBUTION), F.lit(1)), X.tokens)))})
    return f.select(*keys, "sentence", "action", "actions", "agent_names", "agent_words", "object_keys", "nouns", "names", "target", "numbers",
                    "negated", "stage", "attribution", F.col("_passive").alias("passive"))


def frames_of_distinct(df: DataFrame, keys: Sequence[str], sentence: str, lexicon: L.Lexicon = L.PT) -> DataFrame:
    """``event_frames`` where sentences repeat: each distinct one is read once, then joined to its rows."""
    frames = kept(event_frames(df.select(F.col(sentence).alias("_s")).distinct(), ["_s"], "_s", lexicon), "frames")
    joined = df.select(*keys, F.col(sentence).alias("_own")).join(frames, F.col("_own").eqNullSafe(F.col("_s")))
    return joined.drop("_own", "_s")


def original_events(claims: DataFrame, key: str, claim: str, body: str, published: str, lexicon: L.Lexicon = L.PT, opening: int = 4,
                    chars: int | None = None) -> DataFrame:
    """The claim's frame, widened by the first ``opening`` sentences of its article that share the agent or the action.

    ``chars`` limits the text that is read.
    """
    own = frames_of_distinct(claims, [key], claim, lexicon)
    sents = claims.select(key, published, F.posexplode(X.sentences(F.substring(body, 1, chars) if chars else F.col(body), ".!?", 12)).alias("n", "s"))
    frames = frames_of_distinct(sents, [key, "n", published], "s", lexicon)
    lead = own.select(key, F.col("action").alias("_act"), F.array_union("agent_names", F.array_except("agent_words", X.words_array(L.GENERIC_HEADS_PT))).alias("_agent"))
    joined = frames.join(lead, key)
    same_action = F.coalesce(F.array_contains("actions", F.col("_act")), F.lit(False))
    same_agent = F.arrays_overlap(F.concat("names", "agent_words", "object_keys"), "_agent")
    joined = joined.withColumns({"_same": same_action, "_folded": dates.padded_fold("sentence")}).filter(same_agent | F.col("_same"))
    joined = top_per_key(joined, [key], [F.asc("n")], opening)
    joined = joined.withColumn("_date", F.when(F.col("_same"), dates.fact_date("_folded", published)))
    extra = joined.groupBy(key).agg(
        F.array_distinct(F.flatten(F.collect_list("object_keys"))).alias("_obj"), F.array_distinct(F.flatten(F.collect_list("nouns"))).alias("_nouns"),
        F.array_distinct(F.flatten(F.collect_list("attribution"))).alias("_attr"),
        F.min_by("_date", F.when(F.col("_date").isNotNull(), F.col("n"))).alias("_fact"))
    out = own.join(claims.select(key, F.col(claim).alias("_claim"), F.col(published).alias("_pub")), key).join(extra, key, "left")
    none = F.array().cast("array<string>")
    wide = lambda a, b: F.array_except(F.array_union(a, F.coalesce(b, none)), F.array_union("names", "agent_words"))
    out = out.withColumn("_folded", dates.padded_fold("_claim"))
    out = out.withColumn("_cited", F.coalesce("_fact", dates.fact_date("_folded", "_pub", coarse=True)))
    cited = F.col("_cited")
    day = F.coalesce(cited["day"], F.to_date("_pub"))
    return out.withColumns({
        "object_keys": wide("object_keys", "_obj"), "nouns": wide("nouns", "_nouns"), "attribution": F.array_union("attribution", F.coalesce("_attr", none)),
        "other_actions": F.array_except("actions", F.array("action")), "date": F.when(day.isNotNull(), F.struct(
            day.alias("day"), F.coalesce(cited["granularity"], F.lit("dia")).alias("granularity"))), "date_explicit": cited.isNotNull()}).drop("_obj", "_nouns", "_attr", "_fact", "_claim", "_pub", "_folded", "_cited")


def compare_agent(o_names: Column, o_words: Column, c_agent_names: Column, c_agent_words: Column, c_names: Column) -> Column:
    """match, conflict or unknown. A generic head alone identifies nobody; swapped roles conflict."""
    heads = X.words_array([*L.GENERIC_HEADS_PT, *[w[:-1] for w in L.GENERIC_HEADS_PT if w.endswith("s")]])
    everyone = F.array_union(c_agent_names, c_agent_words)
    distinct = F.array_except(everyone, heads)
    words = F.array_except(o_words, heads)
    as_object = F.arrays_overlap(F.array_except(c_names, c_agent_names), o_names) & ~F.arrays_overlap(everyone, o_names)
    return (F.when((F.size(o_names) > 0) & as_object & (F.size(distinct) > 0), F.lit("conflict")).when(F.size(everyone) == 0, F.lit("unknown"))
            .when((F.size(o_names) > 0) & F.arrays_overlap(everyone, o_names), F.lit("match"))
            .when((F.size(o_names) == 0) & (F.size(words) > 0) & F.arrays_overlap(c_agent_words, words), F.lit("match"))
            .when((F.size(o_names) == 0) & (F.size(words) == 0), F.lit("unknown"))
            .when((F.size(distinct) == 0) & (F.size(everyone) <= 1), F.lit("unknown")).otherwise(F.lit("conflict")))


def same_class(a: Column, b: Column) -> Column:
    opposite = a.isin(L.OPPOSITE_CLASSES) & b.isin(L.OPPOSITE_CLASSES)
    return F.coalesce((a == b) | opposite, F.lit(False))


def verdict(agent: Column, has_action: Column, same_action: Column, object_match: Column, names_disjoint: Column, named_match: Column,
            shared_names: Column, no_object: Column, semantic: Column) -> Column:
    """The five relations, in the order the rules apply."""
    return (F.when(~named_match & names_disjoint, F.lit(OTHER))
            .when(~has_action, F.when((agent != "conflict") & (object_match | (shared_names >= 2)), F.lit(UNCERTAIN))
                  .when(object_match, F.lit(CONTEXT)).otherwise(F.lit(OTHER)))
            .when(~same_action, F.when(object_match, F.lit(CONTEXT)).otherwise(F.lit(OTHER)))
            .when(agent == "conflict", F.when(object_match, F.lit(CONTEXT)).otherwise(F.lit(OTHER)))
            .when(agent == "unknown", F.when(object_match, F.lit(UNCERTAIN)).otherwise(F.lit(OTHER)))
            .when(object_match | no_object, F.lit(SAME))
            .when(semantic >= SEMANTIC_SAME, F.lit(SAME)).when(semantic < SEMANTIC_OTHER, F.lit(OTHER)).otherwise(F.lit(UNCERTAIN)))


def date_verdict(o_date: Column, o_explicit: Column, c_date: Column, c_explicit: Column, c_published: Column) -> Column:
    """antes, depois, tarde, mesma_epoca or null (compatible); null when a side has no date."""
    gap, cd, od = dates.date_gap(o_date, c_date), c_date["day"], o_date["day"]
    end = (F.when(o_date["granularity"] == "mes", F.date_add(F.add_months(od, 1), 45)).when(o_date["granularity"] == "ano", F.date_add(F.add_months(od, 12), 90))
           .otherwise(F.date_add(od, 7)))
    near = F.coalesce(F.abs(F.datediff(c_published, od)) <= 7, F.lit(False))
    return (F.when(c_explicit & o_explicit, F.when(gap.isNotNull(), F.when(cd < od, F.lit("antes")).otherwise(F.lit("depois"))))
            .when(c_explicit & near, F.lit("mesma_epoca"))
            .when(c_explicit, F.when(cd < F.date_add(od, -7), F.lit("antes")).when(cd > F.date_add(od, 1), F.lit("depois")))
            .when(o_explicit, F.when(cd < F.date_add(od, -1), F.lit("antes")).when(cd > end, F.lit("tarde")))
            .otherwise(F.when(cd < F.date_add(od, -7), F.lit("antes")).when(cd > F.date_add(od, 7), F.lit("tarde"))))


def settle(kind: Column, when: Column, o_action: Column, c_action: Column, o_negated: Column, c_negated: Column, other_number: Column,
           other_survey: Column) -> tuple[Column, Column]:
    """Final relation and ``earlier`` flag after dates, origin of the data, direction, negation and numbers."""
    dated = (F.when((kind == SAME) & (when == "antes"), F.lit(CONTEXT)).when((kind == SAME) & (when == "depois"), F.lit(OTHER))
             .when((kind == SAME) & (when == "tarde"), F.lit(UNCERTAIN)).otherwise(kind))
    earlier = F.coalesce((kind == SAME) & (when == "antes"), F.lit(False))
    opposite = F.coalesce(o_action.isin(L.OPPOSITE_CLASSES) & c_action.isin(L.OPPOSITE_CLASSES) & (o_action != c_action), F.lit(False))
    final = (F.when((dated == SAME) & other_survey, F.lit(CONTEXT)).when((dated == SAME) & (opposite | (o_negated != c_negated) | other_number), F.lit(DIVERGENT))
             .otherwise(dated))
    return final, earlier


def compare_events(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Relation of candidate frames (c_*) to original events (o_*), one row per pair, with the facts behind it."""
    heads, court = X.words_array(L.GENERIC_HEADS_PT), X.words_array([w.rstrip("s") for w in L.COURT_WORDS_PT])
    o, c = (lambda n: F.col(f"o_{n}")), (lambda n: F.col(f"c_{n}"))
    p = pairs.withColumn("agent", compare_agent(o("agent_names"), o("agent_words"), c("agent_names"), c("agent_words"), c("names")))
    subject = F.concat(c("object_keys"), c("nouns"), F.array_except(c("agent_words"), F.array_union(c("agent_names"), heads)),
                       F.transform(F.array_except(c("names"), F.array_union(c("agent_names"), c("target"))), X.topic_key))
    p = p.withColumn("hits", F.array_except(F.array_intersect(subject, o("object_keys")), court))
    object_match = F.when(F.col("agent") == "match", F.size("hits") > 0).otherwise(F.arrays_overlap("hits", o("nouns")))
    o_part, c_part = F.array_except(o("names"), o("attribution")), F.array_except(c("names"), c("attribution"))
    disjoint = (F.size(o_part) > 0) & (F.size(c_part) > 0) & ~F.arrays_overlap(o_part, c_part)
    p = p.withColumns({
        "same_action": same_class(c("action"), o("action")) | F.coalesce(F.array_contains(o("other_actions"), c("action")), F.lit(False)),
        "object_match": object_match, "names_disjoint": disjoint, "named_match": (F.col("agent") == "match") & (F.size(o("agent_names")) > 0),
        "shared_names": F.size(F.array_intersect(o("names"), c("names"))), "no_object": (F.size(c("object_keys")) == 0) & (F.size(o("object_keys")) == 0)})
    semantic = F.col("semantic") if "semantic" in pairs.columns else F.lit(None).cast("double")
    first = verdict(F.col("agent"), c("action").isNotNull(), F.col("same_action"), F.col("object_match"), F.col("names_disjoint"), F.col("named_match"),
                    F.col("shared_names"), F.col("no_object"), semantic)
    units = F.transform(o("numbers"), lambda n: n["u"])
    shared_units = F.filter(c("numbers"), lambda n: F.array_contains(units, n["u"]))
    other_number = (F.size(shared_units) > 0) & ~F.exists(shared_units, lambda n: F.array_contains(o("numbers"), n))
    survey = o("action").isin(L.OPPOSITE_CLASSES) & (F.size(o("attribution")) > 0) & (F.size(c("attribution")) > 0) & ~F.arrays_overlap(o("attribution"), c("attribution"))
    p = p.withColumns({"first": first, "when": date_verdict(o("date"), o("date_explicit"), c("date"), c("date_explicit"), c("published")),
                       "other_number": other_number, "other_survey": F.coalesce(survey, F.lit(False))})
    final, earlier = settle(F.col("first"), F.col("when"), o("action"), c("action"), o("negated"), c("negated"), F.col("other_number"), F.col("other_survey"))
    return p.withColumns({"kind": final, "earlier": earlier}).select(*keys, "kind", "earlier", "agent", "same_action", "object_match", "when", "first")
