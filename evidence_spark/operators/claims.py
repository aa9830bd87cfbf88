"""Claims to structure: cleaning, entities, quantities, interpretation, queries, relevance of candidate sources.

Everything per claim is computed on arrays inside the row; only term ranking and pair joins shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_spark import lexicons as L
from evidence_spark.functions import dates
from evidence_spark.functions import numbers as N
from evidence_spark.functions import text as X
from evidence_spark.operators import blocking as B
from evidence_spark.operators import context as CX
from evidence_spark.operators import tokens as K
from evidence_spark.session import kept

# --- fixed patterns -----------------------------------------------------------------------------------------------------
FRAMING = (r"(?:(?:é|e)\s+)?(?:verdade|fato|real)\s+que\s+|ser[aá]\s+que\s+|procede\s+que\s+|(?:eu\s+)?(?:vi|li|ouvi|recebi)\s+"
           r"(?:dizer\s+)?que\s+|(?:dizem|disseram|falaram|est[aã]o\s+dizendo|est[aã]o\s+falando)\s+que\s+|(?:é|e)\s+verdade\s*[:,\-]?\s*")
ATTENTION = (r"(?:urgente|bomba|aten[cç][aã]o|alerta|agora|plant[aã]o|exclusivo|grave|breaking|[uú]ltima hora|confirmado|vejam?)"
             r"\s*[:!|–—\-]+\s*")
MEDIA = (r"(?:nov[ao]s?\s+)?(?:imagens?|fotos?|fotografias?|v[ií]deos?)\s+(?:mostram?|revelam?|registram?|exibem?|flagram?)\s+"
         r"(?:como\s+(?:foi|é|era|foram|ficou)\s+|(?:o\s+)?momento\s+em\s+que\s+|que\s+)?")
LEAD_INS = rf"(?iu)^(?:\s*(?:{FRAMING}|{ATTENTION}))+"
MEDIA_START = rf"(?iu)^\s*{MEDIA}"
FUSED = r"(?i)(^|[^\p{L}])(foi|era|para|como|que|sobre|entre)(os|as|o|a)($|[^\p{L}])"
EDGES = r"^[ ?¿!\-–—:]+|[ ?¿!\-–—:]+$"
QUESTION = r"(?iu)^\s*(quem|qual|quais|quando|onde|como|por que|porque|o que|é verdade|será|who|what|when|where|why|how)([^\p{L}\p{N}_]|$)"


@dataclass(frozen=True)
class ClaimPatterns:
    """Word patterns over normalised text that decide the type of a claim."""

    opinion: str
    future: str
    cumulative: str
    recent: str
    how_many: str


def _words(*alternatives: str) -> str:
    return "(^| )(" + "|".join(alternatives) + ")( |$)"


PT_PATTERNS = ClaimPatterns(
    opinion=_words("melhor(es)?", "pior(es)?", "lind[oa]s?", "fei[oa]s?", "incrive(l|is)", "horrive(l|is)", "injust[oa]s?",
                   "absurd[oa]s?", "vergonh[a-z]*", "deveria[a-z]*", "acho", "acredito", "opiniao", "genial", "ridicul[a-z]*",
                   "maravilhos[a-z]*", "pessim[a-z]*", "otim[oa]s?"),
    future=_words("vai", "vao", "ira", "irao", "sera", "serao", "devera", "pretende", "pretendem", "previsao", "preve", "promete",
                  "prometem", "proxim[oa]s?", "futuramente"),
    cumulative=_words("tem", "possui", "possuem", "acumula[a-z]*", "soma[a-z]*", "total", "ao todo", "ja", "conquist[a-z]*",
                      "ganh[a-z]*", "venc[a-z]*"),
    recent=_words("hoje", "ontem", "anteontem", "agora", "nesta", "neste", "esta semana", "recentemente", "acaba de", "acabou de",
                  "atualmente"),
    how_many="^(e verdade que )?quant[oa]s( |$)")
EN_PATTERNS = ClaimPatterns(
    opinion=_words("best", "worst", "beautiful", "terrible", "unfair", "should"),
    future=_words("will", "would", "shall", "going to", "plans to"),
    cumulative=_words("has", "have", "total", "already", "won"),
    recent=_words("today", "yesterday", "now", "this week", "recently"), how_many="^how many( |$)")


# Fixed value: the author's line at the start of a line or sentence.
BYLINE = r"(?m)(^|[.\n])\s*(?:Por|By)\s+[A-ZÀ-Ý][\p{L}\p{N}_'’]+(?:\s+(?:d[aeo]s?\s+)?[A-ZÀ-Ý][\p{L}\p{N}_'’]+)*\s*[,|–-]?"


def clean_claim(c, max_chars: int | None = None) -> Column:
    """Input (cut only if ``max_chars`` is given) without framing, attention marks and media lead-ins, fused short words split."""
    t = F.replace(F.coalesce(X._col(c), F.lit("")), F.lit("\r"), F.lit("\n"))
    t = F.substring(t, 1, max_chars) if max_chars else t
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "[ \t ]+", " "), "\n{2,}", "\n"))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, FUSED, "$1$2 $3$4"), LEAD_INS, ""))
    rest = F.trim(F.regexp_replace(t, MEDIA_START, ""))
    t = F.when(F.size(F.split(rest, " ")) >= 4, rest).otherwise(t)
    return F.regexp_replace(t, EDGES, "")


def is_question(c) -> Column:
    return F.rtrim(X._col(c), F.lit(X.SPACES)).endswith("?") | X._col(c).rlike(QUESTION)


# --- entities -------------------------------------------------------------------------------------------------------------
CAP = r"\p{Lu}[\p{L}\p{N}_'’\-]*"


def run_pattern(connectors: Sequence[str]) -> str:
    link = "(?:(?:" + "|".join(connectors) + r")\s+)?" if connectors else ""
    return rf"(?:[.!?:\"“(\n]\s*|[^\p{{L}}\p{{N}}_'’\-]){CAP}(?:\s+{link}{CAP})*"


def entities(c, lexicon: L.Lexicon = L.PT) -> Column:
    """Capitalised runs joined by connectors and acronyms, without sentence-initial single words; maximal strings only,
    in text order. Mostly upper-case texts have none: capitals say nothing there."""
    text = X._col(c)
    stop = X.words_array(lexicon.stop)
    runs = F.regexp_extract_all(F.concat(F.lit("."), text), F.lit(run_pattern(lexicon.connectors)), F.lit(0))

    def pieces(m):
        start = m.rlike(r"^[.!?:\"“(\n]")
        words = F.split(F.regexp_replace(m, r"^[^\p{Lu}]+", ""), r"\s+")
        marked = F.array_join(F.transform(words, lambda w: F.when(
            w.rlike(r"^\p{Lu}") & F.array_contains(stop, X.norm(w)), F.lit("\u0001")).otherwise(w)), " ")
        return F.transform(F.split(marked, "\u0001"), lambda p, i: F.struct(p.alias("p"), (start & (i == 0)).alias("first")))

    edge = "(?:" + "|".join(lexicon.connectors) + ")" if lexicon.connectors else "(?!)"
    strip = lambda p: X.trim(F.regexp_replace(X.trim(p), rf"^(?:{edge}\s+)+|(?:\s+{edge})+$", ""))
    found = F.transform(F.flatten(F.transform(runs, pieces)), lambda s: F.struct(strip(s["p"]).alias("p"), s["first"].alias("first")))
    acronym = lambda p: ~p.rlike(r"\s") & (F.length(p) >= 2) & ~p.rlike(r"\p{Ll}")
    kept = F.filter(found, lambda s: (s["p"] != "") & (s["p"].rlike(r"\s") | acronym(s["p"]) | ~s["first"]))
    named = F.transform(kept, lambda s: F.struct(s["p"].alias("p"), X.norm(s["p"]).alias("n")))
    named = F.filter(named, lambda s: (F.length(s["n"]) >= 2) & ~F.array_contains(stop, s["n"]) & ~F.array_contains(
        X.words_array([*lexicon.months, "feira"]), s["n"]))
    shouting = F.filter(X.literal_words(text), lambda w: w.rlike(r"^\p{L}") & (F.length(w) >= 3))
    loud = X.let(shouting, lambda words: F.size(F.filter(words, lambda w: ~w.rlike(r"\p{Ll}"))) > F.size(words) * 0.6)
    return F.when(loud, F.array().cast("array<string>")).otherwise(X.let(named, _maximal))


def _maximal(named: Column) -> Column:
    """First literal of every normalised form that is not contained in a longer form.

    Runs of a form's words, of the lengths that occur among the forms, are what it contains: a hash set difference, not all pairs.
    """
    def of(norms: Column) -> Column:
        split = F.transform(norms, lambda n: F.split(n, " "))

        def contained(words: Column) -> Column:
            sizes = F.array_distinct(F.transform(words, F.size))
            return X.let(sizes, lambda sizes: F.flatten(F.transform(words, lambda w: F.flatten(F.transform(F.filter(sizes, lambda k: k < F.size(w)), lambda k: F.transform(
                F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " ")))))))

        lists = F.struct(F.transform(named, lambda s: s["p"]).alias("p"), F.transform(named, lambda s: s["n"]).alias("n"))
        top = F.array_except(norms, X.let(split, contained))
        return X.let(lists, lambda x: F.transform(top, lambda n: F.get(x["p"], (F.array_position(x["n"], n) - 1).cast("int"))))

    return X.let(F.array_distinct(F.transform(named, lambda s: s["n"])), of)


def without_words(words: Column, left_out: Sequence[str]) -> Column:
    """The words joined by blanks, without those of a list."""
    return F.array_join(F.filter(words, lambda w: ~F.array_contains(X.words_array(left_out), w)), " ")


def entity_match(entity: Column, cand_norm: Column, cand_tokens: Column, cand_acronyms: Column, connectors: Sequence[str],
                 by_initials: bool = True, bare: Column | None = None) -> Column:
    """Exact phrase, acronym, or the name's words in order with connectors skipped; with ``by_initials`` also the name's initials as a word.

    ``bare`` is the text without connectors, where it is at hand.
    """
    n = X.norm(entity)
    link = X.words_array(connectors)
    toks = F.filter(F.split(n, " "), lambda w: (F.length(w) >= 3) & ~F.array_contains(link, w))
    bare = without_words(F.split(cand_norm, " "), connectors) if bare is None else bare
    initials = F.array_join(F.transform(toks, lambda w: F.substring(w, 1, 1)), "")
    upper = entity.rlike(r"\p{Lu}") & ~entity.rlike(r"\p{Ll}")
    single = (upper & F.array_contains(cand_acronyms, n)) | F.coalesce(F.array_contains(cand_tokens, F.get(toks, F.lit(0))), F.lit(False))
    many = X.phrase_in(F.array_join(toks, " "), bare)
    many = many | F.array_contains(cand_tokens, initials) if by_initials else many
    return X.phrase_in(n, cand_norm) | F.when(F.size(toks) <= 1, single).otherwise(many)


def acronyms_of(ents: Column, connectors: Sequence[str]) -> Column:
    return F.filter(F.transform(ents, lambda e: X.acronym(X.tokens(e), connectors)), lambda a: a.isNotNull())


# --- quantities -------------------------------------------------------------------------------------------------------------
QUANTITY_TOKEN = r"R\$|US\$|€|[0-9]+[ºª°]|[0-9]+(?:[.,][0-9]+)*|%|\p{L}[\p{L}\p{N}_\-]*|[.,;:!?()\"“”]"
YEAR = "^(1[5-9][0-9]{2}|20[0-9]{2})$"
CURRENCY = {"R$": "reais", "US$": "dólares", "€": "euros"}


def _map(values: dict) -> Column:
    plain = lambda v: F.lit(float(v)) if isinstance(v, (int, float)) else F.lit(v)
    return F.create_map(*[c for k, v in values.items() for c in (F.lit(k), plain(v))])


def unit_key(unit: Column) -> Column:
    n = X.norm(unit)
    return F.when((unit == "%") | n.isin("porcento", "por cento"), F.lit("%")).otherwise(X.stem(F.replace(n, F.lit(" "), F.lit(""))))


def quantities(df: DataFrame, keys: Sequence[str], text: str, lexicon: L.Lexicon = L.PT, weak_units: str | None = None,
               exclude: str | None = None) -> DataFrame:
    """Number (+ scale) + unit (+ up to three qualifiers, comparator, negation) mentions of each row's text.

    ``weak_units`` names an array column of unit keys that also accept "um/uma" and ordinals.
    """
    keep = [*keys, *[c for c in (weak_units, exclude) if c]]
    toks = df.select(*keep, F.regexp_extract_all(text, F.lit(f"({QUANTITY_TOKEN})"), F.lit(1)).alias("tk"))
    toks = toks.withColumn("nt", F.transform("tk", lambda w: F.when(w.isin("%", *CURRENCY), w).otherwise(X.norm(w))))
    mult = "^(" + "|".join(L.CHAMPION_PREFIXES_PT) + ")-?campe"
    numeric = lambda w: w.rlike("^[0-9]+(?:[.,][0-9]+)*[ºª°]?$")
    wordy = [*L.NUMBER_WORDS_PT, *L.WEAK_NUMBERS_PT, *L.ORDINALS_PT] if lexicon.lang == "pt" else []
    is_start = lambda w: numeric(w) | F.array_contains(X.words_array(wordy), X.norm(w)) | F.lower(w).rlike(mult) if wordy else numeric(w)
    at = F.filter(F.transform("tk", lambda w, i: F.when(is_start(w), i)), lambda i: i.isNotNull())
    rows = toks.select(*keep, "tk", "nt", F.explode(at).alias("i"))
    get = lambda arr, pos: F.get(F.col(arr), pos)
    i = F.col("i")
    stop, qstop, links = X.words_array(lexicon.stop), X.words_array(L.QUALIFIER_STOP_PT), X.words_array(L.QUALIFIER_LINKS_PT)
    in_ = lambda arr, v: F.coalesce(F.array_contains(arr, v), F.lit(False))
    t, n, nxt = get("tk", i), get("nt", i), F.coalesce(get("nt", i + 1), F.lit(""))
    letter = lambda v: F.coalesce(v.rlike(r"^\p{L}"), F.lit(False))
    year_alone = t.rlike(YEAR) & ((nxt == "") | in_(stop, nxt) | ~nxt.rlike("^[a-z0-9]") | in_(qstop, nxt))
    weak = F.col(weak_units) if weak_units else None
    value = F.when(t.rlike("^[0-9]+(?:[.,][0-9]+)*$"), F.when(~year_alone, N.to_double(t)))
    if wordy:
        value = value.when(n.isin(list(L.NUMBER_WORDS_PT)), F.element_at(_map(L.NUMBER_WORDS_PT), n))
        if weak is not None:
            ready = F.size(weak) > 0
            ordinal = n.isin(list(L.ORDINALS_PT)) & ~in_(stop, nxt) & letter(get("tk", i + 1)) & in_(weak, unit_key(get("tk", i + 1)))
            value = value.when(ready & n.isin(list(L.WEAK_NUMBERS_PT)), F.lit(1.0)).when(ordinal, F.element_at(_map(L.ORDINALS_PT), n))
            value = value.when(t.rlike("^[0-9]+[ºª°]$"), F.regexp_extract(t, "^([0-9]+)", 1).try_cast("double"))
        champion = F.regexp_extract(n, mult, 1)
        value = value.when(champion != "", F.element_at(_map(L.CHAMPION_PREFIXES_PT), champion))
    rows = rows.withColumn("base", value).filter(F.col("base").isNotNull())
    champion_form = (F.regexp_extract(n, mult, 1) != "") if wordy else F.lit(False)
    scale = F.element_at(_map(L.SCALES_PT), F.coalesce(get("nt", i + 1), F.lit("")))
    rows = rows.withColumn("champion", champion_form & ~t.rlike("^[0-9]"))
    rows = rows.withColumn("value", F.when(~F.col("champion") & scale.isNotNull(), F.col("base") * scale).otherwise(F.col("base")))
    rows = rows.withColumn("j0", F.when(~F.col("champion") & scale.isNotNull(), i + 2).otherwise(i + 1))
    currency = F.element_at(_map(CURRENCY), F.coalesce(F.when(i > 0, get("tk", i - 1)), F.lit("")))
    rows = rows.withColumn("currency", currency)
    j0 = F.col("j0")
    percent, per_cent = get("tk", j0) == "%", (get("nt", j0) == "por") & (get("nt", j0 + 1) == "cento")
    after = F.slice("nt", j0 + 1, F.size("nt"))
    first_plain = F.array_position(F.transform(after, lambda w: ~F.array_contains(links, w)), True).cast("int")
    j1 = j0 + F.when(first_plain > 0, first_plain - 1).otherwise(F.size(after))
    rows = rows.withColumn("j1", j1)
    j1 = F.col("j1")
    noun = get("tk", j1)
    noun_ok = letter(noun) & ~in_(stop, get("nt", j1)) & ~in_(qstop, get("nt", j1)) & ~F.coalesce(get("nt", j1).isin(list(L.SCALES_PT)), F.lit(False))
    has_currency = F.col("currency").isNotNull()
    unit = (F.when(F.col("champion"), t).when(has_currency, F.col("currency")).when(percent | per_cent, F.lit("%")).when(noun_ok, noun))
    end = (F.when(F.col("champion"), i + 1).when(has_currency, j0).when(percent, j0 + 1).when(per_cent, j0 + 2).otherwise(j1 + 1))
    rows = rows.withColumn("unit", unit).withColumn("j", end).filter(F.col("unit").isNotNull())
    key = F.when(F.col("champion"), unit_key(F.lit("titulos"))).otherwise(unit_key(F.col("unit")))
    rows = rows.withColumn("unit_key", key)
    if wordy and weak is not None:
        rows = rows.filter(~n.isin(list(L.WEAK_NUMBERS_PT)) | in_(F.col(weak_units), F.col("unit_key")))
    window = F.arrays_zip(F.slice("tk", F.col("j") + 1, 6).alias("t"), F.slice("nt", F.col("j") + 1, 6).alias("n"))
    rows = rows.withColumn("w", window)
    ends = lambda s: (~s["t"].rlike(r"^\p{L}") | F.array_contains(qstop, s["n"]) | F.array_contains(X.words_array(lexicon.negations), s["n"])
                      | s["n"].rlike("^[a-z]{3,}(ou|eu|iu|aram|eram|iram)$")
                      | s["n"].isin("foram", "eram", "sao", "estao", "tem", "tinha", "tinham", "ha"))
    cut = F.array_position(F.transform("w", ends), True).cast("int")
    open_part = F.when(cut > 0, F.slice("w", F.lit(1), cut - 1)).otherwise(F.col("w"))
    good = lambda s: (~s["n"].rlike("^[a-z]{3,}(ados|idos|adas|idas|ado|ido|ada|ida)$") & ~F.array_contains(links, s["n"])
                      & ~F.array_contains(stop, s["n"]) & (F.length(s["n"]) >= 3))
    if exclude:
        base_good = good
        good = lambda s: base_good(s) & ~F.array_contains(F.col(exclude), s["n"])
    quals = F.slice(F.transform(F.filter(open_part, good), lambda s: s["t"]), 1, 3)
    anchor = F.when(has_currency, i - 1).otherwise(i)
    before = F.array_join(K.words_before(F.col("nt"), anchor, 3), " ")
    comp = None
    for phrase, name in L.COMPARATORS_PT:
        hit = before.endswith(phrase)
        comp = F.when(hit, F.lit(name)) if comp is None else comp.when(hit, F.lit(name))
    negated = ~n.isin("nenhum", "nenhuma") & F.arrays_overlap(K.words_before(F.col("nt"), i, 5), X.words_array(["nao", "nunca", "jamais"]))
    return rows.select(*keys, i.alias("pos"), t.alias("raw"), "value", "unit", "unit_key", quals.alias("quals"),
                       comp.otherwise(F.lit("eq")).alias("comparator"), negated.alias("negated"))


def qualifier_keys(quals: Column) -> Column:
    """Four-letter prefixes: "mundo"/"mundiais" meet."""
    norms = F.filter(F.transform(quals, X.norm), lambda w: F.length(w) >= 4)
    return F.array_distinct(F.transform(norms, lambda w: F.substring(w, 1, 4)))


DURATION = r"(^| )(em|por|ate|dentro de|prazo de|apos|daqui a|durante|ha|com) (ate |cerca de )?$"


def is_duration(text: Column, raw: Column, unit: Column) -> Column:
    """A deadline or duration ("em 30 dias") is a detail of the fact, not a count."""
    at = F.instr(text, raw)
    before = F.concat(X.norm(F.substr(text, F.lit(1), at - 1)), F.lit(" "))
    return X.norm(unit).isin(L.TIME_UNITS_PT) & (at > 0) & before.rlike(DURATION)


# --- interpretation ------------------------------------------------------------------------------------------------------------

def years_in(c) -> Column:
    words = F.regexp_extract_all(X._col(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda w: w.rlike(YEAR)), lambda w: w.cast("int"))))


def claim_type(text_norm: Column, has_quantity: Column, years: Column, now_year, relative: Column, p: ClaimPatterns) -> Column:
    y = F.lit(now_year) if isinstance(now_year, int) else now_year
    some, past = F.size(years) > 0, F.forall(years, lambda v: v < y)
    counted = has_quantity | text_norm.rlike(p.how_many)
    return (F.when(text_norm.rlike(p.opinion) & ~has_quantity, F.lit("opiniao"))
            .when(text_norm.rlike(p.future) & ~F.exists(years, lambda v: v < y), F.lit("previsao"))
            .when(counted & some & past & ~text_norm.rlike(p.cumulative), F.lit("quantidade_periodo"))
            .when(counted, F.lit("contagem"))
            .when((F.size(relative) > 0) | text_norm.rlike(p.recent) | (some & ~past), F.lit("acontecimento_recente"))
            .when(some, F.lit("fato_historico")).otherwise(F.lit("acontecimento")))


def act_stage(c) -> Column:
    """First stage of the ordered list whose words appear in the text."""
    padded = F.concat(F.lit(" "), X.norm(c), F.lit(" "))
    out = None
    for name, pattern in L.STAGES_PT:
        hit = padded.rlike(f" ({pattern}) ")
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


RELATIVE = (r"(^| )(hoje|ontem|anteontem|amanha|agora ha pouco|nesta semana|esta semana|neste fim de semana|recentemente|acaba de|"
            r"acabou de|nest[ae] (?:segunda|terca|quarta|quinta|sexta|sabado|domingo)|today|yesterday|this week|recently)( |$)")


def interpret(claims: DataFrame, key: str, text: str, now_year: int, lexicon: L.Lexicon = L.PT,
              patterns: ClaimPatterns = PT_PATTERNS, cleaned: bool = True) -> DataFrame:
    """One structured row per claim: main sentence, entities, terms, numbers, years, negations, type, incompleteness.

    ``cleaned=False`` reads the text as it stands: the cleaning is for Portuguese and splits words of other languages ("queas").
    """
    clean = clean_claim(text) if cleaned else F.coalesce(F.col(text), F.lit(""))
    base = claims.select(key, F.col(text).alias("original"), clean.alias("clean"))
    base = base.withColumn("sents", X.sentences("clean"))
    stop = X.words_array(lexicon.stop)
    content = lambda s: F.size(F.filter(X.tokens(s), lambda w: ~F.array_contains(stop, w)))
    full = F.get(F.filter("sents", lambda s: content(s) >= 3), F.lit(0))
    base = base.withColumn("main", F.coalesce(full, F.get("sents", F.lit(0)), F.lit("")))
    base = base.withColumn("rest", F.array_join(F.filter("sents", lambda s: s != F.col("main")), " "))
    base = base.withColumn("_ents", entities("clean", lexicon)).withColumn("main_norm", X.norm("main"))
    in_main = lambda e: X.phrase_in(X.norm(e), F.col("main_norm"))
    base = base.withColumn("entities", F.slice(F.concat(F.filter("_ents", in_main), F.filter("_ents", lambda e: ~in_main(e))), 1, 6))
    base = base.withColumn("_etoks", F.flatten(F.transform("_ents", X.tokens))).withColumn("years", F.slice(years_in("clean"), 1, 3))
    dated = F.regexp_replace("clean", r"[0-9]{1,2}/[0-9]{1,2}(?:/[0-9]{2,4})?", " ")
    base = base.withColumn("numbers", F.slice(F.filter(N.numbers_in(dated), lambda n: (n != "") & ~n.rlike(YEAR)), 1, 4))
    base = base.withColumn("negated", X.has_any(X.tokens("clean"), lexicon.negations))
    base = base.withColumn("relative", F.transform(F.regexp_extract_all(X.norm("original"), F.lit(RELATIVE), F.lit(2)), lambda w: w))
    base = base.withColumn("question", is_question("original")).withColumn("stage", act_stage("main"))
    banned = [*lexicon.stop, *lexicon.negations, *lexicon.generic, *lexicon.months]
    # A hyphenated word is one term ("sul africano"); its parts are looked for apart.
    own = lambda c: F.filter(F.transform(X.literal_words(c), X.norm), lambda w: ~F.array_contains(F.col("_etoks"), w))
    ranked = K.rank_terms(base.select(key, own("main").alias("m"), own("rest").alias("r")), key, F.col("m"), F.col("r"), banned)
    terms = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "term"))).alias("t")).select(  # six per claim
        key, F.transform("t", lambda s: s["term"]).alias("terms"))
    base = base.withColumn("durations", CX.durations_in("clean"))
    first = quantities(base, [key, "main"], "main", lexicon, exclude="_etoks").filter(~is_duration(F.col("main"), F.col("raw"), F.col("unit")))
    q = first.groupBy(key).agg(F.min_by(F.struct("pos", "raw", "value", "unit", "unit_key", "quals", "comparator", "negated"), "pos").alias("quantity"))
    out = base.join(terms, key, "left").join(q, key, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    out = out.withColumn("parts", CX.clauses_of(F.col("main"), F.col("terms")))
    out = out.withColumn("claim_type", claim_type(F.col("main_norm"), F.col("quantity").isNotNull(), F.col("years"), now_year,
                                                  F.col("relative"), patterns))
    out = out.withColumn("incomplete", F.col("quantity").isNull() & (
        (F.size("terms") == 0) | (F.size("entities") + F.size("terms") <= 1)))
    return out.drop("_ents", "_etoks", "sents")


def split_claims(df: DataFrame, key: str, text: str, lexicon: L.Lexicon = L.PT, limit: int | None = 3,
                 cleaned: bool = True, numbered: bool = True) -> DataFrame:
    """Up to ``limit`` sentences (None: all) with a claim of their own, bylines left out; one without a name inherits the names of the first.

    ``cleaned=False`` reads the text as it stands (see ``interpret``). With ``numbered`` a quantity makes a claim of a sentence with
    few words, too.
    """
    stop = X.words_array(lexicon.stop)
    clean = clean_claim(text) if cleaned else F.coalesce(F.col(text), F.lit(""))
    sents = df.select(key, F.posexplode(X.sentences(F.trim(F.regexp_replace(clean, BYLINE, "$1 ")))).alias("sent", "sentence"))
    content = F.size(F.filter(X.tokens("sentence"), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))
    kept = sents.withColumn("content", content)
    if numbered:
        counted = quantities(sents, [key, "sent"], "sentence", lexicon).select(key, "sent").distinct().withColumn("counted", F.lit(True))
        kept = kept.join(counted, [key, "sent"], "left").filter((F.col("content") >= 4) | F.col("counted"))
    else:
        kept = kept.filter(F.col("content") >= 4)
    from evidence_spark.operators.ranking import top_per_key
    rows = kept.select(key, "sent", "sentence")
    if limit is None:
        best = rows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("sent")))  # one text's sentences
    else:
        best = top_per_key(rows, [key], [F.asc("sent")], limit)
    best = best.withColumn("ents", entities("sentence", lexicon))
    heads = best.filter(F.col("position") == 1).select(key, F.col("ents").alias("lead"))
    joined = best.join(heads, key)
    inherits = (F.size("ents") == 0) & (F.size("lead") > 0)
    query = F.when(inherits, F.concat(F.regexp_replace("sentence", "[ .]+$", ""), F.lit(" – "), F.array_join(F.slice("lead", 1, 2), ", "))).otherwise(
        F.col("sentence"))
    return joined.select(key, "position", "sentence", query.alias("query"), inherits.alias("inherits"))


def structure(interpreted: DataFrame, key: str) -> DataFrame:
    """The verifiable detail of each claim."""
    q = F.col("quantity")
    prop = F.filter("terms", lambda w: q.isNull() | (X.stem(w) != q["unit_key"]))
    entity = F.coalesce(F.get("entities", F.lit(0)), F.get(prop, F.lit(0)))
    unit = F.concat_ws(" ", q["unit"], F.array_join(q["quals"], " "))
    counted = F.concat(F.lit("Quantidade de "), F.trim(unit), F.when(entity.isNotNull(), F.concat(F.lit(" — "), entity)).otherwise(""),
                       F.lit(": informado "), F.when(q["negated"], "não ").otherwise(""), q["raw"])
    dated = F.concat(F.lit("Data/ano do fato ("), F.array_join(F.transform("years", lambda y: y.cast("string")), ", "), F.lit(")"))
    head = F.array_join(F.slice(prop, 1, 4), " ")
    detail = (F.when(q.isNotNull(), counted).when((F.col("claim_type") == "fato_historico") & (F.size("years") > 0), dated)
              .otherwise(F.when(head != "", head).otherwise(F.col("main"))))
    denied = F.coalesce(q["negated"], F.col("negated") & (F.col("claim_type") == "fato_historico"))
    return interpreted.select(key, "claim_type", entity.alias("entity"), head.alias("property"), detail.alias("detail"), denied.alias("detail_negated"))


# --- search queries -----------------------------------------------------------------------------------------------------------------

def join_query(parts: Column, max_words: int) -> Column:
    """Words of the parts, first use of each normalised form, cut to ``max_words``."""
    words = F.filter(F.split(F.array_join(parts, " "), r"\s+"), lambda w: X.norm(w) != "")
    norms = F.transform(words, X.norm)
    firsts = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))),
                      lambda s: F.array_position(norms, X.norm(s["w"])) == s["i"] + 1)
    trimmed = F.transform(firsts, lambda s: F.regexp_replace(s["w"], "^[,.;:!?\"“”()]+|[,.;:!?\"“”()]+$", ""))
    return F.trim(F.array_join(F.slice(trimmed, 1, max_words), " "))


def build_queries(interpreted: DataFrame, key: str) -> DataFrame:
    """Search queries by purpose; queries with the same word set keep the first purpose."""
    ents, terms = F.col("entities"), F.col("terms")
    q, stable = F.col("quantity"), F.col("claim_type") == "fato_historico"
    years = F.transform(F.slice("years", 1, 1), lambda y: y.cast("string"))
    nums = F.slice("numbers", 1, 1)
    take = lambda arr, k: F.slice(arr, 1, k)
    cat = lambda *xs: F.concat(*xs)
    one = lambda purpose, parts, words: F.struct(F.lit(purpose).alias("purpose"), join_query(parts, words).alias("query"))
    others = F.filter(terms, lambda w: X.stem(w) != F.coalesce(q["unit_key"], F.lit("")))
    generic = q["unit_key"].isin("%") | X.norm(q["unit"]).isin(L.GENERIC_UNITS_PT)
    subject = F.when(generic | (F.size(ents) == 0), cat(take(ents, 2), take(others, 2))).otherwise(take(ents, 2))
    unit = F.when(q["unit_key"] == "%", F.array().cast("array<string>")).otherwise(F.array(q["unit"]))
    wide = F.when(F.size(ents) > 0, cat(take(ents, 2), take(terms, 1))).otherwise(take(terms, 2))
    incomplete = F.array(one("entrada", F.array("clean"), 12), one("ampliada", cat(take(ents, 2), take(terms, 2)), 10))
    counted = F.array(
        one("especifica", cat(subject, F.array(q["raw"]), q["quals"], years), 10), one("valor_documentado", cat(subject, unit, q["quals"], years), 9),
        F.when(F.size(unit) > 0, one("pergunta_valor", cat(F.array(F.when(X.norm(q["unit"]).rlike("as?$"), "quantas").otherwise("quantos")), unit, q["quals"], subject, years), 10))
        .otherwise(one("dados_oficiais", cat(subject, years, F.array(F.lit("dados"), F.lit("oficiais"))), 8)))
    historic = F.array(one("especifica", cat(take(ents, 3), take(terms, 3), years), 10), one("sem_data", cat(take(ents, 2), take(terms, 4)), 8),
                       one("ampliada", wide, 6))
    event = F.array(
        one("especifica", cat(take(ents, 3), take(terms, 3), nums, years), 11), one("acontecimento", cat(take(ents, 1), take(terms, 2)), 7),
        F.when(F.size(nums) > 0, one("detalhe", cat(take(ents, 1), F.slice(terms, 2, 1), nums), 7)), one("ampliada", wide, 6))
    wanted = F.when(F.col("incomplete"), incomplete).when(q.isNotNull(), counted).when(stable, historic).otherwise(event)
    rows = interpreted.select(key, F.posexplode(F.filter(wanted, lambda s: s.isNotNull() & (s["query"] != ""))).alias("pos", "s"))
    word_set = F.array_sort(F.array_distinct(X.tokens(F.col("s.query"))))
    return rows.groupBy(key, word_set.alias("_set")).agg(F.min_by("s", "pos").alias("s"), F.min("pos").alias("pos")).select(
        key, "pos", "s.purpose", "s.query")


def fetch_plan(queries: DataFrame, types: DataFrame, key: str) -> DataFrame:
    """Which provider gets which query: references first for stable claims, news first for the others."""
    ranked = queries.join(types.select(key, "claim_type"), key)
    stable = F.col("claim_type").isin("contagem", "quantidade_periodo", "fato_historico")
    p = F.col("pos")
    names = lambda *xs: F.array(*[F.lit(x) for x in xs])
    providers = (F.when(stable, F.when(p == 0, names("bing_web", "google_news", "bing_news")).when(p <= 2, names("bing_web")))
                 .otherwise(F.when(p == 0, names("google_news", "bing_news", "bing_web")).when(p == 1, names("google_news", "bing_news"))
                            .when(p <= 4, names("google_news"))))
    return ranked.withColumn("provider", F.explode(providers)).select(key, "provider", "purpose", "query")


# --- relevance ------------------------------------------------------------------------------------------------------------------------

CONTENT_RANK = {"completo": 3, "resumo": 2, "trecho": 2, "titulo": 1}
CATEGORY_RANK = {"descartado": 0, "contexto": 1, "anterior": 2, "incerto": 3, "direto": 4}
RELATIVE_MAX_AGE_DAYS, REFERENCE_WINDOW_DAYS = 14, 21


def prepare_candidates(candidates: DataFrame, lexicon: L.Lexicon, capitals: Sequence[str] | None = None) -> DataFrame:
    """What a candidate says, computed once before it meets the claims. Reads title, snippet; keeps the rest.

    ``capitals`` are the all-capital names of the claims (``capital_names``); the initials of a text's own names are read only
    where the initials of its capitalised words spell one of them, and not at all if there are none. None: always.
    """
    full = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("snippet", F.lit("")))
    out = candidates.withColumn("c_text", full)
    out = out.withColumns({"c_tokens": X.tokens("c_text"), "t_tokens": X.tokens("title"), "c_numbers": N.numbers_in("c_text")})
    initials = acronyms_of(entities("c_text", lexicon), lexicon.connectors)
    if capitals is not None:
        spelled = F.array_join(F.transform(F.regexp_extract_all("c_text", F.lit(r"(?<![\p{L}\p{N}_'’\-])(\p{Lu})"), F.lit(1)), X.norm), "")
        some = X.let(spelled, lambda s: F.exists(X.words_array(capitals), lambda a: F.instr(s, a) > 0)) if capitals else F.lit(False)
        initials = F.when(some, initials).otherwise(F.array().cast("array<string>"))
    return out.withColumns({
        "c_norm": F.array_join("c_tokens", " "), "c_bare": without_words(F.col("c_tokens"), lexicon.connectors), "c_set": F.array_distinct("c_tokens"), "c_stems": X.stems_of_tokens(F.col("c_tokens")),
        "t_norm": F.array_join("t_tokens", " "), "t_stems": X.stems_of_tokens(F.col("t_tokens")), "c_acronyms": initials,
        "c_months": months_in(F.col("c_tokens"), lexicon), "c_negated": X.has_any(F.col("c_tokens"), lexicon.negations)}).drop("c_text")


MAX_CAPITALS = 256


def capital_names(claims: DataFrame) -> list[str] | None:
    """Normalised all-capital names of the claims; None beyond ``MAX_CAPITALS`` of them."""
    names = claims.select(F.explode(F.filter("entities", lambda e: e.rlike(r"^\p{Lu}{2,}$"))).alias("e")).select(X.norm("e").alias("n")).distinct().limit(MAX_CAPITALS + 1).collect()
    return sorted(r["n"] for r in names) if len(names) <= MAX_CAPITALS else None


def months_in(tokens: Column, lexicon: L.Lexicon) -> Column:
    return F.array_intersect(F.array_distinct(tokens), X.words_array(lexicon.months))


# What a claim knows from its own article; absent columns count as empty.
ARTICLE_COLUMNS = {"aliases": "array<struct<name:string,alias:string>>", "vocabulary": "array<string>", "topics": "array<string>"}
STABLE_TYPES = ["contagem", "quantidade_periodo", "fato_historico"]
SCORED_ENTITIES, SCORED_TERMS = 4, 5


def _parts(term: Column) -> Column:
    return F.filter(F.split(term, " "), lambda w: F.length(w) >= 3)


def term_hit(term: Column, stems: Column) -> Column:
    """The term's stem, or for a hyphenated term the stems of all its parts, are among ``stems``."""
    parts = _parts(term)
    return F.array_contains(stems, X.stem(term)) | ((F.size(parts) >= 2) & F.forall(parts, lambda w: F.array_contains(stems, X.stem(w))))


def need_of(n_entities: Column, n_terms: Column, quantity: Column, stable: Column) -> Column:
    """How many details a direct source shares with the claim."""
    need = F.when(n_entities == 0, F.when(n_terms <= 3, n_terms).otherwise(F.floor((2 * n_terms + 2) / 3))).otherwise(F.when(n_terms <= 1, 1).otherwise(2))
    return F.when(quantity.isNull() & ~stable & (n_terms >= 4), F.greatest(need, F.floor((n_terms * 3 + 4) / 5))).otherwise(need).cast("int")


def with_article_columns(claims: DataFrame) -> DataFrame:
    missing = {c: F.array().cast(kind) for c, kind in ARTICLE_COLUMNS.items() if c not in claims.columns}
    return claims.withColumns(missing) if missing else claims


def blocking_keys(claims: DataFrame) -> DataFrame:
    """Adds ``keys`` and ``least`` (details a pair must share if no name does it) and ``names`` (name keys, one shared is enough).

    Every pair that ``assess`` does not discard shares ``least`` of the keys or one name key. Terms, own vocabulary, numbers
    and months are details; a hyphenated term is held by the first of its parts.
    """
    c = with_article_columns(claims)
    terms, ents = F.slice("terms", 1, SCORED_TERMS), F.slice("entities", 1, SCORED_ENTITIES)
    first = lambda t: X.stem(F.coalesce(F.get(_parts(t), F.lit(0)), t))
    keys = F.array_distinct(F.concat(B.prefixed("t:", F.transform(terms, first)), B.prefixed("t:", F.transform("vocabulary", first)), B.prefixed("n:", F.col("numbers")),
                                     B.prefixed("m:", F.col("_months"))))
    nt, ne, stable = F.size(terms), F.size(ents), F.col("claim_type").isin(STABLE_TYPES)
    need = need_of(ne, nt, F.col("quantity"), stable)
    half = F.greatest(F.lit(2), F.ceil(nt / 2)).cast("int")
    nameless = F.least(need, half, F.when(F.size("parts") > 0, F.lit(2)).otherwise(need))
    # With names none of which is found: both core terms, or ``need`` terms.
    unnamed = F.least(F.lit(2), F.greatest(need, F.lit(1)))
    # Two terms may share a first part: the count of keys is the bound then.
    least = F.greatest(F.lit(1), F.least(F.when(F.col("incomplete"), F.lit(1)).when(ne == 0, nameless).otherwise(unnamed), F.size("keys")))
    return c.withColumn("keys", keys).withColumn("least", least)


def name_keys(lexicon: L.Lexicon) -> Column:
    """Words one of which stands in every text that mentions one of the claim's names, in full, by its words, its initials or an alias."""
    link = X.words_array(lexicon.connectors)

    def of(e: Column) -> Column:
        words = F.filter(F.split(X.norm(e), " "), lambda w: w != "")
        long = F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(link, w))
        initials = F.array_join(F.transform(long, lambda w: F.substring(w, 1, 1)), "")
        return F.array(F.get(words, F.lit(0)), F.get(long, F.lit(0)), F.when(F.size(long) > 1, initials), F.when(e.rlike(r"^\p{Lu}{2,}$"), F.concat(F.lit("*"), X.norm(e))))

    ents = F.slice("entities", 1, SCORED_ENTITIES)
    known = F.filter("aliases", lambda a: F.array_contains(ents, a["name"]))
    return F.array_compact(F.array_distinct(F.concat(F.flatten(F.transform(ents, of)), F.transform(known, lambda a: F.get(F.split(X.norm(a["alias"]), " "), F.lit(0))))))


def candidate_pairs(claims: DataFrame, prepared: DataFrame, key: str, cand: str, lexicon: L.Lexicon) -> DataFrame:
    """(key, cand) of every pair that ``assess`` may keep: no cap, no all-pairs. Reads ``interpret`` and ``prepare_candidates`` columns.

    Encyclopedia candidates are kept for one shared detail already. A pair that shares no detail and no name is never kept.
    """
    c = claims.withColumn("_months", months_in(X.tokens("main"), lexicon))
    c = blocking_keys(c).withColumn("names", name_keys(lexicon))
    ask = kept(c.select(key, "keys", "least", "names"), "asked")
    asked = ask.select(F.explode("keys").alias("key"))
    stems = asked.filter("key like 't:%'").select(F.substring("key", 3, 1 << 20).alias("stem"))
    # One pass over the texts: each distinct word comes as itself, where a name asks for it, and as its beginning, where a detail does.
    starts = stems.select(F.concat(F.lit("<"), F.substring("stem", 1, 4)).alias("k"))
    wanted = starts.union(ask.select(F.explode(B.prefixed("w", F.col("names"))))).union(asked.filter("key not like 't:%'"))
    wanted = kept(wanted.distinct(), "wanted")
    said = F.concat(F.transform("c_set", lambda w: F.struct(F.concat(F.lit("w"), w).alias("k"), w.alias("w"))),
                    F.transform("c_set", lambda w: F.struct(F.concat(F.lit("<"), F.substring(w, 1, 4)).alias("k"), w.alias("w"))),
                    *[F.transform(B.prefixed(prefix, values), lambda v: F.struct(v.alias("k"), v.alias("w"))) for prefix, values in (
                        ("n:", F.array_distinct("c_numbers")), ("m:", F.col("c_months")), ("w*", F.array_distinct("c_acronyms")))])
    found = kept(prepared.select(cand, "origin", F.inline(said)).join(wanted, "k", "left_semi"), "said")
    stemmed = B.held_stems(found.filter("k like '<%'").select(cand, "w"), cand, stems).select(cand, F.concat(F.lit("t:"), "stem").alias("key"))
    others = found.filter("k like 'n:%' or k like 'm:%'").select(cand, F.col("k").alias("key"))
    origins = found.select(cand, "origin").distinct()
    held = kept(stemmed.unionByName(others).join(origins, cand), "held")
    named = found.filter("k like 'w%'").select(cand, F.substring("k", 2, 1 << 20).alias("key")).distinct()
    met = B.shared_at_least(ask, held.filter("origin <> 'wikipedia'"), key, cand)
    met = met.unionByName(B.any_shared(ask, held.filter("origin = 'wikipedia'"), key, cand))
    by_name = B.any_shared(ask.filter(F.size("names") > 0).select(key, F.col("names").alias("keys")), named, key, cand)
    return met.unionByName(by_name).distinct()


def assess(pairs: DataFrame, now: Column, lexicon: L.Lexicon = L.PT) -> DataFrame:
    """Relevance of each candidate to its claim: coverage, score, category (direto, anterior, contexto, descartado), alerts.

    ``pairs`` joins ``interpret`` output with ``prepare_candidates`` output (plus origin, content_kind, published,
    disambiguation). From the claim's own article, where there is one: ``aliases`` (name, alias) count as the name,
    ``vocabulary`` may stand for one missing term, ``topics`` are the words its clauses must hold.
    """
    none = F.array().cast("array<string>")
    p = with_article_columns(pairs).withColumns({"ents": F.slice("entities", 1, SCORED_ENTITIES), "tms": F.slice("terms", 1, SCORED_TERMS)})
    claim_months = months_in(X.tokens("main"), lexicon)
    match = lambda e, n, s, a, bare=None: entity_match(e, n, s, a, lexicon.connectors, bare=bare) | F.exists("aliases", lambda x: (x["name"] == e) & X.phrase_in(X.norm(x["alias"]), n))
    p = p.withColumns({
        "direct_hits": F.filter("tms", lambda w: term_hit(w, F.col("c_stems"))), "core": F.slice("tms", 1, 2),
        "num_hits": F.array_intersect("numbers", "c_numbers"), "month_hit": F.arrays_overlap(claim_months, "c_months"),
        "other_month": (F.size(claim_months) > 0) & ~F.arrays_overlap(claim_months, "c_months") & (F.size("c_months") > 0),
        "ent_hits": F.filter("ents", lambda e: match(e, F.col("c_norm"), F.col("c_set"), F.col("c_acronyms"), F.col("c_bare")))})
    missing = F.get(F.array_except("tms", "direct_hits"), F.lit(0))
    spoken = F.exists("vocabulary", lambda v: term_hit(v, F.col("c_stems"))) & missing.isNotNull() & (F.size("direct_hits") == 1)
    p = p.withColumn("term_hits", F.when(spoken, F.concat("direct_hits", F.array(missing))).otherwise(F.col("direct_hits")))
    p = p.withColumn("core_hit", (F.size("core") == 2) & (F.size(F.array_except("core", "term_hits")) == 0))
    ne, nt = F.size("ents"), F.size("tms")
    eh, th = F.size("ent_hits"), F.size("term_hits")
    rank = F.element_at(F.create_map(*[F.lit(v) for kv in CONTENT_RANK.items() for v in kv]), F.col("content_kind"))
    stable = F.col("claim_type").isin(STABLE_TYPES)
    num_detail = (F.size("num_hits") > 0) & ((F.size("num_hits") == F.size("numbers")) | F.exists("num_hits", lambda n: F.length(n) >= 2))
    p = p.withColumns({
        "ent_cov": F.when(ne > 0, eh / ne).otherwise(F.lit(1.0)), "term_cov": F.when(nt > 0, th / nt).otherwise(F.lit(0.0)),
        "need": need_of(ne, nt, F.col("quantity"), stable), "detail_hits": th + num_detail.cast("int") + F.col("month_hit").cast("int")})
    full_ents = (ne == 0) | (F.col("ent_cov") == 1.0)
    dh = F.col("detail_hits")
    duration = F.get("durations", F.lit(0))
    anchor = F.coalesce(N.number_key(F.get(F.split(duration, " "), F.lit(0))), F.get("numbers", F.lit(0)))
    near_anchor = CX.terms_near_anchor(X.tokens("main"), anchor, F.col("tms"))
    # Same actor, action and object; only words that say what the number is about are missing.
    detail_only = anchor.isNotNull() & F.col("core_hit") & (ne > 0) & (F.col("ent_cov") == 1.0) & (F.size(F.array_except(F.array_except("tms", "term_hits"), near_anchor)) == 0)
    on_topic = lambda part: (F.size("topics") == 0) | F.exists(part, lambda w: F.array_contains("topics", X.topic_key(w)))
    clause = full_ents & F.exists("parts", lambda part: (F.size(F.array_except(part, F.col("term_hits"))) == 0) & on_topic(part))
    direct = (full_ents & (dh >= F.col("need"))) | ((F.col("ent_cov") >= 0.5) & (dh >= F.col("need") + 1)) | detail_only | clause
    first = (F.when(F.col("origin") == "wikipedia",
                    F.when(F.col("disambiguation"), F.lit("descartado")).when(~stable & (th < 2), F.lit("descartado"))
                    .when((eh > 0) | (th > 0), F.lit("contexto")).otherwise(F.lit("descartado")))
             .when(F.col("incomplete"), F.when((eh > 0) | (th > 0), F.lit("contexto")).otherwise(F.lit("descartado")))
             .when((ne > 0) & (eh > 0) & (dh == 0), F.when(
                 (F.col("quantity").isNotNull() | (F.col("claim_type") == "fato_historico")) & (F.col("origin") == "bing_web"),
                 F.lit("contexto")).otherwise(F.lit("descartado")))
             .when(direct, F.lit("direto_lexical")).when((eh > 0) & (th > 0), F.lit("contexto"))
             .when((eh > 0) & (dh > 0), F.lit("descartado")).when((ne == 0) & (th >= 2) & (F.col("term_cov") >= 0.5), F.lit("contexto"))
             .when((ne > 0) & (eh == 0) & (((th >= F.col("need")) & (F.col("term_cov") >= 0.6)) | F.col("core_hit")), F.lit("contexto"))
             .otherwise(F.lit("descartado")))
    score = F.round(0.5 * F.col("ent_cov") + 0.5 * F.col("term_cov") + 0.1 * F.size("num_hits") + 0.02 * rank, 3)
    p = p.withColumns({"triage": first, "score": score})
    # What follows reads titles and word order; only pairs that the triage calls direct need it.
    is_direct = F.col("triage") == "direto_lexical"
    capital = F.exists("ents", lambda e: e.rlike(r"^\p{Lu}{2,}$"))
    t_acronyms = F.when(capital, acronyms_of(entities("title", lexicon), lexicon.connectors)).otherwise(none)
    on_title = X.let(t_acronyms, lambda a: F.size(F.filter("ents", lambda e: match(e, F.col("t_norm"), F.col("t_tokens"), a)))) + F.size(
        F.filter("tms", lambda w: F.array_contains("t_stems", X.stem(w))))
    action = F.get("core", F.lit(0))
    clause_stage = act_stage(CX.main_clause(F.col("title"), action))
    other_stage = F.col("stage").isNull() | ~F.coalesce(clause_stage == F.col("stage"), F.lit(False))
    detail_terms = F.when(anchor.isNotNull(), F.array_except(near_anchor, F.col("core"))).otherwise(F.slice("tms", 3, SCORED_TERMS))
    told = F.size(F.filter(detail_terms, lambda w: F.array_contains("c_stems", X.stem(w))))
    has_detail = (F.size("num_hits") > 0) | (told >= F.greatest(F.least(F.lit(2), F.size(detail_terms)), F.lit(1)))
    aside = F.exists("core", lambda w: CX.only_subordinate(F.col("title"), w)) & other_stage & ~has_detail
    p = p.withColumns({
        "title_hits": F.when(is_direct, on_title).otherwise(F.lit(0)), "aside": F.when(is_direct, F.coalesce(aside, F.lit(False))).otherwise(F.lit(False)),
        "near_neg": F.when(is_direct, K.negated_near(F.col("c_tokens"), lexicon.negations, F.transform("core", X.stem)))})
    pub, age = F.col("published"), F.datediff(now, F.col("published"))
    cited_year = F.exists("years", lambda y: F.contains(F.col("c_norm"), y.cast("string")))
    reference = F.col("reference_date") if "reference_date" in pairs.columns else F.lit(None).cast("timestamp")
    aged = (F.when((F.size("years") > 0) & ~F.array_contains("years", F.year(pub)) & ~cited_year, True)
            .when(reference.isNotNull() & (F.datediff(reference, pub) > REFERENCE_WINDOW_DAYS), True)
            .when((F.size("relative") > 0) & (age > RELATIVE_MAX_AGE_DAYS), True).otherwise(False))
    category = (F.when(~is_direct, F.col("triage"))
                .when(F.col("aside"), F.lit("contexto")).when(F.col("title_hits") < 2, F.lit("contexto"))
                .when(F.col("negated") != F.col("near_neg"), F.lit("contexto")).when(F.col("other_month"), F.lit("contexto"))
                .when(pub.isNotNull() & aged, F.lit("anterior")).otherwise(F.lit("direto")))
    p = p.withColumn("category", category)
    has_neg = F.col("c_negated")
    plain_numbers = F.filter("c_numbers", lambda n: ~n.rlike("^(19|20)[0-9]{2}$"))
    alerts = F.filter(F.array(
        F.when(F.col("negated") & ~has_neg, F.lit("negation_only_in_claim")),
        F.when(~F.col("negated") & has_neg & (F.col("category") != "contexto"), F.lit("negation_only_in_source")),
        F.when((F.size("numbers") > 0) & (F.size("num_hits") == 0) & (F.size(plain_numbers) > 0) & (F.col("category") != "contexto"),
               F.lit("other_numbers")),
        F.when((eh < ne) & (F.col("category") == "direto"), F.lit("missing_names"))), lambda a: a.isNotNull())
    strong = (F.col("category") == "direto") & full_ents & (((ne > 0) & F.col("core_hit")) | (dh >= F.col("need") + 1))
    return p.withColumns({"alerts": F.coalesce(alerts, none), "strong": strong})


def category_rank(c) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in CATEGORY_RANK.items() for v in kv]), X._col(c))


def best_of_readings(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Second pass after reading the page: only a better category found in the opening (reading 2) replaces the first."""
    both = judged.groupBy(*keys).agg(F.max(F.when(F.col("reading") == 1, F.col("category"))).alias("first"),
                                     F.max(F.when(F.col("reading") == 2, F.col("category"))).alias("second"))
    better = category_rank("second") > category_rank("first")
    return both.select(*keys, F.when(better, F.col("second")).otherwise(F.col("first")).alias("category"), better.alias("promoted"))


def opening_of(title_stems: Column, text: Column, chars: int | None = None) -> Column:
    """The first three sentences that take up the title (two shared stems); ``chars`` limits the text that is read."""
    early = X.sentences(F.substring(text, 1, chars) if chars else text, ".!?", 12)
    return F.array_join(F.slice(F.filter(early, lambda s: F.size(F.array_intersect(X.stems(s), title_stems)) >= 2), 1, 3), " ")


# --- model help and seals --------------------------------------------------------------------------------------------------------------

PROMOTE = {"confirm_no_action": 0.90, "confirm_action": 0.93, "promote_no_action": 0.783151, "promote_action": 0.86, "warn": 0.20}


def model_promotion(kind: Column, earlier: Column, has_action: Column, score: Column) -> tuple[Column, Column]:
    """(final verdict, note). The score only promotes what the rule left in doubt, never demotes, never an earlier event."""
    doubtful = F.when(has_action, kind.isin("relacao_incerta", "contexto_relacionado", "outro_acontecimento") & ~earlier).otherwise(
        kind.isin("relacao_incerta", "contexto_relacionado", "outro_acontecimento"))
    confirm = F.when(has_action, score >= PROMOTE["confirm_action"]).otherwise(score >= PROMOTE["confirm_no_action"])
    promote = F.when(has_action, score >= PROMOTE["promote_action"]).otherwise(score >= PROMOTE["promote_no_action"])
    same = kind.isin("mesmo_acontecimento", "detalhe_divergente")
    verdict = F.when(doubtful & confirm, F.lit("mesmo_acontecimento")).when(doubtful & promote, F.lit("relacao_incerta")).otherwise(kind)
    note = (F.when(doubtful & confirm, F.lit("confirmed")).when(doubtful & promote, F.lit("promoted"))
            .when(same & (score < PROMOTE["warn"]), F.lit("warning")).otherwise(F.lit("unchanged")))
    return verdict, note


def seal(kind: Column, score: Column, cut: float, age_days: Column) -> Column:
    """Label shown: the rule's own verdict stays; the score adds one only for same-day sources, a date warning otherwise."""
    return (F.when(kind.isin("mesmo_acontecimento", "detalhe_divergente"), F.concat(F.lit("regra: "), kind))
            .when((score >= cut) & F.coalesce(age_days <= 1, F.lit(False)), F.lit("provável mesmo fato"))
            .when(score >= cut, F.lit("mesmo assunto, confira a data")).otherwise(F.concat(F.lit("regra: "), kind)))


# --- details, aliases, senses -------------------------------------------------------------------------------------------------------------

def relate_detail(pairs: DataFrame, keys: Sequence[str], number: str, unit: str, topic: str, text: str) -> DataFrame:
    """Whether a source cites, contradicts or omits the numeric detail, with the sentence that shows it.

    ``number`` and ``unit`` are the claim's number key and unit stem, ``topic`` the stems that say what it refers to.
    """
    sents = F.transform(X.sentences(text, ".!?;", 12), lambda s: F.struct(
        s.alias("s"), N.numbers_in(s).alias("nums"), X.stems(s).alias("stems")))
    rows = pairs.select(*keys, number, unit, topic, sents.alias("sents"))
    about = lambda s: F.arrays_overlap(s["stems"], F.col(topic)) & ((F.col(unit) == "") | F.array_contains(s["stems"], F.col(unit)))
    same = F.get(F.filter("sents", lambda s: F.array_contains(s["nums"], F.col(number)) & about(s)), F.lit(0))
    anywhere = F.exists("sents", lambda s: F.array_contains(s["nums"], F.col(number)))
    other = F.get(F.filter("sents", lambda s: (F.size(s["nums"]) > 0) & about(s) & (F.col(unit) != "")), F.lit(0))
    rows = rows.withColumn("_same", same).withColumn("_other", F.when(~anywhere, other))
    status = (F.when(F.col("_same").isNotNull(), F.lit("cita_detalhe")).when(F.col("_other").isNotNull(), F.lit("detalhe_diferente"))
              .otherwise(F.lit("nao_cita_detalhe")))
    return rows.select(*keys, status.alias("detail_status"), F.coalesce("_same.s", "_other.s").alias("sentence"))


def with_article(interpreted: DataFrame, articles: DataFrame, key: str, title: str, body: str, lexicon: L.Lexicon = L.PT) -> DataFrame:
    """Adds what a claim's own article knows: ``aliases``, ``vocabulary``, ``topics`` and ``detail_stems``; empty without an article."""
    a = articles.select(key, F.col(title).alias("_title"), F.col(body).alias("_body"))
    both = interpreted.join(a, key, "left").withColumns({"_text": F.concat_ws("\n", "_title", "_body"), "_claim": F.coalesce("main", "clean")})
    both = both.withColumn("detail_stems", CX.detail_stems(F.col("_claim"), F.coalesce("_text", F.lit("")), lexicon))
    known = CX.aliases(both, key, "clean", "_text", "entities", lexicon).groupBy(key).agg(F.collect_list(F.struct("name", "alias")).alias("aliases"))  # two an acronym
    banned = both.join(known, key, "left").select(key, "_claim", "_body", F.flatten(F.transform(F.concat(
        "entities", F.coalesce(F.transform("aliases", lambda x: x["alias"]), F.array().cast("array<string>"))), X.tokens)).alias("_exclude"))
    words = CX.own_vocabulary(banned, key, "_claim", "_body", "_exclude", lexicon).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "word"))), lambda s: s["word"]).alias("vocabulary"))  # three a claim
    topics = K.repeated_topics(a, key, F.col("_title"), F.col("_body"), lexicon.stop).groupBy(key).agg(F.collect_set("topic").alias("topics"))
    out = both.drop("_text", "_claim", "_title", "_body").join(known, key, "left").join(words, key, "left").join(topics, key, "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in ARTICLE_COLUMNS.items()})


def senses(entries: DataFrame, keys: DataFrame, title: str, key: str) -> DataFrame:
    """Entries that may be meant by a short name: the title equals it or contains it as whole words (list pages excluded).

    Blocked on the name's first word, so the join is an equi-join.
    """
    e = entries.withColumn("_n", X.norm(F.regexp_replace(title, r"\s*\(.*\)$", ""))).withColumn("_full", X.norm(title))
    e = e.filter(~F.substring_index("_full", " ", 1).isin(L.ARTICLE_TYPE_WORDS_PT))
    words = e.withColumn("_w", F.explode(F.array_distinct(F.split("_full", " "))))
    k = keys.withColumn("_k", X.norm(key)).withColumn("_w", F.substring_index("_k", " ", 1))
    hit = k.join(words, "_w").filter((F.col("_n") == F.col("_k")) | (X.phrase_in(F.col("_k"), F.col("_full")) & (F.length("_full") > F.length("_k"))))
    return hit.drop("_w")


def grounded(options: Column, allowed: Column) -> Column:
    """Options whose words all come from the allowed text."""
    return F.size(F.array_except(options, allowed)) == 0


def fact_dates(df: DataFrame, key: str, text: str, published: str, coarse: bool = True) -> DataFrame:
    """Date of the fact: cited in the text, or the publication date when none is."""
    staged = df.select(key, dates.padded_fold(text).alias("_t"), published)
    out = staged.select(key, dates.fact_date("_t", published, coarse=coarse).alias("d"), F.to_date(published).alias("p"))
    return out.select(key, F.coalesce("d.day", "p").alias("day"), F.coalesce("d.granularity", F.lit("dia")).alias("granularity"),
                      F.col("d").isNotNull().alias("explicit"))
