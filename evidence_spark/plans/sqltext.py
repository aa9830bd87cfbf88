"""DuckDB spellings of the text expressions, for the oracle side only."""

from __future__ import annotations

from evidence_spark.functions.text import FOLD_FROM, FOLD_TO, NUMBER, STEM, WORD


def q(text: str) -> str:
    # The oracle's regex engine folds case by code point already and has no ``u`` flag.
    return "'" + text.replace("'", "''").replace("(?iu)", "(?i)") + "'"


def words(items) -> str:
    return "[" + ",".join(q(i) for i in items) + "]"


def fold(c: str) -> str:
    return f"regexp_replace(translate(lower(coalesce({c},'')),{q(FOLD_FROM)},{q(FOLD_TO)}),'\\p{{M}}+','','g')"


def norm(c: str) -> str:
    once = f"regexp_replace({fold(c)},'([0-9])[.,]([0-9])','\\1' || chr(1) || '\\2','g')"
    twice = f"regexp_replace({once},'([0-9])[.,]([0-9])','\\1' || chr(1) || '\\2','g')"
    return f"trim(translate(regexp_replace({twice},'[^a-z0-9' || chr(1) || ']+',' ','g'),chr(1),','))"


def tokens(c: str) -> str:
    return f"list_filter(string_split({norm(c)},' '), lambda w: w <> '')"


def stem(w: str) -> str:
    return f"substr(regexp_replace({w},{q(STEM)},'\\1'),1,6)"


def stems_of(array: str, minimum: int = 3) -> str:
    return f"list_distinct(list_transform(list_filter({array}, lambda w: length(w) >= {minimum}), lambda w: {stem('w')}))"


def title_key(c: str, stop) -> str:
    return (f"list_distinct(list_filter({tokens(c)}, lambda w: length(w) >= 3 and not list_contains({words(stop)}, w)))")


def words3(c: str) -> str:
    return f"list_distinct(regexp_extract_all({fold(c)},'[a-z0-9]{{3,}}'))"


def literal_words(c: str) -> str:
    return f"regexp_extract_all({c},{q(WORD)})"


def split_words(c: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(coalesce({c},''),'\\s+',' ','g')),' '), lambda w: w <> '')"


def sentences(c: str, marks: str = ".!?", minimum: int = 1) -> str:
    broken = f"regexp_replace({c},'([{marks}])\\s+','\\1' || chr(10),'g')"
    return f"list_filter(list_transform(string_split_regex({broken},'\\n+'), lambda s: trim(s)), lambda s: length(s) >= {minimum})"


def number_key(raw: str) -> str:
    parts = f"string_split(regexp_replace({raw},'[^0-9.,]','','g'),'.')"
    glued = (f"array_to_string(list_transform({parts}, lambda p, i: case when i = 1 or regexp_matches(p,'^[0-9]{{3}}([^0-9]|$)') "
             f"then p else '.' || p end),'')")
    return f"trim({glued},'.,')"


def numbers_in(c: str) -> str:
    return (f"list_distinct(list_transform(regexp_extract_all(coalesce({c},''),{q(NUMBER)}), lambda n: {number_key('n')}))")


def jaccard(a: str, b: str) -> str:
    return (f"(case when len({a})=0 or len({b})=0 then 0.0 else len(list_intersect({a},{b}))::double/"
            f"(len({a})+len({b})-len(list_intersect({a},{b}))) end)")


def host(url: str) -> str:
    return f"lower(regexp_extract({url},'^[a-zA-Z][a-zA-Z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)',1))"


def domain(url: str) -> str:
    return f"regexp_replace({host(url)},'^www\\.','')"


def plain_host(url: str) -> str:
    return f"regexp_replace({domain(url)},'(^|\\.)(m|mobile|amp)\\.','\\1','g')"


def canonical_url(url: str) -> str:
    path = f"regexp_replace(regexp_extract({url},'^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*([^?#]*)',1),'/+$','')"
    return (f"{plain_host(url)} || (case when ends_with({plain_host(url)},'news.google.com') then {path} else lower({path}) end)")


def logit(c: str) -> str:
    return f"ln(greatest(1e-6,least(1-1e-6,{c}))/(1-greatest(1e-6,least(1-1e-6,{c}))))"
