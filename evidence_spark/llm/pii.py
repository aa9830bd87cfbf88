"""Personal data: fixed patterns, and more identifiers by bootstrapped contexts. DataFrame functions only.

Base spans are the leftmost non-overlapping matches of one pattern per kind, checked afterwards. The patterns here accept
the same spans as the plain ones, written so that long runs of one character class cost linear time and no recursion.

Bootstrap: base spans are seeds. Other identifier-like chunks (``LOOSE``) are candidates; long mixtures of letters and digits
among them are weak seeds of a kind of their own, ``secret`` (keys, tokens), which become spans only if patterns speak for
them as for any candidate. All give occurrences with two lexical patterns each: the two words before, and the word before
with the word after. On the graph of patterns and
instances (distinct strings), in each of ``rounds`` rounds

* a pattern's confidence in a kind is the summed score of its instances of that kind over its instances plus one,
* an unknown instance's score for a kind is 1 - product of (1 - confidence) over its patterns above ``trust``;

an instance whose best score reaches ``accept`` joins its kind for the next round, and its occurrences are spans. A pattern
needs ``support`` known instances, so contexts seen by chance never speak.

At scale: one scan of the texts inside rows, in time that grows with their length and number of hits (running sums in
blocks, text read from pieces of ``PIECE`` characters); only occurrences (a fraction of a percent of the words) move, and both steps
are map-side combined sums over distinct (pattern, instance) pairs, so a frequent pattern or number is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.functions.text import let
from evidence_spark.llm.common import boxed, stored, unboxed

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# A chunk of letters, digits and joiners with a digit or @ in it, from its start; short ones are dropped later.
LOOSE = r"(?<![A-Za-z0-9._%+()/@:-])(?=[A-Za-z._%+()/:-]*+[0-9@])[A-Za-z0-9._%+()/@:-]++"
MIN_DIGITS, MIN_CHUNK = 6, 12
SECRET = "secret"
SECRET_SHAPE = r"^(?=(?:[^0-9]*[0-9]){4})(?=(?:[^A-Za-z]*[A-Za-z]){4})[A-Za-z0-9_/+-]{20,}$"
BLOCK, PIECE = 256, 1024
ROUNDS, TRUST, SUPPORT, ACCEPT = 3, 0.5, 5, 0.8
AROUND = 64  # code points looked at for the words on either side
HIT = "array<struct<start:int,end:int,hit:string>>"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _running(values: Column, start: Column, step, kind: str) -> Column:
    """``step(state, value)`` = struct(at, item) along an array, state first ``start``; the items, of SQL type ``kind``.

    Items are gathered in blocks, so that appending copies at most a block and not all items so far.
    """
    none = F.array().cast(f"array<{kind}>")

    def add(state: Column, x: Column) -> Column:
        return let(step(state["at"], x), lambda y: F.struct(y["at"].alias("at"), F.concat(state["out"], F.array(y["item"])).alias("out")))

    def add_block(state: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(state["at"].alias("at"), none.alias("out")), add)
        return let(inner, lambda y: F.struct(y["at"].alias("at"), F.concat(state["out"], F.array(y["out"])).alias("out")))

    def blocks(bound: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(bound) / BLOCK).cast("int") - 1, F.lit(0))), lambda b: F.slice(bound, b * BLOCK + 1, BLOCK))

    first = F.struct(start.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(let(values, blocks), first, add_block, lambda s: F.flatten(s["out"]))


def _places(parts: Column, hits: Column) -> Column:
    """Start, end (code points) and text of every match, from what ``split`` and ``regexp_extract_all`` give."""
    gaps = F.zip_with(F.slice(parts, 1, F.size(hits)), hits, lambda p, h: F.struct(F.char_length(p).alias("gap"), F.char_length(h).alias("size"), h.alias("hit")))

    def step(at: Column, x: Column) -> Column:
        start = at + x["gap"]
        end = start + x["size"]
        return F.struct(end.alias("at"), F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")).alias("item"))

    return _running(gaps, F.lit(0), step, "struct<start:int,end:int,hit:string>")


def _pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _between(pieces: Column, begin: Column, end: Column) -> Column:
    """Code points ``begin`` to ``end`` (exclusive) of a text in pieces."""
    first = F.floor(begin / PIECE).cast("int")
    last = F.floor(end / PIECE).cast("int")
    return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), begin - first * PIECE + 1, end - begin)


def _apart(spans: Column, others: Column) -> Column:
    """Those of ``others`` (start, end, hit) that overlap none of ``spans``: one sweep from either side over both by start."""
    event = lambda x, rank, hit: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), hit.alias("hit"))
    both = F.array_sort(F.concat(F.transform(spans, lambda x: event(x, 0, F.lit(None).cast("string"))), F.transform(others, lambda x: event(x, 1, x["hit"]))))
    kind = "struct<start:int,rank:int,end:int,hit:string,free:boolean>"

    def marked(x: Column, free: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["hit"].alias("hit"), free.alias("free"))

    def forward(at: Column, x: Column) -> Column:
        return F.struct(F.when(x["rank"] == 0, F.greatest(at, x["end"])).otherwise(at).alias("at"), marked(x, (x["rank"] == 1) & (at <= x["start"])).alias("item"))

    def backward(at: Column, x: Column) -> Column:
        return F.struct(F.when(x["rank"] == 0, F.least(at, x["start"])).otherwise(at).alias("at"), marked(x, x["free"] & (at >= x["end"])).alias("item"))

    there = _running(both, F.lit(0), forward, kind)
    back = _running(F.reverse(there), F.lit(2 ** 31 - 1), backward, kind)
    return F.transform(F.filter(F.reverse(back), lambda x: x["free"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit")))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.char_length(digits)
    values = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (F.ascii(F.substring(digits, i, F.lit(1))) - 48) * F.when((n - i) % 2 == 1, 2).otherwise(1))
    places = F.transform(values, lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(places, F.lit(0), lambda s, d: s + d) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    digits = _digits(hit)
    if kind == "ip":
        short = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(short, lambda p: (F.char_length(p) <= 2) | ((F.char_length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.char_length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Adds ``base`` (spans by start, then kind) and ``seen`` (occurrences of seeds and candidates with their contexts) to each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digit = text.rlike("[0-9]")
    worth = {"email": F.instr(text, "@") > 0, "ip": digit, "card": digit, "phone": digit & (F.instr(text, "+") > 0), "loose": digit | (F.instr(text, "@") > 0)}
    none = F.array().cast("array<string>")
    cuts = {}
    for kind, pattern in {**PATTERNS, "loose": LOOSE}.items():
        cuts[f"_p_{kind}"] = F.when(worth[kind], F.split(text, pattern, -1)).otherwise(none)
        cuts[f"_h_{kind}"] = F.when(worth[kind], F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    rows = docs.withColumns(cuts)
    rows = rows.withColumns({f"_{kind}": F.filter(_places(F.col(f"_p_{kind}"), F.col(f"_h_{kind}")), lambda x: _valid(kind, x["hit"])) for kind in KINDS}
                            | {"_loose": F.filter(_places(F.col("_p_loose"), F.col("_h_loose")), lambda x: (F.char_length(_digits(x["hit"])) >= MIN_DIGITS) | (F.char_length(x["hit"]) >= MIN_CHUNK) | (F.instr(x["hit"], "@") > 1))})
    rows = rows.drop(*cuts)
    spans = [F.transform(F.col(f"_{kind}"), lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))
             for i, kind in enumerate(KINDS)]
    seeds = [F.transform(F.col(f"_{kind}"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), F.lit(kind).alias("kind"))) for kind in KINDS]
    rows = rows.withColumn("base", F.array_sort(F.concat(*spans).cast(SPAN)))
    free = F.when(F.size("base") > 0, _apart(F.col("base"), F.col("_loose"))).otherwise(F.col("_loose"))
    free = F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), F.when(x["hit"].rlike(SECRET_SHAPE), F.lit(SECRET)).alias("kind")))
    rows = rows.withColumn("_all", F.concat(*seeds, free))
    rows = rows.withColumn("_pieces", F.when(F.size("_all") > 0, _pieces(text)).otherwise(none))

    def context(x: Column) -> Column:
        before = F.lower(_between(F.col("_pieces"), F.greatest(x["start"] - AROUND, F.lit(0)), x["start"]))
        after = F.lower(_between(F.col("_pieces"), x["end"], x["end"] + AROUND))
        two = F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1)
        one, next_ = F.regexp_extract(before, r"(\S+)\s*$", 1), F.regexp_extract(after, r"^\s*(\S+)", 1)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), x["kind"].alias("kind"),
                        F.filter(F.array(F.when(two != "", F.concat(F.lit("b:"), F.regexp_replace(two, r"\s+", " "))),
                                         F.when((one != "") & (next_ != ""), F.concat(F.lit("a:"), one, F.lit(" _ "), next_))), lambda p: p.isNotNull()).alias("patterns"))

    return rows.withColumn("seen", F.transform("_all", context)).drop("_all", "_pieces", "_loose", *[f"_{k}" for k in KINDS])


def bootstrap(seen: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """(hit, kind, score) of the unknown instances and weak seeds accepted. ``seen`` has hit, kind (null: unknown) and patterns."""
    edges = stored(seen.select("hit", F.explode("patterns").alias("pattern")).distinct(), "edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = stored(seen.filter("kind IS NOT NULL").select("hit", "kind", F.lit(1.0).alias("score")).distinct(), "seeds")
    found = seeds.limit(0)
    for _ in range(rounds):
        known = seeds.unionByName(found).groupBy("hit", "kind").agg(F.max("score").alias("score"))
        sure = (edges.join(known, "hit").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("known")).filter(F.col("known") >= support)
                .join(sizes, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("n") + 1)).alias("confidence")).filter(F.col("confidence") >= trust))
        open_edges = edges.join(seeds.filter(F.col("kind") != SECRET).select("hit").distinct(), "hit", "left_anti")
        scored = open_edges.join(sure, "pattern").groupBy("hit", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        best = scored.groupBy("hit").agg(F.max(F.struct("score", "kind")).alias("best")).select("hit", "best.kind", "best.score")
        found = stored(best.filter(F.col("score") >= accept), "found")
    return found


def find(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``base`` and ``spans`` (all spans) added, without the texts if they need not be kept. A null text has none.

    Rows equal in id and text get the same spans. ``docs`` has doc_id, text and at most a box of other columns.
    """
    rows = scan(docs).withColumn("_row", F.xxhash64("doc_id", "text"))
    rows = stored(rows if keep_text else rows.drop("text"), "scan")
    seen = rows.filter(F.size("seen") > 0).select("doc_id", "_row", F.explode("seen").alias("s")).select("doc_id", "_row", "s.*")
    extra = seen.filter(F.col("kind").isNull() | (F.col("kind") == SECRET)).select("doc_id", "_row", "start", "end", "hit").join(bootstrap(seen).select("hit", "kind"), "hit")
    rank = F.array_position(F.array(*map(F.lit, [*KINDS, SECRET])), F.col("kind")).cast("int") - 1
    added = extra.groupBy("doc_id", "_row").agg(F.collect_set(F.struct("start", rank.alias("rank"), "end", "kind")).alias("added"))
    added = added.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_same"), "added")
    both = rows.drop("seen").join(added, (F.col("_row") == F.col("_same")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return both.withColumn("spans", F.array_sort(F.concat("base", F.coalesce(F.col("added").cast(SPAN), F.array().cast(SPAN))))).drop("_row", "_id", "_same", "added")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans for every row."""
    rows = find(docs.select("doc_id", F.col("text").cast("string").alias("text")), keep_text=False)
    counts = [F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in capitals and brackets, and ``n_chars``, if present, counted anew.

    Overlapping spans become one. Texts without spans stay as they are, and so does their ``n_chars``.
    """
    text = F.col("text")

    def step(at: Column, x: Column) -> Column:
        return F.struct(F.greatest(at, x["end"]).alias("at"), F.struct(at.alias("begin"), x["start"].alias("end"), F.when(x["start"] >= at, x["kind"]).alias("kind")).alias("item"))

    last = F.struct(F.char_length(text).alias("start"), F.lit(len(KINDS) + 1).alias("rank"), F.char_length(text).alias("end"), F.lit("").alias("kind"))
    cuts = F.filter(_running(F.concat("spans", F.array(last).cast(SPAN)), F.lit(0), step, "struct<begin:int,end:int,kind:string>"), lambda c: c["kind"].isNotNull())
    tag = lambda c: F.when(c["kind"] == "", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(c["kind"]), F.lit("]")))
    ended = let(_pieces(text), lambda pieces: F.array_join(F.transform(cuts, lambda c: F.concat(_between(pieces, c["begin"], c["end"]), tag(c))), ""))
    rows = find(boxed(docs)).withColumn("_changed", F.size("spans") > 0)
    return unboxed(rows.withColumn("text", F.when(F.col("_changed"), ended).otherwise(text)), docs)
