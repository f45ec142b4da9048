"""Personal data: exact base spans, and bootstrapped contextual extraction.

Base spans are regular expressions for e-mail addresses, IP addresses, card and
phone numbers, with their checks; they are seeds.  Credentials of well-known formats
(``SECRET``) are seeds of a fifth kind, ``secret``, which isn't a base kind.  Identifier-like
strings that fail every rule (numbers with separators, addresses written with ``(at)``,
long strings of letters and digits) are candidates.  An instance's patterns are the word
before it, the two words before, the word and the two words after (within 60 characters,
digits masked), and, where it stands behind ``=`` or ``:``, that sign with the instance's
alphabet.

Patterns and instances are a graph.  A pattern belongs to the kind of which it has
most distinct seeds; it takes part with ``SUPPORT`` of them, if they are at least ``PURE``
of its seeds of all kinds, and ``KNOWN`` of its distinct instances.  Scores then spread in rounds until none changes by ``STILL``: a
pattern's confidence is the scores of its instances (1 for seeds) over all of them and
one more, a candidate's score is 1 - prod(1 - confidence) over its patterns of a kind.
Candidates whose score ends at ``ACCEPT`` or more are spans of that kind.  Copies of a
text don't add to a pattern, as distinct strings count.  All of it is DataFrame
operations; what was read from the texts is stored once in the shared folder, so rounds
don't read texts again, and only patterns that take part are in them.

Spans are code points, end exclusive.  Cases: null is an empty text; repeated rows
are answered one by one; candidates that overlap a base span or a seed are dropped, so base
spans always stay; without seeds nothing is learned; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanway.llm.common import forget, stored
from spanway.llm.winnowing import let

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
_LOCAL = r"[A-Za-z0-9._%+-]"
#: Possessive, and begun only where a run begins or the last match ended: linear, and the same matches as the plain patterns.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
NUMBER = r"(?<![A-Za-z0-9])[0-9](?:[ .:/()-]?[0-9]){4,}+"
WRITTEN = rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++"
MIXED = r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{14,}+"
#: Public formats of access keys and tokens, and hex digests of 160 bits.
SECRET = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|(?i:[0-9a-f]{40}))$"
#: A pattern takes part with so many distinct seeds of its kind, and a candidate is a span with such a score.
SUPPORT = 8
PURE, KNOWN = 0.9, 0.25
ACCEPT = 0.9
STILL = 0.005
ROUNDS = 50


def prefix_sums(lengths: Column, block: int = 256) -> Column:
    """The sum of all lengths before each; by blocks, so the work isn't quadratic in their number."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def whole(all_: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(block))
        return let(F.transform(starts, lambda b: F.aggregate(F.slice(all_, b, block), zero, step)), placed)

    def placed(parts: Column) -> Column:
        before = F.aggregate(F.transform(parts, lambda p: p["at"]), zero, step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, before, lambda p, at: F.transform(p["out"], lambda x: x + at)))

    return let(lengths, whole)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,found>> of the leftmost non-overlapping matches."""

    def place(both: Column) -> Column:
        starts = prefix_sums(F.transform(both, lambda x: F.char_length(x["p"]) + F.char_length(x["m"])))

        def at(x, start):
            first = start + F.char_length(x["p"])
            return F.struct(first.alias("start"), (first + F.char_length(x["m"])).alias("end"), x["m"].alias("found"))

        return F.zip_with(both, starts, at)

    def pair(pieces: Column) -> Column:
        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m"))))

    return let(let(F.split(text, pattern, -1), pair), place)


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Of 12 to 19 digits, is the check sum right?"""
    worth = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _is_card(s: Column) -> Column:
    return let(digits(s["found"]), lambda d: F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind array<struct<start,end,found>>."""
    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")
    octets = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
    return {
        "email": F.when(F.contains(text, F.lit("@")), spans(text, EMAIL)).otherwise(empty),
        "ip": F.when(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), F.filter(spans(text, IP), lambda s: F.rlike(s["found"], F.lit(octets)))).otherwise(empty),
        "card": F.when(F.rlike(text, F.lit(r"[0-9][ -]?[0-9]")), F.filter(spans(text, CARD), _is_card)).otherwise(empty),
        "phone": F.when(F.rlike(text, F.lit(r"\+[0-9]")), F.filter(spans(text, PHONE), lambda s: F.length(digits(s["found"])).between(9, 15))).otherwise(empty),
    }


def _context(text: Column, s: Column) -> Column:
    """The patterns around a span: words before and after, digits masked, and a sign with the alphabet."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]+", "0"), r"\s+", " ")
    near = F.least(s["start"], F.lit(60))

    def around(v: Column) -> Column:
        before, after = F.rtrim(plain(v["b"])), F.ltrim(plain(v["a"]))
        sign = F.regexp_extract(v["b"], r"([=:])\s*[\"']?$", 1)
        found = s["found"]
        alphabet = F.when(F.rlike(found, F.lit("^[0-9 .:/()-]+$")), "digits").when(F.rlike(found, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")), "hex").when(F.rlike(found, F.lit("^[A-Za-z0-9_/+-]+$")), "letters and digits").otherwise("other")
        words = [F.concat(F.lit(f"{k} {n}:"), F.substring_index(c, " ", i)) for k, c, m in (("before", before, -1), ("after", after, 1)) for n, i in ((1, m), (2, 2 * m))]
        return F.array_compact(F.array(*[F.when(F.length(w) > 10, w) for w in words], F.when(sign != "", F.concat(F.lit("sign:"), sign, alphabet))))

    both = F.struct(F.substr(text, s["start"] - near + 1, near).alias("b"), F.substr(text, s["end"] + 1, F.lit(60)).alias("a"))
    return let(both, around)


def read_texts(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: _row, doc_id, base spans, instances with their patterns; stored."""
    text = F.col("text")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_row", F.monotonically_increasing_id())
    found = base_spans(text)
    own = own.select("_row", "doc_id", "text", *[v.alias(f"_{k}") for k, v in found.items()])
    mark = lambda i, k: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("ord"), s["end"].alias("end"), F.lit(k).alias("kind"), s["found"].alias("found"))
    marked = [F.transform(f"_{k}", mark(i, k)) for i, k in enumerate(KINDS)]
    own = own.withColumn("_base", F.array_sort(F.concat(*marked)))
    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")
    free = lambda among, of: F.filter(among, lambda c: ~F.exists(of, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    mixed = F.filter(spans(text, MIXED), lambda s: F.rlike(s["found"], F.lit("[0-9]")) & F.rlike(s["found"], F.lit("[A-Za-z]")))
    own = own.withColumn("_mixed", F.when(F.rlike(text, F.lit("[0-9]")), free(mixed, "_base")).otherwise(empty))
    numbers = F.when(F.rlike(text, F.lit(r"[0-9][ .:/()-]?[0-9]")), spans(text, NUMBER)).otherwise(empty)
    written = F.when(F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")), spans(text, WRITTEN)).otherwise(empty)
    own = own.withColumn("_maybe", free(free(F.concat(numbers, written), "_base"), "_mixed"))

    def instance(s, kind):
        return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.sha2(F.lower(s["found"]), 256).alias("string"), _context(text, s).alias("patterns"))

    secret = lambda s: instance(s, F.when(F.rlike(s["found"], F.lit(SECRET)), F.lit("secret")))
    things = F.concat(F.transform("_base", lambda s: instance(s, s["kind"])), F.transform("_mixed", secret), F.transform("_maybe", lambda s: instance(s, F.lit(None).cast("string"))))
    base = F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind")))
    return stored(own.select("_row", "doc_id", base.alias("base"), things.alias("things")), "pii")


def learn(read: DataFrame, support: int = SUPPORT, accept: float = ACCEPT, rounds: int = ROUNDS) -> DataFrame:
    """(string, kind) of the candidates found by the patterns."""
    edges = read.select(F.explode("things").alias("t")).select("t.kind", "t.string", F.explode("t.patterns").alias("pattern"))
    edges = stored(edges.distinct(), "pii-edges")
    sums = edges.groupBy("pattern").agg(F.count_distinct("string").alias("all"), *[F.count_if(F.col("kind") == k).alias(k) for k in ALL_KINDS])
    best = F.greatest(*[F.struct(F.col(k).alias("seeds"), F.lit(k).alias("found")) for k in ALL_KINDS])
    told = sum((F.col(k) for k in ALL_KINDS[1:]), F.col(ALL_KINDS[0]))
    sure = sums.select("pattern", "all", told.alias("told"), best.alias("b")).select("pattern", "all", "told", "b.*")
    sure = sure.filter((F.col("seeds") >= support) & (F.col("seeds") >= PURE * F.col("told")) & (F.col("seeds") >= KNOWN * F.col("all"))).drop("told")
    # what takes part: the candidates (a seed's string is none) in patterns of a kind
    seeds = edges.filter(F.col("kind").isNotNull()).select("string").distinct()
    open_ = stored(edges.filter(F.col("kind").isNull()).select("string", "pattern").join(seeds, "string", "left_anti").join(sure, "pattern"), "pii-open")
    scores = None
    for _ in range(rounds):
        own = open_.withColumn("score", F.lit(0.0)) if scores is None else open_.join(scores.select("string", "found", "score"), ["string", "found"])
        confidence = own.groupBy("pattern").agg(F.sum("score").alias("more"))
        trusted = open_.join(confidence, "pattern").withColumn("confidence", (F.col("seeds") + F.col("more")) / (F.col("all") + 1))
        # in one order, so that sums of floats don't depend on how rows were dealt out
        miss = F.aggregate(F.array_sort(F.collect_list("confidence")), F.lit(1.0), lambda a, c: a * (1 - c))
        new = trusted.groupBy("string", "found").agg((1 - miss).alias("score"))
        old = new.withColumn("was", F.lit(0.0)) if scores is None else new.join(scores.select("string", "found", F.col("score").alias("was")), ["string", "found"])
        before, scores = scores, stored(old, "pii-scores")
        if before is not None:
            forget(before)
        if not (scores.agg(F.max(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0) >= STILL:
            break
    forget(edges)
    top = scores.groupBy("string").agg(F.max(F.struct("score", "found")).alias("m"))
    return stored(top.filter(F.col("m.score") >= accept).select("string", F.col("m.found").alias("kind")), "pii-found")


def _listed(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, support: int = SUPPORT, accept: float = ACCEPT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base, secrets of
    known formats and learned), n_secret (of both origins), n_learned, n_spans (all)."""
    read = read_texts(docs)
    learned = learn(read, support, accept, rounds)
    order = F.array_position(F.array(*[F.lit(k) for k in ALL_KINDS]), F.col("kind")).cast("int") - 1
    things = read.select("_row", F.explode("things").alias("t")).select("_row", "t.kind", "t.start", "t.end", "t.string")
    known = things.filter(F.col("kind") == "secret").select("_row", "start", "end", "kind", F.lit(0).alias("new"))
    found = things.filter(F.col("kind").isNull()).drop("kind").join(learned, "string").select("_row", "start", "end", "kind", F.lit(1).alias("new"))
    more = known.union(found).groupBy("_row").agg(F.collect_list(F.struct("start", order.alias("ord"), "end", "kind")).alias("more"), F.sum("new").alias("n_learned"))
    out = read.select("_row", "doc_id", "base").join(more, "_row", "left")
    count = lambda c, k: F.coalesce(F.size(F.filter(c, lambda s: s["kind"] == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    both = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>"))))
    out = out.withColumn("both", both)
    return out.select(
        "doc_id", *[count("base", k) for k in KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("both")).alias("spans"),
        count("both", "secret"), F.coalesce("n_learned", F.lit(0)).cast("long").alias("n_learned"), F.size("both").cast("long").alias("n_spans"),
    )
