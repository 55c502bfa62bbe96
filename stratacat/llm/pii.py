"""Personal data: base patterns plus bootstrapped contextual extraction, in DataFrame functions only.

Seeds are what four base patterns match, and long hexadecimal tokens, the seeds of a fifth kind (secret) that has no base pattern. The one or
two words left of an identifier-like token (one with an @ or six digits, or a run of number tokens) and the word right of it are its patterns.
Patterns and tokens form a graph. Each round scores patterns by the belief in their tokens and tokens by the scores of their
patterns; tokens that are believed count like seeds, so that they bring new patterns in. Patterns that end above a confidence, with
enough different believed tokens, mark tokens that no base pattern saw.

Defined cases: null and empty texts have no spans; a null doc_id stays null; repeated rows each give a row and count once as
evidence; of several kinds that a token's patterns name, the most confident one counts (of equals the last by name); an empty table gives an
empty result; extra columns are ignored. Text has no length limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive repeats and look-behinds match what the plain forms match, in linear time:
#: a match that starts inside a run of the first class also starts at that run's beginning or at the end of
#: the previous match.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every text with a match passes.
_MAY = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": "\\+[0-9]"}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Only tokens with an @ or six digits can be identifiers; a seed's first token (+1 of a phone number) is one too.
LIKELY = r"@|^\+[0-9]|[0-9]\.[0-9]+\.[0-9]|(?:[0-9][^0-9]*){6}"
_RUN = r"\+?\(?[0-9][0-9().-]*+(?:\x20\(?[0-9][0-9().-]*+)++(?![^\x20\x09-\x0D])"
TOKEN = rf"(?<![^\x20\x09-\x0D])(?:{_RUN}|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
SECRET = "secret"
#: Seeds of the fifth kind, and the part of a discovered token that is the secret.
SECRET_SEED = r"^[^0-9A-Za-z]*(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})[^0-9A-Za-z]*$"
SECRET_BODY = r"[0-9A-Za-z][0-9A-Za-z_+/=.-]{10,}[0-9A-Za-z]"


#: start and end in code points, the match, up to 80 characters before it (back to the match before that one) and after it (up to the next)
SPAN_TYPE = "struct<start:int,end:int,m:string,left:string,right:string>"
_GROUP = 256


def _found(text: Column, pattern: str, keep) -> Column:
    """Spans of the matches that ``keep`` accepts, left to right.

    The pieces between matches and the matches themselves alternate, so running sums of their lengths are
    the positions. Accepted spans gather in groups, which keeps the work in proportion to the text however many there are.
    """

    def spans(cuts):
        piece, hit = lambda i: F.get(cuts["pieces"], i), lambda i: F.get(cuts["hits"], i)
        before = lambda i: F.when(i > 0, F.concat(F.right(piece(i - 1), F.lit(80)), F.right(hit(i - 1), F.lit(80)))).otherwise("")
        steps = F.transform(cuts["hits"], lambda m, i: F.struct(m.alias("m"), piece(i).alias("gap"), before(i).alias("before"), F.left(piece(i + 1), F.lit(80)).alias("after")))
        empty = F.array().cast(f"array<{SPAN_TYPE}>")
        start = F.struct(F.lit(0).alias("at"), empty.alias("group"), F.array().cast(f"array<array<{SPAN_TYPE}>>").alias("full"))

        def step(acc, x):
            begin = acc["at"] + F.char_length(x["gap"])
            end = begin + F.char_length(x["m"])
            one = F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("m"), F.right(F.concat(x["before"], x["gap"]), F.lit(80)).alias("left"), F.coalesce(x["after"], F.lit("")).alias("right")))
            whole = F.size(acc["group"]) >= _GROUP
            group = F.when(~keep(x["m"]), acc["group"]).when(whole, one).otherwise(F.concat(acc["group"], one))
            full = F.when(keep(x["m"]) & whole, F.concat(acc["full"], F.array(acc["group"]))).otherwise(acc["full"])
            return F.struct(end.alias("at"), group.alias("group"), full.alias("full"))

        return F.aggregate(steps, start, step, lambda acc: F.concat(F.flatten(acc["full"]), acc["group"]))

    return C.let(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), spans)


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubles (its digits summed); the total is a multiple of ten."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + F.when((F.char_length(digits) - i) % 2 == 0, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(
            (F.substr(digits, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substr(digits, i, F.lit(1)).cast("int") / 5).cast("int")
        ),
    )
    return total % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


_KEEP = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda m: F.when(F.char_length(_digits(m)).between(16, 19), _luhn(_digits(m))).otherwise(False),
    "phone": lambda m: F.char_length(_digits(m)).between(8, 15),
}


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pii_<kind>``: arrays of (start, end, m) for each base kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(f"array<{SPAN_TYPE}>")
    return docs.withColumns({f"pii_{k}": F.when(body.rlike(_MAY[k]), _found(body, PATTERNS[k], _KEEP[k])).otherwise(none) for k in KINDS})


def _named(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["m"].alias("m"))


_TOKEN_TYPE = "struct<start:int,end:int,m:string,ctx:string,next:string,kind:string>"


def candidates(based: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pii_tokens``: identifier-like tokens with their span, the two words before and the one after them, and, of a base span they overlap, kind and text.

    Tokens and base spans pass by once in the order of their places (a token at its last character), so that the last end of the spans
    before a token tells whether one overlaps it; the work stays in proportion to the text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.when(body.rlike("[0-9@]"), _found(body, TOKEN, lambda m: m.rlike(LIKELY))).otherwise(F.array().cast(f"array<{SPAN_TYPE}>"))
    seeds = F.concat(*[F.transform(f"pii_{k}", _named(k)) for k in KINDS])
    none = F.lit(None).cast("string")

    def as_event(at, what, s, left, right, kind):
        return F.struct(at.alias("at"), F.lit(what).alias("what"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), left.alias("left"), right.alias("right"), kind.alias("kind"))

    def token(x, best):
        left = F.lower(F.regexp_replace(x["left"], "[0-9]", "0"))
        before = F.btrim(F.regexp_extract(left, r"(\S+[\x20\x09]+)?(\S+)[\x20\x09]+$", 0))
        after = F.regexp_extract(F.lower(F.regexp_replace(x["right"], "[0-9]", "0")), r"^[\x20\x09]+(\S+)", 1)
        inside = best["end"] > x["start"]
        own = F.when(x["m"].rlike(SECRET_SEED), SECRET)
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.when(inside, best["m"]).otherwise(x["m"]).alias("m"), before.alias("ctx"), after.alias("next"), F.when(inside, best["kind"]).otherwise(own).alias("kind")
        )

    def merge(both):
        events = F.array_sort(
            F.concat(
                F.transform(both["seeds"], lambda s: as_event(s["start"], 0, s, none, none, s["kind"])),
                F.transform(both["found"], lambda s: as_event(s["end"] - 1, 1, s, s["left"], s["right"], none)),
            )
        )
        start = F.struct(
            F.struct(F.lit(0).alias("end"), none.alias("m"), none.alias("kind")).alias("best"), F.array().cast(f"array<{_TOKEN_TYPE}>").alias("group"), F.array().cast(f"array<array<{_TOKEN_TYPE}>>").alias("full")
        )

        def step(acc, x):
            seed = x["what"] == 0
            best = F.when(seed & (x["end"] > acc["best"]["end"]), F.struct(x["end"].alias("end"), x["m"].alias("m"), x["kind"].alias("kind"))).otherwise(acc["best"])
            whole = F.size(acc["group"]) >= _GROUP
            one = F.array(token(x, acc["best"]))
            group = F.when(seed, acc["group"]).when(whole, one).otherwise(F.concat(acc["group"], one))
            full = F.when(~seed & whole, F.concat(acc["full"], F.array(acc["group"]))).otherwise(acc["full"])
            return F.struct(best.alias("best"), group.alias("group"), full.alias("full"))

        return F.aggregate(events, start, step, lambda acc: F.concat(F.flatten(acc["full"]), acc["group"]))

    return based.withColumn("pii_tokens", C.let(F.struct(found.alias("found"), seeds.alias("seeds")), merge))


#: What a discovered token must look like for each kind; loose forms that the base patterns miss.
SHAPES = {
    "email": r"^[^@\s]{2,}@[^@\s]{2,}$",
    "ip": r"^[(\[]?[0-9]{1,3}([.:,-][0-9]{1,3}){3}.?$",
    "card": r"^(?:[^0-9]*[0-9]){12,}[^0-9]*$",
    "phone": r"^(?:[^0-9]{0,3}[0-9]){7,15}[^0-9]{0,3}$",
    SECRET: rf"^(?=.*[0-9])(?=.*[A-Za-z])[^0-9A-Za-z]*{SECRET_BODY}[^0-9A-Za-z]*$",
}


def _patterns(t: str) -> Column:
    """The last word before a token, the last two, and the first after it; none for a side that begins or ends the line."""
    ctx, after = F.col(f"{t}.ctx"), F.col(f"{t}.next")
    last = F.element_at(F.split(ctx, r"[\x20\x09]+"), -1)
    left, right = F.when(F.length(ctx) > 0, F.concat(F.lit("1:"), last)), F.when(F.length(after) > 0, F.concat(F.lit("r:"), after))
    return F.array_distinct(F.array_compact(F.array(left, F.when(F.length(ctx) > 0, F.concat(F.lit("2:"), ctx)), right)))


def bootstrap(tokens: DataFrame, rounds: int = 3, min_seeds: int = 8, min_confidence: float = 0.8) -> DataFrame:
    """Scores patterns over the pattern-token graph: ``pattern, kind, confidence``.

    ``tokens`` has ``t`` (kind null for what is no seed). A seed is believed fully for its kind. A pattern's confidence for a kind is
    the mean belief of its tokens, one extra doubting token included; another token's belief is the mean confidence of its patterns. A
    pattern is scored if at least ``min_seeds`` of its tokens are believed by ``min_confidence`` or more; what a round has come to believe can
    so bring in patterns that the seeds alone don't reach.
    """
    edges = C.cut(
        tokens.select(F.explode(_patterns("t")).alias("pattern"), F.sha2("t.m", 256).alias("token"), F.col("t.kind").alias("kind"))
        .groupBy("pattern", "token")
        .agg(F.max("kind").alias("seed"))
    )
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n_tokens"), *[F.count_if(F.col("seed") == k).alias(f"n_{k}") for k in ALL_KINDS])
    # one row per pattern and kind that a seed or, later, a believed token speaks for
    sizes = C.cut(sizes.select("pattern", "n_tokens", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n_seeds")) for k in ALL_KINDS])).alias("k")).select("pattern", "n_tokens", "k.*"))
    unseen = edges.filter(F.col("seed").isNull()).select("pattern", "token")
    more = None
    for k in range(rounds):
        known = sizes.filter("n_seeds > 0") if more is None else sizes.join(more, ["pattern", "kind"], "left").filter("n_seeds > 0 OR extra > 0")
        extra, sure = (F.lit(0.0), F.lit(0)) if more is None else (F.coalesce("extra", F.lit(0.0)), F.coalesce("sure", F.lit(0)))
        score = C.cut(known.filter(F.col("n_seeds") + sure >= min_seeds).select("pattern", "kind", ((F.col("n_seeds") + extra) / (F.col("n_tokens") + 1)).alias("confidence")))
        if k < rounds - 1:
            belief = C.join_sized(unseen, score, "pattern", "inner").groupBy("token", "kind").agg(F.avg("confidence").alias("belief"))
            more = C.cut(unseen.join(belief, "token").groupBy("pattern", "kind").agg(F.sum("belief").alias("extra"), F.count_if(F.col("belief") >= min_confidence).alias("sure")))
    return score.filter(F.col("confidence") >= min_confidence)


ALL_KINDS = (*KINDS, SECRET)


def _spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _by_kind(kind: str) -> Column:
    return F.transform(f"pii_{kind}", lambda s: F.struct(F.lit(KINDS.index(kind)).alias("k"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


ALL = "array<struct<k:int,start:int,end:int,kind:string>>"


def _tokens(based: DataFrame, *columns: str) -> DataFrame:
    """One row per identifier-like token; an outer explode, so that no filter repeats the search below it."""
    *rest, tokens = columns
    return based.filter(F.col("text").rlike("[0-9@]")).select(*rest, F.explode_outer(tokens).alias("t")).filter(F.col("t").isNotNull())


def detect(docs: DataFrame, **options) -> DataFrame:
    """Adds ``pii_email, pii_ip, pii_card, pii_phone`` (base spans) and ``pii_all`` (base and discovered, by kind, then start).

    Every other column stays; rows are neither added nor lost.
    """
    keep = docs.columns
    based = candidates(with_base(docs))
    accepted = C.cut(bootstrap(_tokens(based, "pii_tokens"), **options))
    base = F.concat(*[_by_kind(k) for k in KINDS])
    if not accepted.head(1):
        return based.select(*keep, *[f"pii_{k}" for k in KINDS], base.alias("pii_all"))
    shape = F.coalesce(*[F.when(F.col("kind") == k, F.col("t.m").rlike(p)) for k, p in SHAPES.items()])
    # of a secret only its body, without quotes and punctuation around it
    inner = F.regexp_extract("t.m", SECRET_BODY, 0)
    begin = F.when(F.col("kind") == SECRET, F.col("t.start") + F.instr("t.m", inner) - 1).otherwise(F.col("t.start"))
    end = F.when(F.col("kind") == SECRET, begin + F.char_length(inner)).otherwise(F.col("t.end"))
    # rows are told apart by id and text, so rows that repeat share what was found in them
    key = {"pii_id": F.col("doc_id"), "pii_text": F.sha2(F.coalesce("text", F.lit("")), 256)}
    free = _tokens(based.withColumns(key), "pii_id", "pii_text", "pii_tokens").filter(F.coalesce(F.col("t.kind") == SECRET, F.lit(True)))
    best = (
        C.join_sized(free.withColumn("pattern", F.explode(_patterns("t"))), accepted, "pattern", "inner")
        .filter(shape)
        .withColumns({"begin": begin, "stop": end})
        .groupBy("pii_id", "pii_text", F.col("begin").alias("start"), F.col("stop").alias("end"))
        .agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    )
    place = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(ALL_KINDS)])
    more = best.groupBy(F.col("pii_id").alias("pii_id2"), F.col("pii_text").alias("pii_text2")).agg(
        F.collect_set(F.struct(place.alias("k"), "start", "end", "kind")).alias("pii_more")
    )
    joined = based.withColumns(key).join(more, F.col("pii_id").eqNullSafe(F.col("pii_id2")) & (F.col("pii_text") == F.col("pii_text2")), "left")
    full = F.sort_array(F.concat(base, F.coalesce("pii_more", F.array().cast(ALL))))
    return joined.select(*keep, *[f"pii_{k}" for k in KINDS], full.alias("pii_all"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """Replaces every span with ``<KIND>``; spans that overlap are replaced together, under the kind of the one that starts first (then the longest). Other columns stay; ``n_chars`` is renewed."""
    order = F.sort_array(F.transform("pii_all", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        piece = F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        new = F.concat(acc["out"], F.array(piece, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
        joined = F.struct(F.greatest(acc["at"], -s["neg"]).alias("at"), acc["out"].alias("out"))
        return F.when((s["start"] < acc["at"]) & (F.size(acc["out"]) > 0), joined).otherwise(F.struct((-s["neg"]).alias("at"), new.alias("out")))

    def finish(acc):
        return F.concat(F.array_join(acc["out"], ""), F.substr(F.col("text"), acc["at"] + 1, F.char_length("text")))

    found = detect(docs, **options).withColumn("pii_order", order)
    changed = F.when(F.size("pii_order") > 0, F.aggregate("pii_order", begin, step, finish)).otherwise(F.col("text"))
    out = found.withColumn("pii_new", changed)
    columns = [F.col("pii_new").alias("text") if c == "text" else F.coalesce(F.char_length("pii_new"), F.lit(0)).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[_by_kind(k) for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_spans_text(base), 256).alias("base_sha256"),
        _spans_text(F.col("pii_all")).alias("spans"),
        F.size("pii_all").cast("long").alias("n_spans"),
        F.size(F.filter("pii_all", lambda s: s["kind"] == SECRET)).cast("long").alias("n_secret"),
        (F.size("pii_all") > 0).alias("personal"),
    )
