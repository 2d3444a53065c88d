"""Personal data by weak supervision, in DataFrame functions only.

Base patterns find spans that always stay. Looser patterns propose more. Every candidate is voted on by five
labelers: its format, its checksum or range, a gazetteer, the words before it, and what it touches; each says
yes, no, or nothing. Expectation-maximisation over the vote patterns estimates each labeler's reliability
and each pattern's probability without any labels. A logistic classifier over votes and shape is then fitted to these
probabilities, and proposed spans that it accepts, and that no span of their kind overlaps, are added.

Vote patterns are counted over the whole corpus. Their number depends on the labelers only (3 ** 5 votes times
8 shapes for each kind), so both fits are folds over a few arrays, whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import durable

KINDS = ("email", "ip", "card", "phone")
#: Fixed values. Base patterns; a run's start is tied to what stands before it, so no run is scanned again from inside.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be worth trying.
GATE = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Proposals beyond the base patterns.
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+A-Za-z.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
}
LOOSE |= {
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\x20\.\x20?|\x20?[\[(](?:\.|dot|DOT)[\])]\x20?)[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9._/])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9._/])",
}
LOOSE_GATE = {"ip": r"[0-9]\x20?(?:\.\x20|[\[(](?:\.|dot|DOT)[\])]|\x20\.)", "card": r"[0-9]{4}[._/][0-9]{4}[._/]", "email": r"[\[(](?:at|AT)[\])]", "phone": r"[0-9]{3}[.-][0-9]{4}"}
#: Gazetteers: top-level domains, calling codes, card issuers' first digits, words that announce a kind.
DOMAINS = r"(?i)[.)\]\x20](?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info|it|nl|ch|at|us|ca|co)$"
CALLING = r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
ANNOUNCE = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|correo|courriel|kontakt)[^A-Za-z]{0,3}\W*$",
    "ip": r"(?i)(?:\bip|host|server|address|addr|from)[^A-Za-z]{0,3}\W*$",
    "card": r"(?i)(?:card|visa|master|amex|credit|payment|karte|tarjeta|carte)[^A-Za-z]{0,3}\W*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|telefon|tel[eé]fono)[^A-Za-z]{0,3}\W*$",
}
DENY = r"(?i)(?:version|isbn|order|invoice|serial|hash|page|item|build)[^A-Za-z]{0,3}\W*$"
VOTERS = 5
FEATURES = 1 + 2 * VOTERS + 3  # a constant, a yes and a no for each labeler, three of shape
EM_ROUNDS, FIT_ROUNDS = 25, 200
CONTEXT = 32
SPAN_BLOCK = 256  # matches of a text that are placed together


def found_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with places, in code points: the gaps between matches give the offsets."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(hits.alias("value"), F.slice(gaps, 1, F.size(hits)).alias("before"), F.slice(gaps, 2, F.size(hits)).alias("after"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")

    width = lambda x: F.length(x["before"]) + F.length(x["value"])

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["before"])
        end = start + F.length(x["value"])
        one = F.struct(
            start.alias("start"),
            end.alias("end"),
            x["value"].alias("value"),
            F.right(x["before"], F.lit(CONTEXT)).alias("before"),
            F.left(x["after"], F.lit(1)).alias("after"),
        )
        return F.struct(end.alias("at"), F.array_append(done["out"], one).alias("out"))

    # in blocks, since an array grows by being copied: first the place of each block, then the spans of each
    blocks = F.transform(F.filter(F.sequence(F.lit(0), F.floor(F.size(pairs) / SPAN_BLOCK)), lambda k: k * SPAN_BLOCK < F.size(pairs)), lambda k: F.slice(pairs, (k * SPAN_BLOCK + 1).cast("int"), F.lit(SPAN_BLOCK)))
    long = lambda block: F.aggregate(block, F.lit(0), lambda s, x: s + width(x))
    place = lambda done, n: F.struct((done["at"] + n).alias("at"), F.array_append(done["out"], done["at"]).alias("out"))
    starts = F.aggregate(F.transform(blocks, long), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), place, lambda done: done["out"])
    return F.flatten(F.zip_with(blocks, starts, lambda block, at: F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), step, lambda done: done["out"])))


def luhn(digits: Column) -> Column:
    """Luhn's checksum over a string of digits."""

    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(digits) - 1)), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The base rules' own checks."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.nullif(F.ltrim(x, F.lit("0")), F.lit("")), F.lit("0")).substr(1, 4).cast("int") <= 255)
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 2).otherwise(0)


def judged(kind: str, x: Column, loose: bool) -> Column:
    """A candidate with its votes (0 nothing, 1 yes, 2 no) and shape bits."""
    value, digits = x["value"], F.regexp_replace(x["value"], "[^0-9]", "")
    parts = F.filter(F.split(value, "[^0-9]+"), lambda p: p != "")
    in_range = (F.size(parts) == 4) & F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.substr(1, 3).cast("int"), F.lit(999)) <= 255)) if loose else valid(kind, value)
    glued = x["before"].rlike(r"[\p{L}0-9_]$") | x["after"].rlike(r"^[\p{L}0-9_]")
    listed = {
        "email": _vote(value.rlike(DOMAINS), F.lit(False)),
        "ip": _vote(value.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])(?![0-9])"), value.rlike(r"^0")),
        "card": _vote(digits.rlike(ISSUERS), digits.rlike(r"^[01789]")),
        "phone": _vote(value.rlike(CALLING), ~value.rlike(CALLING)),
    }[kind]
    checked = {
        "email": _vote(value.rlike(r"^[^@]{1,64}@[^@]{4,255}$") if not loose else F.lit(True), F.length(value) > 320),
        "ip": _vote(in_range, ~in_range),
        "card": _vote(valid(kind, value), ~valid(kind, value)),
        "phone": _vote(F.length(digits).between(9, 15), ~F.length(digits).between(9, 15)),
    }[kind]
    others = F.lit(False)
    for k in KINDS:
        if k != kind:
            others = others | x["before"].rlike(ANNOUNCE[k])
    announced = x["before"].rlike(ANNOUNCE[kind])
    votes = (
        F.lit(1) if not loose else F.lit(0),
        checked,
        listed,
        _vote(announced, x["before"].rlike(DENY) | others),
        _vote(~glued, glued),
    )
    code = F.lit(0)
    for v in votes:
        code = code * 3 + v
    shape = value.rlike(r"[\x20()\[\]-]").cast("int") + (F.length(value) > 15).cast("int") * 2 + x["before"].rlike(r"[:=(<\"'\[]\s*$").cast("int") * 4
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        x["start"].alias("start"),
        x["end"].alias("end"),
        (valid(kind, value) if not loose else F.lit(False)).alias("base"),
        (code * 8 + shape).cast("int").alias("code"),
    )


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, found): every row with its judged candidates, base and loose, in one reading of the text."""
    text = F.col("text")
    nothing = F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean,code:int>>")

    def listed(kind: str, gate: str, pattern: str, loose: bool) -> Column:
        return F.when(text.rlike(gate), F.transform(found_spans(text, pattern), lambda x: judged(kind, x, loose))).otherwise(nothing)

    lists = [listed(k, GATE[k], BASE[k], False) for k in KINDS] + [listed(k, LOOSE_GATE[k], LOOSE[k], True) for k in LOOSE]
    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return picked.select("doc_id", F.concat(*lists).alias("found"))


def features(code: Column) -> Column:
    """A constant, yes and no of each labeler, and the shape bits, as 0 or 1."""
    votes = [F.floor(code / (8 * 3 ** (VOTERS - 1 - k))).cast("int") % 3 for k in range(VOTERS)]
    bits = [F.lit(1), *[c for v in votes for c in ((v == 1).cast("int"), (v == 2).cast("int"))], *[F.shiftright(code, k) % 2 for k in range(3)]]
    return F.array(*[b.cast("double") for b in bits])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fit(found: DataFrame) -> DataFrame:
    """(kind, reliability array, weights array): one row for each kind that has candidates."""
    counts = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.code").agg(F.count("*").cast("double").alias("n"))
    patterns = counts.groupBy("kind").agg(
        F.sort_array(F.collect_list(F.struct("code", "n", features(F.col("code")).alias("f")))).alias("p"), F.sum("n").alias("all")
    )
    # EM: yes-or-no reliability of each labeler. Smoothed towards 0.8 by ten imagined votes.
    def posterior(x: Column, prior: Column, r: Column) -> Column:
        odds = F.transform(r, lambda v: F.log(v / (1 - v)))
        said = F.transform(F.sequence(F.lit(0), F.lit(VOTERS - 1)), lambda k: F.get(odds, k) * (F.get(x["f"], 1 + 2 * k) - F.get(x["f"], 2 + 2 * k)))
        return _logistic(F.log(prior / (1 - prior)) + F.aggregate(said, F.lit(0.0), lambda s, v: s + v))

    def em_round(state: Column, _: Column) -> Column:
        scored = F.transform("p", lambda x: F.struct(x["n"].alias("n"), x["f"].alias("f"), posterior(x, state["prior"], state["r"]).alias("y")))
        total = lambda g: F.aggregate(scored, F.lit(0.0), lambda s, x: s + g(x))
        right = lambda k: total(lambda x: x["n"] * (F.get(x["f"], 1 + 2 * k) * x["y"] + F.get(x["f"], 2 + 2 * k) * (1 - x["y"])))
        votes = lambda k: total(lambda x: x["n"] * (F.get(x["f"], 1 + 2 * k) + F.get(x["f"], 2 + 2 * k)))
        r = F.transform(F.sequence(F.lit(0), F.lit(VOTERS - 1)), lambda k: F.least(F.lit(0.99), F.greatest(F.lit(0.5), (right(k) + 8) / (votes(k) + 10))))
        prior = F.least(F.lit(0.98), F.greatest(F.lit(0.02), (total(lambda x: x["n"] * x["y"]) + 1) / (F.col("all") + 2)))
        return F.struct(prior.alias("prior"), r.alias("r"))

    start = F.struct(F.lit(0.5).alias("prior"), F.array(*[F.lit(0.8)] * VOTERS).alias("r"))
    em = durable(patterns.withColumn("em", F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), start, em_round)))
    soft = durable(em.withColumn("p", F.transform("p", lambda x: F.struct((x["n"] / F.col("all")).alias("n"), x["f"].alias("f"), posterior(x, F.col("em.prior"), F.col("em.r")).alias("y")))))

    def fit_round(w: Column, _: Column) -> Column:
        slope = F.aggregate(
            "p",
            F.array(*[F.lit(0.0)] * FEATURES),
            lambda g, x: F.zip_with(g, x["f"], lambda a, b: a + b * x["n"] * (x["y"] - _logistic(_dot(w, x["f"])))),
        )
        return F.zip_with(w, slope, lambda a, b: a * 0.999 + b * 2.0)

    weights = F.aggregate(F.sequence(F.lit(1), F.lit(FIT_ROUNDS)), F.array(*[F.lit(0.0)] * FEATURES), fit_round)
    return soft.select("kind", F.col("em.r").alias("reliability"), weights.alias("weights"))


def _covered(base: Column, x: Column) -> Column:
    """Whether a span overlaps a base span of its kind. These are sorted and apart, so only the last that begins before
    the span's end can; a binary search, as a fold over the powers of two, finds it."""
    before = lambda b: (b["kind"] < x["kind"]) | ((b["kind"] == x["kind"]) & (b["start"] < x["end"]))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(30))])
    n = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at <= F.size(base) - step) & before(F.get(base, at + step - 1)), at + step).otherwise(at))
    last = F.get(base, n - 1)
    return F.coalesce((last["kind"] == x["kind"]) & (last["end"] > x["start"]), F.lit(False))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): one row per input row.

    Spans are kind:start:end in code points, end exclusive, by kind as listed, then start. Null text is empty; an
    empty table gives no rows; null and repeated ids pass through. A base match that fails its check counts
    as a candidate and is never a base span; only the classifier can add a proposed one, and none that fails
    its kind's check.
    """
    found = durable(candidates(docs, id_col, text_col))
    models = {r.kind: r.weights for r in fit(found).collect()}  # at most one row of 14 numbers for each kind
    weights = F.array(*[F.array(*map(F.lit, models.get(k, [-1.0] + [0.0] * (FEATURES - 1)))) for k in range(len(KINDS))])
    loose = lambda x: F.floor(x["code"] / (8 * 3 ** (VOTERS - 1))) % 3 == 0
    failed = lambda x: F.floor(x["code"] / (8 * 3 ** (VOTERS - 2))) % 3 == 2
    accepted = F.filter("found", lambda x: loose(x) & ~failed(x) & (_logistic(_dot(F.get(weights, x["kind"]), features(x["code"]))) >= least))
    base = F.array_sort(F.filter("found", lambda x: x["base"]))
    free = F.filter(accepted, lambda x: ~_covered(base, x))
    names = F.array(*map(F.lit, KINDS))
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    number = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.array_sort(F.concat(base, free))).alias("spans"),
    )
