"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans. A shape, a gazetteer and a context labeler vote on each; expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is and how
likely each pattern means personal data; those likelihoods train a naive Bayes classifier over
features that the labelers do not use, and it decides on the spans beyond the fixed ones.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.functions import columns as C
from scanframe.llm.common import materialise, table

# Possessive quantifiers keep long runs from recursing or being tried again from each of their
# characters; they match the same, as what follows a run is never in the run's own class.
_ADDRESS = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_ADDRESS})){_ADDRESS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?+[0-9])++"
PHONE = r"\+[0-9](?:[ ().-]*+[0-9])++"
#: Candidates beyond the fixed spans.
SPELLED_EMAIL = rf"(?:\G|(?<!{_ADDRESS})){_ADDRESS}++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
NUMBER = r"(?:\G|(?<![0-9]))[0-9]{8,19}+(?![0-9])"
SECRET = r"(?i)(?:token|secret|api[_-]?key|passw(?:or)?d)[\"']? ?[=:] ?[\"'][^\"'\s]{8,}+[\"']"

#: (kind, pattern, strings of which a text must hold one, whether a span stays in any case)
BASE = (("email", EMAIL, ("@",)), ("ip", IP, (".",)), ("card", CARD, ()), ("phone", PHONE, ("+",)))
MORE = (("email", SPELLED_EMAIL, ("(at)", "[at]")), ("phone", LOCAL_PHONE, ()), ("account", NUMBER, ()), ("secret", SECRET, ("=", ":")))
KINDS = ("email", "ip", "card", "phone", "account", "secret")

TOP_DOMAINS = ("com", "net", "org", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "uk", "us", "ch", "at", "it", "nl")
CUES = {
    "email": "mail|contact|write|reach|address",
    "ip": "\\bip\\b|host|server|login|addr",
    "card": "card|visa|master|amex|credit|debit|pay",
    "phone": "tel|phone|call|fax|mobile|whatsapp",
    "account": "account|iban|konto|compte|cuenta|passport|ssn|tax",
    "secret": "secret|token|key|auth|login",
}
AGAINST = "version|isbn|issn|order|invoice|page|figure|build|release|example"
CONTEXT = 24
SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,text:string,before:string,after:string>>"
ROUNDS = 60


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Whether the digits of ``s`` pass the Luhn check."""
    reverse = F.filter(F.split(F.reverse(_digits(s)), ""), lambda c: c != "")
    doubled = F.transform(reverse, lambda c, i: F.when(i % 2 == 1, F.pmod(c.cast("int") * 2 - 1, F.lit(9)) + 1).otherwise(c.cast("int")))
    # doubling: 0 stays 0; 1 to 9 give 2 4 6 8 1 3 5 7 9, the digit sums of their doubles
    fixed = F.zip_with(reverse, doubled, lambda c, d: F.when(c == "0", F.lit(0)).otherwise(d))
    return F.aggregate(fixed, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, s: Column) -> Column:
    """The conditions on a match of a fixed kind besides its pattern."""
    n = F.length(_digits(s))
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda x: x.rlike("^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), _luhn(s)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _spans(found: Column) -> Column:
    """Structs of the matches of ``found``: ``kind``, ``base``, the matches ``m`` of a pattern and
    the text ``p`` split at them."""
    matches, gaps = found["m"], found["p"]
    sizes = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda x, y: (F.length(x) + F.length(y)).cast("long"))

    def span(x: Column, j: Column, starts: Column) -> Column:
        gap = F.get(gaps, j)
        start = F.get(starts, j) + F.length(gap)
        return F.struct(
            found["kind"].alias("kind"),
            start.alias("start"),
            (start + F.length(x)).alias("end"),
            found["base"].alias("base"),
            x.alias("text"),
            F.right(gap, F.lit(CONTEXT)).alias("before"),
            F.left(F.get(gaps, j + 1), F.lit(CONTEXT)).alias("after"),
        )

    spans = C.let(C.running(sizes, F.lit(0).cast("long"), lambda a, x: a + x), lambda starts: F.transform(matches, lambda x, j: span(x, j, starts)))
    return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(SPANS))


def _free(rest: Column, fixed: Column) -> Column:
    """The spans of ``rest`` that overlap none of ``fixed``, in order of their ends.

    Both are sorted together, a fixed span by its start and the others by their ends; one of
    these overlaps where a fixed span before it reaches beyond its start.
    """
    nothing = F.lit(None).cast(SPANS[6:-1])
    opened = F.transform(fixed, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("k"), s["end"].alias("reach"), nothing.alias("span")))
    closed = F.transform(rest, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("k"), F.lit(-1).cast("long").alias("reach"), s.alias("span")))
    both = F.array_sort(F.concat(opened, closed))
    reached = lambda events: C.running(F.transform(events, lambda e: e["reach"]), F.lit(-1).cast("long"), lambda a, x: F.greatest(a, x))
    free = C.let(both, lambda events: F.filter(F.zip_with(events, reached(events), lambda e, far: F.when((e["k"] == 0) & (far <= e["span"]["start"]), e["span"])), lambda s: s.isNotNull()))
    return F.when((F.size(rest) > 0) & (F.size(fixed) > 0), free).otherwise(rest)


def _matches(text: Column, pattern: str, needed: tuple[str, ...]) -> Column:
    nothing = F.array().cast("array<string>")
    may = F.contains(text, F.lit(needed[0])) if needed else text.rlike("[0-9]{3}|[0-9][ -][0-9]")
    for s in needed[1:]:
        may = may | F.contains(text, F.lit(s))
    return F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(nothing)


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every row: all proposed spans, fixed ones first.

    A span has ``kind, start, end, base, text, before, after``; offsets are code points.
    Other spans that overlap a fixed one are left out.
    """
    proposals = [*((*p, True) for p in BASE), *((*p, False) for p in MORE)]
    n = range(len(proposals))
    column = lambda name: [F.col(f"{name}{k}") for k in n]
    nothing = F.array().cast("array<string>")
    step = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("string").alias("text"))
    step = step.select("*", *[_matches(F.col("text"), p, needed).alias(f"m{k}") for k, (_, p, needed, _) in enumerate(proposals)])
    gaps = [F.when(F.size(m) > 0, F.split("text", p, -1)).otherwise(nothing).alias(f"p{k}") for k, (m, (_, p, *_)) in enumerate(zip(column("m"), proposals, strict=True))]
    step = step.select("doc_id", *column("m"), *gaps)
    found = [F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), m.alias("m"), p.alias("p")) for (kind, *_, base), m, p in zip(proposals, column("m"), column("p"), strict=True)]
    step = step.select("doc_id", F.flatten(F.transform(F.array(*found), _spans)).alias("spans"))
    holds = lambda s: _by_kind(s["kind"], {k: _holds(k, s["text"]) for k in ("ip", "card", "phone")}, F.lit(True))
    step = step.select("doc_id", F.filter("spans", lambda s: s["base"] & holds(s)).alias("fixed"), F.filter("spans", lambda s: ~s["base"]).alias("rest"))
    return step.select("doc_id", F.concat("fixed", _free(F.col("rest"), F.col("fixed"))).alias("spans"))


def _by_kind(kind: Column, choices: dict[str, Column], other: Column) -> Column:
    out = other
    for k, c in choices.items():
        out = F.when(kind == k, c).otherwise(out)
    return out


def votes(s: Column) -> list[Column]:
    """What the shape, gazetteer and context labelers say of a span: 1, -1 or 0 (no opinion)."""
    kind, text = s["kind"], F.lower(s["text"])
    digits, n = _digits(s["text"]), F.length(_digits(s["text"]))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    shape = _by_kind(
        kind,
        {
            "email": vote(text.rlike(r"^[a-z0-9][a-z0-9._%+-]*+(?<![.])(?:@| ?[(\[]at[)\]] ?)[a-z0-9-]++.*[a-z]{2,}$"), ~text.rlike("[a-z]")),
            "ip": vote(~text.rlike(r"(?:^|\.)0[0-9]"), text.rlike(r"^0|(?:^|\.)0[0-9]")),
            "card": vote(n == 16, n > 16),
            "phone": vote((n >= 10) & (n <= 13), n < 9),
            "account": vote((n >= 9) & (n <= 12) & ~digits.rlike("^(.)\\1+$"), (n == 8) | digits.rlike("^(.)\\1+$")),
            "secret": vote(text.rlike("[0-9]") & (F.length(text) >= 24), ~text.rlike("[0-9]")),
        },
        F.lit(0),
    )
    domain = F.element_at(F.split(F.regexp_replace(text, r"[)\]]", ""), r"[.\s]|dot"), -1)
    gazetteer = _by_kind(
        kind,
        {
            "email": vote(domain.isin(*TOP_DOMAINS), F.length(domain) > 6),
            "ip": vote(~text.rlike(r"^(?:0|127|2(?:2[4-9]|[345][0-9]))\."), text.rlike(r"^(?:0|127|2(?:2[4-9]|[345][0-9]))\.")),
            "card": vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65|62)"), digits.rlike("^[0179]")),
            "phone": vote(text.rlike(r"^\+(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-8])") | text.rlike(r"^\(?[2-9]"), text.rlike(r"^\(?[01]")),
            "account": vote(_luhn(s["text"]) & (n >= 13), (n >= 13) | digits.rlike("^(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])")),
            "secret": vote(text.rlike("token|secret|key"), text.rlike("example|changeme|placeholder")),
        },
        F.lit(0),
    )
    around = F.lower(F.concat(s["before"], F.lit(" "), s["after"]))
    cue = _by_kind(kind, {k: around.rlike(v) for k, v in CUES.items()}, F.lit(False))
    return [shape, gazetteer, vote(cue, around.rlike(AGAINST))]


def features(s: Column) -> list[Column]:
    """What the final classifier sees: touching characters, punctuation and length."""
    klass = lambda c: F.when(c == "", "edge").when(c.rlike(r"^\s$"), "space").when(c.rlike(r"^\p{L}$"), "letter").when(c.rlike("^[0-9]$"), "digit").otherwise("mark")
    marks = F.regexp_replace(s["text"], r"[\p{L}0-9]", "")
    return [
        F.concat(F.lit("before:"), klass(F.right(s["before"], F.lit(1)))),
        F.concat(F.lit("after:"), klass(F.left(s["after"], F.lit(1)))),
        F.concat(F.lit("marks:"), F.least(F.length(marks), F.lit(6)).cast("string")),
        F.concat(F.lit("size:"), F.least(F.floor(F.length(s["text"]) / 4), F.lit(12)).cast("string")),
    ]


def reliabilities(counts: dict[tuple[int, ...], float], rounds: int = ROUNDS) -> tuple[float, list[dict[tuple[int, int], float]], dict[tuple[int, ...], float]]:
    """EM over vote patterns: prior, P(vote | truth) of each labeler, P(true | pattern).

    Labelers are taken as independent given the truth; add-one smoothing, and a start from the
    majority vote, keep a labeler that always agrees or abstains from breaking it.
    """
    sure = {v: min(0.9, max(0.1, 0.5 + 0.4 * (sum(v) > 0) - 0.4 * (sum(v) < 0))) for v in counts}
    prior, given = 0.5, []
    for _ in range(rounds):
        total = sum(counts.values())
        true = sum(n * sure[v] for v, n in counts.items())
        prior = (true + 1) / (total + 2)
        given = []
        for j in range(len(next(iter(counts)))):
            mass = {(t, x): 1.0 for t, x in product((0, 1), (-1, 0, 1))}
            for v, n in counts.items():
                mass[1, v[j]] += n * sure[v]
                mass[0, v[j]] += n * (1 - sure[v])
            sums = {t: sum(mass[t, x] for x in (-1, 0, 1)) for t in (0, 1)}
            given.append({(t, x): m / sums[t] for (t, x), m in mass.items()})
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(g[1, x] / g[0, x]) for g, x in zip(given, v, strict=True))
            sure[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, given, sure


def train(spans: DataFrame) -> dict[str, float]:
    """Log-odds by ``kind`` (prior) and ``kind|feature:value`` of the span classifier.

    The driver gets counts by kind, votes and feature value: a few thousand rows whatever the
    input, as each of these has a fixed set of values.
    """
    s = F.col("s")
    one = spans.select(F.explode("spans").alias("s"))
    keyed = one.select(s["kind"].alias("kind"), F.concat_ws(",", *[v.cast("string") for v in votes(s)]).alias("votes"), F.explode(F.array(F.lit("all"), *features(s))).alias("feature"))
    counted = keyed.groupBy("kind", "votes", "feature").count().collect()
    by_kind: dict[str, dict[tuple[int, ...], float]] = defaultdict(dict)
    for r in counted:
        if r["feature"] == "all":
            by_kind[r["kind"]][tuple(map(int, r["votes"].split(",")))] = float(r["count"])
    sure = {kind: reliabilities(counts)[2] for kind, counts in by_kind.items()}
    mass: dict[tuple[str, str], list[float]] = defaultdict(lambda: [1.0, 1.0])
    for r in counted:
        p = sure[r["kind"]][tuple(map(int, r["votes"].split(",")))]
        for t, w in ((1, p), (0, 1 - p)):
            mass[r["kind"], r["feature"]][t] += w * r["count"]
    out = {}
    for (kind, feature), (no, yes) in mass.items():
        no_all, yes_all = mass[kind, "all"]
        out[kind if feature == "all" else f"{kind}|{feature}"] = math.log(yes / no) if feature == "all" else math.log(yes / yes_all) - math.log(no / no_all)
    return out


def find(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    The counts and the digest are of the fixed spans; ``spans`` has what the classifier adds
    too. Null and empty texts have no spans and the digest of the empty string. Rows that repeat
    give a row each, and each counts for the classifier; null doc_ids are rows like others;
    extra columns are ignored; an empty table gives no rows. Time grows in proportion to a
    text's length and matches.
    """
    spans = materialise(candidates(docs), "spans")
    odds = train(spans)
    weights = F.create_map(*[F.lit(x) for pair in odds.items() for x in pair]) if odds else F.create_map().cast("map<string,double>")

    def accepted(s: Column) -> Column:
        score = F.coalesce(F.try_element_at(weights, s["kind"]), F.lit(0.0))
        for f in features(s):
            score = score + F.coalesce(F.try_element_at(weights, F.concat(s["kind"], F.lit("|"), f)), F.lit(0.0))
        return F.when(s["base"], True).otherwise(score > 0)

    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    ordered = F.array_sort(
        F.transform(F.filter("spans", accepted), lambda s: F.struct(F.element_at(rank, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))
    )
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    empty = F.array().cast("array<struct<rank:int,start:bigint,end:bigint,kind:string,base:boolean>>")
    chosen = spans.select("doc_id", F.when(F.size("spans") > 0, ordered).otherwise(empty).alias("all")).withColumn("base", F.filter("all", lambda s: s["base"]))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return chosen.select("doc_id", *[count(k) for k, *_ in BASE], F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.col("all")).alias("spans"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
