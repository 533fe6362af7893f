"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

1. Candidates. Strict patterns give the base spans, which always stay; loose patterns give further candidates that
   touch no base span (obfuscated addresses, digit runs that are no valid card, numbers without a country code,
   IPv6 forms).
2. Votes. Six labelers look at each candidate: the strict pattern, a gazetteer (top-level domains, card issuers,
   country codes, public address ranges), structure (checksum, lengths), cue words before it, words that speak
   against it, and what stands next to it. Each says yes (1), no (-1) or nothing (0).
3. EM. Per kind, each labeler answers independently given the hidden truth; expectation-maximisation estimates how
   often it says what for true and for false candidates. It works on the counts of distinct vote patterns, of
   which there are at most 3^6 a kind, so what reaches the driver is bounded whatever the corpus.
4. Classifier. A logistic regression per kind over span features learns the EM posteriors, again from pattern counts
   (at most 2^9 feature patterns a kind and vote pattern). Candidates that it calls likelier than not are added.

Texts are read by DataFrame functions alone; a document's candidates stay in one array in its row, nothing is gathered
by kind or value. Null and empty texts have no spans; repeated rows each get their row; an empty table gives no rows and
a model that accepts nothing beyond the base. Only doc_id and text are read; `redact` hands on all other columns.
Places are code points, end exclusive.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import cut

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "A-Za-z0-9._%+-"
#: Strict patterns. Looking back keeps a search from starting again inside a run that has already failed.
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A whole run of 13 to 19 digits with single spaces or hyphens between; 16 to 19 that pass Luhn are base cards.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
#: Loose patterns; every repetition is bounded.
LOOSE_EMAIL = rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}} ?[(\[]at[)\]] ?[A-Za-z0-9-]{{1,63}}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{{1,63}}){{1,8}}"
LOOSE_IP = r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])"
LOOSE_PHONE = r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![.-]?[0-9])"
_PATTERNS = {  # kind, pattern, what a text must contain for it
    "email": (0, EMAIL, "@"), "ip": (1, IP, "."), "card": (2, CARD, ""), "phone": (3, PHONE, "+"),
    "loose_email": (0, LOOSE_EMAIL, "at"), "loose_ip": (1, LOOSE_IP, ":"), "loose_phone": (3, LOOSE_PHONE, ""),
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
VALID_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"

#: Gazetteers and cue words, per kind.
DOMAINS = "com org net edu gov int info biz io de fr es it uk us eu nl ch at pt br mx in cn jp ru pl se no fi dk be ca au"
ISSUERS = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3[068]|35|6011|64[4-9]|65|62)"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[7-9][0-9]|8[057][0-9]|9[679][0-9])"
RESERVED = r"^(?:0|10|127|22[4-9]|2[34][0-9]|25[0-5]|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."
CUES = [
    r"(?i)e-?mail|mailto|contact|write to|kontakt|correo|courriel|adresse",
    r"(?i)\bip\b|address|host|server|client|from|serveur|servidor|adresse",
    r"(?i)card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment",
    r"(?i)phone|tel\b|tel[.:]|call|mobile|fax|telefon|t[ée]l[ée]phone|tel[ée]fono|anruf|llam",
]
AGAINST = [r"(?i)example of|format|regex", r"(?i)version|release|\bv$|section|chapter", r"(?i)isbn|order|serial|hash|id[:=#]|token", r"(?i)isbn|page|date|order|version|ratio"]
BEFORE, AFTER = 40, 12

_SPAN = "start:int,stop:int,value:string,before:string,after:string"


def _joined(spans: Column) -> Column:
    """kind:start:end, by kind as listed, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["stop"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Does a number of at most 19 digits pass the Luhn check?"""
    padded = F.lpad(_digits(value), 19, "0")
    places = F.sequence(F.lit(1), F.lit(19))

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(padded, place, 1).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(place % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def with_candidates(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """All columns and `name`: an array of candidates (kind, start, stop, value, before, after, base)."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    plain = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    parts = []
    for key, (_, pattern, needs) in _PATTERNS.items():
        there = (plain.contains(needs) if needs else F.lit(True)) & plain.rlike(pattern)
        parts.append(F.when(there, F.split(plain, pattern, -1)).alias(f"{name}_{key}_rest"))
        parts.append(F.when(there, F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))).alias(f"{name}_{key}_found"))
    step = docs.select(*own, *parts)
    placed = []
    for key in _PATTERNS:
        rest, found = f"`{name}_{key}_rest`", f"`{name}_{key}_found`"
        start = f"s.pos + length(get({rest}, s.i))"
        placed.append(
            F.expr(
                f"aggregate({found}, cast(named_struct('pos', 0, 'i', 0, 'out', array()) as struct<pos:int,i:int,out:array<struct<{_SPAN}>>>),"
                f" (s, m) -> named_struct('pos', {start} + length(m), 'i', s.i + 1, 'out', concat(s.out, array(named_struct("
                f"'start', {start}, 'stop', {start} + length(m), 'value', m, 'before', right(get({rest}, s.i), {BEFORE}), 'after', left(get({rest}, s.i + 1), {AFTER})))))"
                f", s -> s.out)"
            ).alias(f"{name}_{key}")
        )
    step = step.select(*own, *placed)

    def group(key: str, base: Column | bool, keep) -> Column:
        spans = F.coalesce(F.col(f"`{name}_{key}`"), F.expr(f"cast(array() as array<struct<{_SPAN}>>)"))
        kind = F.lit(_PATTERNS[key][0])
        fields = lambda s: [s[x].alias(x) for x in ("start", "stop", "value", "before", "after")]
        is_base = (lambda s: base(s)) if callable(base) else (lambda s: F.lit(base))
        return F.transform(F.filter(spans, keep), lambda s: F.struct(kind.alias("kind"), *fields(s), is_base(s).alias("base")))

    every = lambda s: F.lit(True)
    long_card = lambda s: (F.length(_digits(s["value"])) >= 16) & _luhn(s["value"])
    phone_digits = lambda s: F.length(_digits(s["value"])).between(8, 15)
    strict = F.concat(group("email", True, every), group("ip", True, lambda s: s["value"].rlike(VALID_IP)), group("phone", True, phone_digits))
    loose = F.concat(group("loose_email", False, every), group("loose_ip", False, every), group("loose_phone", False, every))
    step = step.select(*own, strict.alias(f"{name}_strict"), group("card", long_card, every).alias(f"{name}_card"), loose.alias(f"{name}_loose"))
    base = F.concat(F.col(f"`{name}_strict`"), F.filter(F.col(f"`{name}_card`"), lambda s: s["base"]))
    more = F.concat(F.col(f"`{name}_loose`"), F.filter(F.col(f"`{name}_card`"), lambda s: ~s["base"]))
    step = step.select(*own, base.alias(f"{name}_base"), more.alias(f"{name}_more"))
    free = lambda s: ~F.exists(F.col(f"`{name}_base`"), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    return step.select(*own, F.concat(F.col(f"`{name}_base`"), F.filter(F.col(f"`{name}_more`"), free)).alias(name))


def _by_kind(c: Column, choices: list[Column]) -> Column:
    out = F.when(c["kind"] == 0, choices[0])
    for kind in (1, 2, 3):
        out = out.when(c["kind"] == kind, choices[kind])
    return out


def _vote(yes: Column) -> Column:
    return F.when(yes, F.lit(1)).otherwise(F.lit(-1))


def _looks(c: Column) -> dict[str, Column]:
    """What labelers and classifier look at, as true or false."""
    value, digits = c["value"], _digits(c["value"])
    is_v4 = value.rlike(VALID_IP)
    domain = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
    return {
        "listed": _by_kind(c, [domain.isin(DOMAINS.split()), is_v4 & ~value.rlike(RESERVED), digits.rlike(ISSUERS), value.rlike(COUNTRIES)]),
        "sound": _by_kind(
            c,
            [
                ~value.rlike(r"^[.]|[.]{2}|[.]@"),
                F.when(is_v4, ~value.rlike(r"(?:^|\.)0[0-9]")).otherwise(value.rlike("[A-Fa-f]") & value.rlike(r"::|(?::[0-9A-Fa-f]*){7}")),
                _luhn(value),
                F.length(digits).between(9, 13),
            ],
        ),
        "cued": _by_kind(c, [c["before"].rlike(x) for x in CUES]),
        "against": _by_kind(c, [c["before"].rlike(x) for x in AGAINST]),
        "apart": ~c["before"].rlike(r"[\p{L}\p{N}_/=#$\"'.-]$") & ~c["after"].rlike(r"^[\p{L}\p{N}_/=#@-]"),
        "base": c["base"],
    }


def votes(c: Column) -> list[Column]:
    """1, -1 or 0 of each labeler."""
    looks = _looks(c)
    bare = (c["kind"] == 3) & ~c["value"].startswith("+") | (c["kind"] == 1) & c["value"].contains(":")
    return [
        F.when(looks["base"], F.lit(1)).otherwise(F.lit(0)),
        F.when(bare, F.lit(0)).otherwise(_vote(looks["listed"])),
        _vote(looks["sound"]),
        F.when(looks["cued"], F.lit(1)).otherwise(F.lit(0)),
        F.when(looks["against"], F.lit(-1)).otherwise(F.lit(0)),
        _vote(looks["apart"]),
    ]


FEATURES = ["listed", "sound", "cued", "against", "apart", "separated", "long", "marked", "letters"]


def features(c: Column) -> list[Column]:
    """0 or 1 for each of FEATURES."""
    value = c["value"]
    looks = _looks(c) | {
        "separated": value.rlike(r"[ .()-]"),
        "long": F.length(value) > 15,
        "marked": value.rlike(r"^[+(]|@"),
        "letters": value.rlike("[A-Za-z]"),
    }
    return [looks[name].cast("int") for name in FEATURES]


@dataclass(frozen=True)
class Model:
    """Per kind: weights of the classifier (the first is the constant), and what EM found."""

    weights: dict[int, list[float]]
    reliability: dict[int, list[dict[tuple[int, int], float]]]


def expectation_maximisation(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[dict[tuple[int, ...], float], list[dict[tuple[int, int], float]]]:
    """Posterior of each vote pattern, and per labeler P(vote | truth); Dirichlet-smoothed. Starts from the mean vote."""
    n = len(next(iter(patterns)))
    post = {p: min(0.95, max(0.05, 0.5 + sum(p) / (2 * n))) for p in patterns}
    table: list[dict[tuple[int, int], float]] = []
    for _ in range(rounds):
        true = 1.0 + sum(c * post[p] for p, c in patterns.items())
        false = 1.0 + sum(c * (1 - post[p]) for p, c in patterns.items())
        table = []
        for j in range(n):
            count = defaultdict(lambda: 0.5)
            for p, c in patterns.items():
                count[p[j], 1] += c * post[p]
                count[p[j], 0] += c * (1 - post[p])
            table.append({(v, y): count[v, y] / (sum(count[u, y] for u in (-1, 0, 1))) for v in (-1, 0, 1) for y in (0, 1)})
        new = {}
        for p in patterns:
            odds = math.log(true) - math.log(false) + sum(math.log(table[j][p[j], 1] / table[j][p[j], 0]) for j in range(n))
            new[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        moved = max(abs(new[p] - post[p]) for p in patterns)
        post = new
        if moved < 1e-6:
            break
    return post, table


def logistic(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 300, rate: float = 1.0, keep: float = 1e-3) -> list[float]:
    """Weights from (features, weight, soft label) by gradient ascent on the mean log likelihood."""
    weights, total = [0.0] * (1 + len(FEATURES)), sum(w for _, w, _ in rows)
    for _ in range(rounds):
        slope = [-keep * w for w in weights]
        for x, count, label in rows:
            score = weights[0] + sum(w for w, f in zip(weights[1:], x, strict=True) if f)
            error = (label - 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))) * count / total
            slope[0] += error
            for k, f in enumerate(x):
                if f:
                    slope[k + 1] += error
        weights = [w + rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def fit(candidates: DataFrame, name: str) -> Model:
    """EM and classifier from a table with a candidate array; only counts of patterns come to the driver."""
    one = candidates.select(F.explode(F.col(f"`{name}`")).alias("c"))
    c = F.col("c")
    grouped = one.groupBy(c["kind"].alias("kind"), F.array(*votes(c)).alias("votes"), F.array(*features(c)).alias("features")).count()
    counts: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))
    for row in grouped.collect():
        counts[row["kind"]][tuple(row["votes"]), tuple(row["features"])] += row["count"]
    weights, reliability = {}, {}
    for kind, patterns in sorted(counts.items()):
        by_vote: dict[tuple[int, ...], int] = defaultdict(int)
        for (vote, _), n in patterns.items():
            by_vote[vote] += n
        post, reliability[kind] = expectation_maximisation(dict(sorted(by_vote.items())))
        weights[kind] = logistic([(x, n, post[vote]) for (vote, x), n in sorted(patterns.items())])
    return Model(weights, reliability)


def accepted(candidates: Column, model: Model) -> Column:
    """The base spans and the candidates that the classifier calls likelier than not."""

    def likely(c: Column) -> Column:
        of = features(c)
        scores = []
        for kind in range(len(KINDS)):
            w = model.weights.get(kind)
            scores.append(sum((F.lit(x) * f for x, f in zip(w[1:], of, strict=True)), F.lit(w[0])) if w else F.lit(-1.0))
        return c["base"] | (_by_kind(c, scores) > 0)

    return F.filter(candidates, likely)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every document."""
    found = cut(with_candidates(docs.select("doc_id", "text"), "spans").select("doc_id", "spans"))
    model = fit(found, "spans")
    base = F.filter("spans", lambda s: s["base"])

    def count(k: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(accepted(F.col("spans"), model)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets, and n_chars, if there, made to fit."""
    found = cut(with_candidates(docs.select("text"), "spans").select("spans"))
    model = fit(found, "spans")
    name = "_spans"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    own = [F.col(f"`{c}`") for c in docs.columns]
    marked = with_candidates(docs, name).select(*own, accepted(F.col(name), model).alias(name))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    ordered = F.sort_array(F.transform(F.col(name), lambda s: F.struct(s["start"], s["stop"], F.get(names, s["kind"]).alias("mark"))))
    marked = marked.select(*own, ordered.alias(name))
    text = F.col("text")

    def put(state: Column, span: Column) -> Column:
        between = F.substring(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        out = F.when(span["start"] >= state["at"], F.concat(state["out"], between, span["mark"])).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["stop"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(F.col(name), zero, put, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    done = F.when(F.size(name) > 0, whole).otherwise(text)
    columns = [done.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    out = marked.select(*columns)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.col("n_chars").isNotNull() & F.col("text").isNotNull()
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out
