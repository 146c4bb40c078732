"""Personal data by weak supervision.

Candidates are found by patterns. Labelers (strict pattern, gazetteer, context words,
surroundings) vote on each candidate: for, against or not at all. Candidates with equal
kind and votes are counted, which leaves a table whose size depends on the labelers alone,
and expectation-maximisation over it estimates each labeler's reliability and the
probability that a candidate is personal data. Those probabilities train the final span
classifier, a naive Bayes model over shape, votes and the word in front. Valid matches of
the base patterns are always personal data; other candidates are if the classifier says so
and they overlap no base span.

Only built-in functions touch the texts. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the base kinds, written so that no input makes them backtrack: a local part
# starts at the start of its run or where the last match ended, runs are possessive.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NATIONAL = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{12,}+(?![A-Za-z0-9])|(?i:password|passwd|api_key|secret|token)\x20{0,2}[=:]\x20{0,2}[\x22']?[A-Za-z0-9+/_-]{6,}+"
HONORIFICS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame"]
GIVEN_NAMES = ["Anna", "Carlos", "David", "Elena", "Emma", "Hans", "James", "Jean", "John", "Juan", "Lisa", "Maria", "Marie", "Michael", "Pierre", "Sarah", "Sofia", "Thomas"]
NAME = rf"(?<![\p{{L}}])(?:{'|'.join(HONORIFICS + GIVEN_NAMES)})\.?\x20\p{{Lu}}[\p{{L}}'-]{{1,}}+"

# In the order of equal starts.
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "number", "secret", "name"]

FOR_WORDS = {
    "email": ["email", "mail", "contact", "correo", "courriel"],
    "ip": ["ip", "address", "host", "adresse"],
    "card": ["card", "visa", "mastercard", "karte", "carte", "tarjeta"],
    "phone": ["phone", "tel", "call", "fax", "mobile", "telefon", "contact"],
    "number": ["ssn", "social", "security", "id", "passport"],
    "secret": ["key", "login", "credentials", "secret", "password"],
    "name": ["name", "dear", "by", "from", "nombre", "nom"],
}
AGAINST_WORDS = ["version", "section", "page", "chapter", "figure", "table", "isbn", "license", "nc", "no", "nr"]
CALLING_CODES = ["+1", "+33", "+34", "+44", "+49"]
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "de", "fr", "es", "info"]
CARD_ISSUERS = ["4", "51", "52", "53", "54", "55", "34", "37", "6011"]

LABELERS = ["strict", "gazetteer", "context", "surroundings"]
EM_ROUNDS = 30
CONTEXT_CHARS = 32
CONTEXT_CELLS = 256
THRESHOLD = 0.5


def _found(text: Column, pattern: str, kind: str, guard: Column) -> Column:
    """All matches in order: array of (kind, start, end, found, before).

    Splitting at the pattern gives the texts between the matches; running lengths of both
    are the positions.
    """
    shown = "array<struct<kind:string,start:int,end:int,found:string,before:string>>"
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, pieces, lambda m, p: F.struct(m.alias("m"), F.length(p).alias("skip"), F.right(p, F.lit(CONTEXT_CHARS)).alias("before")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(shown).alias("spans"))

    def step(held: Column, pair: Column) -> Column:
        start = held["at"] + pair["skip"]
        end = start + F.length(pair["m"])
        span = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["m"].alias("found"), pair["before"].alias("before")
        )
        return F.struct(end.alias("at"), F.array_append(held["spans"], span).alias("spans"))

    # the last piece has no match behind it
    whole = F.aggregate(F.filter(pairs, lambda p: p["m"].isNotNull()), none, step, lambda held: held["spans"])
    return F.when(guard, whole).otherwise(F.array().cast(shown))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of ten."""
    from_right = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substr(F.reverse(digits), i, F.lit(1)).cast("int"))
    doubled = F.transform(from_right, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _small_part(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (bare.try_cast("int") <= 255)


def _valid(span: Column) -> Column:
    """Whether a match of a base pattern passes its check."""
    digits = _digits(span["found"])
    ip = F.forall(F.split(span["found"], r"\.", -1), _small_part)
    card = F.length(digits).between(14, 19) & luhn(digits)
    return (
        F.when(span["kind"] == "email", True)
        .when(span["kind"] == "ip", ip)
        .when(span["kind"] == "card", card)
        .when(span["kind"] == "phone", span["found"].startswith("+") & F.length(digits).between(10, 15))
        .otherwise(False)
    )


def candidates(text: Column) -> Column:
    """All matches of all patterns, base ones first: array of (kind, start, end, found, before)."""
    has_digit = text.rlike("[0-9]")
    return F.concat(
        _found(text, EMAIL, "email", F.contains(text, F.lit("@"))),
        _found(text, IP, "ip", has_digit & text.rlike(IP)),
        _found(text, CARD, "card", has_digit & text.rlike(CARD)),
        _found(text, PHONE, "phone", F.contains(text, F.lit("+"))),
        _found(text, NATIONAL, "phone", has_digit & text.rlike(NATIONAL)),
        _found(text, NUMBER, "number", has_digit & text.rlike(NUMBER)),
        _found(text, SECRET, "secret", text.rlike(SECRET)),
        _found(text, NAME, "name", text.rlike(NAME)),
    )


def _overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (span["start"] < o["end"]) & (o["start"] < span["end"]))


def with_spans(docs: DataFrame, text: str, base: str, extra: str) -> DataFrame:
    """Add the valid base spans and the other candidates that overlap none of them, as arrays."""
    return (
        docs.withColumn("_all", candidates(F.coalesce(F.col(text).cast("string"), F.lit(""))))
        .withColumn(base, F.filter("_all", _valid))
        .withColumn(extra, F.filter("_all", lambda s: ~F.coalesce(_valid(s), F.lit(False)) & ~_overlaps(s, F.col(base))))
        .drop("_all")
    )


def votes(span: Column) -> Column:
    """One sign per labeler: + for, - against, 0 none."""
    kind, found, digits = span["kind"], span["found"], _digits(span["found"])
    words = F.regexp_extract_all(F.lower(span["before"]), F.lit(r"\p{L}+"), F.lit(0))

    def sign(yes: Column, no: Column) -> Column:
        return F.when(F.coalesce(no, F.lit(False)), "-").when(F.coalesce(yes, F.lit(False)), "+").otherwise("0")

    national = found.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]")
    number = found.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    strict = (
        F.when(_valid(span), "+")
        .when(kind.isin("email", "ip", "card"), "-")
        .when(kind == "phone", sign(national, ~national))
        .when(kind == "number", sign(number, ~number))
        .when(kind == "secret", sign(found.rlike(r"^AKIA[0-9A-Z]{16}$") | found.rlike(r"[0-9]"), F.lit(False)))
        .otherwise(sign(found.rlike(rf"^(?:{'|'.join(HONORIFICS)})\.?\x20"), F.lit(False)))
    )
    listed = (
        F.when(kind == "email", F.regexp_extract(F.lower(found), r"\.([a-z]+)$", 1).isin(TOP_DOMAINS))
        .when(kind == "ip", ~found.rlike(r"^(?:0|127|255)\."))
        .when(kind == "card", found.rlike(rf"^(?:{'|'.join(CARD_ISSUERS)})"))
        .when(kind == "phone", found.rlike(rf"^(?:{'|'.join(c.replace('+', '[+]') for c in CALLING_CODES)})[^0-9]"))
        .when(kind == "secret", found.rlike(r"^(?:AKIA|(?i:password|api_key))"))
        .when(kind == "name", found.rlike(rf"^(?:{'|'.join(GIVEN_NAMES)})\x20"))
        .otherwise(False)
    )
    context = F.lit(False)
    for k, names in FOR_WORDS.items():
        context = context | ((kind == k) & F.arrays_overlap(words, F.array(*[F.lit(n) for n in names])))
    against = F.arrays_overlap(words, F.array(*[F.lit(n) for n in AGAINST_WORDS]))
    joined = span["before"].rlike(r"[\p{L}0-9_=/.#-]$") | ((kind != "secret") & (F.length(digits) > 19))
    return F.concat(strict, sign(listed, F.lit(False)), sign(context, against), sign(F.lit(False), joined))


def estimate(counts: Mapping[tuple[str, str], int], rounds: int = EM_ROUNDS) -> dict[tuple[str, str], float]:
    """Expectation-maximisation over (kind, votes) -> count; the probability of each that it is personal data.

    Labelers vote independently given the truth, each with its own chances of every vote;
    chances start from the majority and are smoothed by one vote of each sort.
    """
    chance = {}
    for kind, signs in counts:
        lead = signs.count("+") - signs.count("-")
        chance[kind, signs] = 1 / (1 + math.exp(-1.5 * lead))
    for _ in range(rounds):
        seen = [defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)]
        share = defaultdict(lambda: [1.0, 1.0])
        for (kind, signs), n in counts.items():
            for true, p in ((1, chance[kind, signs]), (0, 1 - chance[kind, signs])):
                share[kind][true] += n * p
                for labeler, sign in enumerate(signs):
                    seen[true][kind, labeler, sign] += n * p
        for kind, signs in counts:
            odds = math.log(share[kind][1] / share[kind][0])
            for labeler, sign in enumerate(signs):
                rate = [seen[t][kind, labeler, sign] / sum(seen[t][kind, labeler, s] for s in "+-0") for t in (0, 1)]
                odds += math.log(rate[1] / rate[0])
            chance[kind, signs] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return chance


@dataclass(frozen=True)
class SpanModel:
    """Log-odds of the span classifier: per feature (a bounded number of them) and in all."""

    prior: float
    weights: Mapping[str, float]


def _features(span: Column) -> Column:
    """At most KINDS x (CONTEXT_CELLS + 64 + 3 LABELERS) different features."""
    word = F.regexp_extract(F.lower(span["before"]), r"(\p{L}+)[^\p{L}]*$", 1)
    signs = votes(span)
    return F.concat(
        F.array(
            F.concat(span["kind"], F.lit(":digits:"), F.least(F.length(_digits(span["found"])), F.lit(63)).cast("string")),
            F.concat(span["kind"], F.lit(":word:"), F.pmod(F.xxhash64(word), F.lit(CONTEXT_CELLS)).cast("string")),
        ),
        F.array(*[F.concat(span["kind"], F.lit(f":{name}:"), F.substr(signs, F.lit(i + 1), F.lit(1))) for i, name in enumerate(LABELERS)]),
    )


def train(docs: DataFrame) -> SpanModel:
    """Estimate labeler reliabilities over all candidates of ``docs`` and train the classifier on them.

    What comes to the driver are counts per vote pattern and per feature, both bounded. A
    table without candidates gives a model that accepts nothing.
    """
    spans = with_spans(docs.select("text"), "text", "base", "extra").select(F.explode(F.concat("base", "extra")).alias("span"))
    voted = spans.select(F.col("span")["kind"].alias("kind"), votes(F.col("span")).alias("votes"), _features(F.col("span")).alias("features"))
    # One pass: every feature counted per vote pattern, and the pattern itself as the empty feature.
    rows = (
        voted.select("kind", "votes", F.explode(F.concat(F.array(F.lit("")), "features")).alias("feature"))
        .groupBy("kind", "votes", "feature")
        .count()
        .collect()
    )
    chance = estimate({(r.kind, r.votes): r["count"] for r in rows if not r.feature})
    mass = defaultdict(lambda: [0.5, 0.5])
    total = [1.0, 1.0]
    for r in rows:
        p = chance[r.kind, r.votes]
        held = mass[r.feature] if r.feature else total
        held[1] += p * r["count"]
        held[0] += (1 - p) * r["count"]
    if len(rows) == 0:
        return SpanModel(-math.inf, {})
    prior = math.log(total[1] / total[0])
    weights = {f: math.log((m[1] / total[1]) / (m[0] / total[0])) for f, m in mass.items()}
    return SpanModel(prior, weights)


def classified(docs: DataFrame, model: SpanModel, text: str = "text", spans: str = "spans", base: str = "base") -> DataFrame:
    """Add ``base`` (valid base spans) and ``spans`` (these and the accepted others), by start, then kind."""
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])

    def sorted_spans(found: Column) -> Column:
        keyed = F.transform(found, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
        return F.array_sort(keyed)

    held = with_spans(docs, text, "_base", "_extra")
    if model.weights:
        table = F.from_json(F.lit(json.dumps(dict(model.weights))), "map<string,double>")

        def accepted(s: Column) -> Column:
            score = F.aggregate(_features(s), F.lit(model.prior), lambda a, f: a + F.coalesce(table[f], F.lit(0.0)))
            return score > math.log(THRESHOLD / (1 - THRESHOLD))

        more = F.filter("_extra", accepted)
    else:
        more = F.filter("_extra", lambda s: F.lit(False))
    return held.withColumn(base, sorted_spans(F.col("_base"))).withColumn(spans, sorted_spans(F.concat("_base", more))).drop("_base", "_extra")


def _written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_table(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base_sha256 and all spans.

    A null or empty text has no spans. Every row is judged by its own text, so null and
    repeated doc_ids change nothing. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    found = classified(docs, train(docs))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans")
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; columns stay, nulls stay.

    Overlapping spans are replaced together, under the kind of the first. ``n_chars``, where
    there is such a column, follows the text.
    """
    names = docs.columns
    place = {n: f"pii_{i}" for i, n in enumerate(names) if n != "text"}
    found = classified(docs.withColumnsRenamed(place), train(docs))
    text = F.col("text").cast("string")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(held: Column, s: Column) -> Column:
        fresh = s["start"] >= held["at"]
        gap = F.substr(text, held["at"] + 1, F.greatest(s["start"] - held["at"], F.lit(0)))
        done = F.when(fresh, F.concat(held["done"], gap, F.lit("<"), s["kind"], F.lit(">"))).otherwise(held["done"])
        return F.struct(F.greatest(held["at"], s["end"]).alias("at"), done.alias("done"))

    clean = F.aggregate("spans", start, step, lambda held: F.concat(held["done"], F.substr(text, held["at"] + 1, F.length(text))))
    found = found.withColumn("pii_text", F.when(F.size("spans") > 0, clean).otherwise(text))
    out = []
    for name in names:
        if name == "text":
            out.append(F.when(F.col("text").isNotNull(), F.col("pii_text")).alias(name))
        elif name == "n_chars":
            own = F.when(F.size("spans") > 0, F.length("pii_text")).otherwise(F.col(place[name]))
            out.append(own.cast(docs.schema[name].dataType).alias(name))
        else:
            out.append(F.col(place[name]).alias(name))
    return found.select(*out)
