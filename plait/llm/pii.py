"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose spans; labelers by format, shape, gazetteer and context vote on each or
abstain; expectation-maximisation over the counts of vote patterns estimates how far each
labeler can be trusted, and its posteriors train the final span classifier.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .common import unused

KINDS = ["email", "ip", "card", "phone"]

# Possessive forms of the patterns asked for: what follows a run can't begin inside it,
# so they match the same without giving anything back, and a run that failed once is not
# tried from its second character (unless a match has just ended there).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Other ways to write the same, never base spans.
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?[(\[]\x20?(?:at|AT)\x20?[)\]]\x20?[A-Za-z0-9-]++"
             r"(?:(?:\.|\x20?[(\[]\x20?(?:dot|DOT)\x20?[)\]]\x20?)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
# A text without a match of this holds no candidate of the kind.
HINT = {"email": r"@|(?:at|AT)\x20?[)\]]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]",
        "phone": r"\+[0-9]|[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-]"}

DOMAINS = "com org net edu gov mil int info biz io dev app co uk de fr es it nl be ch at pl se no dk fi pt us ca au jp cn in br ru"
CALLING = "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 351 352 353 358 380 420 421"
CUES = {
    "email": r"e-?mail|mail|contact|write to|courriel|correo|kontakt",
    "ip": r"\bip\b|address|host|server|login|from|adresse|direcci",
    "card": r"card|visa|master|amex|credit|payment|carte|karte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|cell|contact|anruf|appel|llam",
}
AGAINST = r"version|release|build|isbn|issn|serial|order|invoice|part no|chapter|section|figure"

VALID_IP = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|38|30|35|6011|64|65|62)"
PRIVATE = r"^(?:0|10|127|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|255)\."

VOTES = ["by_format", "by_shape", "by_list", "by_context"]
TRAITS = ["long", "left", "right"]
ABSTAIN = -1


def _digits() -> Column:
    return F.regexp_replace("match", "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right; for a few digits only."""
    def add(total: Column, i: Column) -> Column:
        one = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(one > 4, one * 2 - 9).otherwise(one * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(one)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _class(c: Column) -> Column:
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "edge").when(c.rlike(r"\p{L}"), "letter")
        .when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\s"), "space").otherwise("mark")
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(ABSTAIN)


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def candidates(rows: DataFrame) -> DataFrame:
    """Spans proposed in ``row, text``: place, votes and traits.

    ``start`` and ``end`` count code points. Splitting at a pattern gives what stands
    between its matches, so places are sums of lengths; they are summed by a window over
    the matches of one document, from lengths alone.
    """
    found = []
    for loose, patterns in enumerate([BASE, LOOSE]):
        for kind, pattern in patterns.items():
            hinted = rows.where(F.col("text").rlike(HINT[kind]))
            parts = F.arrays_zip(
                F.split("text", pattern, -1).alias("gap"),
                F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("match"),
            )
            found.append(
                hinted.select("row", F.posexplode(parts).alias("n", "part")).select(
                    "row", "n", F.lit(kind).alias("kind"), F.lit(bool(loose)).alias("loose"),
                    F.length("part.gap").cast("long").alias("gap"),
                    F.right("part.gap", F.lit(24)).alias("tail"),
                    F.left("part.gap", F.lit(1)).alias("head"),
                    F.col("part.match").alias("match"),
                )
            )
    parts = found[0]
    for more in found[1:]:
        parts = parts.union(more)
    own = Window.partitionBy("row", "kind", "loose").orderBy("n")
    width = F.length("match").cast("long")
    placed = parts.withColumns({
        "start": F.coalesce(
            F.sum(F.col("gap") + width).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ) + F.col("gap"),
        "after": F.lead("head").over(own),
    }).where("match IS NOT NULL")
    digits = F.length(_digits())
    valid = (
        F.when(F.col("loose"), False)
        .when(_is("ip"), F.col("match").rlike(VALID_IP))
        .when(_is("card"), F.when(digits.between(12, 19), _luhn(_digits())).otherwise(False))
        .when(_is("phone"), digits.between(9, 15))
        .otherwise(True)
    )
    worth = (
        F.when(_is("card"), digits.between(12, 19)).when(_is("phone"), digits.between(7, 15)).otherwise(True)
    )
    shape = (
        F.when(_is("email"), _vote(F.col("match").rlike(r"[A-Za-z]{2,24}$"), F.lit(True)))
        .when(_is("ip"), _vote(~F.col("match").rlike(r"(?:^|\.)0[0-9]"), F.lit(True)))
        .when(_is("card"), _vote(F.col("match").rlike(r"^(?:[0-9]+|(?:[0-9]{4}[\x20-])+[0-9]{1,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$"), F.lit(True)))
        .otherwise(_vote(F.col("match").rlike(r"^[+(]"), F.col("match").rlike(r"\.[0-9]+\.")))
    )
    listed = (
        F.when(_is("email"), _vote(F.lower(F.regexp_extract("match", r"([A-Za-z]+)$", 1)).isin(DOMAINS.split()), F.lit(False)))
        .when(_is("ip"), _vote(F.lit(False), F.col("match").rlike(PRIVATE)))
        .when(_is("card"), _vote(_digits().rlike(ISSUER), F.lit(True)))
        .otherwise(_vote(F.col("match").rlike(r"^\+(?:" + "|".join(CALLING.split()) + ")"), F.lit(False)))
    )
    before = F.lower("tail")
    cue = F.lit(False)
    for kind, pattern in CUES.items():
        cue = cue | (_is(kind) & before.rlike(pattern))
    proposed = placed.where(valid | worth).select(
        "row", "kind", "start", (F.col("start") + F.length("match")).alias("end"), valid.alias("base"),
        F.when(F.col("loose"), ABSTAIN).otherwise(_vote(valid, F.lit(True))).alias("by_format"), shape.alias("by_shape"), listed.alias("by_list"),
        _vote(cue, before.rlike(AGAINST)).alias("by_context"),
        F.least(F.length("match") / 4, F.lit(12)).cast("int").cast("string").alias("long"),
        _class(F.right("tail", F.lit(1))).alias("left"), _class(F.col("after")).alias("right"),
    )
    # Of other spans only those that touch no base span.
    own = Window.partitionBy("row").orderBy("start", "end", F.desc("base"))
    upto = F.max(F.when(F.col("base"), F.col("end"))).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    next_ = F.min(F.when(F.col("base"), F.col("start"))).over(own.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    touches = (F.coalesce(upto, F.lit(-1)) > F.col("start")) | (F.coalesce(next_, F.col("end")) < F.col("end"))
    return proposed.withColumn("touches", touches).where(F.col("base") | ~F.col("touches")).drop("touches")


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = 60):
    """Posterior of each vote pattern that a span is personal, and each labeler's odds.

    Expectation-maximisation for labelers that err on their own: a prior and, for each
    labeler, the chances of its votes given the truth; who abstains says nothing. It
    starts from the share of positive votes, so the two classes keep their meaning.
    """
    total = sum(n for _, n in counts)
    post = []
    for votes, _ in counts:
        cast = [v for v in votes if v != ABSTAIN]
        post.append((sum(cast) + 0.5) / (len(cast) + 1))
    odds: list[dict[int, tuple[float, float]]] = []
    for _ in range(rounds):
        yes = sum(p * n for p, (_, n) in zip(post, counts))
        prior = (yes + 1) / (total + 2)
        odds = []
        for j in range(len(VOTES)):
            # Labelers are better than chance until counts say otherwise.
            seen = {1: [2.0, 1.0], 0: [1.0, 2.0]}
            for p, (votes, n) in zip(post, counts):
                if votes[j] != ABSTAIN:
                    seen[votes[j]][0] += p * n
                    seen[votes[j]][1] += (1 - p) * n
            sums = [sum(s[k] for s in seen.values()) for k in (0, 1)]
            odds.append({v: (s[0] / sums[0], s[1] / sums[1]) for v, s in seen.items()})
        post = []
        for votes, _ in counts:
            a, b = math.log(prior), math.log(1 - prior)
            for j, v in enumerate(votes):
                if v != ABSTAIN:
                    a, b = a + math.log(odds[j][v][0]), b + math.log(odds[j][v][1])
            post.append(1 / (1 + math.exp(min(700, b - a))))
    return post, odds


def train(spans: DataFrame) -> dict[str, float]:
    """Weights of the span classifier by ``kind|trait|value``; ``kind`` alone is its bias.

    Spark counts spans by kind, votes and traits: some thousand rows at most, whatever
    the table holds. Each pattern's posterior is its soft label, and a naive Bayes
    classifier over votes and traits is fitted to them, one for each kind.
    """
    counted = spans.groupBy("kind", *VOTES, *TRAITS).count().collect()
    weights: dict[str, float] = {}
    for kind in KINDS:
        rows = [r for r in counted if r.kind == kind]
        patterns: dict[tuple, int] = defaultdict(int)
        for r in rows:
            patterns[tuple(r[v] for v in VOTES)] += r["count"]
        keys = sorted(patterns)
        post = dict(zip(keys, reliabilities([(k, patterns[k]) for k in keys])[0])) if keys else {}
        mass = {c: [1.0, 1.0] for c in [None]}
        seen: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.5, 0.5])
        for r in rows:
            p = post[tuple(r[v] for v in VOTES)]
            for k, share in enumerate((p, 1 - p)):
                mass[None][k] += share * r["count"]
                for f in [*VOTES, *TRAITS]:
                    seen[f, str(r[f])][k] += share * r["count"]
        yes, no = mass[None]
        weights[kind] = math.log(yes / no)
        for (f, value), (a, b) in seen.items():
            weights[f"{kind}|{f}|{value}"] = math.log(a / yes) - math.log(b / no)
    return weights


def _chance(weights: dict[str, float]) -> Column:
    table = F.create_map(*[x for k, w in sorted(weights.items()) for x in (F.lit(k), F.lit(w))])
    total = table[F.col("kind")]
    for f in [*VOTES, *TRAITS]:
        key = F.concat_ws("|", "kind", F.lit(f), F.col(f).cast("string"))
        total = total + F.coalesce(F.try_element_at(table, key), F.lit(0.0))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), total))))


def spans_of(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """``row, kind, start, end, base``: base spans, and others that the classifier gives a
    chance of ``least``."""
    proposed = written(candidates(rows), "spans")
    taken = F.col("base") | (_chance(train(proposed)) >= least)
    return proposed.where(taken).select("row", "kind", "start", "end", "base").distinct()


def _order() -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row.

    Counts and digest are of the base spans, ``kind:start:end`` in the order of start,
    then kind; ``spans`` lists all spans likewise. A null text is empty; a row without
    spans has zeros, the digest of nothing and an empty list; repeated rows and null ids
    are answered one by one. ``docs`` has to be read the same way twice, as files are.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    one = F.struct("start", _order().alias("turn"), "end", "kind")
    own = spans_of(rows.select("row", "text")).groupBy("row").agg(
        *[F.count_if(F.col("base") & _is(k)).alias(f"n_{k}") for k in KINDS],
        _joined(F.collect_list(F.when(F.col("base"), one))).alias("base_spans"),
        _joined(F.collect_list(one)).alias("spans"),
    )
    joined = rows.select("row", "doc_id").join(own, "row", "left")
    return joined.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


# Code points in a piece of a text that is cut at many places.
PIECE = 4096


def _cut(pieces: Column, begin: Column, end: Column) -> Column:
    """The code points from ``begin`` to before ``end`` of a text given in pieces."""
    size = F.lit(PIECE)
    i, j = F.floor(begin / size).cast("int"), F.floor((end - 1) / size).cast("int")
    front, back = begin % size, (end - 1) % size + 1
    within = F.substring(F.get(pieces, i), front + 1, end - begin)
    whole = F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    across = F.concat(F.substring(F.get(pieces, i), front + 1, size), whole, F.substring(F.get(pieces, j), F.lit(1), back))
    return F.when(end <= begin, "").when(i == j, within).otherwise(across)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, all rows and columns.

    ``n_chars``, if there is such a column, follows the text. Texts without spans,
    empty and null texts stay as they are. Of spans that overlap, the first is replaced
    and what the later ones go beyond it is dropped.

    A text with spans is split once into pieces, and what stands between the spans is
    taken from these, so the work grows with the text and its spans, not their product.
    """
    row, text, list_, of = (unused(docs, n) for n in ("_row", "_new_text", "_spans", "_of"))
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    found = spans_of(placed.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text")))
    found = found.select("row", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "kind")
    earlier = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("at", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    one = F.struct("start", "end", "kind", "at")
    own = found.groupBy(F.col("row").alias(of)).agg(F.array_sort(F.collect_list(one)).alias(list_))
    source = F.col("text").cast("string")

    def build(pieces: Column) -> Column:
        def part(s: Column) -> Column:
            sign = F.when(s["end"] > s["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
            return F.concat(_cut(pieces, s["at"], s["start"]), sign)

        done = F.greatest(F.element_at(F.col(list_), -1)["at"], F.element_at(F.col(list_), -1)["end"])
        rest = _cut(pieces, done, F.length(source))
        return F.concat(F.array_join(F.transform(F.col(list_), part), ""), rest)

    # As a lambda's argument the pieces are made once for all spans of a text.
    pieces = F.regexp_extract_all(source, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    built = F.get(F.transform(F.array(pieces), build), F.lit(0))
    out = placed.join(own, F.col(row) == F.col(of), "left")
    out = out.withColumn(text, F.when(F.col(list_).isNotNull(), built).otherwise(F.col("text")))
    changed = {"text": F.col(text).alias("text")}
    if "n_chars" in docs.columns:
        size = F.when(F.col(list_).isNotNull(), F.length(text)).otherwise(F.col("n_chars"))
        changed["n_chars"] = size.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[changed.get(c, F.col(c)) for c in docs.columns])
