"""Personal data by weak supervision, with DataFrame functions only.

Base spans are matches of fixed patterns that pass their checks. Looser patterns
add candidates. Three labelers vote for, against or not at all on every span:
its form, gazetteers (domains, calling codes, card issuers) and the words
around it. Expectation-maximisation over the counts of vote patterns, a table of
at most a few hundred rows, estimates how reliable each labeler is and how
likely each pattern is right. A naive Bayes classifier over the spans' features
is trained on these likelihoods and decides about the candidates; base spans
stay whatever it says, and looser patterns are sought outside of them only.

Offsets are code points, ends exclusive. The patterns never scan a run of signs
twice, so very long texts cost in proportion. Null and empty texts have no
spans; repeated rows come out as often as they went in.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm.shared import settle

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: Base patterns. Each finds what its plain form in the comment finds leftmost
#: and without overlap; look-behinds and possessive loops only save steps.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 12 to 19 digits: a whole run or nothing
    CARD: r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms: an address in words, IPv6, an unprefixed number.
LOOSE = {
    EMAIL: r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[{<]at[)\]}>] ?[A-Za-z0-9-]{1,64}+(?: ?[(\[{<]dot[)\]}>] ?[A-Za-z0-9-]{1,64}+)++",
    IP: r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    PHONE: r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
#: What an address in words has at least.
_WORDED = r"(?i)[(\[{<]dot[)\]}>]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

#: Words that speak for a kind when they stand shortly before a span.
CUES = {
    EMAIL: "mail|contact|write|reach|send|address|reply|cc",
    IP: r"\bip\b|host|server|address|login|client|from|ping",
    CARD: "card|visa|master|amex|credit|debit|pay|cvv|account",
    PHONE: "phone|tel|call|mobile|cell|fax|dial|contact|number|reach",
}
#: And words that speak against any.
AGAINST = "version|release|build|isbn|order|serial|invoice|section|chapter|figure|page|issn|sku|hash|token|password|key"
#: Gazetteers as patterns over the value: common top-level domains, address
#: blocks in use, card issuers' first digits, calling codes.
LISTED = {
    EMAIL: r"(?i)(?:\.|dot[)\]}>] ?)(?:com|org|net|edu|gov|mil|int|info|biz|name|io|ai|app|dev|[a-z]{2})$",
    IP: r"^(?!0+\.|127\.|22[4-9]\.|2[3-5][0-9]\.).",
    CARD: r"^(?:4|5[1-5]|2[2-7]|3[47]|36|38|6011|65|35)",
    PHONE: r"^(?:\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
}
CONTEXT = 30

#: Elements that are summed up at once.
_BLOCK = 256


def _running(part: Column, start: Column) -> Column:
    """Running sums of an array of a few hundred elements at most: an array grown
    element by element is copied each time."""

    def step(state: Column, x: Column) -> Column:
        end = state["at"] + x
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(end)).alias("out"))

    return F.aggregate(part, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda state: state["out"])


def with_matches(df: DataFrame, sought: dict[str, tuple[Column, str, Column]]) -> DataFrame:
    """For each name and (text, pattern, hint) an array of (start, end, value,
    before, edge) of the pattern's matches, in code points, with the text before
    each, back to its second neighbour at most, and the character behind it; null
    where the hint is false. Each step is a column of its own, so that no lambda
    makes an array again for each element."""
    split = {f"{n}_b": F.when(hint, F.split(text, pattern, -1)) for n, (text, pattern, hint) in sought.items()}
    df = df.withColumns(split | {f"{n}_v": F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))) for n, (text, pattern, hint) in sought.items()})
    df = df.withColumns({f"{n}_s": F.zip_with(f"{n}_b", f"{n}_v", lambda b, v: F.char_length(b) + F.coalesce(F.char_length(v), F.lit(0))) for n in sought})

    def cut(n: str) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(f"{n}_s"), F.lit(_BLOCK)), lambda i: F.slice(f"{n}_s", i, F.lit(_BLOCK)))

    df = df.withColumns({f"{n}_k": F.when(F.col(f"{n}_s").isNotNull(), cut(n)) for n in sought})
    df = df.withColumns({f"{n}_t": F.transform(f"{n}_k", lambda x: F.aggregate(x, F.lit(0), lambda t, y: t + y)) for n in sought})
    # The last block's end begins no block.
    df = df.withColumns({f"{n}_t": F.concat(F.array(F.lit(0)), F.slice(_running(F.col(f"{n}_t"), F.lit(0)), F.lit(1), F.size(f"{n}_t") - 1)) for n in sought})
    df = df.withColumns({f"{n}_e": F.flatten(F.zip_with(f"{n}_k", f"{n}_t", _running)) for n in sought})
    blank = F.array(F.lit(""))

    def spans(n: str) -> Column:
        between, value = F.col(f"{n}_b"), F.col(f"{n}_v")
        # Whatever stands beside a match is put beside it here.
        both = F.arrays_zip(
            value.alias("value"), between.alias("between"), F.col(f"{n}_e").alias("end"), F.concat(blank, between).alias("between_0"),
            F.concat(blank, value).alias("value_0"), F.slice(between, 2, 1 << 30).alias("between_2"), F.slice(value, 2, 1 << 30).alias("value_2"),
        )

        def one(x: Column) -> Column:
            before = F.right(F.concat(F.right(x["between_0"], F.lit(CONTEXT)), x["value_0"], x["between"]), F.lit(CONTEXT))
            edge = F.left(F.concat(x["between_2"], F.coalesce(x["value_2"], F.lit(""))), F.lit(1))
            return F.struct((x["end"] - F.char_length(x["value"])).alias("start"), x["end"].alias("end"), x["value"].alias("value"), before.alias("before"), edge.alias("edge"))

        return F.transform(F.filter(both, lambda x: x["value"].isNotNull()), one)

    df = df.withColumns({n: spans(n) for n in sought})
    return df.drop(*(f"{n}_{part}" for n in sought for part in "bvskte"))


def _blanked(text: Column, pattern: str, kind: int) -> Column:
    """The text with as many blanks in the place of each valid match."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda b, v: F.concat(b, F.when(v.isNull(), "").when(_valid(kind, v), F.repeat(F.lit("\0"), F.char_length(v))).otherwise(v)))
    return F.array_join(pieces, "")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    backwards = F.reverse(_digits(value))
    places = F.sequence(F.lit(1), F.char_length(backwards))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(backwards, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(digit > 9, digit - 9).otherwise(digit)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: int, value: Column) -> Column:
    if kind == IP:
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == CARD:
        return _luhn(value)
    if kind == PHONE:
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _described(spans: Column, kind: int, base: Callable[[Column], Column]) -> Column:
    """The spans with the labelers' votes and the classifier's features."""

    def one(s: Column) -> Column:
        value = s["value"]
        before = F.lower(s["before"])
        against = before.rlike(rf"(?:{AGAINST})[^.!?\n]{{0,12}}$")
        is_base = base(value)
        cue = before.rlike(CUES[kind])
        listed = value.rlike(LISTED[kind])
        length = F.least(F.floor(F.char_length(value) / 6), F.lit(6)).cast("string")
        marks = F.when(value.rlike("[()]"), "brackets").when(value.rlike("[ -]"), "spaced").otherwise("plain")
        return F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), is_base.alias("base"),
            _vote(is_base, ~is_base & (F.lit(kind == CARD) | s["edge"].rlike("[A-Za-z0-9]"))).alias("form"), _vote(listed, ~listed).alias("listed"), _vote(cue, against).alias("context"),
            F.concat_ws(",", F.concat(F.lit("length="), length), F.concat(F.lit("marks="), marks), F.concat(F.lit("base="), is_base.cast("string")), F.concat(F.lit("listed="), listed.cast("string")), F.concat(F.lit("cue="), cue.cast("string")), F.concat(F.lit("against="), against.cast("string"))).alias("features"),
        )

    return F.transform(spans, one)


def find_spans(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, span): all spans with votes and features, and for every
    document row one row whose span is null."""
    source = documents.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    body = F.col("body")
    number = body.rlike("[0-9]")
    hints = {EMAIL: body.contains("@"), IP: number, CARD: number, PHONE: body.contains("+")}
    source = with_matches(source, {f"base_{kind}": (body, BASE[kind], hint) for kind, hint in hints.items()})
    # Looser forms are sought outside base spans only.
    source = source.withColumn("free", F.when(number | body.rlike(_WORDED), body))
    for kind, hint in hints.items():
        source = source.withColumn("free", F.when(hint, _blanked(F.col("free"), BASE[kind], kind)).otherwise(F.col("free")))
    hints = {EMAIL: body.rlike(_WORDED), IP: body.contains(":") & number, PHONE: number}
    source = with_matches(source, {f"loose_{kind}": (F.col("free"), LOOSE[kind], hint) for kind, hint in hints.items()})

    def valid(kind: int) -> Column:
        return F.filter(f"base_{kind}", lambda s: _valid(kind, s["value"]))

    parts = [_described(valid(kind), kind, lambda value: F.lit(True)) for kind in (EMAIL, IP, PHONE)]
    # Runs of digits that fail the check sum stay as candidates.
    parts.append(_described(F.col(f"base_{CARD}"), CARD, lambda value: _valid(CARD, value)))
    parts += [_described(F.col(f"loose_{kind}"), kind, lambda value: F.lit(False)) for kind in hints]
    spans = F.concat(*(F.coalesce(p, F.array()) for p in parts))
    return source.select(F.col("key").alias(key), "text_hash", F.explode(F.concat(F.array(F.lit(None)), spans)).alias("span"))


def estimate(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 30) -> dict[tuple[int, tuple[int, ...]], float]:
    """Expectation-maximisation over (kind, votes, count): the likelihood that a
    span with these votes is right, given labelers that err independently."""
    if not patterns:
        return {}
    kinds, labelers = sorted({k for k, _, _ in patterns}), range(len(patterns[0][1]))
    right = {(k, v): 1 / (1 + exp(-1.5 * sum(v))) for k, v, _ in patterns}
    for _ in range(rounds):
        prior = {k: (1 + sum(n * right[x, v] for x, v, n in patterns if x == k)) / (2 + sum(n for x, _, n in patterns if x == k)) for k in kinds}
        rates = {}
        for j in labelers:
            for truth in (True, False):
                # Smoothed towards labelers that are right more often than not.
                counts = {vote: 2.0 if vote == (1 if truth else -1) else 1.0 for vote in (-1, 0, 1)}
                for k, v, n in patterns:
                    counts[v[j]] += n * (right[k, v] if truth else 1 - right[k, v])
                total = sum(counts.values())
                rates |= {(j, truth, vote): c / total for vote, c in counts.items()}
        for k, v, _ in patterns:
            odds = log(prior[k] / (1 - prior[k])) + sum(log(rates[j, True, v[j]] / rates[j, False, v[j]]) for j in labelers)
            right[k, v] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
    return right


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    if not table:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in sorted(table.items()) for x in pair)), key), F.lit(default))


def decide(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text_hash, kind, start, end, base, likely): ``spans`` with the trained
    classifier's likelihood; rows of documents keep a null kind."""
    own = spans.where("span IS NOT NULL").select("span.*")
    name = F.concat_ws(":", "kind", "form", "listed", "context")
    # As many rows as vote patterns: 4 kinds, 27 patterns each at most.
    counted = [(r.kind, (r.form, r.listed, r.context), r["count"]) for r in own.groupBy("kind", "form", "listed", "context").count().collect()]
    right = {":".join(map(str, (k, *v))): p for (k, v), p in estimate(counted).items()}
    trained = own.withColumn("right", _lookup(right, name, 0.5)).select("right", F.explode(F.transform(F.split("features", ","), lambda f: F.concat_ws("|", F.col("kind"), f))).alias("feature"))
    sums = trained.groupBy("feature").agg(F.sum("right").alias("yes"), F.sum(1 - F.col("right")).alias("no")).collect()
    totals: dict[str, list[float]] = {}
    for r in sums:
        field = r.feature.split("=")[0]
        both = totals.setdefault(field, [0.0, 0.0])
        both[0] += r.yes
        both[1] += r.no
    weights, priors = {}, {}
    for r in sums:
        field = r.feature.split("=")[0]
        yes, no = totals[field]
        weights[r.feature] = log((r.yes + 1) / (yes + 2)) - log((r.no + 1) / (no + 2))
        priors[field.split("|")[0]] = log((yes + 1) / (no + 1))
    span = F.col("span")
    score = F.aggregate(
        F.transform(F.split(span["features"], ","), lambda f: _lookup(weights, F.concat_ws("|", span["kind"], f), 0.0)),
        _lookup(priors, span["kind"].cast("string"), 0.0),
        lambda total, x: total + x,
    )
    return spans.select(key, "text_hash", "span.kind", "span.start", "span.end", "span.base", F.when(span.isNotNull(), 1 / (1 + F.exp(-score))).alias("likely"))


def collect_spans(decided: DataFrame, key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """(key, text_hash, base, spans): per document row its base spans and all its
    spans, as arrays of (start, kind, end) in order."""
    one = F.struct("start", "kind", "end")
    grouped = decided.groupBy(key, "text_hash").agg(
        F.sum(F.col("kind").isNull().cast("int")).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("base"), one))).alias("base"),
        F.collect_set(F.when(~F.col("base") & (F.col("likely") > least), one)).alias("more"),
    )
    return grouped.select(key, "text_hash", "base", F.array_sort(F.concat("base", "more")).alias("spans"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def written(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base spans and all spans of every document row."""
    return collect_spans(decide(settle(find_spans(documents, key, text), "spans"), key), key)
