"""Personal data by weak supervision, in DataFrame operations only.

Base patterns find e-mail and IP addresses, card and phone numbers. Wider patterns propose more
spans: phone numbers without a country code, obfuscated addresses, secrets after a telling word.
A base match that fails its test is proof of the contrary: it is never proposed, and where the
label model meets it, its chance is 0. Labelers (the strict pattern, gazetteers of domains, card issuers
and country codes, the words before, the characters around, the span's form) vote on every
span, or abstain. Expectation-maximisation over the vote patterns estimates how often each
labeler is right, and so the chance that a span with given votes is personal data. A logistic
classifier is trained on those chances; spans outside the base ones that it accepts are added.

What is fitted is a table of counts by kind and vote pattern, at most 3 ** 5 rows for each kind
however many documents there are; every document is in the counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hetweave.llm.common import cut

#: Kinds in order, base patterns first.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
# The patterns of the contract, made linear: a run that fails at its first character fails at all
# others, so a match starts where a run does or where the last match ended; what nothing follows
# is possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z.-])",
    "secret": r"(?<=(?:token|secret|passwd|password|api_key|apikey)[ ]?[=:][ ]?[\"']?)[A-Za-z0-9_+/-]{16,}+",
}
_NEEDS = {"email": "@", "phone": "+"}
_WIDE_NEEDS = {"email": r"[\[(]at[\])]", "phone": r"[0-9]{3}[ .-][0-9]{4}", "secret": r"(?:token|secret|passw(?:or)?d|api_?key)[ ]?[=:]"}
#: Gazetteers: fixed values.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "it", "uk", "eu", "us", "ch", "at", "nl", "be", "info")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6[05]|35)"
COUNTRIES = r"^\+?(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = {
    "email": r"(?i)(?:mail|contact|write to|address)\W{0,3}\w{0,12}\W{0,3}$",
    "ip": r"(?i)(?:\bip\b|host|server|address)\W{0,3}\w{0,12}\W{0,3}$",
    "card": r"(?i)(?:card|visa|credit|account)\W{0,3}\w{0,12}\W{0,3}$",
    "phone": r"(?i)(?:call|phone|tel|fax|mobile|reach)\W{0,3}\w{0,12}\W{0,3}$",
    "secret": r"(?i)(?:token|secret|passwo?r?d|api_?key)\s?[=:]\s?[\"']?$",
}
VOTES = ("strict", "gazetteer", "context", "around", "form")
_SPAN = "struct<start:int,end:int,value:string,before:string,around:string>"
_PLACE = "struct<k:int,start:int,end:int>"
#: Code points of text before a span that labelers look at.
BEFORE = 24


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """A fold over an array that writes as it goes: step gives the next state and an array of output.

    Growing one array item by item would copy it each time. So blocks of about the square root
    of the items write arrays of their own, which are put together at the end.
    """
    empty = F.array().cast(f"array<{out}>")

    def one(a: Column, x: Column) -> Column:
        state, more = step(a["state"], x)
        return F.struct(state.alias("state"), F.concat(a["out"], more).alias("out"))

    def block(done: Column, xs: Column) -> Column:
        return F.concat(done, F.array(F.aggregate(xs, F.struct(F.element_at(done, -1)["state"].alias("state"), empty.alias("out")), one)))

    def whole(xs: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(16))
        blocks = _let(size, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / n).cast("int")), lambda k: F.slice(xs, k * n + 1, n)))
        done = F.aggregate(blocks, F.array(F.struct(start.alias("state"), empty.alias("out"))), block)
        return F.flatten(F.transform(done, lambda d: d["out"]))

    return _let(items, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(empty))


def spans_of(text: Column, pattern: str, gate: Column) -> Column:
    """Leftmost non-overlapping matches with code-point places and their surroundings.

    Matches and the gaps between them add up to the text, so the places are running sums and the
    text is cut only once. before is what stands in the text just ahead of a match, around the
    characters next to it on both sides.
    """

    def pieces(found: Column, gaps: Column) -> Column:
        after = lambda i: F.when(F.get(gaps, i + 1) != "", F.substring(F.get(gaps, i + 1), 1, 1)).otherwise(F.substring(F.coalesce(F.get(found, i + 1), F.lit("")), 1, 1))
        return F.transform(found, lambda v, i: F.struct(F.get(gaps, i).alias("gap"), v.alias("value"), after(i).alias("after")))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        last = lambda c: F.substring(c, -BEFORE, BEFORE)
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        before = last(F.concat(state["tail"], last(x["gap"])))
        tail = last(F.concat(before, last(x["value"])))
        around = F.concat(F.substring(before, -1, 1), x["after"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"), before.alias("before"), around.alias("around"))
        return F.struct(end.alias("at"), tail.alias("tail")), F.array(span)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
    items = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: _let(F.split(text, pattern, -1), lambda gaps: pieces(found, gaps)))
    return F.when(gate, scan(items, start, step, _SPAN)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """What a base match must pass beyond its pattern; secrets have no such test."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(kind == "email")


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(F.lit(True) if no is None else no, -1).otherwise(0).cast("tinyint")


def _votes(kind: str, value: Column, ok: Column, before: Column, around: Column) -> list[Column]:
    digits = _digits(value)
    if kind == "email":
        last = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
        gazetteer, form = _vote(last.isin(*DOMAINS)), _vote(value.rlike(r"^[A-Za-z0-9].*[A-Za-z0-9]$"))
    elif kind == "ip":
        first = F.regexp_extract(value, r"^0*([0-9]{1,3})\.", 1).try_cast("int")
        gazetteer, form = _vote(first.between(1, 223)), _vote(value.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"))
    elif kind == "card":
        gazetteer, form = _vote(digits.rlike(ISSUERS)), _vote(value.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})$"))
    elif kind == "phone":
        gazetteer, form = _vote(value.startswith("+") & digits.rlike(COUNTRIES), value.startswith("+")), _vote(value.rlike(r"[() .-]"))
    else:
        gazetteer, form = F.lit(0).cast("tinyint"), _vote(value.rlike("[0-9]") & value.rlike("[A-Za-z]"))
    strict = F.when(ok, 1).when(F.lit(kind in ("card", "ip")), -1).otherwise(0).cast("tinyint")
    return [strict, gazetteer, _vote(before.rlike(CUES[kind]), F.lit(False)), _vote(~around.rlike("[A-Za-z0-9]")), form]


def find_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) of each row, a span being (k, start, end, base, proposed, votes); k indexes KINDS.

    Places count code points, ends excluded. base marks matches of the base patterns that pass
    their test, proposed those of the wider patterns; what is neither has failed a test and only
    shows the label model how the other labelers vote on such spans. A null text is empty.
    """
    t = F.col("t")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    has_digit = t.rlike("[0-9]")
    gates = {"email": t.contains("@"), "ip": has_digit & t.rlike(r"[0-9]\.[0-9]"), "card": has_digit & t.rlike(r"[0-9][ -]?[0-9]"), "phone": t.contains("+") & has_digit}
    for kind in BASE:
        rows = rows.withColumn(f"b_{kind}", spans_of(t, PATTERNS[kind], gates[kind]))
    for kind, pattern in WIDE.items():
        rows = rows.withColumn(f"w_{kind}", spans_of(t, pattern, t.rlike(_WIDE_NEEDS[kind])))

    def judged(kind: str, column: str, is_base: bool) -> Column:
        def one(s: Column) -> Column:
            ok = valid(kind, s["value"]) if is_base else F.lit(False)
            votes = F.array(*_votes(kind, s["value"], ok, s["before"], s["around"]))
            return F.struct(F.lit(KINDS.index(kind)).alias("k"), s["start"].alias("start"), s["end"].alias("end"), ok.alias("base"), F.lit(not is_base).alias("proposed"), votes.alias("votes"))

        return F.transform(column, one)

    parts = [judged(kind, f"b_{kind}", True) for kind in BASE] + [judged(kind, f"w_{kind}", False) for kind in WIDE]
    return rows.select("doc_id", F.concat(*parts).alias("spans"))


def label_model(counts: dict[tuple[int, tuple[int, ...]], int], rounds: int = 50) -> dict[tuple[int, tuple[int, ...]], float]:
    """Expectation-maximisation: the chance of each (kind, votes) pattern to be personal data.

    A labeler has, for each kind, a rate of each vote in each class; rates start from labelers
    that are right eight times in ten and never reach 0 or 1. Ten imagined spans of each class
    and kind keep rare kinds near that start. A span that the strict labeler denies (a checksum
    that is wrong) is none, however the others vote, and so tells how often they err.
    """
    chance: dict[tuple[int, tuple[int, ...]], float] = {}
    for k in sorted({k for k, _ in counts}):
        rows = [(votes, n) for (kind, votes), n in sorted(counts.items()) if kind == k]
        width = len(rows[0][0])
        prior = {(j, c, v): 0.5 if v == 0 else 0.4 if (v > 0) == c else 0.1 for j in range(width) for c in (False, True) for v in (-1, 0, 1)}
        rate, share = dict(prior), 0.5
        for _ in range(rounds):
            now = {}
            for votes, _ in rows:
                yes = math.log(share) + sum(math.log(rate[j, True, v]) for j, v in enumerate(votes))
                no = math.log(1 - share) + sum(math.log(rate[j, False, v]) for j, v in enumerate(votes))
                now[votes] = 0.0 if votes[0] < 0 else 1 / (1 + math.exp(max(-60.0, min(60.0, no - yes))))
            mass = {c: sum(n * (now[votes] if c else 1 - now[votes]) for votes, n in rows) for c in (False, True)}
            share = (mass[True] + 10) / (mass[True] + mass[False] + 20)
            rate = {(j, c, v): (sum(n * (now[votes] if c else 1 - now[votes]) for votes, n in rows if votes[j] == v) + 10 * p) / (mass[c] + 10) for (j, c, v), p in prior.items()}
        chance |= {(k, votes): now[votes] for votes, _ in rows}
    return chance


def train_classifier(counts: dict[tuple[int, tuple[int, ...]], int], chance: dict[tuple[int, tuple[int, ...]], float], rounds: int = 400) -> dict[tuple, float]:
    """Logistic weights of (kind,) and (kind, labeler, vote), fitted to the chances as soft labels."""
    total = sum(counts.values()) or 1
    names = {key: [(key[0],), *((key[0], j, v) for j, v in enumerate(key[1]) if v)] for key in counts}
    weights = dict.fromkeys((n for ns in names.values() for n in ns), 0.0)
    squares = dict.fromkeys(weights, 1e-8)
    for _ in range(rounds):
        slope = {n: 1e-4 * w for n, w in weights.items()}
        for key, ns in names.items():
            p = 1 / (1 + math.exp(max(-60.0, min(60.0, -sum(weights[n] for n in ns)))))
            # kinds and patterns vary a lot in size; the root keeps rare ones in view
            off = (p - chance[key]) * math.sqrt(counts[key] / total)
            for n in ns:
                slope[n] += off
        for n, g in slope.items():
            squares[n] += g * g
            weights[n] -= 0.5 * g / math.sqrt(squares[n])
    return weights


def classifier_score(span: Column, weights: dict[tuple, float]) -> Column:
    """The classifier as an expression over a span struct."""
    z = F.lit(0.0)
    for k in sorted({n[0] for n in weights}):
        own = F.lit(weights.get((k,), 0.0))
        for n, w in sorted((n, w) for n, w in weights.items() if len(n) == 3 and n[0] == k):
            own = own + F.when(F.element_at(span["votes"], n[1] + 1) == n[2], F.lit(w)).otherwise(F.lit(0.0))
        z = z + F.when(span["k"] == k, own).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def _apart(base: Column, more: Column) -> Column:
    """Spans of more that meet no span of base and none of more that stays before them, from the left.

    One scan from the right knows the next base span, one from the left the ends behind it, so
    the work grows with the spans and not with their pairs.
    """
    kind = "struct<start:int,added:boolean,end:int,k:int>"
    mark = lambda added: lambda s: F.struct(s["start"].alias("start"), F.lit(added).alias("added"), s["end"].alias("end"), s["k"].alias("k"))
    every = F.array_sort(F.concat(F.transform(base, mark(False)), F.transform(more, mark(True))))

    def from_right(following: Column, x: Column) -> tuple[Column, Column]:
        stays = ~x["added"] | (x["end"] <= following)
        return F.when(x["added"], following).otherwise(x["start"]), F.when(stays, F.array(x)).otherwise(F.array().cast(f"array<{kind}>"))

    def from_left(behind: Column, x: Column) -> tuple[Column, Column]:
        stays = x["added"] & (x["start"] >= behind)
        place = F.array(F.struct(x["k"].alias("k"), x["start"].alias("start"), x["end"].alias("end")))
        return F.when(stays | ~x["added"], F.greatest(behind, x["end"])).otherwise(behind), F.when(stays, place).otherwise(F.array().cast(f"array<{_PLACE}>"))

    clear = scan(F.reverse(every), F.lit(2**31 - 1), from_right, kind)
    return F.when(F.size(more) > 0, scan(F.reverse(clear), F.lit(0), from_left, _PLACE)).otherwise(F.array().cast(f"array<{_PLACE}>"))


def find_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, spans, base) of each row: arrays of (k, start, end), sorted; k indexes KINDS.

    base has the spans of the base patterns, spans those and the ones added: from the left, the
    proposals with a score of at least `least` that overlap no base span and no span added
    before. Null and empty texts have none; repeated rows each keep their own. Kinds may overlap
    each other in base, as a phone number may hold a card number. Work grows in proportion to a
    text and, but for the putting together of arrays, to its matches.
    """
    found = cut(find_spans(docs, doc_id=doc_id, text=text))
    votes = found.select(F.explode("spans").alias("s")).groupBy("s.k", "s.votes").agg(F.count("*").alias("n"))
    counts = {(r.k, tuple(r.votes)): r.n for r in votes.collect()}  # at most 3 ** len(VOTES) rows a kind
    weights = train_classifier(counts, label_model(counts))
    place = lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("spans", lambda s: s["base"]), place))
    more = F.transform(F.filter("spans", lambda s: s["proposed"] & (classifier_score(s, weights) >= least)), place)
    both = F.struct(base.alias("base"), more.alias("more"))
    out = _let(both, lambda x: F.struct(F.array_sort(F.concat(x["base"], _apart(x["base"], x["more"]))).alias("spans"), x["base"].alias("base")))
    return found.select("doc_id", out.alias("out")).select("doc_id", "out.spans", "out.base")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
