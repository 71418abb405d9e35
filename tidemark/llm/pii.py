"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. Generators with
high recall propose more spans, which may overlap: written-out addresses, numbers in other
groupings, long IP addresses. Trees, boosted on base spans in those spellings and on what the base
patterns or its form rule out, look at a candidate's format and context, and a threshold for each kind picks those to redact. All
work on a text is one projection of built-in functions; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import text_or_empty
from tidemark.llm.trees import Node, trees_of
from tidemark.operators.ordered import top_k_per_key
from tidemark.session import written

KINDS = ("email", "ip", "card", "phone")
# Possessive repeats and starts at the edge of a run keep matching linear in long texts; they find the same spans.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The generators: for each pattern, the kinds that its matches are proposed as.
GENERATORS = {
    rf"(?i)(?:\G|(?<!{_LOCAL})){_LOCAL}++ ?[\[({{] ?(?:at|@) ?[\])}}] ?{_LABEL}++(?: ?(?:\.|[\[({{] ?(?:dot|\.) ?[\])}}]) ?{_LABEL}++)++": ("email",),
    r"(?<![A-Za-z0-9+(])\(?[0-9](?:[\x20()./-]{0,2}[0-9])++": ("card", "phone"),
    r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){5,7}": ("ip",),
}
CONTEXT = {
    "phone": "phone|tel|call|fax|mobil|ruf|móvil|llam|appel", "card": "card|visa|master|credit|kart|carte|tarjeta|iban|konto", "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|addr|ping",
}
FEATURES = ("kind", "digits", "length", "groups", "longest_group", "marks", "paren", "luhn", "leading_zero", "letter_before", "letter_after", "own_context", "other_context")
#: Digits of a number that is proposed as a card or phone number.
DIGITS = {"card": (12, 19), "phone": (7, 15)}
#: Bound of the fit: different examples that the trees see at most; the thresholds follow from all.
SAMPLE_ROWS = 20_000
ROUNDS, DEPTH, SEED, PRECISION = 12, 3, 3, 0.95
#: Spellings of examples: the @ and the dots of an address, the marks between groups of digits.
WRITTEN_AT, WRITTEN_DOT, MARKS = (" (at) ", "(at)", " [at] ", "[at]", "{at}", " (@) "), (".", " (dot) ", "[dot]", " {dot} "), (" ", "-", ".", "/", "  ")
_DATE = r"^(?:[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2[0-9]{4})(?: [0-9]{1,2})?$"
_SPAN = "array<struct<start: int, `end`: int, s: string>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """A value computed once and used many times inside an expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _starts(lengths: Column, block: int = 64) -> Column:
    """Sums of the lengths before each place, in blocks, so that long arrays stay cheap."""
    n = F.size(lengths)
    last = F.ceil(n / block).cast("int") - 1

    def blocks(b: Column) -> Column:
        return F.slice(lengths, b * block + 1, F.lit(block))

    def inside(b: Column, before: Column) -> Column:
        return _let(blocks(b), lambda own: F.transform(own, lambda _, i: before + _sum(F.slice(own, F.lit(1), i))))

    sums = F.transform(F.sequence(F.lit(0), last), lambda b: _sum(blocks(b)))
    return _let(sums, lambda s: F.flatten(F.transform(s, lambda _, b: inside(b, _sum(F.slice(s, F.lit(1), b))))))


def spans(text: Column, pattern: str) -> Column:
    """The matches of a pattern with their places in code points, the end exclusive."""

    def placed(found: Column) -> Column:
        # a match starts after all pieces up to it and all matches before it
        def cut(pieces: Column) -> Column:
            lengths = F.transform(pieces, lambda p, i: F.char_length(p) + F.coalesce(F.char_length(F.get(found, i)), F.lit(0)))
            return _let(_let(lengths, lambda l: _starts(l)), lambda at: F.transform(found, lambda m, i: F.struct(
                (F.get(at, i) + F.char_length(F.get(pieces, i))).alias("start"), (F.get(at, i) + F.char_length(F.get(pieces, i)) + F.char_length(m)).alias("end"), m.alias("s"),
            )))

        return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), cut)).otherwise(F.from_json(F.lit("[]"), _SPAN))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed).cast(_SPAN)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def confirmed(kind: str, s: Column) -> Column:
    """Whether a base match is what its kind asks for."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    n = F.char_length(_digits(s))
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", _digits(s))
    return n.between(9, 15)


def _features(kind: Column, s: Column, before: Column, after: Column) -> list[Column]:
    groups = F.filter(F.split(s, "[^0-9]+"), lambda g: g != "")
    own = F.coalesce(*(F.when(kind == i, before.rlike(f"(?i)({CONTEXT[k]})")) for i, k in enumerate(KINDS)), F.lit(False))
    any_ = before.rlike("(?i)(" + "|".join(CONTEXT.values()) + ")")
    number = [
        kind, F.char_length(_digits(s)), F.char_length(s), F.size(groups), F.coalesce(F.array_max(F.transform(groups, F.char_length)), F.lit(0)),
        F.char_length(F.regexp_replace(s, "[0-9]", "")), s.contains("("), F.call_function("luhn_check", _digits(s)), _digits(s).startswith("0"), before.rlike(r"[\p{L}]$"),
        after.rlike(r"^[\p{L}0-9]"), own, any_ & ~own,
    ]
    return [F.coalesce(c.cast("double"), F.lit(0.0)) for c in number]


def _context(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    first = F.greatest(start - 24, F.lit(0))
    return F.substring(text, first + 1, start - first), F.substring(text, end + 1, F.lit(1))


def _as_kind(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["s"].alias("s")))


def _checked(text: Column, kind: int) -> Column:
    """The base matches of a kind that are confirmed."""
    return _as_kind(F.filter(spans(text, BASE[KINDS[kind]]), lambda m: confirmed(KINDS[kind], m["s"])), kind)


def _of_size(matches: Column, low: int, high: int) -> Column:
    return F.filter(matches, lambda m: F.char_length(_digits(m["s"])).between(low, high))


def base_spans(text: Column) -> Column:
    """Confirmed base spans of all kinds: array of (start, kind, end, s), kind as a number."""
    return F.concat(*(_checked(text, kind) for kind in range(len(KINDS))))


def candidate_spans(text: Column) -> Column:
    """What the generators propose: array of (start, kind, end, s); spans may overlap."""
    found = []
    for pattern, kinds in GENERATORS.items():
        for kind in kinds:
            matches = spans(text, pattern)
            if kind in DIGITS:
                matches = _of_size(matches, *DIGITS[kind])
            found.append(_as_kind(matches, KINDS.index(kind)))
    return F.concat(*found)


@dataclass(frozen=True)
class PiiModel:
    """Boosted trees with their weights, and the score from which a candidate of each kind is taken."""

    trees: tuple[Node, ...]
    weights: tuple[float, ...]
    thresholds: tuple[float, ...]

    def score(self, features: Column) -> Column:
        margin = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            margin = margin + F.lit(weight) * tree.column(lambda i: F.get(features, F.lit(i)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))

    def threshold(self, kind: Column) -> Column:
        return F.get(F.array(*(F.lit(t) for t in self.thresholds)), kind)


def _unmarked(kind: int, c: Column) -> Column:
    """The spellings that the generators look for, made from a confirmed base span ``c``: array of strings."""
    s = c["s"]
    if KINDS[kind] == "email":
        name, host = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
        return F.array(*(F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot))) for at in WRITTEN_AT for dot in WRITTEN_DOT))
    if KINDS[kind] == "ip":
        return _let(F.md5(F.concat_ws("/", s, c["start"].cast("string"))), lambda h: _let(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(h, i * 4 + 1, F.lit(4))), _long_addresses))
    if KINDS[kind] == "card":
        return F.array(s, *(F.regexp_replace(_digits(s), "([0-9]{4})(?=[0-9])", f"$1{mark}") for mark in ("", *MARKS)))
    short = F.regexp_replace(s, r"^\+[0-9]{1,3}[\x20.-]*", "")
    numbers = [F.substring(s, 2, 1 << 20), short, F.concat(F.lit("0"), F.regexp_replace(short, "^[^0-9]+", ""))]
    spelled_ = [n if mark is None else F.array_join(F.regexp_extract_all(n, F.lit("[0-9]+"), F.lit(0)), mark) for n in numbers for mark in (None, *MARKS)]
    return F.filter(F.array(*spelled_), lambda n: F.char_length(_digits(n)).between(*DIGITS["phone"]))


def _long_addresses(g: Column) -> Column:
    """Spellings of a long IP address with the eight groups of an array: whole, of digits, short groups, mostly zeros."""
    whole, zero = F.array_join(g, ":"), F.lit("0")

    def part(i: int, n: int = 4) -> Column:
        return F.substring(g[i], 1, n)

    short = F.concat_ws(":", part(0), part(1, 3), part(2, 2), zero, zero, part(5, 3), part(6, 1), part(7))
    return F.array(whole, F.translate(whole, "abcdef", "012345"), short, F.concat_ws(":", part(0), part(1, 3), zero, zero, zero, zero, zero, part(7, 1)))


def _impossible(c: Column, after: Column) -> Column:
    """Whether a candidate cannot be of its kind, whatever it means: its form alone tells."""
    s, groups = c["s"], F.size(F.split(c["s"], ":"))
    runs_on = after.rlike(r"^[\p{L}_]")
    return (
        F.when(c["kind"] == 0, ~s.rlike("(?i)(?:[a-z]{2,}|xn--[a-z0-9-]+)$"))
        .when(c["kind"] == 1, runs_on | (groups < 8) & (after != ":") | (groups == 8) & (after == ":"))
        .when(c["kind"] == 2, runs_on | ~F.call_function("luhn_check", _digits(s)))
        .otherwise(runs_on | s.rlike(_DATE) | s.rlike(r"^[0-9]+\.[0-9]+$"))
    )


def examples(text: Column) -> Column:
    """The labelled examples of a text: array of (start, end, s, kind, label)."""

    def labelled(matches: Column, kind: Callable[[Column], Column], label: float) -> Column:
        return F.transform(matches, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["s"].alias("s"), kind(c).alias("kind"), F.lit(label).alias("label")))

    def of(found: Column) -> Column:
        def sides(base: Column) -> Column:
            def away(matches: Column) -> Column:
                return F.filter(matches, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))

            right = [
                F.flatten(F.transform(F.filter(base, lambda c: c["kind"] == kind), lambda c: F.transform(_unmarked(kind, c), lambda s: F.struct(
                    c["start"].alias("start"), c["end"].alias("end"), s.alias("s"), c["kind"].alias("kind"), F.lit(1.0).alias("label"),
                ))))
                for kind in range(len(KINDS))
            ]
            other = labelled(F.filter(base, lambda c: c["kind"] > 1), lambda c: 5 - c["kind"], 0.0)
            rejected = away(F.filter(found, lambda c: ~c["ok"]))
            impossible = away(F.filter(candidate_spans(text), lambda c: _impossible(c, F.substring(text, c["end"] + 1, F.lit(1)))))
            return F.concat(*right, other, *(labelled(x, lambda c: c["kind"], 0.0) for x in (rejected, impossible)))

        return _let(F.filter(found, lambda c: c["ok"]), sides)

    def checked(kind: int) -> Column:
        return F.transform(spans(text, BASE[KINDS[kind]]), lambda m: F.struct(
            m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["s"].alias("s"), F.coalesce(confirmed(KINDS[kind], m["s"]), F.lit(False)).alias("ok"),
        ))

    return _let(F.concat(*(checked(kind) for kind in range(len(KINDS)))), of)


def _example_rows(documents: DataFrame) -> DataFrame:
    """(kind, label, f, h) of every example in the texts ``_t``; ``h`` is the same for all spellings of one span."""
    rows = documents.select("_t", F.explode(examples(F.col("_t"))).alias("c")).select("_t", "c.*")
    before, after = _context(F.col("_t"), F.col("start"), F.col("end"))
    return rows.select("kind", "label", F.array(*_features(F.col("kind"), F.col("s"), before, after)).alias("f"), F.xxhash64("_t", "start", "kind").alias("h"))


def fit(documents: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> PiiModel:
    """Learn from what the base patterns confirm and reject in all documents.

    A confirmed span in the spellings that the generators look for (an address with the @
    written out, a number in other groupings or without its plus, a long IP address in its
    place) is an example of its kind, and none of the other number kind. What base patterns
    find and reject, and what cannot be of its kind by its form (no Luhn number, a date, a
    decimal, a wrong count of groups), is an example of none. Other finds of the generators are
    not known to be right or wrong, and no examples.

    Examples are counted by their features, so that one pass over the texts serves all. The
    trees see at most ``sample_rows`` different ones of one half, dealt evenly to kinds and
    labels, each of which weighs the same in all. A kind's threshold is the lowest score from
    which on at least ``PRECISION`` of all examples of the other half are right; a kind without
    such a score takes no candidate. Without examples of both sorts no candidate is taken at all.
    """
    never = PiiModel((), (), (2.0,) * len(KINDS))
    half = (F.col("h") % 2 == 0).alias("fitted")
    counts = _example_rows(documents.select(text_or_empty(text).alias("_t"))).groupBy("kind", "label", "f", half).agg(F.count("*").alias("n"))
    counts = written(counts, "span-examples")
    sorts = counts.where("fitted").groupBy("kind", "label").agg(F.sum("n").alias("all"))  # at most two a kind
    if sorts.select("label").distinct().count() < 2:
        return never
    h = F.xxhash64("f")
    dealt = top_k_per_key(counts.where("fitted"), ["kind", "label"], [h, F.col("f")], sample_rows).orderBy("rank", "kind", "label").limit(sample_rows)
    train = written(dealt.join(F.broadcast(sorts), ["kind", "label"]).select("rank", "kind", "label", "f", (F.col("n") / F.col("all")).alias("weight")), "span-sample").coalesce(2)
    train = train.sortWithinPartitions("rank", "kind", "label").select("label", "weight", array_to_vector("f").alias("features"))
    fitted = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, seed=SEED, weightCol="weight").fit(train)
    model = PiiModel(tuple(trees_of(fitted)), tuple(fitted.treeWeights), never.thresholds)
    scores = counts.where("not fitted").groupBy("kind", model.score(F.col("f")).alias("score")).agg(F.sum("n").alias("seen"), F.sum(F.col("n") * F.col("label")).alias("right"))
    down = Window.partitionBy("kind").orderBy(F.desc("score"))  # one row for each score that the trees give
    running = scores.select("kind", "score", F.sum("seen").over(down).alias("seen"), F.sum("right").over(down).alias("right"))
    best = {r["kind"]: r["best"] for r in running.where(F.col("right") >= PRECISION * F.col("seen")).groupBy("kind").agg(F.min("score").alias("best")).collect()}
    return PiiModel(model.trees, model.weights, tuple(best.get(kind, 2.0) for kind in range(len(KINDS))))


def with_spans(documents: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """Add ``_base`` and ``_all``: arrays of (start, kind, end), by start, then kind.

    ``_all`` holds the base spans and the candidates that the model takes: apart from base
    spans, and of those that overlap the one with the best score.
    """

    def place(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))

    df = documents.withColumn("_t", text_or_empty(text)).withColumn("_found", base_spans(F.col("_t")))
    df = df.withColumn("_base", F.array_sort(F.transform("_found", place)))
    if not model.trees:
        return df.withColumn("_all", F.col("_base")).drop("_t", "_found")

    def scored(c: Column) -> Column:
        before, after = _context(F.col("_t"), c["start"], c["end"])
        return _let(F.array(*_features(c["kind"], c["s"], before, after)), lambda f: F.struct((-model.score(f)).alias("worse"), c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))

    def apart(x: Column, y: Column) -> Column:
        return (x["end"] <= y["start"]) | (y["end"] <= x["start"])

    df = df.withColumn("_more", F.filter(F.transform(candidate_spans(F.col("_t")), scored), lambda c: -c["worse"] >= model.threshold(c["kind"])))
    free = F.array_sort(F.filter("_more", lambda c: F.forall("_base", lambda b: apart(b, c))))
    none = F.from_json(F.lit("[]"), "array<struct<start: int, kind: int, `end`: int>>")
    taken = F.aggregate(free, none, lambda held, c: F.when(F.forall(held, lambda h: apart(h, c)), F.concat(held, F.array(place(c)))).otherwise(held))
    return df.withColumn("_all", F.array_sort(F.concat("_base", taken))).drop("_t", "_found", "_more")


def spelled(found: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def find_personal_data(documents: DataFrame, model: PiiModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every whole text.

    The counts and the hash are those of base spans; null texts count as empty. Repeated rows
    each get their row; other columns are left out.
    """
    df = with_spans(documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")), model, "_text")
    kinds = F.transform("_base", lambda c: c["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return df.select(F.col("_key").alias(key), *counts, F.sha2(spelled("_base"), 256).alias("base_sha256"), spelled("_all").alias("spans"))


def redact(documents: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """The rows with their own columns, each span's text replaced by its kind in brackets; a null text stays null.

    Where spans overlap, the first is replaced whole and the rest of the next after it.
    """
    whole = documents.select(F.struct("*").alias("_row"), F.col(text).alias("_source"))  # columns of any name stay apart
    df = with_spans(whole, model, "_source").withColumn("_t", text_or_empty("_source"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, c: Column) -> Column:
        between = F.substring(F.col("_t"), state["at"] + 1, c["start"] - state["at"])
        fresh = F.struct(F.greatest(state["at"], c["end"]).alias("at"), F.concat(state["parts"], F.array(F.when(c["start"] > state["at"], between).otherwise(F.lit("")), F.get(names, c["kind"]))).alias("parts"))
        return F.when(c["end"] <= state["at"], state).otherwise(fresh)

    whole_text = F.aggregate("_all", start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(F.col("_t"), s["at"] + 1, F.char_length("_t"))))
    new = F.when(F.col("_source").isNotNull(), F.when(F.size("_all") == 0, F.col("_t")).otherwise(whole_text))
    return df.select(*(new.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in documents.columns))
