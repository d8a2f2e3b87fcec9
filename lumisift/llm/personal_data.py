"""Personal data: fixed forms as seeds, and bootstrapped contextual extraction of unseen identifiers.

Base spans: leftmost non-overlapping matches of four forms, checked by value (address parts, Luhn, digits).
Bootstrapping: every base span is a seed instance of its kind, and every long hexadecimal run one of a kind that the
base has no form for, secrets (keys, tokens); those are spans, but never base spans. The words next to seeds and
next to other identifier-like tokens (one before, two before, one after) are lexical patterns. Spark scores the graph of patterns and instances in rounds: a
pattern's confidence in a kind is the share of the weight of all its instances that the kind holds (with a
prior for the unknown), and an unknown instance's score is the noisy-or of its patterns' confidence, so that
newly trusted instances strengthen further patterns. Rounds go on until no confidence moves. Each solves a
pattern's own share of its instances' scores at once, so their number does not grow with the unseen instances
of a pattern. Identifiers that high-confidence patterns point to, and whose shape fits the kind, are added as spans.
Instances are tokens, and runs of 7 to 19 digits in groups with single spaces, dots, hyphens or brackets between them.

Everything here is DataFrame functions: matching is ``regexp_extract_all``, positions come from the pieces that
``split`` leaves between the matches, by sums over blocks of them; what overlaps is found by windows over a text. Patterns use possessive groups and start only where a run starts, so long
runs of letters or digits cost linear time and no deep recursion. Hot patterns ("the") are pre-aggregated;
their way back is an equi-join that Spark can split.

Edge cases: a null text is empty and has no spans; null or repeated doc_ids are separate rows, as each input
row is keyed by its own number once written; an empty table gives no rows; ties in a pattern's confidence keep
both kinds below the acceptance level. Extra columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumisift.plans.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
#: Found by the method alone: keys and tokens. Its seeds are long runs of hexadecimal digits.
MORE_KINDS = ("secret",)
ALL_KINDS = KINDS + MORE_KINDS
_SP = r"\x20\x09-\x0D"
_LOCAL = r"A-Za-z0-9._%+-"
# The four forms. Each is entered at the start of a run, or where the last match ended (\G): matches that began
# inside a run would have begun at its start already.
FORMS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
}
# Shapes an added identifier must have, and how a token of such a shape is found.
SHAPES = {
    "email": r"^[^@]+(@|\[at\]|\(at\))[^@]+$",
    "ip": r"^[0-9]+([.:_-][0-9]+){3}$",
    "card": r"^[0-9]([ .:_/-]?[0-9]){12,18}$",
    "phone": r"^[+(]?[0-9]([ .:_/()-]*[0-9]){6,14}$",
    "secret": r"^(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])[a-z0-9_+/=-]{16,}$",
}
_TOKEN = rf"(?<![^{_SP}])(?=[^{_SP}]*+(?<=[^{_SP}]))(?=[^0-9@{_SP}]*+[0-9@]|[^{_SP}\[(]*+[\[(]at)[^{_SP}]{{4,}}"
# Groups of digits, bare or in brackets, with a space, dot or hyphen between, to the end of the last token.
_GROUP = r"(?:\([0-9]++\)|[0-9]++)"
_RUN = rf"(?<![^{_SP}])[\"'(<\[{{]{{0,3}}\+?{_GROUP}(?:[\x20.-]{_GROUP}|(?<=\))[0-9]++|\([0-9]++\))++[^{_SP}]*+"
_OPENING, _CLOSING = "\"'(<[{", "\"')>]}.,;:!?"
_EDGE = "[\"'(<\\[{]"
_TAIL = "[\"')>\\]}.,;:!?]"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _offsets(sizes: Column) -> Column:
    """The sum of all sizes before each, by sums of blocks of about the root of their number."""
    each = lambda t: F.greatest(F.ceil(F.sqrt(F.size(t))).cast("int"), F.lit(1))
    block = lambda t: F.transform(F.sequence(F.lit(0), each(t)), lambda b: _sum(F.slice(t, 1, b * each(t))))
    at = lambda t, f, i: F.element_at(f, (F.floor(i / each(t)) + 1).cast("int")) + _sum(F.slice(t, (i - i % each(t)) + 1, i % each(t)))
    return _let(sizes, lambda t: _let(block(t), lambda f: F.transform(t, lambda _, i: at(t, f, i))))


def _located(text: Column, form: str) -> Column:
    """Matches of ``form`` with code-point positions, and the whole words before (one, and two) and after them."""
    pieces, found = F.split(text, form, -1), F.regexp_extract_all(text, F.lit(form), F.lit(0))
    rows = F.arrays_zip(pieces.alias("gap"), found.alias("v"), F.slice(pieces, 2, F.size(pieces)).alias("next"))
    rows = rows.cast("array<struct<gap:string,v:string,next:string>>")
    sizes = lambda r: F.transform(r, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["v"]), F.lit(0)))
    before = lambda s, words: F.lower(F.regexp_extract(F.rtrim(s, F.lit(_OPENING)), rf"(?<![^{_SP}])({words})[{_SP}]*+$", 1))
    after = lambda s: F.lower(F.regexp_extract(F.ltrim(s, F.lit(_CLOSING)), rf"^[{_SP}]*+([^{_SP}]++)", 1))

    def placed(x: Column, offset: Column) -> Column:
        start = offset + F.length(x["gap"])
        names = [start.alias("start"), (start + F.length(x["v"])).alias("end"), x["v"].alias("v")]
        words = [before(x["gap"], f"[^{_SP}]++").alias("left"), before(x["gap"], f"[^{_SP}]++[{_SP}]++[^{_SP}]++").alias("left2"), after(x["next"]).alias("right")]
        return F.struct(*names, *words)

    whole = _let(rows, lambda r: F.filter(F.zip_with(r, _offsets(sizes(r)), placed), lambda x: x["v"].isNotNull()))
    return F.when(text.rlike(form), whole).otherwise(F.array().cast("array<struct<start:int,end:int,v:string,left:string,left2:string,right:string>>"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    twice = lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    parts = F.transform(F.split(F.reverse(_digits(v)), ""), lambda c, i: twice(F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)), i))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(v, r"\."), lambda p: (F.length(short(p)) < 3) | ((F.length(short(p)) == 3) & (short(p) <= "255")))
    if kind == "card":
        return n.between(13, 19) & _luhn(v)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


_WORDS = ("left", "left2", "right")


def _keeper(kind: str):
    return lambda x: _valid(kind, x["v"])


def _tagged(spans: Column | str, kind: str, *more: str) -> Column:
    """Spans as (kind, start, end) and ``more`` fields."""
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), *(x[m].alias(m) for m in more)))


def _of_kind(spans: Column | str, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def _scan(docs: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """One row per document: base spans with contexts, and other identifier-like tokens and runs of digit groups."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    out = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, text.alias("_text"))
    for k in ALL_KINDS:
        out = out.withColumn(f"_{k}", F.filter(_located(F.col("_text"), FORMS[k]), _keeper(k)))
    return out.withColumn("_token", _located(F.col("_text"), _TOKEN)).withColumn("_run", _runs(_located(F.col("_text"), _RUN))).drop("_text")


def _runs(found: Column) -> Column:
    """Of matches of _RUN without the signs around them, those of several tokens and 7 to 19 digits."""

    def bare(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["v"], rf"^{_EDGE}*?(?=\([0-9]+\)|\+?[0-9])", 0))
        tail = F.length(F.regexp_extract(x["v"], f"{_TAIL}*$", 0))
        v = F.substring(x["v"], lead + 1, F.length(x["v"]) - lead - tail)
        return F.struct((x["start"] + lead).alias("start"), (x["end"] - tail).alias("end"), v.alias("v"), *(x[w].alias(w) for w in _WORDS))

    whole = lambda x: x["v"].rlike(r"^[+(]?[0-9][0-9.()-]*\x20[0-9\x20.()-]*[0-9]$") & F.length(_digits(x["v"])).between(7, 19)
    return F.filter(F.transform(found, bare), whole)


def _clear(blocks: Column) -> Column:
    """Whether an item overlaps none of the blocking items before it or behind it in its text."""
    place = Window.partitionBy("_row")
    before = F.max(F.when(blocks, F.col("end"))).over(place.orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(blocks, F.col("start"))).over(place.orderBy(F.desc("start"), F.desc("rank"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(behind >= F.col("end"), F.lit(True))


def _occurrences(scanned: DataFrame) -> DataFrame:
    """One row for each seed or unknown token: _row, start, end, kind (null if unknown), instance, pattern words."""
    seeds = F.concat(*(_tagged(f"_{k}", k, "v", *_WORDS) for k in ALL_KINDS))
    of = lambda spans, rank: scanned.select("_row", F.explode(spans).alias("x")).select("_row", "x.*").withColumn("rank", F.lit(rank))
    items = of(seeds, 0).unionByName(of("_run", 1), allowMissingColumns=True).unionByName(of("_token", 2), allowMissingColumns=True)
    # a run that overlaps a seed is no instance, nor is a token that overlaps either
    items = items.withColumn("clear", _clear(F.col("rank") == 0)).where("rank <> 1 or clear")
    items = items.withColumn("clear", _clear(F.col("rank") < 2)).where("rank <> 2 or clear").drop("clear")
    tokens = items.where("rank = 2")
    lead = F.length(F.regexp_extract("v", f"^{_EDGE}*", 0))
    tail = F.length(F.regexp_extract("v", f"{_TAIL}*$", 0))
    tokens = tokens.withColumns({"start": F.col("start") + lead, "end": F.greatest(F.col("end") - tail, F.col("start") + lead), "v": F.regexp_replace("v", f"^{_EDGE}*|{_TAIL}*$", "")})
    return items.where("rank < 2").unionByName(tokens.where("length(v) >= 4")).drop("rank").withColumn("v", F.lower("v"))


def bootstrap(scratch: Scratch, occurrences: DataFrame, settled: float, min_seeds: int, prior: float, accept: float) -> DataFrame:
    """Unknown occurrences (_row, start, end, kind) that trusted patterns point to.

    Rounds end when no pattern's trust changes by more than ``settled``. Trust only rises, to the least solution of
    trust = (n_kind + sum n * score) / (n_known + n_unknown + prior), score = 1 - product of (1 - trust).
    """
    sides = F.array(*(F.when(F.col(s) != "", F.concat(F.lit(f"{s}:"), F.col(s))) for s in _WORDS))
    edges = occurrences.select("_row", "start", "end", "kind", "v", F.explode(F.array_compact(sides)).alias("pattern"))
    graph = scratch.table(edges.groupBy("pattern", "v", "kind").agg(F.count("*").alias("n")), "graph")
    known = graph.where("kind is not null").select("pattern", "v", "kind", "n", F.lit(1e0).alias("weight"))
    unknown = graph.where("kind is null").select("pattern", "v", "n")
    # only patterns that stand next to something unknown can add a span
    asked = unknown.groupBy("pattern").agg(F.sum("n").alias("n_unknown"))
    seeded = known.groupBy("pattern", "kind").agg(F.sum("n").alias("n_kind"), F.countDistinct("v").alias("n_seeds"))
    total = known.groupBy("pattern").agg(F.sum("n").alias("n_known"))
    base = scratch.table(asked.join(total, "pattern").join(seeded, "pattern").where(F.col("n_seeds") >= min_seeds), "patterns")
    fits = reduce(lambda a, k: a | ((F.col("kind") == k) & F.col("v").rlike(SHAPES[k])), ALL_KINDS, F.lit(False))
    fitting = scratch.table(unknown.join(base.select("pattern", "kind"), "pattern").where(fits), "fitting")
    miss = F.log1p(-F.least("trust", F.lit(1 - 1e-9)))
    own = fitting.groupBy("pattern", "kind").agg(F.sum("n").alias("n_fit"))
    base = scratch.table(base.join(own, ["pattern", "kind"], "left").na.fill(0, ["n_fit"]), "asked")
    trust = base.select("pattern", "kind", F.lit(0e0).alias("trust"))
    while True:
        # score = 1 - rest * (1 - trust), where rest is the product over the instance's other patterns
        placed = fitting.join(trust.withColumn("miss", miss), ["pattern", "kind"])
        total_miss = placed.groupBy("v", "kind").agg(F.sum("miss").alias("all"))
        rest = placed.join(total_miss, ["v", "kind"]).groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.exp(F.col("all") - F.col("miss"))).alias("rest"))
        held = base.join(rest, ["pattern", "kind"], "left").join(trust.withColumnRenamed("trust", "before"), ["pattern", "kind"])
        left = F.coalesce("rest", F.lit(0e0))
        share = (F.col("n_kind") + F.col("n_fit") - left) / (F.col("n_known") + F.col("n_unknown") + F.lit(prior) - left)
        trust = scratch.table(held.select("pattern", "kind", share.alias("trust"), F.abs(share - F.col("before")).alias("change")), "trust")
        if (trust.agg(F.max("change")).first()[0] or 0.0) <= settled:
            break
        trust = trust.drop("change")
    placed = fitting.join(trust.withColumn("miss", miss), ["pattern", "kind"])
    score = placed.groupBy("v", "kind").agg((1 - F.exp(F.sum("miss"))).alias("score")).where(F.col("score") >= accept)
    good = placed.where(F.col("trust") >= accept).join(score, ["v", "kind"]).select("pattern", "v", "kind", "score")
    near = edges.where("kind is null").drop("kind").join(good, ["pattern", "v"])
    return near.groupBy("_row", "start", "end").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))


def _spans(docs: DataFrame, text: Column, keep: list[str], scratch: Scratch, **tuning) -> DataFrame:
    """``keep`` and per document the base spans and all spans, as arrays of (kind, start, end) in order."""
    scanned = scratch.table(_scan(docs, text, keep), "scanned")
    occurrences = scratch.table(_occurrences(scanned), "occurrences")
    added = bootstrap(scratch, occurrences, **tuning).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("_added"))
    added = scratch.table(added, "added")
    scratch.drop_all_but(scanned, added)
    base = F.concat(*(_tagged(f"_{k}", k) for k in KINDS))
    seeds = F.concat(*(_tagged(f"_{k}", k) for k in ALL_KINDS))
    out = scanned.select("_row", *keep, base.alias("base"), seeds.alias("_seeds"), *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS)).join(added, "_row", "left")
    both = F.flatten(F.array(*(F.array_sort(F.concat(_of_kind("_seeds", k), _tagged(_of_kind("_added", k), k))) for k in ALL_KINDS)))
    return out.withColumn("spans", F.when(F.col("_added").isNull(), F.col("_seeds")).otherwise(both)).drop("_added", "_seeds")


TUNING = {"settled": 1e-6, "min_seeds": 5, "prior": 1.0, "accept": 0.9}


def find(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **tuning) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end), and base counts by kind."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_source"))
    out = _spans(source, F.col("_source"), ["doc_id"], Scratch(spark, "personal"), **(TUNING | tuning))
    return out.drop("_row")


def redact(spark: SparkSession, docs: DataFrame, text_col: str = "text", **tuning) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets, columns and row count unchanged.

    Overlapping spans are replaced from left to right; what a replaced one covers is not replaced again.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    source = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    text = F.col(names[text_col])
    out = _spans(source, text, list(names.values()), Scratch(spark, "redact"), **(TUNING | tuning))
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"], x["end"], x["kind"])))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,len:int,kind:string>>").alias("out"))
    step = lambda acc, x: F.when(x["start"] < acc["pos"], acc).otherwise(F.struct(x["end"].alias("pos"), F.concat(acc["out"], F.array(F.struct(acc["pos"].alias("start"), (x["start"] - acc["pos"]).alias("len"), x["kind"].alias("kind")))).alias("out")))
    plan = F.aggregate(ordered, zero, step)
    out = out.withColumn("_plan", plan)
    pieces = F.transform("_plan.out", lambda p: F.concat(F.substring(text, p["start"] + 1, p["len"]), F.lit("["), F.upper(p["kind"]), F.lit("]")))
    done = F.concat(F.array_join(pieces, ""), F.substring(text, F.col("_plan.pos") + 1, F.length(text)))
    clean = F.when(F.size("spans") > 0, done).otherwise(text)
    return out.select(*((clean if c == text_col else F.col(n)).alias(c) for c, n in names.items()))


def spelled(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
