"""Secret scans: base patterns, and character Markov models compared by log-likelihood ratio.

Everything runs as DataFrame expressions. One pass over the texts finds the base spans and the
candidate tokens (runs of `CANDIDATE`). Two first-order character models are then fitted from all
labelled candidates: tokens that touch a base span are random, words as in `ORDINARY` are identifiers.
Their smoothed transition ratios, scaled to integers, fill one table of at most 67 x 67 weights; a token
with letters and digits whose mean weight is `THRESHOLD` or more, and which touches no base span, is a
span of kind `markov`.

Rows: a null text is empty and has no spans; repeated rows are each answered; an empty table gives
no rows and no model. Positions are code points, ends exclusive. Other columns pass through in
`find_secrets`; input columns named `spans` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.llm.common import keep, table

#: kind, pattern, group whose length counts, its least length; in the order that breaks ties.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KINDS = [k for k, *_ in BASE] + ["markov"]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
#: What counts as a labelled ordinary identifier: no digits but for a short number at the end.
ORDINARY = r"^[A-Za-z+/_-]+[0-9]{0,4}$"
SIDE, SCALE, THRESHOLD, SMOOTH = len(ALPHABET) + 1, 100, 50, 0.5
#: Matches that are folded at once; what a fold costs grows with the square of this only.
CHUNK = 64
FOUND = "cast(array() as array<struct<start:int,kind:int,stop:int,token:string>>)"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once; lambdas would compute it again at every call."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunks(items: Column) -> Column:
    """An array cut into arrays of CHUNK elements (of an empty one: empty arrays)."""
    return F.transform(F.sequence(F.lit(0), ((F.size(items) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, CHUNK))


def spans_of(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, stop, token>> of a pattern's matches, short ones dropped.

    Spark has no match positions; the lengths of what lies between matches (split) and of the
    matches themselves add up to them, chunk by chunk and then within each.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(F.arrays_zip(found.alias("m"), counted.alias("c")), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m["m"]).alias("n"), F.length(m["c"]).alias("counted"), m["m"].alias("token")))
    def walk(ch: Column, at: Column) -> Column:
        return F.aggregate(
            ch,
            F.struct(at.alias("at"), F.expr(FOUND).alias("out")),
            lambda acc, p: F.struct(
                (acc["at"] + p["gap"] + p["n"]).alias("at"),
                F.when(p["counted"] >= least, F.array_append(acc["out"], F.struct((acc["at"] + p["gap"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + p["gap"] + p["n"]).alias("stop"), p["token"].alias("token")))).otherwise(acc["out"]).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    def walked(cut: Column) -> Column:
        ends = F.aggregate(cut, F.array(F.lit(0)), lambda out, x: F.array_append(out, F.element_at(out, -1) + x["long"]))
        return F.flatten(F.transform(F.arrays_zip(cut.alias("cut"), F.slice(ends, 1, F.size(cut)).alias("at")), lambda x: walk(x["cut"]["ch"], x["at"])))

    measured = lambda p: F.transform(chunks(p), lambda ch: F.struct(ch.alias("ch"), F.aggregate(ch, F.lit(0), lambda a, p: a + p["gap"] + p["n"]).alias("long")))
    return F.when(text.rlike(pattern), let(parts, lambda p: let(measured(p), walked))).otherwise(F.expr(FOUND))


def touching(candidates: Column, others: Column) -> Column:
    """Candidates with `touch`, whether a span of `others` overlaps them; each chunk meets only the spans near it."""
    near = lambda cs, bs: F.transform(chunks(cs), lambda ch: F.struct(ch.alias("ch"), F.filter(bs, lambda b: (b["start"] < F.element_at(ch, -1)["stop"]) & (F.element_at(ch, 1)["start"] < b["stop"])).alias("near")))
    mark = lambda x: F.transform(x["ch"], lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"), c["token"].alias("token"), F.exists(x["near"], lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])).alias("touch")))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,stop:int,token:string,touch:boolean>>)")
    return let(candidates, lambda cs: F.when(F.size(cs) > 0, let(others, lambda bs: F.flatten(F.transform(near(cs, bs), mark)))).otherwise(none))


def codes(token: Column) -> Column:
    """0 for the start, then each character's place in the alphabet."""
    return F.concat(F.array(F.lit(0)), F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c)))


def cells(token: Column) -> Column:
    """The transition table's cell (0-based) of each step of a token."""
    code = codes(token)
    return F.zip_with(F.slice(code, 1, F.length(token)), F.slice(code, 2, F.length(token)), lambda a, b: a * SIDE + b)


def markov_weights(found: DataFrame) -> list[int] | None:
    """Scaled log ratios of all transitions; at most SIDE x SIDE counts of each label reach the driver."""
    tokens = found.select(F.explode("candidates").alias("c"))
    label = F.when(F.col("c.touch"), True).when(F.col("c.token").rlike(ORDINARY), False)
    tokens = tokens.select("c", label.alias("random")).filter("random is not null")
    counted = tokens.select(F.explode(cells(F.col("c.token"))).alias("cell"), "random").groupBy("cell", "random").count().collect()
    if len({r.random for r in counted}) < 2:
        return None
    seen = {(r.random, r.cell): r["count"] for r in counted}
    rows = {(label, a): sum(seen.get((label, a * SIDE + b), 0) for b in range(SIDE)) for label in (True, False) for a in range(SIDE)}
    logp = lambda label, cell: math.log((seen.get((label, cell), 0) + SMOOTH) / (rows[label, cell // SIDE] + SMOOTH * (SIDE - 1)))
    return [round(SCALE * (logp(True, cell) - logp(False, cell))) for cell in range(SIDE * SIDE)]


def marked(docs: DataFrame) -> DataFrame:
    """`docs` with `base` and `candidates`, from one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*[spans_of(text, i, *rest) for i, (_, *rest) in enumerate(BASE)])
    found = docs.withColumn("base", base)
    return found.withColumn("candidates", touching(spans_of(text, len(BASE), CANDIDATE, 0, 16), F.col("base")))


def with_spans(found: DataFrame, weights: list[int] | None) -> DataFrame:
    """Turn base and candidates into sorted `base` and `spans`, array<struct<start, kind, stop>>."""
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    if weights is None:
        extra = F.filter("candidates", lambda c: F.lit(False))
    else:
        table_ = F.lit(weights)
        mean = lambda t: F.aggregate(cells(t), F.lit(0), lambda a, x: a + F.get(table_, x)) / F.length(t)
        extra = F.filter("candidates", lambda c: c["token"].rlike("[0-9]") & c["token"].rlike("[A-Za-z]") & ~c["touch"] & (mean(c["token"]) >= THRESHOLD))
    return found.withColumn("spans", F.array_sort(F.concat(bare(F.col("base")), bare(extra)))).withColumn("base", F.array_sort(bare(F.col("base")))).drop("candidates")


def find_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with `spans` (an input column of that name is replaced): array<struct<start, kind, stop>>, kind an index into KINDS; the model is fitted from all of `docs`."""
    weights = markov_weights(keep(marked(docs.select("text")).select("base", "candidates"), "candidates"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "spans"]).alias("row")
    return with_spans(marked(docs.select("text", row)), weights).select("row.*", "spans")


def joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keep(marked(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "base", "candidates"), "candidates")
    out = with_spans(found, markov_weights(found))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
