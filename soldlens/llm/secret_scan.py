"""Secret scans, native: patterns for known shapes and sliding-window Shannon entropy for the rest.

Spans come from splitting the text by a pattern and summing the lengths of what lies between the matches. Candidates for
the entropy test are runs of 20 or more token characters that hold a digit; each belongs to one character class (hex, lower
alphanumeric or mixed), and a window of 20 characters slides over it. Its sum of c*log2(c) over character counts changes only
by the character that enters and the one that leaves. Each run of the union of windows at or over the class's threshold
is a span. Spans of the patterns are cut out of a run first, and so are its parts between '/', '=' and '-' that
hold an allowed word; what remains is a candidate if it is long enough and holds a digit. A candidate of an allowed form
is left out; separators where it was cut do not count for its form.

Defined cases: a null text is empty and has no spans; positions are code points, end exclusive; repeated rows are scanned
each; columns beside doc_id and text are ignored (`redact` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soldlens.llm._shared import text_of

#: Kinds in their order, with pattern, group whose length counts, least length.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]{24,})", 1, 24),  # runs are whole, so shorter ones need not be matched and dropped
}
ENTROPY = "entropy"
WINDOW = 20
CANDIDATE = r"((?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*[0-9])[A-Za-z0-9+/=_-]{20,})"
#: Bits per character that a window must reach, by class.
LEAST_BITS = {"hex": 3.0, "lower": 3.6, "mixed": 3.8}
#: Words whose part of a run is never a secret by entropy alone, and forms of whole candidates that never are.
ALLOW_WORDS = "example|sample|dummy|placeholder|changeme|lorem|0123456789|123456789|abcdefghij|qwerty"
ALLOWED_PART = rf"(?<![A-Za-z0-9+_])([A-Za-z0-9+_]*(?i:{ALLOW_WORDS})[A-Za-z0-9+_]*)"
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/=_-]*$",
    r"^[A-Za-z]+(?:[-_/+=][A-Za-z]+)*[-_/+=]?[0-9]{1,4}$",
    r"^(?:[A-Za-z]{2,}|[0-9]{1,4})(?:[-_/][A-Za-z]{2,}|[-_/][0-9]{1,4})+$",
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
_ITEM = "struct<start:int,end:int,value:string>"


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Matches of the pattern as array<struct<start, end, value>>, value being the group; none of them is empty."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    found = F.aggregate(
        F.filter(rows, lambda r: r["whole"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_ITEM}>)").alias("out")),
        lambda s, r: F.struct(
            (s["at"] + F.char_length(r["gap"]) + F.char_length(r["whole"])).alias("at"),
            F.concat(s["out"], F.array(F.struct((s["at"] + F.char_length(r["gap"])).alias("start"), (s["at"] + F.char_length(r["gap"]) + F.char_length(r["whole"])).alias("end"), r["value"].alias("value")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as array<{_ITEM}>)"))


def _clog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def _class_bits(s: Column) -> Column:
    hex_like = s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    mixed = s.rlike("[a-z]") & s.rlike("[A-Z]")
    return F.when(hex_like, LEAST_BITS["hex"]).when(mixed, LEAST_BITS["mixed"]).otherwise(LEAST_BITS["lower"])


def _windows(s: Column) -> Column:
    """Array of struct begin, end: the union, in runs, of the windows of s at or over its class's threshold."""
    least = _class_bits(s)
    codes = F.transform(F.split(s, ""), lambda ch: F.when(ch != "", F.position(ch, F.lit(ALPHABET))).otherwise(F.lit(0)))
    codes = F.filter(codes, lambda k: k > 0)

    def step(state: Column, i: Column) -> Column:
        ins, c, hot = F.element_at(state["codes"], i), state["counts"], state["hot"]
        old = F.when(i > WINDOW, F.element_at(state["codes"], F.greatest(i - WINDOW, F.lit(1)))).otherwise(F.lit(0))
        n_in = F.element_at(c, ins)
        n_out = F.when(old > 0, F.element_at(c, F.greatest(old, F.lit(1)))).otherwise(F.lit(0))
        total = F.when(old == ins, state["sum"]).otherwise(state["sum"] + _clog(n_in + 1) - _clog(n_in) + F.when(old > 0, _clog(n_out - 1) - _clog(n_out)).otherwise(0.0))
        counts = F.when(old == ins, c).otherwise(F.transform(c, lambda v, k: v + F.when(k + 1 == ins, 1).otherwise(0) - F.when(k + 1 == old, 1).otherwise(0)))
        # the threshold is met within what sums of doubles may be off by
        high = (i >= WINDOW) & (F.lit(1.0) * F.log2(F.lit(float(WINDOW))) - total / WINDOW >= state["least"] - 1e-9)
        last = F.try_element_at(hot, F.lit(-1))
        joins = (F.size(hot) > 0) & (last["end"] >= i - WINDOW)
        grown = F.concat(F.slice(hot, F.lit(1), F.greatest(F.size(hot) - 1, F.lit(0))), F.array(F.struct(last["begin"].alias("begin"), i.alias("end"))))
        begun = F.concat(hot, F.array(F.struct((i - WINDOW).alias("begin"), i.alias("end"))))
        return F.struct(
            state["codes"].alias("codes"),
            state["least"].alias("least"),
            counts.alias("counts"),
            total.alias("sum"),
            F.when(~high, hot).when(joins, grown).otherwise(begun).alias("hot"),
        )

    none = F.expr("cast(array() as array<struct<begin:int,end:int>>)")
    start = F.struct(codes.alias("codes"), least.alias("least"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), none.alias("hot"))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(s)), start, step, lambda state: state["hot"])


def _blanked(text: Column, spans: Column) -> Column:
    """The text with each character of the spans, which have start and end and may overlap, as a blank."""
    state = F.aggregate(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.repeat(F.lit(" "), x["end"] - F.greatest(s["at"], x["start"]))).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text) - s["at"])),
    )
    return F.when(F.size(spans) == 0, text).otherwise(state)


def _entropy_spans(text: Column, cut: Column) -> Column:
    """Spans by entropy; cut is the text without what is known or allowed, at the same positions."""
    token = lambda at: F.substring(text, at, F.lit(1)).rlike("[A-Za-z0-9+/=_-]")

    def form(m: Column) -> Column:
        head = F.when((m["start"] > 0) & token(m["start"]), F.regexp_replace(m["value"], "^[/=-]+", "")).otherwise(m["value"])
        return F.when(token(m["end"] + 1), F.regexp_replace(head, "[/=-]+$", "")).otherwise(head)

    allowed = lambda s: F.exists(F.array(*[F.lit(p) for p in ALLOW]), lambda p: F.rlike(s, p))
    free = F.filter(_matches(cut, CANDIDATE, 1), lambda m: ~allowed(form(m)))
    hot = F.transform(free, lambda m: F.struct(m["start"].alias("at"), _windows(m["value"]).alias("w")))
    return F.flatten(F.transform(hot, lambda h: F.transform(h["w"], lambda w: F.struct((h["at"] + w["begin"]).alias("start"), F.lit(len(KINDS)).alias("order"), (h["at"] + w["end"]).alias("end")))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, ENTROPY)])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["order"] + 1), s["start"], s["end"])), ",")


def _base_spans(text: Column, order: int, pattern: str, group: int, least: int) -> Column:
    # one argument each: a second one would be the element's index
    good = F.filter(_matches(text, pattern, group), lambda m: F.char_length(m["value"]) >= least)
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (a struct of all columns), t (the text), base and spans: array<struct<start, order, end>>; base is what the patterns alone found."""
    out = docs.select(F.struct(*docs.columns).alias("row"), text_of(text).alias("t"))
    t = F.col("t")
    for i, kind in enumerate(KINDS):
        out = out.withColumn(kind, _base_spans(t, i, *KINDS[kind]))
    out = out.withColumn("base", F.concat(*KINDS))
    out = out.withColumn("rest", F.when(t.rlike(CANDIDATE), _blanked(t, F.col("base"))).otherwise(""))
    out = out.withColumn("cut", _blanked(F.col("rest"), _matches(F.col("rest"), ALLOWED_PART, 1)))
    entropy = F.when(F.col("cut").rlike(CANDIDATE), _entropy_spans(t, F.col("cut")))
    spans = F.concat("base", F.coalesce(entropy, F.expr("cast(array() as array<struct<start:int,order:int,end:int>>)")))
    return out.select("row", "t", "base", spans.alias("spans"))


def secrets(docs: DataFrame) -> DataFrame:
    """The digest per document."""
    n = lambda k: F.size(F.filter("base", lambda s: s["order"] == k)).cast("long")
    return scan(docs.select("doc_id", "text")).select("row.doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """The documents, all columns, with each run of overlapping spans in the text replaced by the mark; a null text stays null."""
    state = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], F.substring("t", s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substring("t", s["at"] + 1, F.char_length("t") - s["at"])),
    )
    own = F.col("row")[text]
    clean = F.when(F.size("spans") == 0, own).otherwise(state)
    return scan(docs, text).select(*[clean.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
