"""Secrets in text: three patterns, and stretches of high entropy, with DataFrame functions only.

Spark's regular expressions give the matches but not their places. The pieces between the matches
(`split`) and the matches (`regexp_extract_all`) alternate, so running lengths give every span in
code points. Candidates for the entropy scan are the longest runs of a class's characters, for every
class on its own; allow-listed strings are blanked first, so they clear themselves and nothing
beside them. A window slides over each run; the count of the incoming character goes up and that
of the outgoing one goes down, and with them the sum of c*log2(c), which fixes the Shannon entropy
of the window.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# (kind, pattern, group whose length counts, least length)
BASE = [("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32)]
KINDS = ["assign", "access", "hex", "entropy"]
# What the matches of a kind need at the least; texts without it are not searched further.
GUARDS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}

#: c*log2(c) is kept in whole billionths, so that adding and taking away leaves no rounding behind.
SCALE = 1_000_000_000


@dataclass(frozen=True)
class CharClass:
    """Characters, as a pattern and an alphabet, and the entropy in bits per character from which a window counts as random.

    With `fold` upper and lower case are one character.
    """

    name: str
    pattern: str
    alphabet: str
    bits: float
    fold: bool = False


@dataclass(frozen=True)
class EntropyRules:
    """`window` characters slide over the longest runs of each class's characters."""

    window: int = 20
    classes: tuple[CharClass, ...] = (
        CharClass("hex", "[0-9A-Fa-f]", "0123456789abcdef", 3.0, True),
        CharClass("base64", "[A-Za-z0-9+/=_-]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 3.8),
    )
    #: Runs that match one of these are no secrets: no digit or no letter in them.
    clear: tuple[str, ...] = ("^[^0-9]*$", "^[^A-Za-z]*$")
    #: Allow-listed strings, as (pattern, length of its matches): an alphabet written out, and the
    #: mark of the keys that public manuals print.
    allow: tuple[tuple[str, int], ...] = (("(?i)0123456789abcdef", 16), ("(?i)abcdefghijklmnop", 16), ("EXAMPLE", 7))


def _spans(text: Column, pattern: str, group: int, least: int, kind: str, guard: str) -> Column:
    """Spans of a pattern's matches, leftmost first, whose group has at least `least` characters."""
    step = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )
    empty = F.lit([]).cast("array<struct<start:int,end:int,kind:int>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind")))
        return F.struct(end.alias("pos"), F.when(F.length(x["part"]) >= least, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("pos"), empty.alias("found"))
    return F.when(text.rlike(guard), F.aggregate(step, start, add, lambda acc: acc["found"])).otherwise(empty)


def _hot_stretch(word: Column, of: CharClass, window: int) -> Column:
    """(first, last) 1-based places of the windows' ends above the class's entropy; first is NULL if none is."""
    chars = F.split(word, "")
    table = F.array(*[F.lit(round(SCALE * c * math.log2(c)) if c else 0).cast("long") for c in range(window + 1)])
    most = math.floor(SCALE * window * (math.log2(window) - of.bits))
    size = len(of.alphabet)

    def place(i: Column) -> Column:
        return F.instr(F.lit(of.alphabet), F.get(chars, i - 1))

    def step(acc: Column, i: Column) -> Column:
        return F.transform(
            F.array(F.struct(place(i).alias("a"), F.when(i > window, place(i - window)).otherwise(F.lit(0)).alias("b"))),
            lambda x: _moved(acc, i, x["a"], x["b"]),
        )[0]

    def _moved(acc: Column, i: Column, a: Column, b: Column) -> Column:
        same = a == b
        up = F.get(table, F.get(acc["counts"], a - 1) + 1) - F.get(table, F.get(acc["counts"], a - 1))
        down = F.get(table, F.get(acc["counts"], b - 1) - 1) - F.get(table, F.get(acc["counts"], b - 1))
        total = acc["total"] + F.when(same, 0).otherwise(up + F.when(b > 0, down).otherwise(0))
        counts = F.when(same, acc["counts"]).otherwise(
            F.transform(acc["counts"], lambda c, j: c + (j == a - 1).cast("int") - (j == b - 1).cast("int"))
        )
        hot = (i >= window) & (total <= most)
        return F.struct(
            counts.alias("counts"), total.alias("total"),
            F.when(hot & acc["first"].isNull(), i).otherwise(acc["first"]).alias("first"),
            F.when(hot, i).otherwise(acc["last"]).alias("last"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0).cast("long").alias("total"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step, lambda acc: F.struct(acc["first"], acc["last"]))


def _class_spans(text: Column, of: CharClass, rules: EntropyRules) -> Column:
    run = f"{of.pattern}{{{rules.window},}}"
    spans = _spans(text, run, 0, rules.window, "entropy", run)

    def stretch(span: Column) -> Column:
        word = F.substring(text, span["start"] + 1, span["end"] - span["start"])
        hot = _hot_stretch(F.lower(word) if of.fold else word, of, rules.window)
        for clear in rules.clear:
            hot = F.when(~word.rlike(clear), hot)
        start, end = span["start"] + hot["first"] - rules.window, span["start"] + hot["last"]
        return F.when(hot["first"].isNotNull(), F.struct(start.alias("start"), end.alias("end"), span["kind"].alias("kind")))

    return F.filter(F.transform(spans, stretch), lambda s: s.isNotNull())


def _entropy_spans(text: Column, rules: EntropyRules) -> Column:
    """Entropy spans of all classes; a span that two classes find is one."""
    return F.array_distinct(F.concat(*[_class_spans(text, of, rules) for of in rules.classes]))


def _scanned(docs: DataFrame, id: str, text: str, rules: EntropyRules) -> DataFrame:
    """(id, body, base, spans) of every row, with spans in order."""
    body, blanked = F.col("body"), F.col("blanked")
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    hidden = body
    for pattern, length in rules.allow:
        hidden = F.regexp_replace(hidden, pattern, " " * length)
    rows = rows.withColumn("blanked", hidden)
    found = rows.select(
        "id", "body",
        F.concat(*[_spans(body, p, g, n, kind, GUARDS[kind]) for kind, p, g, n in BASE]).alias("base"),
        _entropy_spans(blanked, rules).alias("more"),
    )

    def in_order(spans: Column) -> Column:
        return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))

    return found.select("id", "body", in_order(F.col("base")).alias("base"), in_order(F.concat("base", "more")).alias("spans"))


def secret_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: EntropyRules = EntropyRules()) -> DataFrame:
    """(id, base, spans): arrays of (start, end, kind) in code points, end exclusive, in order.

    `base` holds the spans of the three patterns, `spans` these and the entropy spans, which may
    overlap them and each other. `kind` counts in KINDS. One row per row of `docs`, in one pass
    without a shuffle. NULL and empty texts have no spans. Other columns are ignored, whatever
    their names.
    """
    return _scanned(docs, id, text, rules).select(F.col("id").alias(id), "base", "spans")


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, id: str = "doc_id", text: str = "text", mask: str = "[secret]", rules: EntropyRules = EntropyRules()) -> DataFrame:
    """(id, text) with every span replaced by `mask`; overlapping spans are replaced as one.

    One row per row of `docs`, whether its id is missing or repeated: spans are those of the row itself.
    """
    body = F.col("body")

    def cut(acc: Column, s: Column) -> Column:
        gap = F.substring(body, acc["pos"] + 1, s["start"] - acc["pos"])
        out = F.when(s["start"] < acc["pos"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mask)))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate("spans", start, cut, lambda acc: F.concat(acc["out"], F.substring(body, acc["pos"] + 1, F.length(body))))
    return _scanned(docs, id, text, rules).select(F.col("id").alias(id), done.alias(text))
