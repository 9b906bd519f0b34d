"""How far the sources of a language differ in their terms, by ranking cells of counts.

A language's terms are runs of letters and non-ASCII characters that enough of its documents have.
Smoothed shares of terms in a source, p, and elsewhere, q, are compared by (p - q)^2 / (p + q), in
whole billionths. That value follows from the two counts alone, and many terms share their counts.
So terms are grouped into cells of equal counts, a value is worked out once per cell, and cells
are ranked by value with their multiplicities. Only the terms of the first cells are looked at again.
A kept term is one row with its sources in a list, so sources are paired without a join of terms.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.llm.words import gives_back
from dayloom.runtime import cut_lineage, rest

UNIT = 1_000_000_000
#: Terms that a task holds counts of before they become rows, rows that it holds for each of these
#: before it hands them on, and bytes of a text worked on at a time.
MOST_TERMS, ROWS_EACH, PART = 300_000, 4, 1 << 20

_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _parts(data: bytes):
    """Pieces of about PART bytes that don't cut a term."""
    at = 0
    while len(data) - at > PART:
        end = at + PART
        while end < len(data) and (97 <= data[end] <= 122 or data[end] >= 128):
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def count_terms(text: str | None, n: Counter, docs: Counter) -> None:
    """Add the terms of a text to `n`, and each of them once to `docs`; terms are UTF-8 with only A to Z lower-cased."""
    own: set[bytes] = set()
    # Lower-casing bytes leaves everything outside ASCII as it is.
    for part in _parts((text or "").encode().lower()):
        found = _TERM.findall(part)
        n.update(found)
        own.update(found)
    docs.update(own)


def _rows(counts: dict[int, tuple[Counter, Counter]]) -> list[pa.Table]:
    """(group, term, n, docs) of the counts of groups."""
    made = []
    for group, (n, docs) in counts.items():
        # Terms are cut at ASCII characters, so they are UTF-8 as their texts are.
        terms = pa.array(list(n), pa.binary()).cast(pa.string())
        columns = [pa.array(np.full(len(n), group, np.int32)), terms, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
        made.append(pa.table(columns, names=["group", "term", "n", "docs"]))
    return made


def _summed(tables: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(tables).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return summed.select(["group", "term", "n_sum", "docs_sum"]).rename_columns(["group", "term", "n", "docs"])


def _counted(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs), where all rows of a language's term are in one task."""

    def handed_on(table: pa.Table, groups: dict[tuple[str, str], int]) -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array(names, pa.string()) for names in zip(*groups, strict=True))
        for batch in table.to_batches(max_chunksize=MOST_TERMS):
            columns = [langs.take(batch["group"]), sources.take(batch["group"]), batch["term"], batch["n"], batch["docs"]]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        groups: dict[tuple[str, str], int] = {}
        counts: dict[int, tuple[Counter, Counter]] = {}
        tables: list[pa.Table] = []
        held = rows = 0
        for batch in batches:
            for body, where, whence in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n, in_docs = counts.setdefault(groups.setdefault((where, whence), len(groups)), (Counter(), Counter()))
                held -= len(n)
                count_terms(body.as_py(), n, in_docs)
                held += len(n)
                if held + len(counts) >= MOST_TERMS:
                    tables += _rows(counts)
                    rows += held
                    counts, held = {}, 0
                    if rows >= ROWS_EACH * MOST_TERMS:
                        tables = [_summed(tables)]
                        rows = len(tables[0])
                        # What summing hardly shrinks is handed on.
                        if rows >= ROWS_EACH * MOST_TERMS // 2:
                            yield from handed_on(tables[0], groups)
                            tables, rows = [], 0
        tables += _rows(counts)
        if tables:
            yield from handed_on(_summed(tables), groups)

    rows = docs.select(F.col(text).alias("body"), _name(lang).alias("lang"), _name(source).alias("source"))
    made = rows.mapInArrow(gives_back(run), "lang string, source string, term string, n bigint, docs bigint")
    return made.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _share(n: str, total: str, terms: str) -> str:
    """1 + floor(UNIT (n + 2) / (total + 2 terms)), in decimals where the product passes 64 bits."""
    wide = f"cast({UNIT} * (cast({n} as decimal(19, 0)) + 2) div (cast({total} as decimal(19, 0)) + 2 * cast({terms} as decimal(19, 0))) as bigint)"
    return f"1 + if({n} <= 9000000000, {UNIT}L * ({n} + 2) div ({total} + 2 * {terms}), {wide})"


def _gap(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square fits in 64 bits."""
    return f"({p} - {q}) * ({p} - {q}) div ({p} + {q})"


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group, a source of a language.

    Part `pair` compares a group with each other source of its language over all kept terms; all
    are ranked. Part `term` has the `top` terms that occur in the group and more often there than
    in the whole language. Ranks go by falling value, then by item in the order of its UTF-8
    bytes. NULL text, language and source count as empty; every row is a document, whatever its
    id. A group without terms has pairs, of value 0 if its language keeps no term. No rows give
    no rows. Other columns are ignored, whatever their names.
    """
    counted = _counted(docs, text, lang, source)
    whole = Window.partitionBy("lang", "term")  # A row per source.
    sums = [F.sum("docs").over(whole).alias("in_docs"), F.sum("n").over(whole).alias("lang_n"), F.min("source").over(whole).alias("least")]
    listed = counted.select("lang", "term", "source", *sums, F.collect_list(F.struct("source", "n")).over(whole).alias("by"))
    kept = cut_lineage(listed.filter((F.col("in_docs") >= min_docs) & (F.col("source") == F.col("least"))).select("lang", "term", "lang_n", "by"))
    own = kept.select("lang", "term", "lang_n", F.inline("by"))

    # Cells of equal counts: few, whatever the number of terms.
    cells = cut_lineage(own.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("terms")))
    groups = docs.select(_name(lang).alias("lang"), _name(source).alias("source")).distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum(F.expr("n * terms")).alias("total"), F.sum("terms").alias("own_terms"))
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    # In a file, so that the planner knows that groups are few.
    groups = rest(groups.fillna(0, ["total", "own_terms", "v", "lang_total"]))
    return _pairs(kept, cells, groups).unionByName(_terms(own, cells, groups, top))


def _terms(own: DataFrame, cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The part `term`: cells ranked by value and multiplicity, and the terms of the first ones."""
    rated = cells.join(groups, ["lang", "source"]).withColumn("p", F.expr(_share("n", "total", "v"))).withColumn("q", F.expr(_share("lang_n", "lang_total", "v")))
    rated = rated.filter("p > q").select("lang", "source", "n", "lang_n", "terms", F.expr(_gap("p", "q")).alias("value"))
    values = rated.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    # A value stands for one term at least, so the first `top` values are enough; they are cut before the shuffle.
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    first = values.withColumn("at", F.row_number().over(falling)).filter(F.col("at") <= top)
    before = F.coalesce(F.sum("terms").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.withColumn("before", before).filter(F.col("before") < top)
    wanted = rest(rated.drop("terms").join(first.select("lang", "source", "value", "before"), ["lang", "source", "value"]))

    # A value may have very many terms: its first `top` are cut out before the shuffle.
    place = F.row_number().over(Window.partitionBy("lang", "source", "value").orderBy("term"))
    shown = own.join(wanted, ["lang", "source", "n", "lang_n"]).withColumn("place", place).filter(F.col("place") <= top)
    ranked = shown.withColumn("rank", F.expr("cast(before + place as int)")).filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(kept: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """The part `pair`: sums over all kept terms, from the cells of one source and the terms of two.

    Every term of the language is added as if the other source lacked it, or both did; terms that
    both have are then put right, by pairing the sources in the list of each term. Sources are
    paired as the result asks for every pair.
    """
    marginal = cells.groupBy("lang", "source", "n").agg(F.sum("terms").alias("terms"))
    one = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("a_total"), F.col("own_terms").alias("a_terms"), "v")
    two = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("b_total"), F.col("own_terms").alias("b_terms"))
    pairs = one.join(two, "lang").filter("a < b")
    filled = pairs.filter("v > 0").withColumn("a_none", F.expr(_share("0", "a_total", "v"))).withColumn("b_none", F.expr(_share("0", "b_total", "v")))
    neither = filled.select("lang", "a", "b", F.expr(f"(v - a_terms - b_terms) * ({_gap('a_none', 'b_none')})").alias("value"))

    def lone(own: str, other: str) -> DataFrame:
        had = filled.join(marginal.withColumnRenamed("source", own), ["lang", own]).withColumn("p", F.expr(_share("n", f"{own}_total", "v")))
        return had.select("lang", "a", "b", F.expr(f"terms * ({_gap('p', f'{other}_none')})").alias("value"))

    # The sources of a language by name, with their sums and their share of a term they lack.
    named = F.map_from_entries(F.collect_list(F.struct("source", F.struct("total", F.expr(_share("0", "total", "v")).alias("none")))))
    sums = groups.filter("v > 0").groupBy("lang").agg(named.alias("sums"), F.first("v").alias("v"))
    shares = F.expr(f"transform(by, x -> named_struct('source', x.source, 'p', {_share('x.n', 'sums[x.source].total', 'v')}, 'none', sums[x.source].none))")
    met = kept.filter("size(by) > 1").join(sums, "lang").select("lang", shares.alias("by"))
    met = met.select("lang", "by", F.posexplode("by").alias("at", "x")).select("lang", "x", F.explode(F.expr("slice(by, at + 2, size(by))")).alias("y"))
    right_value = f"({_gap('x.p', 'y.p')}) - ({_gap('x.p', 'y.none')}) - ({_gap('x.none', 'y.p')}) + ({_gap('x.none', 'y.none')})"
    met = met.select("lang", F.least("x.source", "y.source").alias("a"), F.greatest("x.source", "y.source").alias("b"), F.expr(right_value).alias("value"))
    both = met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    empty = pairs.filter("v = 0").select("lang", "a", "b", F.lit(0).cast("long").alias("value"))
    summed = neither.union(lone("a", "b")).union(lone("b", "a")).union(both).union(empty).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    turned = summed.select("lang", sides.alias("side"), "value").select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return turned.withColumn("rank", F.row_number().over(order))
