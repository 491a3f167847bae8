"""Source divergence audit: how far the sources of a language stand apart, and the terms that they overuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, let, materialise

#: A term is a run of letters A-Z, a-z and characters beyond ASCII; only A-Z are lowered.
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A language keeps the terms of so many of its documents; what is added to each count; a share of 1; terms listed a group.
LEAST_DOCUMENTS, PRIOR, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Below this total, SCALE times a count fits a long; from it on shares are computed as decimals.
LONG_TOTAL = 9_000_000_000


def term_counts(text: Column) -> Column:
    """array<struct<term, n>>: the different terms of a text and how often each occurs, without a shuffle: in the sorted
    terms, the places where a new one begins are as far apart as it has occurrences."""
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), NO_TERM), lambda x: x != "")

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        last = lambda at: F.transform(
            at, lambda b, k: F.struct(F.get(s, b).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - b).cast("bigint").alias("n"))
        )
        return F.when(F.size(s) > 0, let(first, last))

    return let(F.sort_array(words), runs)


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * count / total), exactly."""
    narrow = F.call_function("div", count * F.lit(SCALE), total)
    wide = F.call_function("div", count.cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(19,0)"))
    return F.when(total < LONG_TOTAL, narrow).otherwise(wide) + 1


def _spread(entries: Column, width: Column) -> Column:
    """array<bigint> of width: entries (struct<at, n>, ascending) at their places, 0 between them."""
    zeros = lambda n: F.array_repeat(F.lit(0).cast("bigint"), n)
    parts = F.transform(entries, lambda e, k: F.concat(zeros(e["at"] - F.coalesce(F.get(entries, k - 1)["at"], F.lit(-1)) - 1), F.array(e["n"])))
    return F.concat(F.flatten(parts), zeros(width - F.element_at(entries, -1)["at"] - 1))


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: for each other source of the language the sum over its kept terms
    of the distance of the two shares; all ranks. Part `term`: kept terms whose share in the source is above that in the
    language, and by how much; the first `top`. Ranks by value falling, ties by item in UTF-8 order.

    Each term of a language becomes an array of its counts by source (sources numbered in order). A row of that and one
    source after the other emit that source's distances to the later ones, summed before they are shuffled, so that a
    term, a source or a language with most of the rows is no task of its own. Memory of a row is that of an array of
    the language's sources. Pairs of sources are what is asked for; their number is that of the result's rows.

    Null text, lang and source count as ''; a group of documents without terms has its rows of part `pair` (0 where the
    language keeps no term) and none of part `term`. Repeated rows count each. No document: no row. Counts are exact up to
    2^63. Other columns are ignored, whatever their names.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source"), (text, "text"))))
    groups = docs.groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("names"))
    groups = materialise(groups, "groups")
    # the counts of a row's terms are taken out row by row; what a partition has of a group and term is summed before the shuffle
    terms = docs.select("lang", "source", F.inline(term_counts(F.col("text"))))
    counts = terms.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    places = broadcast_if_small(groups.select("lang", F.posexplode("names").alias("at", "source")))
    counts = counts.join(places, ["lang", "source"])
    wide = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.sort_array(F.collect_list(F.struct("at", "n"))).alias("entries"))
    wide = wide.where(F.col("docs") >= least).join(broadcast_if_small(groups), "lang")
    wide = materialise(wide.select("lang", "term", "all", _spread(F.col("entries"), F.size("names")).alias("counts")), "wide")
    # totals by language and place, and shares' denominators as arrays
    sums = wide.select("lang", F.posexplode("counts").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms"))
    sums = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("s"), F.max("terms").alias("terms"))
    below = F.transform("s", lambda x: x["n"] + PRIOR * F.col("terms"))
    sums = sums.select("lang", below.alias("below"), (F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]) + PRIOR * F.col("terms")).alias("below_all"))
    shares = wide.join(broadcast_if_small(materialise(sums, "sums")), "lang").select(
        "lang",
        "term",
        "counts",
        F.zip_with("counts", "below", lambda c, b: _share(c + PRIOR, b)).alias("p"),
        _share(F.col("all") + PRIOR, F.col("below_all")).alias("q"),
    )
    shares = materialise(shares, "shares")

    each = shares.select("lang", "p", F.posexplode("p").alias("i", "own"))
    later = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda x, k: F.struct((F.col("i") + k + 1).alias("j"), F.abs(x - F.col("own")).alias("f")))
    apart = each.select("lang", "i", F.inline(later)).groupBy("lang", "i", "j").agg(F.sum("f").alias("f"))
    both = apart.select("lang", F.explode(F.array(F.struct("i", "j", "f"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "f"))).alias("x")).select("lang", "x.*")
    own = groups.select("lang", "names", F.posexplode("names").alias("i", "source"))
    pairs = own.select("lang", "source", "i", F.posexplode("names").alias("j", "item")).where("i <> j").join(both, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0)).cast("bigint").alias("value"))

    over = shares.select("lang", "term", "q", F.posexplode(F.arrays_zip("counts", "p")).alias("i", "x")).where("x.counts > 0 and x.p > q")
    over = over.join(places.withColumnRenamed("at", "i"), ["lang", "i"])
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("x.p") - F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(over).where(F.col("rank") <= top))


#: The same in SQL (of DuckDB).
SQL = r"""
with d as (
  select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') ts
  from documents
), g as (select distinct lang, source from d
), o as (select r, lang, source, unnest(ts) term from d
), k as (select lang, term from o group by lang, term having count(distinct r) >= 30
), v as (select lang, count(*) v from k group by lang
), n as (select lang, source, term, count(*) c from o semi join k using (lang, term) group by all
), full_ as (select g.lang, g.source, k.term, coalesce(c, 0) c from g join k using (lang) left join n on n.lang = g.lang and n.source = g.source and n.term = k.term
), p as (
  select lang, source, term, c, 1 + 1000000000 * (c::hugeint + 5) // (sum(c) over (partition by lang, source) + 5 * v)::hugeint p from full_ join v using (lang)
), t as (select lang, term, sum(c)::hugeint c from full_ group by all
), q as (select lang, term, 1 + 1000000000 * (c + 5) // (sum(c) over (partition by lang) + 5 * v)::hugeint q from t join v using (lang)
), pairs as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(s.f, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (
    select x.lang, x.source a, y.source b, sum(abs(x.p - y.p)) f from p x join p y on x.lang = y.lang and x.term = y.term group by all
  ) s on s.lang = a.lang and s.a = a.source and s.b = b.source
), terms as (
  select p.lang, p.source, 'term' part, p.term item, (p - q)::bigint as value from p join q on p.lang = q.lang and p.term = q.term where c > 0 and p > q
), every as (select * from pairs union all select * from terms)
select lang, source, part, item, value, rank::int as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) rank from every)
where part = 'pair' or rank <= 50
"""
