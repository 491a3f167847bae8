"""Queries over texts and spans, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import patterns
from ..operators import corpus, segments

#: The default patterns in RE2's words.
SQL_PATTERNS = (r"[0-9]*\.?[0-9]+", r"[\p{L}\p{N}_]+", r"[^\s\v\x{1c}-\x{1f}\x{85}\p{Z}\p{L}\p{N}_]")
#: Overlapping targets: this long, this far apart.
LONG, APART = 40, 25


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bigints(df: DataFrame) -> DataFrame:
    """Integer columns as bigint, as the SQL side has them."""
    return df.select(*[F.col(f"`{n}`").cast("bigint").alias(n) if t in ("int", "smallint") else F.col(f"`{n}`") for n, t in df.dtypes])


def token_rows(df: DataFrame, key: str, which=patterns.DEFAULT) -> DataFrame:
    """doc_id, ord, start, stop, data"""
    tokens = patterns.tokenise(df.select(F.col(key).alias("doc_id"), "text"), patterns=which)
    rows = tokens.select("doc_id", F.posexplode("tokens").alias("ord", "t"))
    return rows.select("doc_id", "ord", "t.start", "t.stop", "t.data")


def target_rows(df: DataFrame, key: str) -> DataFrame:
    """Spans of LONG places, APART from each other, that cover each text."""
    n = F.char_length("text")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(APART))).otherwise(F.array().cast("array<int>"))
    rows = df.select(F.col(key).alias("doc_id"), n.alias("n"), F.posexplode(starts).alias("ord", "start"))
    return rows.select("doc_id", "ord", "start", F.least(F.col("start") + LONG, F.col("n")).alias("stop"))


def tokens_sql(table: str, key: str, which: tuple[str, ...] = SQL_PATTERNS) -> str:
    """CTEs that end in tok(doc_id, ord, start, stop, data)."""
    out, found = [f"m0 as (select {key} doc_id, text from {table} where text is not null)"], []
    for k, p in enumerate(which):
        out.append(
            f"""g{k} as materialized (select doc_id, string_split_regex(text, '{p}') gaps, regexp_extract_all(text, '{p}') hits from m{k}),
            r{k} as materialized (select doc_id, i, gaps[i] gap, coalesce(hits[i], '') hit from (select *, unnest(range(1, len(gaps) + 1)) i from g{k})),
            p{k} as (select *, sum(length(gap) + length(hit)) over (partition by doc_id order by i) stop from r{k}),
            m{k + 1} as materialized (select doc_id, string_agg(gap || repeat(' ', length(hit)), '' order by i) as text from r{k} group by doc_id)"""
        )
        found.append(f"select doc_id, cast(stop - length(hit) as bigint) as start, cast(stop as bigint) as stop, hit as data from p{k} where hit <> ''")
    out.append(f"tk as materialized ({' union all '.join(found)})")
    out.append('tok as materialized (select doc_id, cast(row_number() over (partition by doc_id order by "start", stop) - 1 as bigint) ord, "start", stop, data from tk)')
    return ", ".join(out)


def targets_sql(table: str, key: str) -> str:
    """A CTE tgt(doc_id, ord, start, stop)."""
    return f"""tgt as (select doc_id, cast("start" // {APART} as bigint) ord, cast("start" as bigint) as start, cast(least("start" + {LONG}, n) as bigint) as stop
        from (select {key} doc_id, length(text) n, unnest(range(0, length(text), {APART})) as start from {table} where text is not null))"""


OVERLAP = '((t."start" <= a."start" and a."start" < t.stop) or (a."start" <= t."start" and t."start" < a.stop))'


def tokenise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts need no places, so masking and counting are the JVM's; see patterns.counts."""
    counted = read(spark, sf_dir, "documents").select("lang", patterns.counts(F.col("text")).alias("found"))
    sums = counted.groupBy("lang").agg(*[F.sum(F.col("found")[kind][n]).alias(f"{kind}_{n}") for kind in patterns.KINDS for n in ("n_tokens", "n_chars")])
    rows = F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), *(F.col(f"{kind}_{n}").alias(n) for n in ("n_tokens", "n_chars"))) for kind in patterns.KINDS]))
    return sums.select("lang", rows).where("n_tokens > 0")


TOKENISE_COUNTS = f"""
with m as (select lang, text, regexp_replace(text, '{SQL_PATTERNS[0]}', ' ', 'g') w from documents where text is not null),
n as (select *, regexp_replace(w, '{SQL_PATTERNS[1]}', ' ', 'g') x from m),
u as (select lang, 'numeric' kind, unnest(regexp_extract_all(text, '{SQL_PATTERNS[0]}')) hit from n
  union all select lang, 'word', unnest(regexp_extract_all(w, '{SQL_PATTERNS[1]}')) from n
  union all select lang, 'misc', unnest(regexp_extract_all(x, '{SQL_PATTERNS[2]}')) from n)
select lang, kind, count(*) n_tokens, cast(sum(length(hit)) as bigint) n_chars from u group by lang, kind
"""


def tokenise_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bigints(token_rows(read(spark, sf_dir, "documents"), "doc_id"))


TOKENISE_SPANS = f'with {tokens_sql("documents", "doc_id")} select doc_id, ord, "start", stop, data from tok'


def ptransform_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [(r"[0-9]+", "0"), (r"(\p{L}+), (\p{L}+)", "$2 $1"), (r"[ \t\n]+", " ")]
    text = patterns.strip(patterns.transform(F.col("text"), steps))
    return read(spark, sf_dir, "documents").select("doc_id", text.alias("normal"))


PTRANSFORM_NORMALISE = r"""
select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]+', '0', 'g'), '(\p{L}+), (\p{L}+)', '\2 \1', 'g'), '[ \t\n]+', ' ', 'g')) normal
from documents
"""


def segment_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_borders(read(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "start", "stop")


def sentence_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.sentence_borders(read(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "start", "stop")


def _borders_sql(gap: int) -> str:
    return f"""
select conv_id, turn, cast(e - n as bigint) as start, cast(e as bigint) as stop from (
  select conv_id, turn, n, sum(n) over w + {gap} * (row_number() over w - 1) e
  from (select conv_id, turn, coalesce(length(text), 0) n from conversations) window w as (partition by conv_id order by turn))
"""


def _abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as abstracts: the first line is the title, the rest the body."""
    at = F.instr("text", "\n")
    title = F.when(at > 0, F.expr("substring(text, 1, instr(text, '\n') - 1)")).otherwise(F.col("text"))
    body = F.when(at > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.lit(""))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), title.alias("title"), body.alias("body"))


ABSTRACTS = """ab as (select doc_id id, case when p > 0 then substr(text, 1, p - 1) else text end title,
  case when p > 0 then substr(text, p + 1) else '' end body from (select doc_id, text, instr(text, chr(10)) p from documents))"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.records(corpus.align(_abstracts(spark, sf_dir)))
    return bigints(rows.select("id", "part", "text", F.size("annotation").alias("n_annotations"), F.size("borders").alias("n_borders")))


RECORDS = f"""with {ABSTRACTS} select id, 'T' part, title as text, cast(0 as bigint) n_annotations, cast(0 as bigint) n_borders from ab
union all select id, 'A', body, 0, 0 from ab"""


def flatten_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.flatten(corpus.align(_abstracts(spark, sf_dir)), "ord")
    return rows.groupBy("part").agg(F.count("ord").alias("n"), F.sum(F.char_length("text")).alias("n_chars"))


FLATTEN_PARTS = f"""with {ABSTRACTS}, f as (select 'T' part, id, title as text from ab union all select 'A', id, body from ab)
select part, count(id) n, cast(sum(length(text)) as bigint) n_chars from f group by part"""


def align_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand in for annotations: a span over the title, labelled by quality."""
    labels = read(spark, sf_dir, "labels")
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("stop"), F.col("quality").cast("string").alias("data")))
    side = labels.select(F.col("doc_id").alias("id"), spans.alias("title"), F.array().cast(corpus.SPANS).alias("body"), F.col("toxic").alias("ord"))
    rows = corpus.records(corpus.align(_abstracts(spark, sf_dir), side))
    return bigints(rows.select("id", "part", F.size("annotation").alias("n"), F.get("annotation", F.lit(0))["data"].alias("label")))


ALIGN_LABELS = """
with l as (select doc_id, arg_max(quality, toxic) q from labels group by doc_id), j as (select d.doc_id id, l.doc_id hit, q from documents d left join l using (doc_id))
select id, 'T' part, cast(case when hit is null then 0 else 1 end as bigint) n, case when hit is null then null else cast(q as varchar) end as label from j
union all select id, 'A', 0, null from j
"""


def intersects_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    met = segments.overlaps(token_rows(items, "item_id"), target_rows(items, "item_id"))
    return bigints(met.select("doc_id", "ord", "t_ord", "start", "t_start"))


INTERSECTS_PAIRS = f"""with {tokens_sql("benchmark", "item_id")}, {targets_sql("benchmark", "item_id")}
select a.doc_id, a.ord, t.ord t_ord, a."start", t."start" t_start from tok a join tgt t on a.doc_id = t.doc_id and {OVERLAP}"""


def intersects_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "documents")
    met = segments.overlaps_in_buckets(token_rows(items, "doc_id"), target_rows(items, "doc_id"), 512)
    return bigints(met.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("ord") * F.col("t_ord")).alias("mix")))


INTERSECTS_BUCKETED = f"""with {tokens_sql("documents", "doc_id")}, {targets_sql("documents", "doc_id")}
select a.doc_id, count(*) n_pairs, cast(sum(a.ord * t.ord) as bigint) mix from tok a join tgt t on a.doc_id = t.doc_id and {OVERLAP} group by a.doc_id"""


def contains_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    points = items.select(F.col("item_id").alias("p_doc"), F.explode(F.sequence(F.lit(0), F.char_length("text"), F.lit(7))).alias("point"))
    span = F.struct("start", "stop")
    met = token_rows(items, "item_id").join(points, (F.col("doc_id") == F.col("p_doc")) & iv.covers(span, F.col("point")))
    return bigints(met.select("doc_id", "ord", "point", iv.holds(F.struct("data"), F.lit("the")).alias("is_the")))


CONTAINS_POINT = f"""with {tokens_sql("benchmark", "item_id")}, pt as (select item_id doc_id, unnest(range(0, length(text) + 1, 7)) point from benchmark)
select tok.doc_id, ord, cast(point as bigint) point, data = 'the' is_the from tok join pt on tok.doc_id = pt.doc_id and "start" <= point and point < stop"""


def extract_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = patterns.tokenise(read(spark, sf_dir, "benchmark"))
    pieces = docs.select("item_id", "tokens", iv.extract(F.col("text"), F.col("tokens")).alias("pieces"))
    rows = pieces.select("item_id", F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("pieces").alias("piece"))))
    token = F.col("token")
    return bigints(
        rows.select("item_id", token["start"].alias("start"), iv.length(token).alias("n"), "piece", iv.render(token).alias("shown"), F.size(iv.positions(token)).alias("n_places"))
    )


EXTRACT_SPANS = f"""with {tokens_sql("benchmark", "item_id")}
select doc_id item_id, "start", stop - "start" n, substr(b.text, "start" + 1, stop - "start") piece,
  'Interval(start=' || "start" || ', stop=' || stop || ', data=' || data || ')' shown, stop - "start" n_places
from tok join benchmark b on b.item_id = tok.doc_id"""


def unextract_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = token_rows(read(spark, sf_dir, "benchmark"), "item_id", (patterns.WORDLIKE,))
    filled = segments.scatter(words, F.lit("_"))
    return bigints(filled.select("doc_id", "start", F.array_join("chars", "").alias("filled")))


UNEXTRACT_FILL = f"""with {tokens_sql("benchmark", "item_id", SQL_PATTERNS[1:2])},
l as (select *, lag(stop, 1, "start") over (partition by doc_id order by ord) before from tok)
select doc_id, min("start") as start, string_agg(repeat('_', "start" - before) || data, '' order by ord) filled from l group by doc_id"""


def interval_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    targets = target_rows(items, "item_id").withColumn("data", F.lit("t"))
    merged = segments.merge_groups(targets.withColumn("grp", F.lit(1)))
    per_doc = merged.select("doc_id", F.col("start").alias("m_start"), F.col("stop").alias("m_stop"), F.size("data").alias("n"))
    spans = segments.document_spans(token_rows(items, "item_id"))
    return bigints(spans.join(per_doc, "doc_id"))


INTERVAL_SPAN = f"""with {tokens_sql("benchmark", "item_id")}, {targets_sql("benchmark", "item_id")},
s as (select doc_id, arg_min("start", ord) as start, arg_max(stop, ord) as stop from tok group by doc_id),
g as (select doc_id, min("start") m_start, arg_max(stop, "start") m_stop, count(*) n from tgt group by doc_id)
select s.doc_id, s."start", s.stop, m_start, m_stop, n from s join g using (doc_id)"""


def nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans between commas and stops, of which many are empty."""
    docs = read(spark, sf_dir, "benchmark")
    gaps = F.transform(F.split("text", "[.,]"), lambda x, i: F.struct(i.alias("start"), (i + F.char_length(x)).alias("stop"), x.alias("data")))
    kept = docs.select("item_id", F.size(gaps).alias("n_all"), iv.nonempty(gaps).alias("kept"))
    return bigints(kept.select("item_id", "n_all", F.size("kept").alias("n_kept"), F.aggregate(iv.breakpoints(F.col("kept")), F.lit(0), lambda a, x: a + x).alias("breaks")))


NONEMPTY = """
with g as (select item_id, string_split_regex(text, '[.,]') p from benchmark), u as (select item_id, len(p) n_all, unnest(range(0, len(p))) i, unnest(p) x from g)
select item_id, cast(max(n_all) as bigint) n_all, count(*) filter (x <> '') n_kept, cast(sum(i + length(x) - 1) filter (x <> '') as bigint) breaks from u group by item_id
"""


def stitchpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    return bigints(segments.stitch_points(token_rows(items, "item_id"), target_rows(items, "item_id")))


def points_sql(table: str, key: str) -> str:
    """CTEs tok, tgt and pts(doc_id, point)."""
    return f"""{tokens_sql(table, key)}, {targets_sql(table, key)},
cl as (select a.doc_id, a.ord, a."start", a.stop, min(t.ord) t_ord from tok a join tgt t on a.doc_id = t.doc_id and {OVERLAP} group by all),
pts as (select doc_id, stop - 1 point from (select *, row_number() over (partition by doc_id, t_ord order by "start" desc, ord desc) n from cl) where n > 1)"""


_POINTS = points_sql("benchmark", "item_id")
STITCHPOINTS = f"with {_POINTS} select doc_id, point from pts"


def stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    tokens = token_rows(items, "item_id")
    merged = segments.stitch(tokens, segments.stitch_points(tokens, target_rows(items, "item_id")))
    return bigints(merged.select("doc_id", "grp", "start", "stop", F.array_join("data", " ").alias("data")))


def stitch_sql(points: str) -> str:
    return f"""with {points},
fl as (select *, exists (select 1 from pts where pts.doc_id = tok.doc_id and "start" <= point and point < stop) f from tok),
nw as (select *, case when lag(f) over (partition by doc_id order by "start", ord) then 0 else 1 end b from fl),
gr as (select *, sum(b) over (partition by doc_id order by "start", ord) grp from nw)
select doc_id, cast(grp as bigint) grp, min("start") as start, arg_max(stop, "start") as stop, string_agg(data, ' ' order by "start", ord) as data from gr group by doc_id, grp"""


STITCH = stitch_sql(_POINTS)


def queries() -> dict:
    named = (
        tokenise_counts, tokenise_spans, ptransform_normalise, segment_borders, sentence_borders, records, flatten_parts, align_labels, intersects_pairs,
        intersects_bucketed, contains_point, extract_spans, unextract_fill, interval_span, nonempty, stitchpoints, stitch,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "tokenise_counts": TOKENISE_COUNTS,
        "tokenise_spans": TOKENISE_SPANS,
        "ptransform_normalise": PTRANSFORM_NORMALISE,
        "segment_borders": _borders_sql(0),
        "sentence_borders": _borders_sql(1),
        "records": RECORDS,
        "flatten_parts": FLATTEN_PARTS,
        "align_labels": ALIGN_LABELS,
        "intersects_pairs": INTERSECTS_PAIRS,
        "intersects_bucketed": INTERSECTS_BUCKETED,
        "contains_point": CONTAINS_POINT,
        "extract_spans": EXTRACT_SPANS,
        "unextract_fill": UNEXTRACT_FILL,
        "interval_span": INTERVAL_SPAN,
        "nonempty": NONEMPTY,
        "stitchpoints": STITCHPOINTS,
        "stitch": STITCH,
    }
