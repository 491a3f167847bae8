"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, conversation_repair, decontaminate, divergence, embedding_dedup, html_text, language, line_dedup, nearest, simhash, substring_dedup, token_files, toxicity
from .common import table, work_path

END_ID = 2


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item and where. Null and empty texts hold none; repeated rows count once; empty tables give no rows."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row its language; `und`, 0 for a text that is null or has no letter; repeated rows stay; an empty table gives no rows."""
    return language.identify(table(spark, sf_dir, "documents")).drop("shares")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row its digests; null text counts as empty; repeated rows stay; an empty table gives no rows."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip_digest(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row its fingerprint and component; null and wordless texts have fingerprint zero; repeated rows stay; an empty table gives no rows."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page its text; null html counts as empty, a page without blocks has the empty text; repeated rows stay; an empty table gives no rows."""
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row its score; null and empty texts have the score of no terms; repeated rows stay; an empty table gives no rows."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that other texts repeat; null and short texts have none; repeated rows are copies of each other; an empty table gives no rows."""
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row its place in the files; null text counts as empty and has its end id; repeated rows stay; an empty table gives no rows."""
    words = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), work_path(spark, "tokens"), words, END_ID)
    return token_files.read_token_files(spark, manifest, digest=True)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row its text without boilerplate; null text stays null; repeated rows are pages of their own; an empty table gives no rows."""
    docs = line_dedup.drop_boilerplate_lines(table(spark, sf_dir, "documents"))
    return docs.selectExpr("doc_id", "text", "cast(__sl_lines as bigint) n_lines", "cast(__sl_dropped as bigint) n_dropped")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row its links; what is no finite vector with a label has none; repeated rows link with each other; an empty table gives no rows."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts, langs and sources as ''; an empty table gives no rows (divergence.divergence)."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conv_id has its row; an empty table gives none (conversation_repair.repair)."""
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are null, zero or not finite take no part; an empty table gives no rows (nearest.nearest)."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
with d as (
  select doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w
  from documents where text is not null
), b as (
  select distinct item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w
  from benchmark where text is not null
), bi as (
  select item_id, w, len(w) n, least(13, len(w)) z, case when len(w) >= 13 then 11 else len(w) end need
  from b where len(w) >= 5
), dg as (
  select doc_id, w, unnest(range(0, len(w) - 3)) p from d where len(w) >= 4
), bg as (
  select item_id, w, unnest(range(0, n - 3)) p from bi
), shifts as (
  select distinct dg.doc_id, bg.item_id, dg.p - bg.p s
  from (select doc_id, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] || ' ' || w[p + 4] g from dg) dg
  join (select item_id, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] || ' ' || w[p + 4] g from bg) bg using (g)
), al as (
  select s.doc_id, s.item_id, s.s, z, need, greatest(0, -s.s) lo, least(n, len(d.w) - s.s) hi, d.w dw, bi.w bw
  from shifts s join d on d.doc_id is not distinct from s.doc_id join bi on bi.item_id is not distinct from s.item_id
), eq as (
  select doc_id, item_id, s, z, need, lo, hi,
         list_transform(range(lo, hi), lambda j: case when dw[j + s + 1] = bw[j + 1] then 1 else 0 end) e
  from al where hi - lo >= z
), good as (
  select doc_id, item_id, s, lo, z,
         list_filter(range(0, hi - lo - z + 1), lambda k: list_sum(e[k + 1 : k + z]) >= need) g
  from eq
), one as (
  select distinct doc_id, item_id, s, len(g) n, lo + s + list_min(g) a, lo + s + list_max(g) + z - 1 c
  from good where len(g) > 0
)
select doc_id, item_id, cast(sum(n) as bigint) n_windows, cast(min(a) as bigint) first_word, cast(max(c) as bigint) last_word
from one group by doc_id, item_id
"""

OP9_SQL = """
with p as (
  select row_number() over () r, doc_id, source, text, string_split(text, chr(10)) ls from documents
), t as (
  select source, count(*) pages from documents group by source
), u as (
  select distinct r, source, k
  from (select r, source, unnest(list_transform(ls, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) k from p)
  where k <> ''
), c as (
  select source, k, count(*) n from u group by source, k having count(*) >= 5
), bad as (
  select c.source, list(k) ks from c join t on c.source is not distinct from t.source
  where cast(n as double) / pages > 0.1 group by c.source
), f as (
  select p.doc_id, text, ls, ks,
         list_filter(ls, lambda x: not list_contains(ks, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) kept
  from p left join bad on p.source is not distinct from bad.source
)
select doc_id,
       case when ks is null or text is null then text else array_to_string(kept, chr(10)) end as text,
       cast(coalesce(len(ls), 0) as bigint) n_lines,
       cast(case when ks is null or text is null then 0 else len(ls) - len(kept) end as bigint) n_dropped
from f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_decontaminate, op2_language, op3_byte_bpe, op4_simhash, op5_html_text, op6_toxicity, op7_substring_dedup, op8_token_files, op9_line_dedup, op10_embedding_dedup, op11_source_divergence, op12_conversation_repair, op13_nearest)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op9_line_dedup": OP9_SQL, "op11_source_divergence": divergence.SQL, "op12_conversation_repair": conversation_repair.SQL}
