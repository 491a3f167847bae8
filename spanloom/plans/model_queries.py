"""Queries over layers of networks and over a training run, each with its SQL. Weights are fixed numbers."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics, tensors
from ..operators import layers
from ..session import work_path, written
from ..streaming.training import Validator
from .array_queries import _PREDICTIONS, _predictions, _sums
from .text_queries import bigints, read

#: Width 3, one feature, two filters; and the filters' biases.
KERNEL, BIAS = ((0.5, -1.0), (1.0, 0.25), (-0.5, 2.0)), (0.1, -0.2)
CHUNK = 16
#: Of a simple cell: input, recurrent, bias.
AHEAD, BEHIND = (0.7, 0.5, 0.1), (-0.4, 0.3, 0.0)
CODES = 128


def _cell(weights: tuple[float, float, float]) -> layers.Simple:
    return layers.Simple(np.array([[weights[0]]]), np.array([[weights[1]]]), np.array([weights[2]]))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").where("embedding is not null")
    return rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as steps of one feature through a convolution of two filters."""
    rows = _vectors(spark, sf_dir).select("vec_id", tensors.tensor(F.col("e"), F.array(F.size("e"), F.lit(1))).alias("t"))
    found = layers.apply_layers(rows, "t", [layers.Convolution(np.array(KERNEL)[:, None, :], np.array(BIAS))])
    places = tensors.exploded(found, ["vec_id"], "output", 2)
    return bigints(places.select("vec_id", F.col("i0").alias("step"), F.col("i1").alias("filter"), F.round("value", 6).alias("value")))


def _filter_sql(f: int) -> str:
    x = [f"coalesce(e[i + {k}], 0) * {KERNEL[k][f]}" for k in range(3)]
    return f"greatest(0, case when i = 0 then 0 else {x[0]} end + {x[1]} + {x[2]} + ({BIAS[f]}))"


CONVOLUTION = f"""with s as (select vec_id, embedding::double[] e, unnest(range(0, len(embedding))) i from embeddings where embedding is not null),
v as (select vec_id, i, unnest([{_filter_sql(0)}, {_filter_sql(1)}]) x, unnest([0, 1]) f from s)
select vec_id, cast(i as bigint) step, cast(f as bigint) "filter", round(x, 6) as value from v"""


def half_stateful_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector in chunks of steps: a cell that goes on over chunks, and one that goes back within each, added."""
    at = F.transform(F.sequence(F.lit(0), F.ceil(F.size("e") / CHUNK).cast("int") - 1), lambda k: F.slice("e", k * CHUNK + 1, F.lit(CHUNK)))
    rows = _vectors(spark, sf_dir).where("size(e) > 0").select("vec_id", F.posexplode(at).alias("chunk", "c"))
    rows = rows.select("vec_id", "chunk", tensors.tensor(F.col("c"), F.array(F.size("c"), F.lit(1))).alias("t"))
    found = layers.half_stateful(rows, "vec_id", "chunk", "t", layers.Recurrent(_cell(AHEAD), _cell(BEHIND), "sum"))
    places = tensors.exploded(found, ["vec_id", "chunk"], "output", 2)
    return bigints(places.select("vec_id", (F.col("chunk") * CHUNK + F.col("i0")).alias("step"), F.round("value", 6).alias("value")))


HALF_STATEFUL_SCAN = f"""with recursive e as materialized (select vec_id, embedding::double[] e, len(embedding) n from embeddings where len(embedding) > 0),
f as (select vec_id, 0 i, 0.0::double h from e union all select f.vec_id, i + 1, tanh({AHEAD[0]} * e[i + 1] + {AHEAD[1]} * h + {AHEAD[2]}) from f join e using (vec_id) where i < n),
b as (select vec_id, n + 1 i, 0.0::double h from e
  union all select b.vec_id, i - 1, tanh(({BEHIND[0]}) * e[i - 1] + {BEHIND[1]} * (case when (i - 1) % {CHUNK} = 0 or i - 1 = n then 0 else h end) + {BEHIND[2]}) from b join e using (vec_id) where i > 1)
select vec_id, cast(i - 1 as bigint) step, round(f.h + b.h, 6) as value from f join b using (vec_id, i) where i >= 1"""


def word_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different words of conversations, embedded by their characters: the last state from either side."""
    words = read(spark, sf_dir, "conversations").select(F.explode(F.split("text", "[ \n]+")).alias("word")).where("word <> ''").distinct()
    codes = F.transform(F.split("word", ""), lambda c: F.least(F.ascii(c), F.lit(CODES - 1)))
    found = layers.embed_words(words.select("word", F.array(codes).alias("c")), "c", np.arange(CODES)[:, None] / 100.0, _cell(AHEAD), _cell(BEHIND))
    return found.select("word", *(F.round(F.get("output.values", F.lit(k)), 6).alias(name) for k, name in enumerate(("ahead", "behind"))))


WORD_STATES = f"""with recursive w as materialized (select distinct unnest(string_split_regex(text, '[ \n]+')) word from conversations),
c as materialized (select word, length(word) n, list_transform(string_split(word, ''), lambda x: least(ascii(x), {CODES - 1}) / 100.0) v from w where word <> ''),
s as (select word, 0 i, 0.0::double a, 0.0::double b from c
  union all select s.word, i + 1, tanh({AHEAD[0]} * v[i + 1] + {AHEAD[1]} * a + {AHEAD[2]}), tanh(({BEHIND[0]}) * v[n - i] + {BEHIND[1]} * b + {BEHIND[2]}) from s join c using (word) where i < n)
select word, round(a, 6) ahead, round(b, 6) behind from s join c using (word) where i = n"""


def validated_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as a stream, scored epoch by epoch by the sink that keeps the best."""
    base = work_path(spark, "training")
    rows = _predictions(spark, sf_dir).select("epoch", F.col("t").alias("y_true"), F.col("p").alias("y_pred"))
    coming = spark.readStream.schema(rows.schema).parquet(written(rows, "predictions").work_path)
    sink = Validator({"p": metrics.precision, "r": metrics.recall}, "r", prefix=f"{base}/run", stream=io.StringIO())
    coming.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/at").trigger(availableNow=True).start().awaitTermination()
    lines = sink.log(spark)
    scores, verdicts = lines.where("text like 'p - %'"), lines.where("text not like 'p - %'")
    return scores.select("epoch", F.col("text").alias("scores")).join(verdicts.select("epoch", F.col("text").like("r improved from %").alias("improved")), "epoch")


VALIDATED_EPOCHS = f"""with {_PREDICTIONS}, s as (select epoch, {_sums("t * p")} / ({_sums("p")} + 1e-7) p, {_sums("t * p")} / ({_sums("t")} + 1e-7) r from pr group by epoch)
select epoch, format('p - {{:.3f}} | r - {{:.3f}}', p, r) scores, r > coalesce(max(r) over (order by epoch rows between unbounded preceding and 1 preceding), -1) improved from s"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (convolution, half_stateful_scan, word_states, validated_epochs)}


def oracle_sql() -> dict[str, str]:
    return {"convolution": CONVOLUTION, "half_stateful_scan": HALF_STATEFUL_SCAN, "word_states": WORD_STATES, "validated_epochs": VALIDATED_EPOCHS}
