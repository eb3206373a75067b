"""Queries on pixels, patches, masks, biases and losses, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import fixture, images, table
from ..functions import pixels as px
from ..operators import payloads, tensors
from .tile_queries import duck, query

_NOISE = "(sample * 7919 + patch * 104729 + 12345) % 1000003"
_MASK = f"cells AS (SELECT DISTINCT sample, patch FROM patches), mask AS (SELECT sample, patch, CAST(row_number() OVER (PARTITION BY sample ORDER BY {_NOISE}, patch) - 1 AS INT) AS rank FROM cells), kept AS (SELECT * FROM mask WHERE rank < 9)"
_NORM = "stats AS (SELECT sample, patch, avg(v) AS m, sum(v * v) / 3 - sum(v) * sum(v) / 12 AS s FROM patches GROUP BY sample, patch), norm AS (SELECT sample, patch, elem, (v - m) / sqrt(s + 1e-6) AS v FROM patches JOIN stats USING (sample, patch))"
#: 2^(-(h + 1) / 2) for 16 heads and 2^(-2 (h + 1)) for 4.
_SLOPE16 = "pow(2.0, -0.5 * (h + 1))"
_SLOPE4 = "pow(2.0, -2.0 * (h + 1))"


def _bias(heads: int, side: int, slope: str, scale: float = 1.0) -> str:
    return f"bias AS (SELECT CAST(h AS INT) AS head, CAST(i AS INT) AS i, CAST(j AS INT) AS j, -{slope} * {scale} * sqrt(pow(i // {side} - j // {side}, 2) + pow(i % {side} - j % {side}, 2)) + 0.0 AS bias FROM range({heads}) a(h), range({side * side}) b(i), range({side * side}) c(j))"


def _r(name: str, digits: int = 6):
    return (F.round(name, digits) + 0.0).alias(name)


def _exploded(df: DataFrame, data) -> DataFrame:
    return df.select("tile", F.posexplode(data).alias("k", "value"))


def _masks(spark, sf_dir):
    return tensors.mask(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample")), 16)


def _patches(spark, sf_dir):
    return fixture(spark, sf_dir, "patches")


def _flat(value: str = "value", where: str = "TRUE", index: str = "row * 16 + col * 4 + ch") -> str:
    return duck("pixels", select=f"SELECT tile, CAST({index} AS INT) AS k, {value} AS value FROM pixels WHERE {where}")


@query(duck("pixels", select="SELECT tile, row, col, CAST(floor(greatest(0, least(1, value / 150.0)) * 255) AS INT) AS sar, CAST(CASE WHEN value >= 150 THEN 0 ELSE floor(value / 150.0 * 256) END AS INT) AS wrapped FROM pixels WHERE ch = 0"))
def sar_scale(spark, sf_dir):
    p = fixture(spark, sf_dir, "pixels").where("ch = 0")
    v = F.col("value") / F.lit(0.15)
    return p.select("tile", "row", "col", px.sar_scale(v).alias("sar"), px.sar_scale(v, wrap=True).alias("wrapped"))


@query(duck("pixels", ctes="m AS (SELECT tile, min(value) AS lo, max(value) AS hi FROM pixels GROUP BY tile)", select="SELECT tile, CAST(row * 16 + col * 4 + ch AS INT) AS k, CAST(CASE WHEN hi = lo THEN 0 ELSE trunc((value - lo) / (hi - lo) * 255) END AS INT) AS value FROM pixels JOIN m USING (tile)"))
def scale_channels(spark, sf_dir):
    return _exploded(images(spark, sf_dir), px.scale_channels(F.col("data")))


@query(_flat(where="ch IN (1, 2)", index="(row * 4 + col) * 2 + ch - 1"))
def remove_channels(spark, sf_dir):
    return _exploded(images(spark, sf_dir), px.remove_channels(F.col("data"), 4, [0, 3, 9]))


@query(_flat(index="ch * 16 + row * 4 + col"))
def channels_first(spark, sf_dir):
    return _exploded(images(spark, sf_dir), px.channels_first(F.col("data"), 4, 4, 4))


@query(_flat(where="row % 2 = 0 AND col % 2 = 0", index="row // 2 * 8 + col // 2 * 4 + ch"))
def half_resolution(spark, sf_dir):
    return _exploded(images(spark, sf_dir), px.half_resolution(F.col("data"), 4, 4))


@query(_flat(value="CASE WHEN ch = 3 THEN 255 ELSE value END"))
def ensure_alpha(spark, sf_dir):
    rgb = px.remove_channels(F.col("data"), 4, [3])
    return _exploded(images(spark, sf_dir).select("tile", rgb.alias("data")), px.ensure_alpha(F.col("data"), 16, 3))


@query(duck("pixels", select="SELECT tile, CAST((row * 4 + col) * 5 + ch + CASE WHEN ch >= 1 THEN 1 ELSE 0 END AS INT) AS k, value FROM pixels UNION ALL SELECT DISTINCT tile, CAST((row * 4 + col) * 5 + 1 AS INT), 7 FROM pixels"))
def add_blank_channel(spark, sf_dir):
    return _exploded(images(spark, sf_dir), px.add_blank_channel(F.col("data"), 16, 4, 1, 7))


@query(duck("pixels", select="SELECT tile, CAST((row * 4 + col) * 2 + ch AS INT) AS k, value FROM pixels WHERE ch < 2"))
def band_stack(spark, sf_dir):
    band = lambda ch: F.filter("data", lambda v, i: i % 4 == ch)
    return _exploded(images(spark, sf_dir), px.band_stack(band(0), band(1)))


@query(_flat(index="((row // 2) * 2 + col // 2) * 16 + ch * 4 + (row % 2) * 2 + col % 2"))
def patchify(spark, sf_dir):
    return _exploded(images(spark, sf_dir), px.patchify(px.channels_first(F.col("data"), 4, 4, 4), 4, 4, 4, 2))


@query(_flat(index="ch * 16 + row * 4 + col"))
def unpatchify(spark, sf_dir):
    cut = images(spark, sf_dir).select("tile", px.patchify(px.channels_first(F.col("data"), 4, 4, 4), 4, 4, 4, 2).alias("data"))
    return _exploded(cut, px.unpatchify(F.col("data"), 4, 4, 4, 2))


@query(duck("patches", ctes=_NORM, select="SELECT sample, patch, elem, round(v, 6) + 0.0 AS v FROM norm"))
def patch_normalize(spark, sf_dir):
    return tensors.patch_normalize(_patches(spark, sf_dir)).select("sample", "patch", "elem", _r("v"))


@query(duck("patches", select="SELECT sample, elem, round(sum(v) / 16, 6) + 0.0 AS v FROM patches GROUP BY sample, elem"))
def mean_pool(spark, sf_dir):
    return tensors.mean_pool(_patches(spark, sf_dir)).select("sample", "elem", _r("v"))


@query(duck("patches", ctes=_MASK, select="SELECT sample, patch, rank, rank < 9 AS keep FROM mask"))
def mask_rank(spark, sf_dir):
    return _masks(spark, sf_dir)


@query(duck("patches", ctes=_MASK, select="SELECT sample, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY patch) AS ids_restore, string_agg(CAST(patch AS VARCHAR), ',' ORDER BY rank) FILTER (rank < 9) AS ids_keep, string_agg(CASE WHEN rank < 9 THEN '0' ELSE '1' END, ',' ORDER BY patch) AS mask_for_mae FROM mask GROUP BY sample"))
def mask_restore(spark, sf_dir):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return tensors.mask_arrays(_masks(spark, sf_dir)).select("sample", *map(text, ("ids_restore", "ids_keep", "mask_for_mae")))


@query(duck("patches", ctes=_MASK, select="SELECT p.sample, rank, elem, v FROM patches p JOIN kept USING (sample, patch)"))
def mask_gather(spark, sf_dir):
    return tensors.mask_gather(_patches(spark, sf_dir), _masks(spark, sf_dir))


@query(duck("patches", ctes=_MASK, select="SELECT sample, CAST(patch // 8 AS INT) AS row, CAST(patch % 4 // 2 AS INT) AS col, max(CASE WHEN rank < 9 THEN 0 ELSE 1 END) AS removed FROM mask GROUP BY sample, patch // 8, patch % 4 // 2"))
def mask_maxpool(spark, sf_dir):
    return tensors.mask_maxpool(_masks(spark, sf_dir), 4)


@query(duck("patches", ctes=_MASK, select="SELECT p.sample, p.patch, p.elem, CASE WHEN rank < 9 THEN v ELSE 0.0 END AS v FROM patches p JOIN mask USING (sample, patch)"))
def mae_restore(spark, sf_dir):
    return tensors.mae_restore(_patches(spark, sf_dir), _masks(spark, sf_dir))


@query(duck("patches", ctes=f"{_MASK}, {_NORM}, e AS (SELECT n.sample, n.patch, sum(pow(p.v / 2 - n.v, 2)) / 4 AS l FROM norm n JOIN patches p USING (sample, patch, elem) GROUP BY n.sample, n.patch)", select="SELECT CAST(sample // 32 AS BIGINT) AS batch, round(avg(l), 6) AS loss FROM e JOIN mask USING (sample, patch) WHERE rank >= 9 GROUP BY sample // 32"))
def mae_loss(spark, sf_dir):
    p = _patches(spark, sf_dir)
    return tensors.mae_loss(p, p.withColumn("v", F.col("v") / 2), _masks(spark, sf_dir)).select("batch", _r("loss"))


@query(f"SELECT CAST(h AS INT) AS head, round({_SLOPE16}, 9) AS slope FROM range(16) r(h)")
def alibi_slopes(spark, sf_dir):
    return tensors.slopes(spark, 16).select("head", _r("slope", 9))


@query(f"WITH {_bias(16, 8, _SLOPE16, 0.5)} SELECT head, i, j, round(bias, 9) + 0.0 AS bias FROM bias")
def scaled_grid_bias(spark, sf_dir):
    return tensors.grid_bias(spark, 16, 64, 0.5).select("head", "i", "j", _r("bias", 9))


@query(f"WITH {_bias(16, 8, _SLOPE16, 0.5)} SELECT head, i, CAST(j // 4 AS INT) AS j, round(bias, 9) + 0.0 AS bias FROM bias WHERE j % 4 = 0")
def bias_stride(spark, sf_dir):
    return tensors.bias_stride(tensors.grid_bias(spark, 16, 64, 0.5)).select("head", "i", "j", _r("bias", 9))


@query(duck("patches", ctes=f"{_MASK}, {_bias(4, 4, _SLOPE4)}", select="SELECT a.sample, head, a.rank AS i, b.rank AS j, round(bias, 9) + 0.0 AS bias FROM kept a JOIN kept b USING (sample) JOIN bias ON bias.i = a.patch AND bias.j = b.patch"))
def bias_gather(spark, sf_dir):
    return tensors.bias_gather(tensors.grid_bias(spark, 4, 16), _masks(spark, sf_dir)).select("sample", "head", "i", "j", _r("bias", 9))


@query(
    f"WITH {_bias(4, 8, _SLOPE4, 0.5)}, rect AS (SELECT head, i, j // 4 AS j, bias FROM bias WHERE j % 4 = 0) "
    "SELECT head, CAST(q AS INT) AS q, CAST(k AS INT) AS k, round(f.bias, 9) + 0.0 AS flat, round(g.bias, 9) + 0.0 AS intended FROM range(16) a(q), range(64) b(k) JOIN rect f ON f.i = q + k // 16 AND f.j = k % 16 JOIN rect g USING (head) WHERE g.i = k AND g.j = q"
)
def bias_gather_rect(spark, sf_dir):
    square = tensors.grid_bias(spark, 4, 64, 0.5)
    flat, plain = (tensors.bias_gather_rect(square, 16, flat=f).withColumnRenamed("bias", n) for f, n in ((True, "flat"), (False, "intended")))
    return flat.join(plain, ["head", "q", "k"]).select("head", "q", "k", _r("flat", 9), _r("intended", 9))


@query(
    "WITH c AS (SELECT p, e, e // 4 AS part, CASE WHEN e < 8 THEN p % 8 ELSE p // 8 END / pow(10000.0, (e % 4) / 4.0) AS t FROM range(64) a(p), range(16) b(e)) "
    "SELECT CAST(p AS INT) AS position, CAST(e AS INT) AS elem, round(CASE WHEN part % 2 = 0 THEN sin(t) ELSE cos(t) END, 6) + 0.0 AS value FROM c"
)
def sincos_embed(spark, sf_dir):
    return tensors.sincos(spark, 16, 8).select("position", "elem", _r("value"))


_UNIT = "u AS (SELECT vec_id AS sample, unnest(embedding) AS v, unnest(range(len(embedding))) AS e FROM embeddings)"


@query(f"WITH {_UNIT}, n AS (SELECT sample, sqrt(sum(CAST(v AS DOUBLE) * v)) AS n FROM u GROUP BY sample) SELECT sample, CAST(e AS INT) AS elem, round(CAST(v AS DOUBLE) / n, 6) + 0.0 AS v FROM u JOIN n USING (sample)")
def l2_normalize(spark, sf_dir):
    unit = tensors.l2_normalize(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.posexplode(unit).alias("elem", "v")).select("sample", "elem", _r("v"))


_LOGITS = (
    f"{_UNIT}, sides AS (SELECT sample, e // 32 AS side, e % 32 AS e, CAST(v AS DOUBLE) AS v FROM u), norms AS (SELECT sample, side, sqrt(sum(v * v)) AS n FROM sides GROUP BY sample, side), "
    "unit AS (SELECT sample, sample // 32 AS batch, side, e, v / n AS v FROM sides JOIN norms USING (sample, side)), "
    "logits AS (SELECT a.batch, a.sample AS i, b.sample AS j, sum(a.v * b.v) / 0.07 AS logit FROM unit a JOIN unit b ON a.batch = b.batch AND a.e = b.e WHERE a.side = 0 AND b.side = 1 GROUP BY a.batch, a.sample, b.sample)"
)


def _logits(spark, sf_dir):
    wide = F.col("embedding").cast("array<double>")
    return tensors.logits(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.slice(wide, 1, 32).alias("a"), F.slice(wide, 33, 32).alias("b")))


@query(f"WITH {_LOGITS} SELECT CAST(batch AS BIGINT) AS batch, i, j, round(logit, 6) + 0.0 AS logit FROM logits")
def contrastive_logits(spark, sf_dir):
    return _logits(spark, sf_dir).select("batch", "i", "j", _r("logit"))


@query(
    f"WITH {_LOGITS}, ri AS (SELECT batch, i AS k, ln(sum(exp(logit))) AS l FROM logits GROUP BY batch, i), rj AS (SELECT batch, j AS k, ln(sum(exp(logit))) AS l FROM logits GROUP BY batch, j), d AS (SELECT batch, i AS k, logit FROM logits WHERE i = j) "
    "SELECT CAST(batch AS BIGINT) AS batch, round((avg(ri.l - logit) + avg(rj.l - logit)) / 2, 6) AS loss FROM d JOIN ri USING (batch, k) JOIN rj USING (batch, k) GROUP BY batch"
)
def contrastive_loss(spark, sf_dir):
    return tensors.contrastive_loss(_logits(spark, sf_dir)).select("batch", _r("loss"))


_OWN = _LOGITS.replace("WHERE a.side = 0 AND b.side = 1", "WHERE a.side = 1 AND b.side = 1").split("logits AS (", 1)[1]


@query(
    f"WITH {_LOGITS}, own AS ({_OWN}, ri AS (SELECT batch, i AS k, ln(sum(exp(logit))) AS l FROM logits GROUP BY batch, i), rj AS (SELECT batch, j AS k, ln(sum(exp(logit))) AS l FROM logits GROUP BY batch, j), "
    "ro AS (SELECT batch, i AS k, ln(sum(exp(logit))) AS l FROM own GROUP BY batch, i), d AS (SELECT batch, i AS k, logit FROM logits WHERE i = j), o AS (SELECT batch, i AS k, logit FROM own WHERE i = j) "
    "SELECT CAST(batch AS BIGINT) AS batch, round((avg(ri.l - d.logit) + avg(rj.l - d.logit) + avg(ro.l - o.logit)) / 3, 6) AS loss FROM d JOIN ri USING (batch, k) JOIN rj USING (batch, k) JOIN ro USING (batch, k) JOIN o USING (batch, k) GROUP BY batch"
)
def contrastive_three(spark, sf_dir):
    wide = F.slice(F.col("embedding").cast("array<double>"), 33, 32)
    third = tensors.logits(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), wide.alias("a"), wide.alias("b")))
    return tensors.contrastive_three(_logits(spark, sf_dir), third).select("batch", _r("loss"))


@query(
    duck(
        "patches",
        ctes="s AS (SELECT a.sample, a.patch AS i, b.patch AS j, sum(a.v * b.v) / 2 - 0.5 * sqrt(pow(a.patch // 4 - b.patch // 4, 2) + pow(a.patch % 4 - b.patch % 4, 2)) AS s FROM patches a JOIN patches b ON a.sample = b.sample AND a.elem = b.elem GROUP BY a.sample, a.patch, b.patch), z AS (SELECT sample, i, sum(exp(s)) AS z FROM s GROUP BY sample, i)",
        select="SELECT sample, i, j, round(exp(s) / z, 6) AS w FROM s JOIN z USING (sample, i)",
    )
)
def attention_softmax(spark, sf_dir):
    return tensors.attention_weights(_patches(spark, sf_dir), 0.5, 4).select("sample", "i", "j", _r("w"))


@query()
def project_embeddings(spark, sf_dir):
    return tensors.project(images(spark, sf_dir), 4, 4, 4)


def _by_image(df: DataFrame, make, kind: str, arrow: pa.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [make(np.array(x, np.uint8).reshape(4, 4, 4)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, arrow)], ["tile", "made"])

    return df.select("tile", "data").mapInArrow(run, f"tile long, made {kind}")


@query(duck("pixels", select="SELECT tile, row, col, ch, value FROM pixels"))
def png_roundtrip(spark, sf_dir):
    rows = payloads.encode_images(images(spark, sf_dir).select("tile", "data"), 4, 4, 4)
    return payloads.pixels(payloads.decode_images(rows))


@query(_flat(where="row % 2 = 1 AND col % 2 = 1", index="row // 2 * 8 + col // 2 * 4 + ch"))
def resize_array(spark, sf_dir):
    from ..functions.codec import resize

    made = _by_image(images(spark, sf_dir), lambda x: resize(x, 2, 2).ravel().tolist(), "array<int>", pa.list_(pa.int32()))
    return made.select("tile", F.posexplode("made").alias("k", "value"))
