"""Queries over images: the vectors of the test tables, read as images of eight rows of eight pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.operators import images, ink
from wordloom.plans.catalogue import _t, query

SIDE = 8

_P = """p as (select vec_id, label, i // 8 as y, i % 8 as x, least(255, greatest(0, floor((embedding[i + 1]::double * 4 + 1) * 127.5)))::bigint as g
from (select vec_id, label, embedding, unnest(range(64)) as i from embeddings)), """
_OTSU = _P + """l as (select vec_id, g, count(*) as n from p group by all),
c as (select vec_id, g, sum(n) over w as dark, sum(n * g) over w as grey, sum(n) over (partition by vec_id) as pixels, sum(n * g) over (partition by vec_id) as total from l window w as (partition by vec_id order by g)),
v as (select vec_id, g, case when dark < pixels then (total * dark - pixels * grey)::double * (total * dark - pixels * grey)::double / (dark::double * (pixels - dark)) else 0 end as between_ from c),
o as (select vec_id, case when max(between_) > 0 then min(g) filter (between_ = best) else 0 end as level from (select *, max(between_) over (partition by vec_id) as best from v) group by vec_id) """
_INK = _OTSU + """, d as (select p.*, g <= level as ink from p join o using (vec_id)) """
_RUNS = _INK + """, r as (select *, count(*) over (partition by vec_id, y, ink, x - a) as h, count(*) over (partition by vec_id, x, ink, y - b) as v from (select *, row_number() over (partition by vec_id, y, ink order by x) as a, row_number() over (partition by vec_id, x, ink order by y) as b from d)),
m as (select vec_id, label, count(*) filter (ink) as n, count(*) filter (ink and h < v) as nx, count(*) filter (ink and v < h) as ny, median(h) filter (ink and h < v) as mx, median(v) filter (ink and v < h) as my from r group by all),
k as (select vec_id, label, case when nx >= 0.15 * n and mx <= 0.6 * 8 then mx::double end as t_x, case when ny >= 0.15 * n and my <= 0.6 * 8 then my::double end as t_y from m) """


def _images(spark, sf_dir):
    def row(y):
        return F.transform(F.slice("embedding", SIDE * y + 1, SIDE), lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") * 4 + 1) * 127.5))).cast("int"))

    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.array(*map(row, range(SIDE))).alias("gray"))


@query(f"with {_OTSU} select vec_id, level::bigint as level from o")
def image_otsu(spark, sf_dir):
    return _images(spark, sf_dir).select("vec_id", images.threshold_of("gray")["level"].alias("level"))


@query(f"""with {_INK}, e as (select * replace (case when (avg(ink::int) over (partition by vec_id)) > 0.5 then not ink else ink end as ink) from d),
s as (select *, ink and coalesce(lag(ink) over a, false) and coalesce(lead(ink) over a, false) and coalesce(lag(ink) over b, false) and coalesce(lead(ink) over b, false) as inside from e window a as (partition by vec_id, y order by x), b as (partition by vec_id, x order by y))
select vec_id, 8::bigint as height, 8::bigint as width, case when bool_or(ink) then avg(ink::int)::double end as ink, case when bool_or(ink) then median(g) filter (not ink)::double end as paper_level, median(g) filter (ink)::double as ink_level,
2.0::double * count(*) filter (ink) / count(*) filter (ink and not inside) as stroke, min(y) filter (ink) / 8.0::double as free_top, (7 - max(y) filter (ink)) / 8.0::double as free_bottom, min(x) filter (ink) / 8.0::double as free_left, (7 - max(x) filter (ink)) / 8.0::double as free_right from s group by vec_id""")
def image_features(spark, sf_dir):
    return _images(spark, sf_dir).select("vec_id", images.features_of("gray").alias("f")).select("vec_id", "f.*")


@query(f"with {_RUNS} select vec_id, t_x, t_y from k")
def chord_thickness(spark, sf_dir):
    return _images(spark, sf_dir).select("vec_id", images.chords_of("gray").alias("t")).select("vec_id", "t.*")


@query(f"""with {_RUNS}, q as (select label, count(*) as images, case when count(t_x) >= 0.5 * count(*) then avg(t_x) end as t_x, case when count(t_y) >= 0.5 * count(*) then avg(t_y) end as t_y from k group by label),
u as (select median(t_y) as unit from q) select label, images, round(t_x, 9) as t_x, round(t_y, 9) as t_y, round(unit / t_x, 9) as w, round(unit / t_y, 9) as h from q, u""")
def class_boxes(spark, sf_dir):
    each = _images(spark, sf_dir).select("label", images.chords_of("gray").alias("t")).select("label", "t.*")
    told = images.boxes(images.thickness_by_class(each, "label"), "label")
    return told.select("label", "images", *[F.round(c, 9).alias(c) for c in ("t_x", "t_y", "w", "h")])


@query(f"with {_P} h as (select vec_id, md5(string_agg(printf('%02x', g), '' order by y, x)) as pixels from p group by 1) select pixels, count(*)::bigint as images, min(vec_id) as least from h group by 1")
def image_twins(spark, sf_dir):
    """Images with equal pixels: the digest is made of the pixels, not of a file's bytes, and in the JVM."""
    pixels = F.md5(F.array_join(F.transform(F.flatten("gray"), lambda g: F.lower(F.lpad(F.hex(g.cast("long")), 2, "0"))), ""))
    return _images(spark, sf_dir).groupBy(pixels.alias("pixels")).agg(F.count("*").alias("images"), F.min("vec_id").alias("least"))


@query(f"with {_P} c as (select vec_id, max(g) - min(g) as span from p group by 1) select t::bigint as over_level, round(avg((span > t)::int), 9) as share from c, (select unnest([120, 160, 200, 240]) as t) group by 1")
def contrast_shares(spark, sf_dir):
    """Share of the images whose contrast is over each level: one pass over them."""
    flat = F.flatten("gray")
    span = _images(spark, sf_dir).select((F.array_max(flat) - F.array_min(flat)).alias("span"))
    each = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("over_level"), (F.col("span") > t).cast("int").alias("over")) for t in (120, 160, 200, 240)]))
    return span.select(each.alias("e")).groupBy("e.over_level").agg(F.round(F.avg("e.over"), 9).alias("share"))


@query()
def image_style(spark, sf_dir):
    """Slant, stroke width, share and level of the soft ink."""
    return _images(spark, sf_dir).select("vec_id", images.style_of("gray").alias("s")).select("vec_id", "s.*")


@query()
def image_strokes(spark, sf_dir):
    """Stroke statistics of the normalised images."""
    return _images(spark, sf_dir).select("vec_id", images.strokes_of("gray").alias("s")).select("vec_id", "s.*")


@query()
def image_normalised(spark, sf_dir):
    """Digest of the normalised pixels, with the width the network's batch is padded to."""
    told = _images(spark, sf_dir).select("vec_id", images.normalised_of("gray").alias("n"))
    return told.select("vec_id", "n.height", "n.width", images.padded_width(F.col("n.width")).alias("padded"), F.md5("n.pixels").alias("pixel_md5"))


@query()
def image_pieces(spark, sf_dir):
    """Connected pieces of the ink, and the pixels of the largest."""
    return _images(spark, sf_dir).select("vec_id", images.pieces_of("gray").alias("p")).select("vec_id", "p.*")


_FIT = _INK + """, a as (select vec_id as k, y, x from d where ink and vec_id % 2 = 0), b as (select vec_id - 1 as k, y, x + 6 as x from d where ink and vec_id % 2 = 1),
k as (select e.vec_id as k from embeddings e join embeddings f on f.vec_id = e.vec_id + 1 where e.vec_id % 2 = 0),
f as (select k, y, min(x) as first, max(x) as last from b group by all), g as (select k, y, min(x) as first, max(x) as last from a group by all),
room as (select k, min(f.first - a.x - 1) as room from a join f using (k, y) where a.x < f.first and a.x >= f.first - 7 group by k),
hang as (select k, max(g.last - f.first + 1) as overhang from f join g using (k, y) group by k),
inner_ as (select distinct k, 1 as enclosed from b join (select k, x, min(y) as top, max(y) as bottom from a group by all) using (k, x) where top < b.y and b.y < bottom),
nest as (select distinct k, 1 as nested from (select a.k from a join (select k, x, max(y) as bottom from b group by all) c on a.k = c.k and a.x = c.x and a.y <= c.bottom union all select f.k from f join g using (k, y) where g.first < f.first and g.last > f.last)),
far as (select k, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) - 1 as apart from a join b using (k) group by k),
col as (select k, x, count(*) as n from b group by all), most as (select k, max(n) as n from col group by k), begin_ as (select k, min(x) as x from col join most using (k) where col.n >= 0.35 * most.n group by k),
body as (select k, count(*) as body from b join begin_ using (k) where b.x >= begin_.x group by k) """


@query(f"with {_FIT} select k as vec_id, coalesce(room, 0)::bigint as room, overhang::double as overhang, coalesce(enclosed, 0)::bigint as enclosed, coalesce(nested, 0)::bigint as nested, round(apart, 9) as apart, coalesce(body, 0)::bigint as body from k left join room using (k) left join hang using (k) left join inner_ using (k) left join nest using (k) left join far using (k) left join body using (k)")
def sign_fit(spark, sf_dir):
    """Every second image as a sign six columns right of the image before it: room, overhang, hollows, distance, body."""
    each = _images(spark, sf_dir)
    sign = each.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("gray").alias("sign"))
    pairs = each.where("vec_id % 2 = 0").join(sign, "vec_id").select("vec_id", F.concat("gray", "sign").alias("pair"))
    told = pairs.select("vec_id", ink.fit_of(6, 6)("pair").alias("f")).select("vec_id", "f.*")
    return told.withColumn("apart", F.round("apart", 9))


@query()
def pen_strokes(spark, sf_dir):
    """Strokes with their faint parts, their width, and the width once redrawn with a pen of two pixels."""
    return _images(spark, sf_dir).select("vec_id", ink.pen_of(2.0)("gray").alias("p")).select("vec_id", "p.*")


@query()
def image_distorted(spark, sf_dir):
    """Mean level of distorted images."""
    told = _images(spark, sf_dir).select("vec_id", F.flatten(ink.distorted_of("gray", F.col("vec_id"), 7)).alias("p"))
    return told.select("vec_id", F.round(F.aggregate("p", F.lit(0.0), lambda s, v: s + v) / F.size("p"), 3).alias("level"))
