"""Reports: names and numbers, spacing, differences of sets, training histories, shares of classes, model export."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.operators import decode, duplicates, language_model, lexicon, names, spacing, training
from wordloom.plans.catalogue import _LM, _PARTED, _W, _asked_sql, _boxes, _counts, _grams_sql, _model_words, _t, _tables_sql, query
from wordloom.sources.stores import stored

# ------------------------------------------------------------------ names and numbers

_PAIRS = "p as (select p_brand as label, p_partkey % 97 as number, count(*) as n from part group by all)"


@query(f"""with {_PAIRS}, c as (select label, max(n) as most, count(*)::double / (max(number) - min(number) + 1) as fill from p group by 1), k as (select count(*) as classes, max(most) as max_repeats, median(fill) as median_fill from c),
v as (select number, sum(n) as n, count(*) as held from p group by 1) select classes::bigint as classes, max_repeats::bigint as max_repeats, round(median_fill, 9) as median_fill, sum(n)::bigint as files, count(*)::bigint as distinct_values, min(number)::bigint as least, max(number)::bigint as most, median(held)::double as median_classes, round(avg((held >= classes / 2.0)::int), 9) as widespread from v, k group by classes, max_repeats, median_fill""")
def number_use(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_brand", (F.col("p_partkey") % 97).alias("number"))
    told = names.number_use(part, "p_brand", "number")
    return told.withColumn("median_fill", F.round("median_fill", 9)).withColumn("widespread", F.round("widespread", 9))


@query("with r as (select n_regionkey, n_nationkey, s_suppkey, s_acctbal, s_suppkey % 10 as number from supplier join nation on s_nationkey = n_nationkey), f as (select n_regionkey, number, n_nationkey, max(s_acctbal) as v from r group by all), l as (select n_regionkey, number, n_nationkey as label_a, lead(n_nationkey) over w as label_b, v as a, lead(v) over w as b from f window w as (partition by n_regionkey, number order by n_nationkey)) select * from l where label_a <> label_b")
def same_number_pairs(spark, sf_dir):
    held = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    one = held.groupBy("n_regionkey", (F.col("s_suppkey") % 10).alias("number"), "n_nationkey").agg(F.max("s_acctbal").alias("v"))
    return names.same_number(one, "n_regionkey", "n_nationkey", "number", "v")


@query("with n as (select p_brand as label, p_size as size, count(*) as n from part group by all), r as (select *, row_number() over (partition by label order by n desc, size) as i, sum(n) over (partition by label) as rows_, count(*) over (partition by label) as sizes from n) select label, size as common, n as common_rows, (rows_ - n)::bigint as other_rows, sizes - 1 as other_sizes from r where i = 1")
def size_report(spark, sf_dir):
    return names.sizes(_t(spark, sf_dir, "part"), "p_brand", "p_size")


@query()
def page_spacing(spark, sf_dir):
    """Letter heights, lines, gaps and touching letters of the pages' boxes."""
    return spacing.spacing(_boxes(spark, sf_dir)[1])


# ------------------------------------------------------------------ letters

_TRIPLES = f"with {_W}, k as (select word, n, unnest(range(1, length(word) - 1)) as i from w where length(word) >= 3), t as (select word[i] as before, word[i + 1] as sign, word[i + 2] as after, word, n from k) "


@query(_TRIPLES + "select before, sign, after, count(*)::bigint as places, sum(n)::bigint as running from t where sign in ('a', 'e', 'i', 'o', 'u') group by all")
def letter_triples(spark, sf_dir):
    """A letter, a vowel and the next letter: positions in the words, and running ones."""
    words = _counts(spark, sf_dir).where(F.length("word") >= 3)
    at = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 2)).alias("i"))
    three = at.select(*[F.substring("word", F.col("i") + k, F.lit(1)).alias(c) for k, c in enumerate(("before", "sign", "after"))], "n")
    return three.where(F.col("sign").isin(*"aeiou")).groupBy("before", "sign", "after").agg(F.count("*").alias("places"), F.sum("n").alias("running"))


@query(f"with {_W}, k as (select s as sign, word, n, row_number() over (partition by s order by n desc, word) as place from w, (select unnest(['a', 'e', 'i', 'o', 'u']) as s) where regexp_matches(word, s || '[bcdfghjklmnpqrstvwxyz]')) select sign, place::bigint as place, word, n from k where place <= 5")
def words_by_sign(spark, sf_dir):
    """The five commonest words in which each vowel stands before a consonant: the best of a word list per sign, kept small before the ranking."""
    signs = F.array(*map(F.lit, "aeiou"))
    held = F.filter(signs, lambda s: F.regexp_like("word", F.concat(s, F.lit("[bcdfghjklmnpqrstvwxyz]"))))
    each = _counts(spark, sf_dir).select(F.explode(held).alias("sign"), "word", "n")
    w = Window.partitionBy("sign").orderBy(F.desc("n"), "word")
    return each.withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 5").select("sign", "place", "word", "n")


# ------------------------------------------------------------------ differences of sets


@query("select 'missing' as kind, count(*)::bigint as n from documents where doc_id not in (select doc_id from labels) union all select 'extra', count(*) from labels where doc_id not in (select doc_id from documents)")
def key_differences(spark, sf_dir):
    docs, labels = _t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels").select("doc_id")
    def told(a, b, kind):
        return a.join(b, "doc_id", "left_anti").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))

    return told(docs, labels, "missing").unionAll(told(labels, docs, "extra"))


@query("select range as doc_id from range((select max(doc_id) + 1 from documents)) where range not in (select doc_id from labels)")
def ids_not_given(spark, sf_dir):
    """Ids of the whole range that have no label."""
    top = _t(spark, sf_dir, "documents").agg(F.max("doc_id").alias("top"))
    return duplicates.ids_not_given(_t(spark, sf_dir, "labels"), top, "doc_id")


# ------------------------------------------------------------------ training histories


@query("select event_id, round(case when event_id % 4000 < 200 then 0.001 * (event_id % 4000 + 1) / 200 else 0.0005 * (1 + cos(3.141592653589793 * (event_id % 4000 - 200) / 3800)) end, 12) as rate from events")
def learning_rates(spark, sf_dir):
    step = F.col("event_id") % 4000
    return _t(spark, sf_dir, "events").select("event_id", F.round(training.learning_rate(step, 0.001, 200, 4000), 12).alias("rate"))


@query("select event_id // 500 as evaluation, count(*)::bigint as steps, round(sum(value::decimal(20, 6))::double / count(value), 9) as mean from events group by 1")
def evaluation_means(spark, sf_dir):
    told = _t(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 500).alias("evaluation"))
    return told.agg(F.count("*").alias("steps"), F.round(F.sum(F.col("value").cast("decimal(20,6)")).cast("double") / F.count("value"), 9).alias("mean"))


@query("select event_id, round(avg(value) over (partition by user_id order by event_id rows between 19 preceding and current row), 7) as mean from events")
def moving_loss(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-19, 0)
    return _t(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 7).alias("mean"))


@query("select vec_id, round(list_reduce(list_transform(embedding, lambda v: v::double), lambda a, v, i: least(0.999::double, i::double / (9 + i)) * a + (1 - least(0.999::double, i::double / (9 + i))) * v), 12) as average from embeddings")
def averaged_weights(spark, sf_dir):
    """The exponential average, with its warm-up, of each vector's components as if they were a history."""
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(training.moving_average(F.transform("embedding", lambda v: v.cast("double"))), 12).alias("average"))


# ------------------------------------------------------------------ classes

_C = "c as (select vec_id, label, i as class, embedding[i + 1]::double as v from (select vec_id, label, embedding, unnest(range(64)) as i from embeddings)) "


def _scores(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("scores"))


@query(f"with {_C}, r as (select *, row_number() over (partition by vec_id order by v desc, class) as place from c) select vec_id, place::bigint as place, class::bigint as class, round(exp(v) / sum(exp(v)) over (partition by vec_id), 9) as share from r where place <= 5")
def class_shares(spark, sf_dir):
    each = _scores(spark, sf_dir).select("vec_id", F.posexplode(decode.best_shares(F.col("scores"))).alias("i", "s"))
    return each.select("vec_id", (F.col("i") + 1).cast("bigint").alias("place"), F.col("s.class").cast("bigint").alias("class"), F.round("s.share", 9).alias("share"))


@query(f"with {_C}, m as (select vec_id, class, case when class = 2 then ln(exp(v) + exp(max(v) filter (class = 3) over (partition by vec_id))) when class = 3 then -1e300 else v end as v from c) select vec_id, arg_max(class, v)::bigint as best, round(max(v), 9) as score from m group by 1")
def merged_classes(spark, sf_dir):
    """The best class once class 2 has taken over class 3."""
    told = _scores(spark, sf_dir).select("vec_id", decode.merged(F.col("scores"), 2, 3).alias("s"))
    return told.select("vec_id", (F.array_position("s", F.array_max("s")) - 1).cast("bigint").alias("best"), F.round(F.array_max("s"), 9).alias("score"))


@query(f"with {_C} select vec_id, arg_max(class, v)::bigint as best from c where class % 10 = label group by 1")
def masked_classes(spark, sf_dir):
    """The best of the classes that a vector's label allows."""
    allowed = F.transform("scores", lambda v, i: i % 10 == F.col("label"))
    told = _scores(spark, sf_dir).select("vec_id", decode.masked(F.col("scores"), allowed).alias("s"))
    return told.select("vec_id", (F.array_position("s", F.array_max("s")) - 1).cast("bigint").alias("best"))


# ------------------------------------------------------------------ the language model's export and weights


@query(_LM + " union all ".join(f"select {n}::bigint as n, h, c, round(ln(p), 8) as value from ({_asked_sql(f'k{n}', n)}) union all select {n}, h, null, round(ln(0.75 * y / t), 8) from x{n}" for n in (1, 2, 3)))
def kn_back_off(spark, sf_dir):
    """The rows of the exported model, all orders."""
    tables = language_model.counts(_model_words(spark, sf_dir))
    return language_model.back_off(tables, tables[1]).select("n", "h", "c", F.round("value", 8).alias("value"))


@query(f"with {_W}, k as (select word, n::double ** 0.5 as weight from w), a as (select * from k union all select '<number>', sum(weight) * 0.03 from k union all select '<stop>', sum(weight) * 0.02 from k) select word, round(weight, 6) as weight from a")
def training_weights(spark, sf_dir):
    return language_model.training_weights(_counts(spark, sf_dir)).select("word", F.round("weight", 6).alias("weight"))


@query(_PARTED + ", " + _tables_sql("train", 6) + f" select round(exp(-sum(ln(p)) / count(*)), 6) as perplexity from ({_asked_sql('(' + _grams_sql('val', 6) + ')', 6)})")
def kn_order6(spark, sf_dir):
    """A model of order 6 fitted on the training words and scored on the validation words."""
    words = stored(lexicon.split(_counts(spark, sf_dir)).select("word", "split"), "words")
    tables = language_model.counts(words.where("split = 'train'").select("word"), 6)
    return language_model.perplexity(words.where("split = 'val'").select("word"), tables, tables[1]).select(F.round("perplexity", 6).alias("perplexity"))
