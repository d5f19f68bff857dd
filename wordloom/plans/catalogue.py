"""The catalogue of queries over the corpus, lexicon, model, scoring and vector operators, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions.text import natural_key, split_of, standard_spelling, words_of
from wordloom.operators import corpus, decode, duplicates, geometry, language_model, lexicon, metrics, sampling, training, vectors
from wordloom.sources.stores import stored
from wordloom.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str = ""):
    """Registers a query under its function's name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _counts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return corpus.word_counts(_t(spark, sf_dir, name))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _t(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), "text")
        .unionAll(_t(spark, sf_dir, "conversations").select(F.lit("conversations"), "text"))
        .unionAll(_t(spark, sf_dir, "benchmark").select(F.lit("benchmark"), "text"))
    )


_W = "w as (select word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '\\p{L}+')) as word from documents) group by word)"
_U = "('0x' || substr(sha256({s} || '|' || {k}), 1, 16))::ubigint::double / 18446744073709551616.0"
_HASH = _U.format(s="'lexicon'", k="word")
_SPLIT = "case when {u} < 0.90 then 'train' when {u} < 0.95 then 'val' else 'test' end"
_SRC = "src as (select 'documents' as source, text from documents union all select 'conversations', text from conversations union all select 'benchmark', text from benchmark)"
_SYL = "(?:[bcdfghjklmnpqrstvwxyz]|[0-9]|^[^bcdfghjklmnpqrstvwxyz0-9])[^bcdfghjklmnpqrstvwxyz0-9]*"
_POS = "p as (select word, n, unnest(range(1, length(word) + 1)) as i from w), c as (select word, n, i, word[i] as ch, case when i > 1 then word[i - 1] end as prev from p)"
_KIND = "case when prev is null then 'start' when regexp_matches(prev, '^[aou]$') then 'trigger' when regexp_matches(prev, '^[aeiou]$') then 'vowel' when regexp_matches(prev, '^[a-z]$') then 'consonant' else 'other' end"


# ------------------------------------------------------------------ corpus


@query(f"with {_W} select word, n::bigint as n from w")
def word_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query("select lang, word, count(*)::bigint as n from (select lang, unnest(regexp_extract_all(lower(text), '\\p{L}+')) as word from documents) group by all")
def word_counts_by_lang(spark, sf_dir):
    return corpus.word_counts(_t(spark, sf_dir, "documents"), "lang")


@query(f"""with {_SRC}, k as (select source, count(*) as chunks from src group by 1),
t as (select source, word, count(*) as n from (select source, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as word from src) group by all),
s as (select source, sum(n) as running, count(*) as d, sum(n * length(word)) as letters from t group by 1)
select source, chunks::bigint as chunks, coalesce(running, 0)::bigint as running, coalesce(d, 0)::bigint as distinct_words, coalesce(letters, 0)::bigint as letters, letters::double / running::double as mean_length from k left join s using (source)""")
def corpus_summary(spark, sf_dir):
    return corpus.corpus_summary(_sources(spark, sf_dir))


_EACH = f"with {_SRC}, t as (select source, word, count(*) as n from (select source, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as word from src) group by all) "


@query(_EACH + "select word, sum(n)::bigint as n from t group by word")
def combine_sum(spark, sf_dir):
    return corpus.combine(*[_counts(spark, sf_dir, t) for t in ("documents", "conversations", "benchmark")])


@query(_EACH + "select word, max(n)::bigint as n from t group by word")
def combine_max(spark, sf_dir):
    return corpus.combine(*[_counts(spark, sf_dir, t) for t in ("documents", "conversations", "benchmark")], how="max")


@query(f"with {_W}, c as (select unnest(string_split(word, '')) as ch, n from w), s as (select ch, sum(n) as n from c where ch <> '' group by 1) select ch, n::bigint as n, n::double / (sum(n) over ())::double as share from s")
def char_shares(spark, sf_dir):
    return corpus.character_counts(_counts(spark, sf_dir))


@query(f"with {_W}, {_POS}, r as (select *, case when regexp_matches(coalesce(prev, ''), '^[aou]$') then 'y' else 'i' end as predicted from c where ch in ('i', 'y')) select ch as actual, predicted, sum(n)::bigint as running, count(*)::bigint as distinct_words from r group by all")
def rule_confusion(spark, sf_dir):
    return corpus.rule_confusion(_counts(spark, sf_dir))


@query(f"with {_W}, {_POS}, k as (select *, {_KIND} as kind, coalesce(prev, '') as before from c where ch in ('i', 'y')) select kind, before, sum(case when ch = 'i' then n else 0 end)::bigint as n_loose, sum(case when ch = 'y' then n else 0 end)::bigint as n_final from k group by rollup (kind, before)")
def i_contexts(spark, sf_dir):
    return corpus.contexts(_counts(spark, sf_dir))


_SHARE = """with d as (select doc_id as doc, len(regexp_extract_all(lower(text), '[aou]s'))::bigint as a, len(regexp_extract_all(lower(text), '[aou]t'))::bigint as b from documents),
s as (select *, case when a + b > 0 then a::double / (a + b)::double end as share from d),
k as (select *, case when a + b < 5 then 'too few' when share >= 0.9 then 'first' when share <= 0.1 then 'second' else 'mixed' end as kind from s) """


@query(_SHARE + "select kind, count(*)::bigint as documents, sum(a)::bigint as a, sum(b)::bigint as b from k group by kind")
def doc_spelling_classes(spark, sf_dir):
    return corpus.document_shares(_t(spark, sf_dir, "documents"), "doc_id", "[aou]s", "[aou]t").groupBy("kind").agg(F.count("*").alias("documents"), F.sum("a").alias("a"), F.sum("b").alias("b"))


@query(_SHARE + "select least(floor(share * 10), 9)::bigint as bin, count(*)::bigint as documents from k where kind <> 'too few' group by 1")
def share_histogram(spark, sf_dir):
    shares = corpus.document_shares(_t(spark, sf_dir, "documents"), "doc_id", "[aou]s", "[aou]t").where("kind <> 'too few'")
    return shares.groupBy(F.least(F.floor(F.col("share") * 10), F.lit(9)).cast("bigint").alias("bin")).agg(F.count("*").alias("documents"))


_TWIN = f"with {_W}, o as (select word, n, regexp_replace(word, '([aou])i', '\\1y', 'g') as twin from w where regexp_matches(word, '[aou]i')), t as (select o.word, o.n, twin, coalesce(w.n, 0) as twin_n from o left join w on w.word = twin) "


@query(_TWIN + "select word, n::bigint as n, twin, twin_n::bigint as twin_n from t")
def twin_candidates(spark, sf_dir):
    return corpus.twins(_counts(spark, sf_dir))


@query(_TWIN + "select count(*)::bigint as words, sum(n)::bigint as running, count(*) filter (twin_n > n)::bigint as twin_more_frequent, (sum(n) - max(n))::bigint as running_without_top from t")
def convention_summary(spark, sf_dir):
    return corpus.twins(_counts(spark, sf_dir)).agg(F.count("*").alias("words"), F.sum("n").alias("running"), F.count_if(F.col("twin_n") > F.col("n")).alias("twin_more_frequent"), (F.sum("n") - F.max("n")).alias("running_without_top"))


# ------------------------------------------------------------------ lexicon

_REASON = "case when not regexp_matches(word, '^[bcdfghjklmnpqrstvwxyzaeiou0-9]+$') then 'character outside the alphabet' when regexp_matches(word, '^[aeiou]') then 'starts with a sign' when length(word) > 24 then 'too long' end"


@query(f"with {_W}, r as (select *, {_REASON} as reason from w) select reason, count(*)::bigint as distinct_words, sum(n)::bigint as running from r where reason is not null group by reason")
def clean_reasons(spark, sf_dir):
    return lexicon.clean(_counts(spark, sf_dir))[1]


@query(f"with {_W}, r as (select *, {_REASON} as reason from w) select word, n::bigint as n from r where reason is null")
def clean_kept(spark, sf_dir):
    return lexicon.clean(_counts(spark, sf_dir))[0]


@query(f"with {_W}, s as (select *, {_SPLIT.format(u=_HASH)} as split from w) select split, count(*)::bigint as distinct_words, sum(n)::bigint as running from s group by split")
def hash_split_report(spark, sf_dir):
    return lexicon.split(_counts(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("distinct_words"), F.sum("n").alias("running"))


@query(f"with {_W}, s as (select *, {_SPLIT.format(u=_HASH)} as split from w), b as (select distinct unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as word from benchmark) select split, count(*)::bigint as distinct_words, sum(n)::bigint as running from s where not (split = 'train' and word in (select word from b)) group by split")
def split_exclude_benchmark(spark, sf_dir):
    return lexicon.split(_counts(spark, sf_dir), _counts(spark, sf_dir, "benchmark")).groupBy("split").agg(F.count("*").alias("distinct_words"), F.sum("n").alias("running"))


_DOCS = "d as (select *, " + _SPLIT.format(u=_U.format(s="'lexicon'", k="doc_id::varchar")) + " as part from documents)"


@query(f"with {_DOCS}, w as (select distinct part, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as word from d) select count(*)::bigint as shared from (select word from w where part = 'train' intersect select word from w where part = 'val')")
def train_val_overlap(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("part", split_of(F.col("doc_id").cast("string")))
    words = docs.select("part", F.explode(words_of(F.col("text"))).alias("word"))
    train, val = (words.where(F.col("part") == p).select("word") for p in ("train", "val"))
    return train.intersect(val).agg(F.count("*").alias("shared"))


@query(f"with {_W}, r as (select length(word) as len, n, unnest(range(n)) as i from w), q as (select floor(quantile_cont(len, 0.5))::bigint as p50, floor(quantile_cont(len, 0.95))::bigint as p95 from r) select (select count(*) from w)::bigint as distinct_words, (select sum(n) from w)::bigint as running, (select sum(n * length(word))::double / sum(n)::double from w) as mean_length, p50, p95, (select max(length(word)) from w)::bigint as longest from q")
def lexicon_describe(spark, sf_dir):
    return lexicon.describe(_counts(spark, sf_dir))


@query(f"with {_W} select least(len(regexp_extract_all(word, '{_SYL}')), 7)::bigint as syllables, count(*)::bigint as distinct_words, sum(n)::bigint as running from w group by 1")
def syllables_per_word(spark, sf_dir):
    return lexicon.syllables_per_word(_counts(spark, sf_dir))


_BANK = f"with {_W}, s as (select word, n, unnest(regexp_extract_all(word, '{_SYL}')) as syllable from w), k as (select *, case when regexp_matches(syllable, '^[bcdfghjklmnpqrstvwxyz]$') then 'C' when regexp_matches(syllable, '^[bcdfghjklmnpqrstvwxyz][aeiou]+$') then 'CV' else 'other' end as kind from s) "


@query(_BANK + "select kind, syllable, sum(n)::bigint as n from k group by all")
def syllable_bank(spark, sf_dir):
    return lexicon.syllable_bank(_counts(spark, sf_dir))


@query(_BANK + "select kind, sum(n)::bigint as running, count(distinct word)::bigint as words from k group by all")
def syllable_kinds(spark, sf_dir):
    return lexicon.syllable_kinds(_counts(spark, sf_dir))


@query(f"with {_W}, c as (select distinct word, sqrt(n) as w, unnest(string_split(word, '')) as ch from w), s as (select ch, round(sum(w) / (select sum(sqrt(n)) from w), 9) as share from c where ch <> '' group by ch) select * from s where share < 0.02")
def rare_characters(spark, sf_dir):
    return lexicon.rare_characters(_counts(spark, sf_dir))


@query(f"with {_W} select word, n::bigint as n from w order by n desc, word limit 50")
def top_words(spark, sf_dir):
    return _counts(spark, sf_dir).orderBy(F.desc("n"), "word").limit(50)


@query(f"with {_W} select word, regexp_replace(word, '([aou])i', '\\1y', 'g') as standard from w where word ~ '.*[aou]i.*'")
def standard_spellings(spark, sf_dir):
    return _counts(spark, sf_dir).where(F.col("word").rlike("[aou]i")).select("word", standard_spelling(F.col("word")).alias("standard"))


# ------------------------------------------------------------------ language model

def _grams_sql(words: str, order: int) -> str:
    """(h, c) of the words of a relation."""
    return f"select ('{'^' * (order - 1)}' || word || '$')[i:i+{order - 2}] as h, ('{'^' * (order - 1)}' || word || '$')[i+{order - 1}] as c from (select word, unnest(range(1, length(word) + 2)) as i from {words})" if order > 1 else f"select '' as h, (word || '$')[i] as c from (select word, unnest(range(1, length(word) + 2)) as i from {words})"


def _tables_sql(words: str, order: int, name: str = "") -> str:
    """Counts k1 to k<order>, contexts x1 to x<order> and the vocabulary v of a model fitted on the words of a relation."""
    parts = [f"{name}k{order} as (select h, c, count(*)::double as cnt from ({_grams_sql(words, order)}) group by all)"]
    parts += [f"{name}k{n} as (select h[2:] as h, c, count(*)::double as cnt from {name}k{n + 1} group by all)" for n in range(order - 1, 0, -1)]
    parts += [f"{name}x{n} as (select h, sum(cnt) as t, count(*) as y from {name}k{n} group by h)" for n in range(1, order + 1)]
    return ", ".join([*parts, f"{name}v as (select count(*) as v from {name}k1)"])


def _asked_sql(rows: str, order: int, name: str = "") -> str:
    """Rows (h, c, and others) with their probability p, the history ``order - 1`` long."""
    p, joins = "1.0 / v.v", f"{rows} r cross join {name}v v"
    for n in range(1, order + 1):
        joins += f" left join {name}k{n} k{n} on k{n}.h = r.h[{order - n + 1}:] and k{n}.c = r.c left join {name}x{n} x{n} on x{n}.h = r.h[{order - n + 1}:]"
        p = f"case when x{n}.t is null then {p} else greatest(coalesce(k{n}.cnt, 0) - 0.75, 0) / x{n}.t + 0.75 * x{n}.y / x{n}.t * ({p}) end"
    return f"select r.*, {p} as p from {joins}"


_LM = f"with {_W}, {_tables_sql('w', 3)} "


def _model_words(spark, sf_dir):
    return _counts(spark, sf_dir).select("word")


@query(_LM + "select 1::bigint as n, * from k1 union all select 2, * from k2 union all select 3, * from k3")
def kn_counts(spark, sf_dir):
    return language_model.stacked(language_model.counts(_model_words(spark, sf_dir)))


@query(_LM + "select n::bigint as n, h, t as total, y::bigint as types from (select 1 as n, * from x1 union all select 2, * from x2 union all select 3, * from x3)")
def kn_contexts(spark, sf_dir):
    return language_model.stacked(language_model.counts(_model_words(spark, sf_dir))).groupBy("n", "h").agg(F.sum("cnt").alias("total"), F.count("*").alias("types"))


@query(_LM + f"select h, c, round(p, 9) as p from ({_asked_sql('k3', 3)})")
def kn_probabilities(spark, sf_dir):
    tables = language_model.counts(_model_words(spark, sf_dir))
    return language_model.probabilities(tables[3].select("h", "c"), tables, tables[1]).select("h", "c", F.round("p", 9).alias("p"))


@query(_LM + f"select round(exp(-sum(cnt * ln(p)) / sum(cnt)), 6) as perplexity from ({_asked_sql('k3', 3)})")
def kn_perplexity(spark, sf_dir):
    words = stored(_model_words(spark, sf_dir), "words")
    tables = language_model.counts(words)
    return language_model.perplexity(words, tables, tables[1]).select(F.round("perplexity", 6).alias("perplexity"))


_PARTED = f"with {_W}, s as (select word, {_SPLIT.format(u=_HASH)} as part from w), train as (select word from s where part = 'train'), val as (select word from s where part = 'val') "


@query(_PARTED + ", " + ", ".join(_tables_sql("train", n, f"o{n}") for n in (1, 2, 3, 4)) + " " + " union all ".join(f"select {n}::bigint as n, round(exp(-sum(ln(p)) / count(*)), 6) as perplexity from ({_asked_sql('(' + _grams_sql('val', n) + ')', n, f'o{n}')})" for n in (1, 2, 3, 4)))
def perplexity_grid(spark, sf_dir):
    """Orders 1 to 4 fitted on the training words, scored on the validation words. Small grid, one plan."""
    words = stored(lexicon.split(_counts(spark, sf_dir)).select("word", "split"), "words")
    train, val = words.where("split = 'train'").select("word"), words.where("split = 'val'").select("word")
    out = None
    for order in (1, 2, 3, 4):
        tables = language_model.counts(train, order)
        one = language_model.perplexity(val, tables, tables[1]).select(F.lit(order).cast("bigint").alias("n"), F.round("perplexity", 6).alias("perplexity"))
        out = one if out is None else out.unionAll(one)
    return out


# ------------------------------------------------------------------ duplicates

_DUP = f"with {_DOCS}, g as (select md5(text) as digest, count(*) as members, count(distinct source) as labels, count(distinct part) as parts from d group by 1) "


def _parted(spark, sf_dir):
    return _t(spark, sf_dir, "documents").withColumn("part", split_of(F.col("doc_id").cast("string")))


@query(_DUP + "select digest, members::bigint as members, labels::bigint as labels, parts::bigint as parts from g where members > 1")
def dup_groups(spark, sf_dir):
    return duplicates.groups(_parted(spark, sf_dir), F.col("text"), "source", "part")


@query(_DUP + "select count(*)::bigint as groups, sum(members)::bigint as members, count(*) filter (labels > 1)::bigint as conflicting, count(*) filter (parts > 1)::bigint as spanning from g where members > 1")
def dup_label_conflicts(spark, sf_dir):
    return duplicates.groups(_parted(spark, sf_dir), F.col("text"), "source", "part").agg(F.count("*").alias("groups"), F.sum("members").alias("members"), F.count_if(F.col("labels") > 1).alias("conflicting"), F.count_if(F.col("parts") > 1).alias("spanning"))


@query("with s as (select distinct md5(text) as k, source from documents) select a.source as label_a, b.source as label_b, count(*)::bigint as groups from s a join s b on a.k = b.k and a.source < b.source group by all")
def dup_label_pairs(spark, sf_dir):
    return duplicates.label_pairs(_t(spark, sf_dir, "documents"), F.col("text"), "source")


@query(f"with {_DOCS}, t as (select distinct md5(text) as k, source from d where part = 'train'), o as (select part, source, md5(text) as k from d where part <> 'train'), m as (select o.part, exists(select 1 from t where t.k = o.k and t.source = o.source) as same from o where k in (select k from t)) select part, count(*) filter (same)::bigint as same_label, count(*) filter (not same)::bigint as other_label from m group by part")
def split_twins(spark, sf_dir):
    return duplicates.twins(_parted(spark, sf_dir), F.col("text"), "source", "part")


@query(f"with {_DOCS}, k as (select *, md5(text) as digest from d), g as (select digest, count(distinct source) as labels, bool_or(part = 'train') as trained from k group by 1) select doc_id, case when labels > 1 then 'conflict' else 'leak' end as reason from k join g using (digest) where labels > 1 or (part <> 'train' and trained)")
def excluded_docs(spark, sf_dir):
    return duplicates.exclusions(_parted(spark, sf_dir), "doc_id", F.col("text"), "source", "part")


@query("with l as (select unnest(range((select max(label) + 1 from embeddings))) as label), c as (select l.label, count(e.label) as n from l left join embeddings e using (label) group by 1) select label::bigint as label, n::bigint as n, (n = (select min(n) from c)) as fewest from c")
def class_counts_min(spark, sf_dir):
    """Every class up to the largest, those without images included."""
    held = _t(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("bigint").alias("label")).agg(F.count("*").alias("n"))
    every = held.agg(F.max("label").alias("top")).select(F.explode(F.sequence(F.lit(0).cast("bigint"), "top")).alias("label"))
    counts = every.join(held, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.min("n").alias("least")))).select("label", "n", (F.col("n") == F.col("least")).alias("fewest"))


@query("select lang, source, count(*)::bigint as n, grouping(lang, source)::bigint as level from documents group by cube (lang, source)")
def counts_cube(spark, sf_dir):
    return _t(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.grouping_id("lang", "source").cast("bigint").alias("level"))


# ------------------------------------------------------------------ names and paths


@query("select regexp_replace(c_name, '[0-9]', '#', 'g') as template, count(*)::bigint as n from customer group by 1")
def name_templates(spark, sf_dir):
    return _t(spark, sf_dir, "customer").groupBy(F.regexp_replace("c_name", "[0-9]", "#").alias("template")).agg(F.count("*").alias("n"))


@query("select page_id, regexp_extract(url, '^[a-z]+') as scheme, regexp_extract(url, '://([^/]+)', 1) as host, regexp_extract(url, '([0-9]+)', 1) as number from pages")
def path_parts(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+", 0).alias("scheme"), F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.regexp_extract("url", "([0-9]+)", 1).alias("number"))


@query("select page_id, array_to_string(string_split(url, '/')[-3:], '/') as key from pages")
def url_keys(spark, sf_dir):
    parts = F.split("url", "/")
    return _t(spark, sf_dir, "pages").select("page_id", F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 2), F.lit(3)), "/").alias("key"))


@query("with k as (select p_partkey, p_name, list_transform(regexp_extract_all(p_name || p_brand, '[0-9]+'), lambda x: x::bigint) as key, p_brand from part) select p_partkey, row_number() over (partition by p_brand order by key, p_name, p_partkey)::bigint as place from k")
def natural_order(spark, sf_dir):
    part = _t(spark, sf_dir, "part").withColumn("key", natural_key(F.concat("p_name", "p_brand")))
    return part.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("key", "p_name", "p_partkey")).cast("bigint").alias("place"))


# ------------------------------------------------------------------ vectors and series


@query("select event_id, round((value - avg(value) over p) / case when stddev_pop(value) over p > 1e-9 then stddev_pop(value) over p else 1.0 end, 6) as z from events window p as (partition by event_type)")
def zscore_by_class(spark, sf_dir):
    return vectors.z_scores(_t(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", "value").select("event_id", F.round("z", 6).alias("z"))


@query("with l as (select unnest([1, 2, 3, 5, 10, 20, 50, 100, 200]) as lag), r as (select event_type, value, row_number() over (partition by event_type order by event_id) as i from events), p as (select lag, a.value as x, b.value as y from l, r a, r b where a.event_type = b.event_type and b.i = a.i + lag) select lag::bigint as lag, count(*)::bigint as pairs, case when count(*) >= 30 then round(corr(x, y), 6) end as r from p group by lag")
def order_lag_corr(spark, sf_dir):
    return vectors.lag_correlations(_t(spark, sf_dir, "events"), "event_type", "event_id", "value").withColumn("r", F.round("r", 6))


_SHUFFLED = "('0x' || substr(md5('control|' || event_id::varchar), 1, 8))::ubigint"


@query(f"with l as (select unnest([1, 2, 3, 5, 10, 20, 50, 100, 200]) as lag), r as (select event_type, value, row_number() over (partition by event_type order by {_SHUFFLED}) as i from events), p as (select lag, a.value as x, b.value as y from l, r a, r b where a.event_type = b.event_type and b.i = a.i + lag) select lag::bigint as lag, count(*)::bigint as pairs, case when count(*) >= 30 then round(corr(x, y), 6) end as r from p group by lag")
def order_control(spark, sf_dir):
    """The same correlations in a random order."""
    events = _t(spark, sf_dir, "events")
    mixed = events.withColumn("h", vectors.shuffled_order(events, "event_id", "control"))
    return vectors.lag_correlations(mixed, "event_type", "h", "value", width=1 << 26).withColumn("r", F.round("r", 6))


@query("with q as (select vec_id as query, label, embedding as q from embeddings where vec_id % 100 = 0), d as (select query, e.vec_id, round(list_sum(list_transform(list_zip(q, embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))), 6) as d from q join embeddings e on e.label = q.label and e.vec_id <> q.query), r as (select *, row_number() over (partition by query order by d, vec_id) as place from d) select query, vec_id, d, place::bigint as place from r where place <= 5")
def style_knn(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return vectors.nearest_in_class(e, e.where("vec_id % 100 = 0"), "vec_id", "label", "embedding", 5, digits=6).select("query", "vec_id", "d", "place")


@query("select l_returnflag, quantile_cont(l_quantity, 0.1) as p10, quantile_cont(l_quantity, 0.5) as p50, quantile_cont(l_quantity, 0.9) as p90 from lineitem group by 1")
def percentiles_by_class(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.percentile("l_quantity", p).alias(n) for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))])


# ------------------------------------------------------------------ scores

_READ = "r as (select p_name as reference, case p_partkey % 4 when 0 then replace(p_name, 'e', 'i') when 1 then substr(p_name, 2) when 2 then p_name || 'x' else p_name end as reading, (p_size % 5)::bigint as kind from part) "


def _readings(spark, sf_dir):
    """Part names, and readings of them with a letter confused, lost or added."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    reading = F.when(k == 0, F.replace(name, F.lit("e"), F.lit("i"))).when(k == 1, F.expr("substr(p_name, 2)")).when(k == 2, F.concat(name, F.lit("x"))).otherwise(name)
    return _t(spark, sf_dir, "part").select(name.alias("reference"), reading.alias("reading"), (F.col("p_size") % 5).cast("bigint").alias("kind"))


_RATES = "count(*)::bigint as words, sum(length(reference))::bigint as chars, sum(levenshtein(reference, reading))::bigint as edits, sum((reference <> reading)::int)::bigint as wrong, sum(levenshtein(reference, reading))::double / greatest(sum(length(reference)), 1)::double as cer, sum((reference <> reading)::int)::double / count(*)::double as wer"


@query(f"with {_READ} select {_RATES} from r")
def cer_wer(spark, sf_dir):
    return metrics.rates(_readings(spark, sf_dir))


@query(f"with {_READ} select kind, {_RATES} from r group by kind")
def cer_by_kind(spark, sf_dir):
    return metrics.rates(_readings(spark, sf_dir), "kind")


@query("select a.n_name as a, b.n_name as b, levenshtein(a.n_name, b.n_name)::bigint as d from nation a join nation b on a.n_nationkey < b.n_nationkey")
def edit_distance_pairs(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")  # 25 rows in any size
    a, b = (F.broadcast(n).select(F.col("n_nationkey").alias("k" + x), F.col("n_name").alias(x)) for x in "ab")
    return a.join(b, F.col("ka") < F.col("kb")).select("a", "b", F.levenshtein("a", "b").cast("bigint").alias("d"))


@query("with c as (select quality::bigint as quality, sum(toxic)::bigint as hits, count(*)::bigint as total from labels group by 1), i as (select *, hits::double / total as p, 1.959964 as z from c) select quality, hits, total, round((p + z*z/(2*total) - z*sqrt(p*(1-p)/total + z*z/(4.0*total*total))) / (1 + z*z/total), 6) as low, round((p + z*z/(2*total) + z*sqrt(p*(1-p)/total + z*z/(4.0*total*total))) / (1 + z*z/total), 6) as high from i")
def wilson(spark, sf_dir):
    c = _t(spark, sf_dir, "labels").groupBy(F.col("quality").cast("bigint").alias("quality")).agg(F.sum("toxic").cast("bigint").alias("hits"), F.count("*").alias("total"))
    return metrics.interval(c, "hits", "total").select("quality", "hits", "total", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query()
def align_ops(spark, sf_dir):
    return metrics.operations(metrics.aligned(_readings(spark, sf_dir)))


@query()
def top_confusions(spark, sf_dir):
    pairs = metrics.aligned(_readings(spark, sf_dir))
    return pairs.where("ref <> hyp").orderBy(F.desc("n"), "ref", "hyp").limit(20)


_RUNS = "r as (select o_orderkey, o_orderstatus as reference, case when o_orderkey % 7 = 0 then '?' else o_orderstatus end as a, case when o_orderkey % 5 = 0 then '?' else o_orderstatus end as b from orders) "


def _runs(spark, sf_dir):
    o, k = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(k, F.col("o_orderstatus").alias("reference"), F.when(k % 7 == 0, "?").otherwise(F.col("o_orderstatus")).alias("a"), F.when(k % 5 == 0, "?").otherwise(F.col("o_orderstatus")).alias("b"))


@query(f"with {_RUNS} select count(*)::bigint as words, count(*) filter (a <> reference)::bigint as wrong_first, count(*) filter (b <> reference)::bigint as wrong_second, count(*) filter (a <> reference and b = reference)::bigint as fixed, count(*) filter (a = reference and b <> reference)::bigint as broken, count(*) filter (a = reference and b = reference)::bigint as both_right, count(*) filter (a <> reference and b <> reference)::bigint as both_wrong from r")
def compare_runs(spark, sf_dir):
    return metrics.compare(_runs(spark, sf_dir), "reference", "a", "b")


_DISCORD = "d as (select quality, count(*) filter (toxic = 1) as b, count(*) filter (toxic = 0 and doc_id % 7 = 0) as c from labels group by 1) "


@query(f"with {_DISCORD}, t as (select *, unnest(range(least(b, c) + 1)) as i from d) select quality::bigint as quality, b::bigint as b, c::bigint as c, round(least(1.0, 2 * sum(case when b + c = 0 then 1.0 else exp(lgamma(b + c + 1.0) - lgamma(i + 1.0) - lgamma(b + c - i + 1.0) - (b + c) * ln(2)) end)), 9) as p from t group by all")
def mcnemar_exact(spark, sf_dir):
    told = _t(spark, sf_dir, "labels").groupBy("quality").agg(F.count_if(F.col("toxic") == 1).alias("b"), F.count_if((F.col("toxic") == 0) & (F.col("doc_id") % 7 == 0)).alias("c"))
    return told.select(F.col("quality").cast("bigint").alias("quality"), "b", "c", F.round(metrics.exact_p("b", "c"), 9).alias("p"))


@query("with m as (select strftime(o_orderdate, '%Y-%m') as month, count(*)::bigint as n, count(*) filter (o_orderstatus = 'F')::bigint as f from orders group by 1) select month as setting from m order by f, n, month limit 1")
def best_setting(spark, sf_dir):
    m = _t(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("setting")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return metrics.best(m, "setting", "f", "n")


@query("with m as (select strftime(o_orderdate, '%Y-%m') as month, count(*)::bigint as n from orders group by 1), b as (select *, min(n) over (order by month rows unbounded preceding) as best, min(n) over (order by month rows between unbounded preceding and 1 preceding) as old from m) select month, n, best, (old is null or n < old) as improved from b")
def running_best(spark, sf_dir):
    m = _t(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return training.running_best(m, "month", "n")


@query("select doc_id::varchar as file, case doc_id when (select min(doc_id) from labels) then '9' else quality::varchar end as reference, (doc_id = (select min(doc_id) from labels)) as changed from labels")
def relabel_corrections(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("file"), F.col("quality").cast("string").alias("reference"))
    fix = _t(spark, sf_dir, "labels").agg(F.min("doc_id").cast("string").alias("file")).withColumn("text", F.lit("9"))
    return metrics.corrected(labels, fix).select("file", "reference", "changed")


# ------------------------------------------------------------------ samples

_RACE = "round(ln(greatest(" + _U.format(s="'sample'", k="p_partkey::varchar") + ", 1e-300)) / p_size, 9)"


@query(f"select p_partkey, {_RACE} as race from part order by race desc, p_partkey limit 100")
def weighted_sample(spark, sf_dir):
    return sampling.weighted(_t(spark, sf_dir, "part"), "p_partkey", F.col("p_size").cast("double"), 100).select("p_partkey", "race")


@query("select label::bigint as label, vec_id, place::bigint as place from (select *, row_number() over (partition by label order by vec_id) as place from embeddings) where place <= 3")
def first_n_per_class(spark, sf_dir):
    return sampling.first_of_each(_t(spark, sf_dir, "embeddings"), "label", 3, "vec_id").select(F.col("label").cast("bigint").alias("label"), "vec_id", "place")


_CDF = "c as (select p_partkey as value, (sum(p_size) over (order by p_partkey))::double / (sum(p_size) over ())::double as cum from part), u as (select o_orderkey as item, " + _U.format(s="'draw'", k="o_orderkey::varchar") + " as u from orders)"


@query(f"with {_CDF} select u.item, coalesce(c.value, (select arg_max(value, cum) from c)) as value from u asof left join c on u.u < c.cum")
def cdf_draw(spark, sf_dir):
    from wordloom.functions.text import fraction

    part = sampling.numbered(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    # running sums in blocks, then of blocks: no window over all rows
    sized = part.withColumn("block", F.floor((F.col("place") - 1) / 4096))
    heads = sized.groupBy("block").agg(F.sum("p_size").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = part.agg(F.sum("p_size").alias("total"))
    own = F.sum("p_size").over(Window.partitionBy("block").orderBy("p_partkey"))
    cum = sized.withColumn("own", own).join(heads, "block").crossJoin(F.broadcast(total)).select(F.col("p_partkey").alias("value"), ((F.col("before") + F.col("own")).cast("double") / F.col("total").cast("double")).alias("cum"))
    draws = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), fraction(F.col("o_orderkey").cast("string"), "draw").alias("u"))
    return sampling.draw(cum, draws).select("item", "value")


@query()
def coverage_pick(spark, sf_dir):
    """A page of 120 words that has every letter five times, picked from the whole ranked lexicon.

    The pick can only take a letter's first five words and the first 120 of all, so these, a bounded list, go to one
    task with the letters' counts over all words.
    """
    words = _counts(spark, sf_dir).where(F.length("word").between(3, 10))
    ranked = words.select("word", sampling.race(F.col("word"), F.sqrt("n"), "cover").alias("race"))
    letters = ranked.select("word", "race", F.explode(F.array_distinct(F.split("word", ""))).alias("ch"))
    held = letters.groupBy("ch").agg(F.count("*").alias("words"))
    first = sampling.first_of_each(letters, "ch", 5, F.desc("race"), "word").select("word", "race")
    some = first.unionByName(ranked.orderBy(F.desc("race"), "word").limit(120)).distinct()
    listed = some.select(F.lit(None).cast("string").alias("ch"), F.lit(None).cast("bigint").alias("words"), "word", "race").unionByName(held.select("ch", "words", F.lit(None).cast("string").alias("word"), F.lit(None).cast("double").alias("race")))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = pdf.dropna(subset="ch")
        best = pdf.dropna(subset="word").sort_values(["race", "word"], ascending=[False, True]).reset_index(drop=True)
        rows = sampling.coverage(best, 5, 120, dict(zip(counts["ch"], counts["words"], strict=True)))
        return pd.DataFrame({"place": range(1, len(rows) + 1), "word": best["word"].iloc[rows].tolist()})

    return listed.withColumn("page", F.lit(1)).groupBy("page").applyInPandas(pick, "place long, word string")


@query()
def row_packing(spark, sf_dir):
    """Part names packed into rows of 60 characters with a gap of two, brand by brand and box by box of a thousand."""
    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p_partkey").reset_index(drop=True)
        pdf["row"] = sampling.pack(pdf["width"].tolist(), 60.0, 2.0)
        return pdf[["p_brand", "box", "p_partkey", "row"]]

    parts = _t(spark, sf_dir, "part").select("p_brand", "p_partkey", F.floor(F.col("p_partkey") / 1000).alias("box"), F.length("p_name").cast("double").alias("width"))
    return parts.groupBy("p_brand", "box").applyInPandas(rows, "p_brand string, box long, p_partkey long, row long")


# ------------------------------------------------------------------ geometry

_BOX = """b as (select p_size as page, p_partkey as box, (p_partkey * 37) % 900 as x0, (p_partkey * 53) % 900 as y0, (p_partkey * 37) % 900 + 80 as x1, (p_partkey * 53) % 900 + 60 as y1 from part where p_partkey % 4 = 0),
s as (select p_size as page, p_partkey as piece, (p_partkey * 41) % 900 as x0, (p_partkey * 59) % 900 as y0, (p_partkey * 41) % 900 + 30 as x1, (p_partkey * 59) % 900 + 30 as y1 from part where p_partkey % 4 <> 0) """


def _boxes(spark, sf_dir):
    k, page = F.col("p_partkey"), F.col("p_size").alias("page")

    def at(a, b, w, h):
        return [((k * a) % 900).alias("x0"), ((k * b) % 900).alias("y0"), ((k * a) % 900 + w).alias("x1"), ((k * b) % 900 + h).alias("y1")]

    part = _t(spark, sf_dir, "part")
    return part.where(k % 4 != 0).select(page, k.alias("piece"), *at(41, 59, 30, 30)), part.where(k % 4 == 0).select(page, k.alias("box"), *at(37, 53, 80, 60))


@query(f"""with {_BOX}, m as (select s.page, piece, box, greatest(0, least(s.x1, b.x1) - greatest(s.x0, b.x0)) * greatest(0, least(s.y1, b.y1) - greatest(s.y0, b.y0)) as o, greatest(0, b.x0 - s.x1, s.x0 - b.x1) + greatest(0, b.y0 - s.y1, s.y0 - b.y1) as g from s join b on s.page = b.page),
k as (select * from m where o > 0 or g <= 40), r as (select *, row_number() over (partition by page, piece order by o desc, g, box) as i, sum((o > 0)::int) over (partition by page, piece) as over_ from k)
select s.page::bigint as page, s.piece, case when over_ > 1 then 'shared' when over_ = 1 then 'inside' when box is not null then 'near' else 'stray' end as kind, case when coalesce(over_, 0) <= 1 then box end as box from s left join r on r.page = s.page and r.piece = s.piece and r.i = 1""")
def box_overlap_assign(spark, sf_dir):
    out = geometry.assign(*_boxes(spark, sf_dir))
    return out.select(F.col("page").cast("bigint").alias("page"), "piece", "kind", "box")


@query(f"with {_BOX} select page::bigint as page, box, (lead(x0) over (partition by page order by x0, box) - x1)::bigint as gap from b")
def neighbour_gaps(spark, sf_dir):
    b = _boxes(spark, sf_dir)[1]
    return b.select(F.col("page").cast("bigint").alias("page"), "box", (F.lead("x0").over(Window.partitionBy("page").orderBy("x0", "box")) - F.col("x1")).cast("bigint").alias("gap"))


@query("select p_partkey, case when p_size / 10.0 - 2 <= 0 then 'lower' when p_size / 10.0 - 3 >= 1 then 'upper' when p_size / 10.0 - 3 >= 0.5 then 'raised' else 'middle' end as zone from part")
def zones(spark, sf_dir):
    size = F.col("p_size") / 10.0
    return _t(spark, sf_dir, "part").select("p_partkey", geometry.zone(size - 3, size - 2).alias("zone"))


@query("select page_id, ((row_number() over (order by page_id) - 1) // 10 + 1)::bigint as sheet, ((row_number() over (order by page_id) - 1) % 10 + 1)::bigint as item from pages")
def page_numbering(spark, sf_dir):
    """Pages in reading order, ten to a sheet."""
    placed = sampling.numbered(_t(spark, sf_dir, "pages").select("page_id"), "page_id")
    return placed.select("page_id", (F.floor((F.col("place") - 1) / 10) + 1).cast("bigint").alias("sheet"), ((F.col("place") - 1) % 10 + 1).cast("bigint").alias("item"))


# ------------------------------------------------------------------ decoding


def _frames(spark, sf_dir):
    rows = [F.transform(F.slice("embedding", 8 * i + 1, 8), lambda x: x.cast("double")) for i in range(8)]
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.array(*rows).alias("frames"))


@query("with f as (select vec_id, unnest(range(8)) as t, embedding from embeddings), b as (select vec_id, t, list_position(embedding[t*8+1:t*8+8], list_max(embedding[t*8+1:t*8+8])) - 1 as c from f), k as (select *, lag(c) over (partition by vec_id order by t) as before from b), s as (select vec_id, coalesce(string_agg(c::varchar, ',' order by t) filter (c <> 0 and (before is null or before <> c)), '') as classes from k group by vec_id) select * from s")
def ctc_greedy(spark, sf_dir):
    best = _frames(spark, sf_dir).select("vec_id", decode.best_classes(F.col("frames")).alias("b"))
    return best.select("vec_id", F.array_join(F.transform(decode.collapse(F.col("b")), lambda c: c.cast("string")), ",").alias("classes"))


@query()
def ctc_beam(spark, sf_dir):
    """Frames of scores through the prefix beam search. The search costs far more than moving a row, and a small table is one split: rows are dealt to all cores first."""
    dealt = _frames(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism)
    return dealt.select("vec_id", decode.beam_udf()("frames").alias("b")).select("vec_id", F.array_join(F.transform("b", lambda c: c.cast("string")), ",").alias("classes"))


# ------------------------------------------------------------------ updates, JSON, streams


@query("select conv_id, arg_max(role, turn) as role, max(turn)::bigint as turn from conversations group by 1")
def last_wins_upsert(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn"))


@query("select event_type, count(*)::bigint as n, sum((props->>'$.k')::bigint)::bigint as k from events group by 1")
def json_props(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("select event_type, count(*)::bigint as n, sum(value::decimal(20,6))::double as total from events group by 1")
def stream_counts(spark, sf_dir):
    table = _t(spark, sf_dir, "events")
    counted = stream.event_counts(stream.file_stream(spark, f"{sf_dir}/events.parquet", table.schema))
    return stream.drained(spark, counted, "stream_counts").select("event_type", "n", F.col("total").cast("double").alias("total"))


@query("with u as (select range as item, " + _U.format(s="'stream'", k="range::varchar") + " as u from range(10000)) select case when u < 0.03 then 'number' when u < 0.13 then 'built' when u < 0.23 then 'scrambled' else 'lexicon' end as kind, count(*)::bigint as n, sum(item)::bigint as items from u group by 1")
def stream_item_kinds(spark, sf_dir):
    return stream.items(spark, 0, 10_000, "stream").groupBy("kind").agg(F.count("*").alias("n"), F.sum("item").alias("items"))


# the further parts of the catalogue register themselves
from wordloom.plans import pictures, reports, score_plans, store_plans  # noqa: E402, F401
