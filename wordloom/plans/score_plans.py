"""Queries over labels, releases, runs of a recogniser, layouts and decoding with a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions.text import words_of
from wordloom.operators import corpus, decode, labels, language_model, layout, lexicon, metrics, release, sampling
from wordloom.plans.catalogue import _HASH, _KIND, _POS, _REASON, _SHARE, _SPLIT, _SRC, _W, _counts, _frames, _sources, _t, _U, query

# ---------------------------------------------------------------- labels

LETTERS = "abcdefghijklmnopqrstuvwxyz "


@query(f"with {_W}, r as (select *, {_REASON} as reason, {_SPLIT.format(u=_HASH)} as part from w) select word, n::bigint as n from r where reason is null and part = 'train' and length(word) between 3 and 8 and not regexp_matches(word, '[0-9]')")
def usable_words(spark, sf_dir):
    return _counts(spark, sf_dir).where(labels.usable(F.col("word"), "train", 3, 8))


@query("select doc_id, regexp_replace(text, '[^a-z ]', '', 'g') as kept, regexp_replace(text, '[a-z ]', '', 'g') as dropped from documents where text is not null")
def cleaned_labels(spark, sf_dir):
    kept, dropped = labels.cleaned(F.col("text"), "a-z ")
    return _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", kept.alias("kept"), dropped.alias("dropped"))


@query(f"with c as (select p_partkey, unnest(range(1, length(p_name) + 1)) as i, p_name from part) select p_partkey, string_agg(instr('{LETTERS}', p_name[i])::varchar, ',' order by i) as classes, any_value(p_name) as decoded from c group by 1")
def encoded_labels(spark, sf_dir):
    coded = _t(spark, sf_dir, "part").select("p_partkey", labels.encode(F.col("p_name"), LETTERS).alias("c"))
    return coded.select("p_partkey", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("classes"), labels.decode(F.col("c"), LETTERS).alias("decoded"))


def _u(seed: str, key: str) -> str:
    return _U.format(s=f"'{seed}'", k=key)


@query("with i as (select range as item from range(5000)), l as (select item, floor(" + _u("number length", "item::varchar") + " * 4)::int + 1 as n, " + ", ".join(f"{_u('number', f'item::varchar || {chr(39)}/{k}{chr(39)}')} as u{k}" for k in (1, 2, 3, 4)) + " from i) select item, case when n > 1 then '123456789'[floor(u1 * 9)::int + 1] else '0123456789'[floor(u1 * 10)::int + 1] end || " + " || ".join(f"case when n >= {k} then '0123456789'[floor(u{k} * 10)::int + 1] else '' end" for k in (2, 3, 4)) + " as number from l")
def numbers(spark, sf_dir):
    """Made-up numbers of one to four digits."""
    return spark.range(5000).select(F.col("id").alias("item"), labels.number(F.col("id")).alias("number"))


@query()
def scrambled_words(spark, sf_dir):
    """Words with letters and vowels replaced by others of their kind."""
    words = _counts(spark, sf_dir).where(F.col("word").rlike("^[a-z]{3,8}$"))
    return words.select("word", labels.scrambled(F.col("word"), F.col("word"), ("bcdfghjklmnpqrstvwxyz", "aeiou")).alias("scrambled"))


@query(f"with {_W}, k as (select word, sqrt(n) as weight from w), r as (select *, round(ln(greatest({_u('stop', 'word')}, 1e-300)) / weight, 9) as race from k), p as (select word from r order by race desc, word limit 500) select word, round(weight, 6) as weight from k union all select word || '.', round((select sum(weight) from k) * 0.02 / 500, 6) from p")
def training_words(spark, sf_dir):
    """The model's training words, and a sample of 500 drawn by weight that end with a stop and share its mass."""
    words = _counts(spark, sf_dir).select("word", F.sqrt("n").alias("weight"))
    total = words.agg((F.sum("weight") * 0.02 / 500).alias("weight"))
    stops = sampling.weighted(words, "word", F.col("weight"), 500, "stop").select(F.concat("word", F.lit(".")).alias("word")).crossJoin(F.broadcast(total))
    return words.unionByName(stops).select("word", F.round("weight", 6).alias("weight"))


def _drawn(spark, sf_dir):
    words = _counts(spark, sf_dir).select("word", F.sqrt("n").alias("weight"))
    rare = lexicon.rare_characters(_counts(spark, sf_dir), threshold=0.005).where("share > 0.001")
    return sampling.drawn_with_rare(words, rare, spark.range(20_000).withColumnRenamed("id", "item"), 0.1)


@query()
def drawn_words(spark, sf_dir):
    """Words drawn by weight, a tenth of the draws for rare characters."""
    return _drawn(spark, sf_dir)


@query()
def sampled_shares(spark, sf_dir):
    """Shares of characters in drawn words."""
    return corpus.character_counts(_drawn(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n")))


@query("select row_number() over (order by ('0x' || substr(md5('page|' || doc_id::varchar), 1, 8))::ubigint, doc_id)::bigint as place, doc_id from documents")
def permuted(spark, sf_dir):
    """A random order, the same everywhere, numbered without sorting in one task."""
    from wordloom.operators.vectors import shuffled_order

    docs = _t(spark, sf_dir, "documents").select("doc_id")
    return sampling.numbered(docs.withColumn("h", shuffled_order(docs, "doc_id", "page")), "h", width=1 << 20, ties=("doc_id",)).select("place", "doc_id")


# ---------------------------------------------------------------- corpus


@query(f"with {_SRC}, t as (select source, regexp_replace(text, '[ \\t\\n\\r]', '', 'g') as text from src where text is not null) select source, sum(length(text))::bigint as characters, sum(length(regexp_replace(lower(text), '[^a-z]', '', 'g')))::bigint as letters, round(sum(length(regexp_replace(lower(text), '[^a-z]', '', 'g')))::double / sum(length(text)), 9) as share from t group by 1")
def script_shares(spark, sf_dir):
    """Characters other than blanks, those of the script, and their share, by source."""
    text = F.regexp_replace("text", "[ \\t\\n\\r]", "")
    sized = _sources(spark, sf_dir).where("text is not null").select("source", F.length(text).alias("c"), F.length(F.regexp_replace(F.lower(text), "[^a-z]", "")).alias("l"))
    return sized.groupBy("source").agg(F.sum("c").alias("characters"), F.sum("l").alias("letters"), F.round(F.sum("l") / F.sum("c"), 9).alias("share"))


@query(f"with {_SRC}, t as (select source, word, count(*) as n from (select source, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as word from src) group by all), r as (select *, row_number() over (partition by source order by n desc, word) as place from t) select source, place::bigint as place, word, n::bigint as n from r where place <= 30")
def top_words_by_source(spark, sf_dir):
    return sampling.first_of_each(corpus.word_counts(_sources(spark, sf_dir), "source"), "source", 30, F.desc("n"), "word").select("source", "place", "word", "n")


@query(f"with {_W}, {_POS}, k as (select coalesce(prev, '') as before, sum(n) as n, sum(case when ch = 'i' then n else 0 end) as n_loose from c where ch in ('i', 'y') group by 1) select before, n::bigint as n, n_loose::bigint as n_loose from k order by n desc, before limit 40")
def top_contexts(spark, sf_dir):
    """The forty commonest characters before an i or y."""
    at = corpus.positions(_counts(spark, sf_dir)).where(F.col("ch").isin("i", "y"))
    told = at.groupBy(F.coalesce("prev", F.lit("")).alias("before")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("ch") == "i", F.col("n")).otherwise(0)).alias("n_loose"))
    return told.orderBy(F.desc("n"), "before").limit(40)


@query(f"with {_W}, {_POS} select word, n::bigint as n, i::bigint as pos, {_KIND} as kind from c where ch = 'i' order by n desc, word, i limit 200")
def i_list(spark, sf_dir):
    """The first two hundred i's by count, word and position, each with the kind of its context."""
    at = corpus.positions(_counts(spark, sf_dir)).where("ch = 'i'")
    return at.select("word", "n", (F.col("pos") + 1).cast("bigint").alias("pos"), corpus.context_of(F.col("prev")).alias("kind")).orderBy(F.desc("n"), "word", "pos").limit(200)


@query(_SHARE + ", w as (select word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '\\p{L}+')) as word from documents where doc_id in (select doc from k where kind = 'first')) group by 1), p as (select word, n, unnest(range(1, length(word) + 1)) as i from w), r as (select word[i] as actual, case when i > 1 and regexp_matches(word[i - 1], '^[aou]$') then 'y' else 'i' end as predicted, n from p where word[i] in ('i', 'y')) select actual, predicted, sum(n)::bigint as running, count(*)::bigint as distinct_words from r group by all")
def consistent_subset(spark, sf_dir):
    """The spelling rule counted again over the documents that spell alike."""
    docs = _t(spark, sf_dir, "documents")
    alike = corpus.document_shares(docs, "doc_id", "[aou]s", "[aou]t").where("kind = 'first'").select(F.col("doc").alias("doc_id"))
    return corpus.rule_confusion(corpus.word_counts(docs.join(alike, "doc_id", "left_semi")))


@query(_SHARE + ", n as (select doc_id, len(regexp_extract_all(lower(text), '\\p{L}+')) as words from documents) select kind, count(*)::bigint as documents, coalesce(sum(words), 0)::bigint as running from k join n on n.doc_id = k.doc group by 1")
def class_words(spark, sf_dir):
    """Documents and running words of each class of spelling."""
    docs = _t(spark, sf_dir, "documents")
    sized = docs.select(F.col("doc_id").alias("doc"), F.size(words_of(F.coalesce("text", F.lit("")))).alias("words"))
    shares = corpus.document_shares(docs, "doc_id", "[aou]s", "[aou]t").join(sized, "doc")
    return shares.groupBy("kind").agg(F.count("*").alias("documents"), F.sum("words").cast("bigint").alias("running"))


@query("select event_type, count(distinct ts)::bigint as distinct_times, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as earliest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as latest from events group by 1")
def time_stamps(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("ts").alias("distinct_times"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("earliest"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("select lang, avg(n_chars) as mean, max(n_chars)::bigint as widest, printf('%.2f%%', 100.0 * count(*) / (select count(*) from documents)) as share from documents group by 1")
def data_shape(spark, sf_dir):
    """Mean and largest size, and the share of the rows as text."""
    docs = _t(spark, sf_dir, "documents")
    told = docs.groupBy("lang").agg(F.avg("n_chars").alias("mean"), F.max("n_chars").cast("bigint").alias("widest"), F.count("*").alias("n"))
    return told.crossJoin(F.broadcast(docs.agg(F.count("*").alias("total")))).select("lang", "mean", "widest", labels.percent(F.col("n") / F.col("total")).alias("share"))


@query("with q as (select l_returnflag, case when l_discount < 0.02 then null else l_tax / l_discount end as v from lineitem) select l_returnflag, count(v)::bigint as n, round(quantile_cont(v, 0.1), 9) as p10, round(quantile_cont(v, 0.5), 9) as p50, round(quantile_cont(v, 0.9), 9) as p90 from q group by 1")
def measurable_percentiles(spark, sf_dir):
    """Percentiles of what can be measured: NaN takes no part."""
    v = F.when(F.col("l_discount") < 0.02, F.lit(float("nan"))).otherwise(F.col("l_tax") / F.col("l_discount"))
    told = _t(spark, sf_dir, "lineitem").select("l_returnflag", F.nanvl(v, F.lit(None).cast("double")).alias("v")).groupBy("l_returnflag")
    return told.agg(F.count("v").alias("n"), *[F.round(F.percentile("v", p), 9).alias(f"p{int(100 * p)}") for p in (0.1, 0.5, 0.9)])


# ---------------------------------------------------------------- runs

_RUN = "select p_partkey, p_name as reference, regexp_replace(p_name, 'e', 'i') as a, case when p_partkey % 3 = 0 then p_name || 'x' else p_name end as b, case when p_partkey % 5 = 0 then '' else p_name end as c from part"


def _three(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    k, name = F.col("p_partkey"), F.col("p_name")
    readings = {"a": F.regexp_replace(name, "^([^e]*)e", "$1i"), "b": F.when(k % 3 == 0, F.concat(name, F.lit("x"))).otherwise(name), "c": F.when(k % 5 == 0, "").otherwise(name)}
    return {n: part.select(k.alias("file"), name.alias("reference"), r.alias("reading")) for n, r in readings.items()}


@query(f"""with r as ({_RUN}), t as (select 'a' as first, 'b' as second, count(*) filter (a = reference and b <> reference) as x, count(*) filter (a <> reference and b = reference) as y from r
union all select 'a', 'c', count(*) filter (a = reference and c <> reference), count(*) filter (a <> reference and c = reference) from r
union all select 'b', 'c', count(*) filter (b = reference and c <> reference), count(*) filter (b <> reference and c = reference) from r),
u as (select *, unnest(range(least(x, y) + 1)) as i from t)
select first, second, x::bigint as only_first, y::bigint as only_second, round(least(1.0, 2 * sum(exp(lgamma(x + y + 1.0) - lgamma(i + 1.0) - lgamma(x + y - i + 1.0) - (x + y) * ln(2)))), 9) as p from u group by all""")
def run_pairs(spark, sf_dir):
    """Three runs compared two by two, their words checked to be the same."""
    runs = _three(spark, sf_dir)
    return metrics.run_pairs(metrics.runs_wide(runs), list(runs)).withColumn("p", F.round("p", 9))


@query(f"""with r as ({_RUN}), m as (select reference, (a <> reference)::int + (b <> reference)::int + (c <> reference)::int as w from r),
g as (select 'all' as words_of, w from m union all select case when regexp_matches(reference, '[dg]') then 'with dg' else 'without dg' end, w from m)
select words_of, count(*)::bigint as words, count(*) filter (w = 0)::bigint as read_by_every, count(*) filter (w = 3)::bigint as read_by_none, sum(w)::bigint as wrong from g group by 1""")
def run_totals(spark, sf_dir):
    return metrics.run_totals(metrics.runs_wide(_three(spark, sf_dir)), ["dg"])


_LABELLED = "l as (select doc_id, quality::varchar as was, case when doc_id % 50 = 0 then '9' else quality::varchar end as now from labels)"


@query(f"with {_LABELLED} select doc_id::varchar as file, now as reference, (now <> was) as changed from l")
def rescored(spark, sf_dir):
    """References replaced by the set's corrected labels; every change has its correction."""
    told = _t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("file"), F.col("quality").cast("string").alias("reference"), (F.col("doc_id") % 50 == 0).alias("fix"))
    fixes = told.where("fix").select("file", F.lit("9").alias("text"))
    now = told.select("file", F.when(F.col("fix"), "9").otherwise(F.col("reference")).alias("text"))
    return metrics.corrected(told.drop("fix"), fixes, now).select("file", "reference", "changed")


@query("with s as (select vec_id, unnest(range(64)) as i, embedding from embeddings), d as (select vec_id, max(abs(embedding[i + 1]::double - round(embedding[i + 1]::double, 2))) as diff, arg_max(i, (embedding[i + 1]::double, -i)) = arg_max(i, (round(embedding[i + 1]::double, 2), -i)) as same from s group by 1) select round(avg(same::int), 9) as same, round(max(diff), 9) as difference from d")
def parity(spark, sf_dir):
    """Two networks' outputs compared: share of equal best classes, largest difference."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    both = _t(spark, sf_dir, "embeddings").select("vec_id", v.alias("a"), F.transform(v, lambda x: F.round(x, 2)).alias("b"))
    one, two = both.select("vec_id", "a"), both.select("vec_id", "b")
    told = one.join(two, "vec_id").select((F.array_position("a", F.array_max("a")) == F.array_position("b", F.array_max("b"))).cast("int").alias("same"), F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y))).alias("d"))
    return told.agg(F.round(F.avg("same"), 9).alias("same"), F.round(F.max("d"), 9).alias("difference"))


# ---------------------------------------------------------------- release

_ITEMS = "m as (select p_partkey, p_partkey // 10 + 1 as page, p_partkey::varchar || '.png' as file, p_name as text, p_brand as kind, p_size % 3 as s from part where p_size % 3 <> 2)"


def _release(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    k, file = F.col("p_partkey"), F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("file")
    flags = F.when(k % 4 == 0, F.array(F.lit("faint"), F.lit("touching"))).otherwise(F.array().cast("array<string>")).alias("flags")
    items = part.select(k.alias("item"), (F.floor(k / 10) + 1).alias("page"), file, F.col("p_name").alias("text"), F.col("p_brand").alias("kind"), F.when(F.col("p_size") % 3 == 2, "empty").otherwise("written").alias("status"), flags)
    fixes = part.where((k % 40 == 0) & (F.col("p_size") % 3 != 2)).select(file, F.upper("p_name").alias("text"), F.lit("case").alias("reason"))
    return items, release.release(items, part.select(file, F.col("p_name").alias("text")), fixes)


@query(f"with {_ITEMS} select p_partkey as item, page::bigint as page, file, case when p_partkey % 40 = 0 then upper(text) else text end as text, kind, case when p_partkey % 40 = 0 then text end as was from m")
def released(spark, sf_dir):
    return _release(spark, sf_dir)[1].select("item", "page", "file", "text", "kind", "was")


@query(f"with {_ITEMS}, t as (select case when p_partkey % 40 = 0 then upper(text) else text end as text, p_partkey % 40 = 0 as fixed from m) select count(*)::bigint as words, sum(length(text))::bigint as characters, count(*) filter (fixed)::bigint as corrected, (select count(distinct ch) from (select unnest(string_split(text, '')) as ch from t) where ch <> '')::bigint as distinct_characters from t")
def release_summary(spark, sf_dir):
    return release.summary(_release(spark, sf_dir)[1])


@query("with f as (select case when p_size % 3 = 2 then 'empty' else 'written' end as status, p_brand as kind, p_partkey from part) select 'status' as what, status as value, count(*)::bigint as n from f group by all union all select 'kind', kind, count(*) from f group by all union all select 'flags', flag, count(*) from f, (select unnest(['faint', 'touching']) as flag) where p_partkey % 4 = 0 group by all")
def set_counts(spark, sf_dir):
    """Status, kinds and flags of a cut set in one pass."""
    return release.counted(_release(spark, sf_dir)[0], "status", "kind", "flags")


# ---------------------------------------------------------------- layout

_PRIOR = "p as (select p_partkey as ch, case when p_partkey % 3 = 0 then 'mark' else 'base' end as kind, p_size / 50.0::double as w, ((p_partkey % 7) - 3) / 2.0::double as bottom, ((p_partkey % 7) - 3) / 2.0::double + p_size / 40.0::double as top from part), m as (select p_partkey as ch, (p_partkey % 11) / 10.0::double as w, (p_partkey % 13) / 10.0::double as h from part where p_partkey % 2 = 0)"


def _priors(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    part = _t(spark, sf_dir, "part")
    bottom = (k % 7 - 3) / 2.0
    priors = part.select(k.alias("ch"), F.when(k % 3 == 0, "mark").otherwise("base").alias("kind"), (size / 50.0).alias("w"), bottom.alias("bottom"), (bottom + size / 40.0).alias("top"))
    return priors, part.where(k % 2 == 0).select(k.alias("ch"), ((k % 11) / 10.0).alias("w"), ((k % 13) / 10.0).alias("h"))


@query(f"""with {_PRIOR}, j as (select p.*, m.w as mw, m.h as mh, top - bottom as own, kind = 'mark' and bottom < 0.9 and abs(bottom) >= 0.05 as hangs from p left join m using (ch)),
n as (select *, case when coalesce(mh, 0) <> 0 then greatest(least(mh, 2 * own), 0.5 * own) end as nh from j)
select ch, kind, round(case when coalesce(mw, 0) <> 0 then greatest(least(mw, 2 * w), 0.5 * w) else w end, 9) as w, round(case when nh is not null and hangs then top - nh else bottom end, 9) as bottom, round(case when nh is not null and not hangs then bottom + nh else top end, 9) as top from n""")
def sized_priors(spark, sf_dir):
    return layout.sized(*_priors(spark, sf_dir)).select("ch", "kind", *[F.round(c, 9).alias(c) for c in ("w", "bottom", "top")])


@query(f"with {_PRIOR} select ch, (kind = 'mark' and bottom >= 0.9) as above, (kind = 'base' or w > 0.1) as line from p")
def line_predicates(spark, sf_dir):
    p = _priors(spark, sf_dir)[0]
    return p.select("ch", layout.above_sign(F.col("kind"), F.col("bottom")).alias("above"), layout.on_line(F.col("kind"), F.col("bottom"), F.col("w")).alias("line"))


@query("with c as (select chr(97 + k::int) as ch, unnest([k, (k + 3) % 10]) as label from range(10) t(k)) select ch, count(*)::bigint as images from c join embeddings e on e.label = c.label group by 1")
def character_images(spark, sf_dir):
    """Images that can draw each character; every character may be written by two classes."""
    classes = spark.range(10).select(F.char(F.col("id") + 97).alias("ch"), F.array("id", (F.col("id") + 3) % 10).alias("classes"))
    return layout.candidates(_t(spark, sf_dir, "embeddings").select("label", "vec_id"), classes, "label").groupBy("ch").agg(F.count("*").alias("images"))


_GAPS = "b as (select p_size as word, p_partkey, (p_partkey * 37) % 9000 as x0, (p_partkey * 37) % 9000 + 8 as x1, case when p_partkey % 4 = 0 then 'mark' else 'base' end as kind, p_partkey // 3 as syllable from part), n as (select *, lead(kind) over w as nk, lead(syllable) over w as ns, lead(x0) over w as nx from b window w as (partition by word order by x0, x1, p_partkey))"


@query(f"with {_GAPS} select case when kind = 'base' and nk = 'base' then 'letter to letter' when nk = 'mark' then 'letter to sign beside it' else 'sign to next letter' end as between_, count(*)::bigint as n, round(median(nx - x1), 9) as median, count(*) filter (syllable = ns)::bigint as inside from n where nk is not null and nx > x0 group by 1")
def line_gap_report(spark, sf_dir):
    """Gaps of neighbours on a line by what they lie between."""
    k = F.col("p_partkey")
    b = _t(spark, sf_dir, "part").select(F.col("p_size").alias("word"), ((k * 37) % 9000).alias("x0"), ((k * 37) % 9000 + 8).alias("x1"), F.when(k % 4 == 0, "mark").otherwise("base").alias("kind"), F.floor(k / 3).alias("syllable"))
    gaps = layout.line_gaps(b).where("gap > -8")
    return gaps.groupBy(F.col("between").alias("between_")).agg(F.count("*").alias("n"), F.round(F.median("gap"), 9).alias("median"), F.count_if("inside").alias("inside"))


_LACK = "k as (select s_suppkey as page, n_nationkey as template, ((s_suppkey * 31 + n_nationkey * n_nationkey * 17 + s_nationkey) % 101) / 400.0::double as lack from supplier cross join nation)"


@query(f"with {_LACK}, r as (select *, row_number() over (partition by page order by lack, template) as i from k), t as (select page, max(template) filter (i = 1) as template, max(lack) filter (i = 1) as lacks, max(lack) filter (i = 2) as runner_up from r group by 1) select page, case when lacks < 0.05 and runner_up > 2 * lacks + 0.05 then template end as template, lacks, runner_up from t")
def page_templates(spark, sf_dir):
    """Which template a page was written on, if that is clear."""
    n = F.broadcast(_t(spark, sf_dir, "nation").select("n_nationkey"))  # 25 templates in any size
    both = _t(spark, sf_dir, "supplier").crossJoin(n)
    lack = ((F.col("s_suppkey") * 31 + F.col("n_nationkey") * F.col("n_nationkey") * 17 + F.col("s_nationkey")) % 101) / 400.0
    return layout.identified(both.select(F.col("s_suppkey").alias("page"), F.col("n_nationkey").alias("template"), lack.alias("lack")), "page", "template", "lack")


_SIGNS = "s as (select conv_id, turn, role from conversations where role = 'user'), q as (select conv_id, turn as x, length(coalesce(text, '')) as size from conversations where role = 'assistant')"


@query(f"with {_SIGNS}, a as (select *, row_number() over (partition by conv_id order by turn) as place, count(*) over (partition by conv_id) as n from s), b as (select *, row_number() over (partition by conv_id order by x) as place, count(*) over (partition by conv_id) as n from q) select a.conv_id, a.turn::bigint as turn, b.x::bigint as x, b.size::bigint as size from a join b on a.conv_id = b.conv_id and a.place = b.place and a.n = b.n")
def matched_signs(spark, sf_dir):
    """Signs and pieces paired from left to right where there are as many of each."""
    c = _t(spark, sf_dir, "conversations")
    signs = c.where("role = 'user'").select("conv_id", F.col("turn").cast("bigint").alias("turn"))
    found = c.where("role = 'assistant'").select("conv_id", F.col("turn").cast("bigint").alias("x"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))
    return layout.matched(signs, found, "conv_id", "turn", "x").select("conv_id", "turn", "x", "size")


@query("with r as (select l_returnflag as sign, l_discount - 0.02 as to_letter, l_tax - 0.01 as to_next, l_discount as centre_to_letter, l_tax as centre_to_next, l_linenumber > 5 as crossing from lineitem) select sign, count(*)::bigint as cases, round(avg((to_next <= to_letter)::int), 9) as body_nearer_next, round(avg((centre_to_next <= centre_to_letter)::int), 9) as centre_nearer_next, round(avg((to_letter <= 0)::int), 9) as touching, round(avg((to_letter < 0.03)::int), 9) as almost_stuck, round(avg(crossing::int), 9) as crossing, round(avg((to_next <= 0)::int), 9) as next_touching, round(median(to_letter), 9) as median_to_letter, round(median(to_next), 9) as median_to_next from r group by 1")
def sign_placement(spark, sf_dir):
    """Shares and medians of how signs stand to their neighbours."""
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sign"), (F.col("l_discount") - 0.02).alias("to_letter"), (F.col("l_tax") - 0.01).alias("to_next"), F.col("l_discount").alias("centre_to_letter"), F.col("l_tax").alias("centre_to_next"), (F.col("l_linenumber") > 5).alias("crossing"))
    told = layout.placement(rows, "sign")
    return told.select("sign", "cases", *[F.round(c, 9).alias(c) for c in ("body_nearer_next", "centre_nearer_next", "touching", "almost_stuck", "crossing", "next_touching", "median_to_letter", "median_to_next")])


# ---------------------------------------------------------------- decoding with a model


def _model(spark, sf_dir):
    """A model of the characters a to h: the classes of the test frames."""
    words = _counts(spark, sf_dir).select(F.regexp_replace("word", "[^a-h]", "").alias("word")).where("word <> ''").distinct()
    tables = language_model.counts(words)
    return decode.collected(language_model.back_off(tables, tables[1]), 3)


@query()
def ctc_beam_model(spark, sf_dir):
    """The prefix beam search with a character model."""
    dealt = _frames(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism)
    found = dealt.select("vec_id", decode.beam_udf(model=_model(spark, sf_dir), alphabet="abcdefg")("frames").alias("b"))
    return found.select("vec_id", labels.decode(F.col("b"), "abcdefg").alias("text"))


@query()
def segmented_beam_model(spark, sf_dir):
    """One character a frame, with a character model."""
    dealt = _frames(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism)
    return dealt.select("vec_id", decode.segmented_udf("abcdefgh", _model(spark, sf_dir))("frames").alias("text"))


@query("with f as (select vec_id, unnest(range(8)) as t, embedding from embeddings) select vec_id, string_agg(chr(96 + list_position(embedding[t*8+1:t*8+8], list_max(embedding[t*8+1:t*8+8]))::int), '' order by t) as text from f group by 1")
def segmented_plain(spark, sf_dir):
    """One character a frame, without a model."""
    return _frames(spark, sf_dir).select("vec_id", decode.segmented_udf("abcdefgh")("frames").alias("text"))


@query("select vec_id, k::double / 10 as alpha, j::double / 10 as beta, round(embedding[1] * (k::double / 10) + j::double / 10, 6) as score from embeddings cross join range(6) a(k) cross join range(4) b(j)")
def tuning_grid(spark, sf_dir):
    """Every setting of two parameters for every word."""
    grid = F.explode(F.flatten(F.array(*[F.array(*[F.struct(F.lit(k / 10).alias("alpha"), F.lit(j / 10).alias("beta")) for j in range(4)]) for k in range(6)]))).alias("s")
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("v"), grid).select("vec_id", "s.alpha", "s.beta", F.round(F.col("v") * F.col("s.alpha") + F.col("s.beta"), 6).alias("score"))

