"""One query per operator over the driver's tables, with the same query in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .operators import distribution as D
from .operators import division as S
from .operators import evaluate as E
from .operators import interpolate as I
from .operators import linalg as L
from .operators import merge as M
from .operators import results as R
from .operators import train as TR
from .operators import vocabulary as W
from .plans import pipelines as P
from .sources.corpus import document_lines, file_sentences, numbered_lines
from .sources import benchmarks as B
from .sources import vectors as SV
from .sources.vectors import intact, slices
from .storage import materialize, scratch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
PARTS, WINDOW, TOP = 4, 5, 200
STOP = ["the", "of", "and", "to", "in"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = CTE + sql
        return f

    return add


#: Shared inputs, as DataFrames and as SQL.
CTE = r"""
with recursive raw as (select doc_id, string_split(text, chr(10)) as ls from documents),
lines as (select row_number() over (order by doc_id, pos) - 1 as line_id, doc_id, pos, line from (select doc_id, unnest(range(len(ls))) as pos, unnest(ls) as line from raw)),
sent as (select line_id, list_filter(regexp_split_to_array(lower(line), '\s+'), lambda x: x <> '') as tokens from lines),
tok as (select line_id, unnest(tokens) as word from sent),
wc as (select word, count(*) as n from tok group by word),
origin as (select word, n, n / (select sum(n) from wc) as p from wc),
emb as (select cast(vec_id as varchar) as word, vec_id, label, cast(embedding as double[]) as vector from embeddings),
mod_a as (select word, list_slice(vector, 1, len(vector) // 2) as vector from emb where vec_id % 5 <> 0),
mod_b as (select word, list_slice(vector, len(vector) // 2 + 1, len(vector)) as vector from emb where vec_id % 7 <> 0),
models as (select m as model_id, word, vec_id, list_slice(vector, m * 16 + 1, m * 16 + 16) as vector from emb, range(4) r(m) where (vec_id + m) % 9 <> 0),
pairs as (select a.word as w1, b.word as w2, ((a.vec_id * 7919 + 3) % 101) / 10.0 as score from emb a join emb b on b.vec_id = a.vec_id + 3),
quads as (select vec_id as qid, cast(vec_id as varchar) as a, cast(vec_id + 1 as varchar) as b, cast(vec_id + 2 as varchar) as c, cast(vec_id + 3 as varchar) as answer, 'c' || label as category from emb where vec_id + 3 <= (select max(vec_id) from emb))
"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def lines(spark, d) -> DataFrame:
    return numbered_lines(docs(spark, d))


def sent(spark, d) -> DataFrame:
    return lines(spark, d).select("line_id", T.tokens("line", True).alias("tokens"))


def unnumbered(spark, d) -> DataFrame:
    """Token lists where line numbers do not matter: no numbering, no shuffle."""
    return document_lines(docs(spark, d)).select(T.tokens("line", True).alias("tokens"))


def tok(spark, d) -> DataFrame:
    return docs(spark, d).select(F.explode(T.tokens("text", True)).alias("word"))


def wc(spark, d) -> DataFrame:
    return W.word_count(tok(spark, d))


def origin(spark, d) -> DataFrame:
    return D.to_distribution(wc(spark, d))


def emb(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("word"), "vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))


def model_a(spark, d) -> DataFrame:
    return emb(spark, d).where("vec_id % 5 <> 0").select("word", F.slice("vector", F.lit(1), F.floor(F.size("vector") / 2).cast("int")).alias("vector"))


def model_b(spark, d) -> DataFrame:
    half = F.floor(F.size("vector") / 2).cast("int")
    return emb(spark, d).where("vec_id % 7 <> 0").select("word", F.slice("vector", half + 1, F.size("vector") - half).alias("vector"))


def models(spark, d) -> DataFrame:
    return slices(emb(spark, d).select("word", "vector"), 16).where("(cast(word as bigint) + model_id) % 9 <> 0").select(F.col("model_id").cast("int"), "word", "vector")


def pairs(spark, d) -> DataFrame:
    e = emb(spark, d)
    a, b = e.select(F.col("vec_id").alias("i"), F.col("word").alias("w1")), e.select((F.col("vec_id") - 3).alias("i"), F.col("word").alias("w2"))
    return a.join(b, "i").select("w1", "w2", (((F.col("i") * 7919 + 3) % 101) / 10.0).alias("score"))


def quads(spark, d) -> DataFrame:
    e = emb(spark, d)
    last = F.broadcast(e.agg(F.max("vec_id").alias("last")))  # one row
    return e.join(last).where("vec_id + 3 <= last").select(F.col("vec_id").alias("qid"), *((F.col("vec_id") + i).cast("string").alias(c) for i, c in enumerate(("a", "b", "c", "answer"))), F.concat(F.lit("c"), "label").alias("category"))


def benchmark_words(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(T.tokens("text", True)).alias("word")).distinct()


BENCH = "bw as (select distinct unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) as word from benchmark)"


def _modulo_counts(spark, d) -> DataFrame:
    """(part_id, word, n) of a modulo division: written, so the corpus is counted once."""
    return P.part_counts(S.modulo(sent(spark, d), PARTS).select("part_id", F.explode("tokens").alias("word")), ("part_id",))


def _r(c, n: int = 6):
    return F.round(c, n)


def _sum(v):
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


# corpora and vocabularies


@query(f", parts as (select line_id % {PARTS} as part_id, word, count(*) as n from tok group by all), pp as (select part_id, word, n / sum(n) over (partition by part_id) as p from parts) select cast(part_id as integer) as part_id, round(sum(pp.p * (ln(pp.p) - ln(o.p))), 6) as kl from pp join origin o using (word) group by part_id")
def kl_by_part_word(spark, d):
    return P.fidelity(lines(spark, d), PARTS).select("part_id", _r(F.col("kl")).alias("kl"))


@query("select count(*) as n_lines, cast(sum(line_id) as bigint) as ids, cast(sum(len(line)) as bigint) as chars, count(distinct doc_id) as n_docs from lines")
def line_sentences(spark, d):
    return lines(spark, d).agg(F.count("*").alias("n_lines"), F.sum("line_id").alias("ids"), F.sum(F.length("line")).alias("chars"), F.count_distinct("doc_id").alias("n_docs"))


@query("select word, n from wc")
def word_count(spark, d):
    return wc(spark, d)


@query(f"select word, n, row_number() over (order by n desc, word) - 1 as word_id from wc order by n desc, word limit {TOP}")
def vocab_topk(spark, d):
    return W.with_ids(W.most_frequent(wc(spark, d), TOP)).select("word", "n", "word_id")


@query("select word, n from wc where n >= 20")
def min_count_vocab(spark, d):
    return W.trimmed(wc(spark, d), 20)


@query(f", {BENCH} select word, n from wc where n >= 5 and word not in (select word from bw)")
def trim_rule_vocab(spark, d):
    return W.trimmed(wc(spark, d), 5, benchmark_words(spark, d))


@query(f", {BENCH} select word, n from wc where word in (select word from bw)")
def scan_vocab_dictionary(spark, d):
    return W.scan_vocabulary(tok(spark, d), benchmark_words(spark, d))


@query(r", s as (select doc_id, unnest(string_split(lower(replace(text, chr(10), ' ')), '.')) as s from documents), w as (select unnest(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x not in ('', 'the', 'of', 'and', 'to', 'in'))) as word from s) select word, count(*) as n from w group by word")
def sentence_filter_stopwords(spark, d):
    rows = file_sentences(docs(spark, d), STOP)
    return W.word_count(rows.select(F.explode("words").alias("word")))


@query(r"select lower(regexp_replace(word, '[\x00-\x08\x0a-\x1f!-,./:-@\[-^`{-\x{a9}\x{ab}-\x{b1}\x{b4}\x{b6}-\x{b8}\x{bb}\x{bf}\x{d7}\x{f7}]', '', 'g')) as word, cast(sum(n) as bigint) as n from wc group by 1")
def standardize_words(spark, d):
    return wc(spark, d).groupBy(T.standardize("word").alias("word")).agg(F.sum("n").alias("n"))


@query(r", t as (select unnest(regexp_extract_all(text, '[^\s]+')) as w from documents), f as (select distinct w, lower(w) as form from t) select form as word, max(w = form) as kept_case, case when max(w = form) then form else min(w) end as source from f group by form")
def dedupe_standardized(spark, d):
    words = docs(spark, d).select(F.explode(T.tokens("text")).alias("word")).distinct().withColumn("source", F.col("word"))
    out = W.transform_words(words, F.lower)
    return out.select("word", (F.col("source") == F.col("word")).alias("kept_case"), "source")


@query(r", t as (select page_id, list_filter(regexp_split_to_array(regexp_replace(html, '<[^>]*>', '', 'g'), '\s+'), lambda x: x <> '') as ts from pages) select page_id, len(ts) as n_tokens, cast(sum(len(w)) as bigint) as chars from (select page_id, ts, unnest(ts) as w from t) group by all")
def strip_tags_tokens(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.tokens(T.strip_tags("html")).alias("ts"))
    return rows.select("page_id", "ts", F.size("ts").cast("long").alias("n_tokens")).where("n_tokens > 0").select("page_id", "n_tokens", _sum(F.transform("ts", F.length)).cast("long").alias("chars"))


@query(r"select regexp_matches(word, '^[a-zA-Z]+[a-zA-Z0-9''_-]*') as valid, count(*) as words, cast(sum(n) as bigint) as n from wc group by 1")
def valid_words(spark, d):
    return wc(spark, d).groupBy(T.valid_word("word").alias("valid")).agg(F.count("*").alias("words"), F.sum("n").alias("n"))


@query("select count(*) as n from events where (event_type in ('click', 'view') or value between 10 and 20) and user_id >= 5")
def criteria_filter(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.where(T.all_criteria({"event_type": ["click", "view"], "value": (10, 20)}, "or") & T.all_criteria({"user_id": (5, None)})).agg(F.count("*").alias("n"))


@query("select user_id, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) as seconds from (select user_id, date_trunc('millisecond', ts) as ts from events) group by user_id")
def log_elapsed(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss,SSS").alias("s"))
    return e.groupBy("user_id").agg(F.min("s").alias("a"), F.max("s").alias("b")).select("user_id", _r(T.elapsed_seconds("a", "b"), 3).alias("seconds"))


@query("select d, round(1.0 / d, 6) as value from range(1, 11) t(d)")
def fraction_parse(spark, d):
    return spark.range(1, 11).select(F.col("id").alias("d"), _r(T.fraction(F.concat(F.lit("1/"), F.col("id").cast("string")))).alias("value"))


# division and sampling


def _stats(rows):
    return rows.groupBy("part_id").agg(F.count("*").alias("n_lines"), F.sum("line_id").alias("ids"))


@query(f"select cast(line_id % {PARTS} as integer) as part_id, count(*) as n_lines, cast(sum(line_id) as bigint) as ids from lines group by 1")
def modulo_partition_stats(spark, d):
    return _stats(S.divide(lines(spark, d), "modulo", PARTS))


@query(f"select cast(line_id * {PARTS} // (select count(*) from lines) as integer) as part_id, count(*) as n_lines, cast(sum(line_id) as bigint) as ids from lines group by 1")
def block_partition_stats(spark, d):
    rows = lines(spark, d)
    return _stats(S.divide(rows, "block", PARTS, total=docs(spark, d).agg(F.sum(F.size(F.split("text", "\n")))).first()[0]))


@query("select line_id from lines order by md5('7:' || line_id), line_id limit 100")
def reservoir_md5(spark, d):
    return S.reservoir(lines(spark, d).select("line_id"), 100, 7)


@query(f"select cast(part_id as integer) as part_id, line_id from (select part_id, line_id, row_number() over (partition by part_id order by md5('7:' || part_id || ':' || line_id), line_id) as r from lines, range({PARTS}) t(part_id)) where r <= 100")
def dist_reservoir_md5(spark, d):
    return S.sampling(lines(spark, d).select("line_id"), PARTS, 100, 7).select("part_id", "line_id")


@query()
def random_buckets(spark, d):
    return S.buckets(lines(spark, d)).groupBy("bucket").agg(F.count("*").alias("n"))


@query("select cast(size as integer) as size, repeat, model_id from (select size, repeat, model_id, row_number() over (partition by size, repeat order by md5('3:' || size || ':' || repeat || ':' || model_id), model_id) as r from range(1, 4) s(size), range(10) t(repeat), range(8) m(model_id)) where r <= size")
def model_subsets(spark, d):
    return S.subsets(spark.range(8).withColumnRenamed("id", "model_id"), range(1, 4), 10, 3)


@query("select a.i as a, b.i as b, c.i as c from range(6) a(i), range(6) b(i), range(6) c(i) where a.i < b.i and b.i < c.i")
def combinations(spark, d):
    return spark.createDataFrame(S.selections(6, 3), "a long, b long, c long")


# skip-grams and distributions


@query(f", v as (select word from wc order by n desc, word limit {TOP}), places as (select line_id, unnest(tokens) as word, unnest(range(len(tokens))) as i from sent) select a.word, b.word as context, count(*) as n from places a join places b on a.line_id = b.line_id and a.i <> b.i and abs(a.i - b.i) <= {WINDOW} where a.word in (from v) and b.word in (from v) group by all")
def skipgram_count(spark, d):
    v = W.most_frequent(wc(spark, d), TOP)
    return D.skipgram_count(unnumbered(spark, d), WINDOW, v).select("word", "context", "n")


@query(f", places as (select line_id, unnest(tokens) as word, unnest(range(len(tokens))) as i from sent), p as (select a.word as a, b.word as b from places a join places b on a.line_id = b.line_id and abs(a.i - b.i) = 2) select a, b, count(*) as n from p group by all having count(*) >= 5")
def offset_bigrams(spark, d):
    return D.offset_counts(unnumbered(spark, d), 2, 5)


@query(f", v as (select word from wc order by n desc, word limit {TOP}), places as (select line_id, unnest(tokens) as word, unnest(range(len(tokens))) as i from sent), g as (select a.line_id % {PARTS} as part_id, a.word, b.word as context, count(*) as n from places a join places b on a.line_id = b.line_id and a.i <> b.i and abs(a.i - b.i) <= {WINDOW} where a.word in (from v) and b.word in (from v) group by all), q as (select word, context, sum(n) / (select sum(n) from g) as q from g group by all), p as (select part_id, word, context, n / sum(n) over (partition by part_id) as p from g) select cast(part_id as integer) as part_id, round(sum(p * (ln(p) - ln(q))), 6) as kl from p join q using (word, context) group by part_id")
def kl_by_part_bigram(spark, d):
    v = materialize(W.most_frequent(wc(spark, d), TOP))  # TOP rows
    g = materialize(D.skipgram_count(S.modulo(sent(spark, d), PARTS), WINDOW, v, ("part_id",)))
    whole = D.to_distribution(g.groupBy("word", "context").agg(F.sum("n").alias("n")))
    return D.kl(g, whole, ["word", "context"], ("part_id",)).select("part_id", _r(F.col("kl")).alias("kl"))


@query(f", parts as (select line_id % {PARTS} as part_id, word, count(*) as n from tok group by all), pp as (select part_id, word, n / sum(n) over (partition by part_id) as p from parts), grid as (select t.part_id, o.word, o.p as q from origin o, range({PARTS}) t(part_id)) select cast(grid.part_id as integer) as part_id, round(sum(pow(coalesce(pp.p, 0) - q, 2)), 9) as ssd from grid left join pp on pp.part_id = grid.part_id and pp.word = grid.word group by 1")
def sov_by_part(spark, d):
    parts = _modulo_counts(spark, d)
    return D.squared_difference(parts, P.whole_of(parts), ["word"], ("part_id",)).select("part_id", _r(F.col("ssd"), 9).alias("ssd"))


@query(", b as (select d, line_id // ((select count(*) from lines) // d) as part_id, word, count(*) as n from tok, (values (4), (10)) t(d) group by all), p as (select d, part_id, word, n / sum(n) over (partition by d, part_id) as p from b where part_id < 10) select d, cast(part_id as integer) as part_id, round(sum(p.p * (ln(p.p) - ln(o.p))), 6) as kl from p join origin o using (word) group by all")
def kl_by_block_size(spark, d):
    n = docs(spark, d).agg(F.sum(F.size(F.split("text", "\n")))).first()[0]
    return P.block_fidelity(lines(spark, d), n, [4, 10], 10).select("d", "part_id", _r(F.col("kl")).alias("kl"))


@query(f", c as (select line_id % {PARTS} as part_id, word, count(*) as n from tok group by all), g as (select t.part_id, w.word from (select distinct word from c) w, range({PARTS}) t(part_id)), a as (select g.part_id, g.word, sum(coalesce(c.n, 0)) over (partition by g.word order by g.part_id) as n from g left join c on c.part_id = g.part_id and c.word = g.word), p as (select part_id, word, n / sum(n) over (partition by part_id) as p from a where n > 0) select cast(part_id as integer) as part_id, round(sum(p.p * (ln(p.p) - ln(o.p))), 6) as kl from p join origin o using (word) group by 1")
def accumulated_kl(spark, d):
    c = _modulo_counts(spark, d)
    return D.kl(D.accumulated(c, "part_id", ["word"]), P.whole_of(c), ["word"], ("part_id",)).select("part_id", _r(F.col("kl")).alias("kl"))


@query(", k as (select line_id, row_number() over (order by md5('5:' || line_id), line_id) as r from lines), s as (select size, word, count(*) as n from k join tok using (line_id), (values (100), (1000)) t(size) where r <= size group by all), p as (select size, word, n / sum(n) over (partition by size) as p from s) select size, round(sum(p.p * (ln(p.p) - ln(o.p))), 6) as kl from p join origin o using (word) group by size")
def nested_sample_kl(spark, d):
    rows = sent(spark, d)
    parts = None
    for size in (100, 1000):
        got = S.reservoir(rows, size, 5).select(F.lit(size).alias("size"), F.explode("tokens").alias("word"))
        parts = got if parts is None else parts.unionByName(got)
    return D.kl(W.word_count(parts, ("size",)), origin(spark, d), ["word"], ("size",)).select("size", _r(F.col("kl")).alias("kl"))


@query(", s as materialized (select word, p, case when p < 1e-5 then 0 else p end as p0 from (select word, n / sum(n) over () as p from wc)), t as materialized (select sum(p0) as total, count(*) filter (p0 = 0) as zeros from s) select word, round(case when p0 = 0 then 1e-9 else p0 - 1e-9 * zeros * p0 / total end, 12) as p from s, t")
def smoothing(spark, d):
    s = origin(spark, d).withColumn("p0", F.when(F.col("p") < 1e-5, 0.0).otherwise(F.col("p")))
    t = F.broadcast(s.agg(F.sum("p0").alias("total"), F.sum((F.col("p0") == 0).cast("long")).alias("zeros")))  # one row
    return s.join(t).select("word", _r(D.smoothed(F.col("p0"), F.col("total"), F.col("zeros"), 1e-9), 12).alias("p"))


HIST = ", h as (select w.word, least(len(list_filter(tokens, lambda x: x = w.word)), 1000) as bucket, count(*) as n from sent, (values ('the'), ('of'), ('and')) w(word) group by all)"


def _hist(spark, d):
    return D.occurrence_histogram(unnumbered(spark, d), ["the", "of", "and"])


@query(HIST + " select word, cast(bucket as integer) as bucket, n from h")
def occurrence_histogram(spark, d):
    return _hist(spark, d)


@query(HIST + ", f as (select word, bucket, n, sum(n) over (partition by word) as lines, sum(n * bucket) over (partition by word) as total, sum(n) over (partition by word order by bucket) as run from h) select word, cast(bucket as integer) as bucket, round(n / lines, 6) as pdf, round(run / lines, 6) as cdf, round(lines / total * exp(-lines / total * bucket), 6) as model_pdf, round(1 - exp(-lines / total * bucket), 6) as model_cdf from f")
def exponential_fit(spark, d):
    return D.exponential_fit(_hist(spark, d)).select("word", "bucket", *(_r(F.col(c)).alias(c) for c in ("pdf", "cdf", "model_pdf", "model_cdf")))


@query(HIST + ", x as (select word, n, ln(case when bucket = 0 then 0.1 else bucket end) as x from h), m as (select word, sum(n * x) / sum(n) as mu, sum(n * x * x) / sum(n) as m2 from x group by word) select word, round(mu, 6) as mu, round(sqrt(m2 - mu * mu), 6) as sigma, round(exp(-pow((ln(2.0) - mu) / sqrt(m2 - mu * mu), 2) / 2) / (2 * sqrt(m2 - mu * mu) * sqrt(2 * pi())), 6) as pdf2 from m")
def lognormal_fit(spark, d):
    f = D.lognormal_fit(_hist(spark, d))
    return f.select("word", _r(F.col("mu")).alias("mu"), _r(F.col("sigma")).alias("sigma"), _r(D.lognormal_pdf(F.lit(2.0), F.col("mu"), F.col("sigma"))).alias("pdf2"))


@query(f"select cast(sum(len(tokens)) as bigint) * 2 * {WINDOW} - {(1 + WINDOW) * WINDOW} * count(*) as total from sent")
def skipgram_total(spark, d):
    s = unnumbered(spark, d).agg(F.sum(F.size("tokens")).alias("n"), F.count("*").alias("s"))
    return s.select(D.skipgram_total(F.col("n"), F.col("s"), WINDOW).alias("total"))


# joins and set operations over embeddings


@query("select word, count(*) as n_models from models group by word")
def vocab_union_counts(spark, d):
    return W.union_counts(models(spark, d))


@query("select word from models group by word having count(*) = 4")
def vocab_intersection(spark, d):
    return W.intersection(models(spark, d), 4)


@query("select word from mod_a where word not in (select word from mod_b)")
def vocab_difference(spark, d):
    return W.only_in(model_a(spark, d), model_b(spark, d)).select("word")


@query("select e.word, a.word is not null as member from emb e left join mod_a a using (word)")
def membership_mask(spark, d):
    return W.membership(emb(spark, d).select("word"), model_a(spark, d))


@query(f", {BENCH}, v as (select line_id % {PARTS} as model_id, word, count(*) as n from tok group by all having count(*) >= 3) select cast(t.model_id as integer) as model_id, 'benchmark' as dataset, floor(count(v.word) * 1000 / count(*)) / 1000 as recall from bw cross join range({PARTS}) t(model_id) left join v on v.model_id = t.model_id and v.word = bw.word group by 1")
def vocab_recall(spark, d):
    v = W.word_count(S.modulo(sent(spark, d), PARTS).select(F.col("part_id").alias("model_id"), F.explode("tokens").alias("word")), ("model_id",)).where("n >= 3")
    return W.recall(v, benchmark_words(spark, d).withColumn("dataset", F.lit("benchmark")))


@query(f", {BENCH}, r as (select bw.word, coalesce(n, 0) as n, row_number() over (order by coalesce(n, 0), bw.word) as r, count(*) over () as c from bw left join wc using (word)) select word, n from r where r > c - c // 2")
def half_mask(spark, d):
    return W.half_mask(benchmark_words(spark, d), wc(spark, d))


def _vec(v, name="v"):
    return [_r(_sum(v), 5).alias(f"{name}_sum"), F.size(v).cast("long").alias(f"{name}_dim")]


@query("select a.word, round(list_sum(list_concat(a.vector, b.vector)), 5) as v_sum, len(a.vector) + len(b.vector) as v_dim from mod_a a join mod_b b using (word)")
def embedding_concat(spark, d):
    return W.concat(model_a(spark, d), model_b(spark, d)).select("word", *_vec(F.col("vector")))


@query("select word, round(sum(list_sum(vector)), 5) as v_sum, cast(sum(len(vector)) as bigint) as v_dim from models group by word having count(*) = 4")
def nway_vector_join(spark, d):
    return W.join_all(models(spark, d), 4).select("word", *_vec(F.col("vector")))


@query(", k as (select word from models group by word having count(*) = 4), x as (select word, unnest(vector) as x, unnest(range(16)) as i from models where word in (from k)) select word, i as pos, round(sum(x), 6) as x from x group by all")
def vector_add_merge(spark, d):
    return M.vector_add(models(spark, d), 4).select("word", F.posexplode("vector").alias("pos", "x")).select("word", F.col("pos").cast("long").alias("pos"), _r(F.col("x")).alias("x"))


@query(", x as (select unnest(vector) as x, unnest(range(len(vector))) as pos from emb) select pos, round(avg(x), 6) as x from x group by pos")
def mean_vector(spark, d):
    return V.mean_vector(emb(spark, d)).select(F.posexplode("vector").alias("pos", "x")).select(F.col("pos").cast("long").alias("pos"), _r(F.col("x")).alias("x"))


@query("select word, round(list_sum(list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y))))), 6) as l2, round(list_sum(list_transform(vector, lambda x: x / list_sum(list_transform(vector, lambda y: abs(y))))), 6) as l1, round(list_sum(list_transform(vector, lambda x: x / list_max(list_transform(vector, lambda y: abs(y))))), 6) as linf from emb")
def l2_normalize(spark, d):
    e = emb(spark, d)
    return e.select("word", _r(_sum(V.normalize("vector"))).alias("l2"), _r(_sum(V.normalize("vector", 1))).alias("l1"), _r(_sum(V.normalize("vector", float("inf")))).alias("linf"))


@query(", x as materialized (select vec_id, unnest(vector) as x, unnest(range(len(vector))) as i from emb), m as (select a.i as row, b.i as col, sum(a.x * b.x) as v, sum(a.x) as sa, sum(b.x) as sb, count(*) as n from x a join x b using (vec_id) group by all) select row, col, round(v, 4) as gram, round(v - sa * sb / n, 4) as covariance from m")
def gram_matrix(spark, d):
    e = emb(spark, d).select("vector")
    m, c = L.gram(e), L.gram(e, centred=True)
    rows = [(i, j, round(float(m[i, j]), 4), round(float(c[i, j]), 4)) for i in range(len(m)) for j in range(len(m))]
    return spark.createDataFrame(rows, "row long, col long, gram double, covariance double")


@query("select word, round(list_sum(vector), 5) as v_sum, len(vector) as v_dim from mod_b union all select word, 0.0, len(vector) from mod_a where word not in (select word from mod_b)")
def fill_zero(spark, d):
    return W.fill_zero(model_a(spark, d), model_b(spark, d)).select("word", *_vec(F.col("vector")))


@query("select a.word, case when b.word is null then 'validation' else 'train' end as role, round(list_sum(a.vector), 5) as s, round(coalesce(list_sum(b.vector), 0), 5) as t from mod_a a left join mod_b b using (word)")
def extrinsic_split(spark, d):
    return W.extrinsic_split(model_a(spark, d), model_b(spark, d)).select("word", "role", _r(_sum("source"), 5).alias("s"), _r(_sum("target"), 5).alias("t"))


@query(", j as (select word, row_number() over (order by word) as r, count(*) over () as n from mod_a join mod_b using (word)) select word, case when r <= round(n * 0.6) then 'train' when r <= round(n * 0.6) + round(n * 0.4) then 'test' else 'validation' end as role from j")
def intrinsic_split(spark, d):
    return W.intrinsic_split(model_a(spark, d), model_b(spark, d)).select("word", "role")


@query("select cast(model_id as integer) as model_id, count(*) as n_words, cast(0 as bigint) as n_bad, cast(0 as bigint) as n_wrong_length from models group by model_id")
def submodel_integrity(spark, d):
    return intact(models(spark, d), 16)


@query("select sqrt(sum(list_sum(list_transform(list_zip(a.vector, b.vector), lambda p: pow(p[1] - p[2], 2))))).round(5) as error from mod_a a join mod_b b using (word)")
def frobenius_error(spark, d):
    return spark.createDataFrame([(round(I.frobenius(model_a(spark, d), model_b(spark, d)), 5),)], "error double")


# evaluation

MEAN = ", mean as (select list(x order by i) as m from (select i, avg(x) as x from (select unnest(vector) as x, unnest(range(len(vector))) as i from mod_a) group by i)), av as (select e.word, coalesce(a.vector, (select m from mean)) as vector from emb e left join mod_a a using (word))"


@query(MEAN + ", s as (select score, list_dot_product(x.vector, y.vector) as model from pairs join av x on x.word = w1 join av y on y.word = w2), r as (select rank() over (order by model) + (count(*) over (partition by model) - 1) / 2 as rx, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as ry from s) select round(corr(rx, ry), 6) as spearman, count(*) as n from r")
def similarity_spearman(spark, d):
    p = pairs(spark, d)
    s = E.similarity_scores(p, model_a(spark, d))
    return E.spearman(s.withColumn("model", _r(F.col("model"), 12)), "model", "score").select(_r(F.col("spearman")).alias("spearman")).join(F.broadcast(s.agg(F.count("*").alias("n"))))


ANSWERS = ", q as (select quads.*, ea.vector as va, eb.vector as vb, ec.vector as vc from quads join emb ea on ea.word = a join emb eb on eb.word = b join emb ec on ec.word = c)"


@query(ANSWERS + ", s as (select qid, e.word, list_dot_product(e.vector, vb) - list_dot_product(e.vector, va) + list_dot_product(e.vector, vc) as s from q join emb e on e.word not in (a, b, c)), r as (select *, row_number() over (partition by qid order by s desc, word) as r from s) select qid, word as predicted, round(s, 5) as score from r where r = 1")
def analogy_add(spark, d):
    return E.analogy_answers(quads(spark, d), emb(spark, d)).select("qid", "predicted", _r(F.col("score"), 5).alias("score"))


UNIT = ", u as (select word, vec_id, list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) as vector from emb), q as (select quads.*, ea.vector as va, eb.vector as vb, ec.vector as vc from quads join u ea on ea.word = a join u eb on eb.word = b join u ec on ec.word = c)"


@query(UNIT + ", s as (select qid, e.word, ln((1 + list_dot_product(e.vector, vb)) / 2 + 1e-5) + ln((1 + list_dot_product(e.vector, vc)) / 2 + 1e-5) - ln((1 + list_dot_product(e.vector, va)) / 2 + 1e-5) as s from q join u e on e.word not in (a, b, c)), r as (select *, row_number() over (partition by qid order by s desc, word) as r from s) select qid, word as predicted, round(s, 5) as score from r where r = 1")
def analogy_mul(spark, d):
    e = emb(spark, d).withColumn("vector", V.normalize("vector"))
    return E.analogy_answers(quads(spark, d), e, "mul").select("qid", "predicted", _r(F.col("score"), 5).alias("score"))


@query(ANSWERS + ", s as (select qid, answer, category, e.word, list_dot_product(e.vector, vb) - list_dot_product(e.vector, va) + list_dot_product(e.vector, vc) as s from q join emb e on e.word not in (a, b, c)), r as (select *, row_number() over (partition by qid order by s desc, word) as r from s) select category, count(*) as n, cast(sum(cast(word = answer as integer)) as bigint) as correct, round(avg(cast(word = answer as integer)), 6) as accuracy from r where r = 1 group by rollup (category)")
def analogy_rollup(spark, d):
    a = E.analogy_accuracy(E.analogy_answers(quads(spark, d), emb(spark, d)))
    return a.select("category", "n", "correct", _r(F.col("accuracy")).alias("accuracy"))


WORDREP = ", wp as (select 'c' || a.label as category, a.label % 2 as high, a.word as l, b.word as r from emb a join emb b on b.vec_id = a.vec_id + 1 where a.vec_id % 7 = 0), wr as (select *, row_number() over (partition by category order by l, r) as k from wp), wq as (select x.category, x.high, x.l as a, x.r as b, y.l as c, y.r as answer from wr x join wr y using (category) where x.k <= 5 and y.k <= 5 and x.k <> y.k)"


@query(WORDREP + " select category, count(*) as n, count(distinct a) as firsts from wq group by category")
def wordrep_pairs(spark, d):
    return E.wordrep_questions(_wordrep(spark, d), 5).groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("a").alias("firsts"))


@query(", pr as (select 'c' || (a.vec_id % 5) as category, a.vec_id as i, a.word as l, b.word as r, ((a.vec_id * 7919) % 101) / 10.0 as score, a.vector as vl, b.vector as vr from emb a join emb b on b.vec_id = a.vec_id + 1), o as (select category, i, score, list_transform(list_zip(vl, vr), lambda p: p[1] - p[2]) as o from pr), m as (select category, list(x order by k) as m from (select category, k, avg(x) as x from (select category, unnest(o) as x, unnest(range(len(o))) as k from o where i % 10 = 0) group by all) group by category), s as (select category, score, round(list_dot_product(o, m), 12) as model from o join m using (category)), r as (select category, rank() over (partition by category order by model) + (count(*) over (partition by category, model) - 1) / 2 as rx, rank() over (partition by category order by score) + (count(*) over (partition by category, score) - 1) / 2 as ry from s) select category, round(corr(rx, ry), 5) as spearman from r group by category")
def semeval_scores(spark, d):
    e = emb(spark, d)
    p = e.select("vec_id", F.col("word").alias("left")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("word").alias("right")), "vec_id").select("vec_id", F.concat(F.lit("c"), (F.col("vec_id") % 5).cast("string")).alias("category"), "left", "right", (((F.col("vec_id") * 7919) % 101) / 10.0).alias("score"))
    return E.relational(p, p.where("vec_id % 10 = 0"), e).select("category", _r(F.col("spearman"), 5).alias("spearman"))


@query(", g as (select vec_id % 7 as predicted, label, count(*) as n from emb group by all) select round(sum(m) / sum(n), 6) as purity from (select predicted, max(n) as m, cast(sum(n) as bigint) as n from g group by predicted)")
def cluster_purity(spark, d):
    return E.purity(emb(spark, d).withColumn("predicted", F.col("vec_id") % 7), "label").select(_r(F.col("purity")).alias("purity"))


@query(", d as (select a.word as query, b.word, 1 - list_dot_product(a.vector, b.vector) / sqrt(list_dot_product(a.vector, a.vector) * list_dot_product(b.vector, b.vector)) as d from emb a join emb b on a.word <> b.word where a.vec_id % 20 = 0), r as (select *, row_number() over (partition by query order by d, word) as rank from d) select query, word, round(d, 5) as distance, rank from r where rank <= 5")
def knn_cosine(spark, d):
    e = emb(spark, d)
    return E.neighbours(e.where("vec_id % 20 = 0"), e, 5).select("query", "word", _r(F.col("distance"), 5).alias("distance"), "rank")


@query("select qid from quads where a in (select word from mod_a) and b in (select word from mod_a) and c in (select word from mod_a) and answer in (select word from mod_a)")
def demanded_filter(spark, d):
    return W.demanded(quads(spark, d), ["a", "b", "c", "answer"], model_a(spark, d)).select("qid")


@query("select label as nsubs, round(min(x), 6) as low, round(quantile_cont(x, 0.25), 6) as q1, round(quantile_cont(x, 0.5), 6) as median, round(quantile_cont(x, 0.75), 6) as q3, round(max(x), 6) as high from (select label, vector[1] as x from emb) group by label")
def metrics_by_nsubs(spark, d):
    b = R.box(emb(spark, d).select(F.col("label").alias("nsubs"), F.col("vector")[0].alias("x")), "nsubs", "x")
    return b.select("nsubs", *(_r(F.col(c)).alias(c) for c in ("low", "q1", "median", "q3", "high")))


@query("select label, round(avg(vector[1]), 6) as x, round(avg(vector[2]), 6) as y from emb group by label")
def metric_means(spark, d):
    m = R.mean_by(emb(spark, d).select("label", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y")), ["label"], ["x", "y"])
    return m.select("label", _r(F.col("x")).alias("x"), _r(F.col("y")).alias("y"))


# results that are random, iterative, or unique only up to rotation: tests hold their invariants


#: Squared lengths do not depend on the basis: with all directions kept they are those of the centred vectors.
@query(", k as (select word from models group by word having count(*) = 4), x as materialized (select word, model_id * 16 + i as i, x from (select word, model_id, unnest(vector) as x, unnest(range(16)) as i from models where word in (from k))), m as (select i, avg(x) as m from x group by i) select word, round(sum((x - m) * (x - m)), 4) as norm2, count(*) as dim from x join m using (i) group by word")
def pca_merge(spark, d):
    v = F.col("vector")
    return M.pca(models(spark, d), 4).select("word", _r(_sum(F.transform(v, lambda x: x * x)), 4).alias("norm2"), F.size(v).cast("long").alias("dim"))


@query(", k as (select word from models group by word having count(*) = 4) select word, round(sum(list_sum(vector)), 5) as v_sum, cast(16 as bigint) as v_dim from models where word in (from k) group by word")
def fold_add(spark, d):
    m = models(spark, d)
    return M.fold([m.where(F.col("model_id") == i).select("word", "vector") for i in range(4)], "binary").select("word", *_vec(F.col("vector")))


@query()
def linear_merge(spark, d):
    return M.linear_transform(model_a(spark, d), model_b(spark, d)).select("word", *_vec(F.col("vector")))


@query()
def lra_merge(spark, d):
    return M.lra([model_a(spark, d), model_b(spark, d)], 8).select("word", *_vec(F.col("vector")))


@query()
def interpolate_methods(spark, d):
    return P.missing_words(model_a(spark, d), model_b(spark, d), pairs(spark, d))


@query()
def consensus(spark, d):
    m = models(spark, d)
    return I.consensus([m.where(F.col("model_id") == i).select("word", "vector") for i in range(3)], 3)[0].select("word", *_vec(F.col("vector")))


@query()
def train_submodels(spark, d):
    parts = S.modulo(lines(spark, d), 8).withColumn("tokens", T.tokens("line", True))
    return TR.train_parts(parts, size=16, window=4, min_count=10, epochs=1).groupBy("model_id").agg(F.count("*").alias("n_words"))


@query()
def categorization_purity(spark, d):
    e = emb(spark, d)
    words = e.select(F.lit("labels").alias("dataset"), "word", F.col("label").cast("string").alias("cluster"))
    return E.categorization(words, e)


# readers and writers: tables written in a format and read back, against the table itself

READ = "select word, round(list_sum(vector), 4) as v_sum, len(vector) as v_dim from emb"


def _back(df: DataFrame) -> DataFrame:
    return df.select("word", _r(_sum(F.col("vector")), 4).alias("v_sum"), F.size("vector").cast("long").alias("v_dim"))


@query(READ)
def word2vec_text_round_trip(spark, d):
    path = scratch(spark)
    SV.write_word2vec_text(emb(spark, d), path)
    return _back(SV.load(spark, path, "word2vec"))


@query(READ)
def csv_round_trip(spark, d):
    path = scratch(spark)
    SV.write_csv(emb(spark, d), path)
    return _back(SV.load(spark, path, "csv"))


@query(READ)
def hadoop_lines(spark, d):
    path = scratch(spark)
    numbers = F.array_join(F.transform("vector", lambda x: x.cast("string")), ",")
    emb(spark, d).select(F.concat(F.lit("'"), "word", F.lit("':"), numbers)).write.text(path)
    return _back(SV.load(spark, path, "hadoop"))


@query(READ)
def glove_lines(spark, d):
    path, e = scratch(spark), emb(spark, d)
    e.select(F.concat_ws(" ", "word", F.array_join(F.transform("vector", lambda x: x.cast("string")), " "))).write.text(path)
    return _back(SV.load(spark, path, "glove", dim=e.select(F.size("vector")).first()[0]))


@query("select cast(model_id as integer) as model_id, count(*) as n_words, round(sum(list_sum(vector)), 3) as v_sum from models group by model_id")
def model_parts_round_trip(spark, d):
    path = scratch(spark)
    SV.write_parts(models(spark, d), path)
    return spark.read.parquet(path).groupBy(F.col("model_id").cast("int").alias("model_id")).agg(F.count("*").alias("n_words"), _r(F.sum(_sum(F.col("vector"))), 3).alias("v_sum"))


@query(f"select cast(line_id % {PARTS} as integer) as part_id, count(*) as n_lines, cast(sum(len(line)) as bigint) as chars from lines group by 1")
def sub_corpora_round_trip(spark, d):
    path = scratch(spark)
    SV.write_bundles(S.modulo(lines(spark, d), PARTS), path)
    back = spark.read.schema("value string, part_id int").text(path)
    return back.groupBy("part_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("value")).alias("chars"))


@query("select word, cast(n as bigint) as count from wc where n >= 20 and not regexp_matches(word, '\\s')")
def vocabulary_file_round_trip(spark, d):
    from .sources.corpus import vocabulary_file

    path = scratch(spark)
    W.trimmed(wc(spark, d), 20).where(~F.col("word").rlike(r"\s")).select(F.concat_ws(" ", "word", F.col("n").cast("string"))).write.text(path)
    return vocabulary_file(spark, path)


@query("select a.label, a.word as w1, b.word as w2, round(((a.vec_id * 7919 + 3) % 101) / 25.0 / 2, 6) as score from emb a join emb b on b.vec_id = a.vec_id + 3")
def men_pairs(spark, d):
    path, e = scratch(spark), emb(spark, d)
    p = pairs(spark, d)
    p.select(F.concat_ws(" ", F.concat("w1", F.lit("-n")), F.concat("w2", F.lit("-v")), F.col("score").cast("string"))).write.text(path)
    return B.men(spark, path).join(e.select(F.col("word").alias("w1"), "label"), "w1").select("label", "w1", "w2", _r(F.col("score")).alias("score"))


@query("select a, b, c, answer, 'gram' || cast(substr(category, 2) as bigint) % 3 as category, 'syntactic' as category_high from quads")
def google_analogy_blocks(spark, d):
    text = F.concat_ws(" ", "a", "b", "c", "answer")
    rows = quads(spark, d).withColumn("k", F.concat(F.lit("gram"), (F.substring("category", 2, 20).cast("long") % 3).cast("string")))
    line = rows.select("k", F.lit(1).alias("order"), "qid", text.alias("line")).union(rows.select("k", F.lit(0), F.lit(0).cast("long"), F.concat(F.lit(": "), "k")).distinct())
    number = F.xxhash64("k") * 0 + F.regexp_extract("k", "[0-9]+", 0).cast("long") * 10**9 + F.col("order") * 10**6 + F.col("qid")
    return B.fill_categories(line.select(number.alias("line_id"), "line"))


# lookups and table operations


@query("select a.word, round(list_sum(a.vector), 5) as v_sum, len(a.vector) as v_dim from mod_a a where word in (select word from mod_b)")
def restrict_embedding(spark, d):
    return W.restrict(model_a(spark, d), model_b(spark, d)).select("word", *_vec(F.col("vector")))


@query("select word, round(list_sum(vector), 5) as v_sum, len(vector) as v_dim from mod_a where word not in (select word from mod_b) union all select word, round(list_sum(vector), 5), len(vector) from mod_b")
def append_disjoint(spark, d):
    a, b = model_a(spark, d), model_b(spark, d)
    return W.append(W.remove(a, b), b).select("word", *_vec(F.col("vector")))


@query("select word, round(list_sum(vector), 5) as v_sum, len(vector) as v_dim from mod_a where word not in (select word from mod_b) union all select word, round(list_sum(vector), 5), len(vector) from mod_b")
def upsert_rows(spark, d):
    return W.upsert(model_a(spark, d), model_b(spark, d)).select("word", *_vec(F.col("vector")))


@query("select e.word, round(coalesce(list_sum(a.vector), 0), 5) as v_sum from emb e left join mod_a a using (word)")
def lookup_default(spark, d):
    zero = F.array(F.lit(0.0))
    return W.lookup(emb(spark, d).select("word"), model_a(spark, d), zero).select("word", _r(_sum(F.col("vector")), 5).alias("v_sum"))


@query(f", {BENCH}, v as (select word, row_number() over (order by n desc, word) - 1 as word_id from wc) select word, word_id from v where word in (from bw)")
def index_table(spark, d):
    return W.index_table(benchmark_words(spark, d), W.with_ids(wc(spark, d)).select("word", "word_id"))


@query("select case when w like 'VB%' then 'verb' when w like 'NN%' then 'noun' else 'adjective' end as pos, case when w like 'gram%' then 'syntactic' else 'semantic' end as level, count(*) as n from (select (['VBD_VBZ', 'NNS_NN', 'JJR_JJS', 'gram1-adverb', 'capital'])[1 + label % 5] as w from emb) group by all")
def category_levels(spark, d):
    names = F.array(*map(F.lit, ("VBD_VBZ", "NNS_NN", "JJR_JJS", "gram1-adverb", "capital")))
    rows = emb(spark, d).select(names[(F.col("label") % 5).cast("int")].alias("w"))
    return rows.groupBy(T.part_of_speech("w").alias("pos"), T.high_level("w").alias("level")).agg(F.count("*").alias("n"))


@query(", dd as (select a.word as query, b.word, a.vec_id, 1 - list_dot_product(a.vector, b.vector) / sqrt(list_dot_product(a.vector, a.vector) * list_dot_product(b.vector, b.vector)) as d from emb a join emb b on a.word <> b.word where a.vec_id % 20 = 0), r as (select *, row_number() over (partition by query order by d, word) as rank from dd) select e.word as x, cast(e.vec_id + 1 as varchar) as y, round(coalesce(1.0 / r.rank, 0.5), 6) as score from emb e left join r on r.query = e.word and r.word = cast(e.vec_id + 1 as varchar) and r.rank <= 100 where e.vec_id % 20 = 0")
def reciprocal_rank(spark, d):
    e = emb(spark, d).where("vec_id % 20 = 0")
    ranked = E.neighbours(e, emb(spark, d), 100).select(F.col("query").alias("x"), F.col("word").alias("y"), "rank")
    return W.reciprocal_rank(ranked, e.select(F.col("word").alias("x"), (F.col("vec_id") + 1).cast("string").alias("y")), 100, 0.5).select("x", "y", _r(F.col("score")).alias("score"))


@query(HIST + ", g as (select w.word, b.bucket, coalesce(h.n, 0) + 1 as n from (select word, max(bucket) as top from h group by word) w cross join range(1001) b(bucket) left join h on h.word = w.word and h.bucket = b.bucket where b.bucket <= w.top), x as (select word, bucket, n, ln(case when bucket = 0 then 1e-6 else bucket end) as x from g), m as (select word, sum(n) as total, sum(n * x) / sum(n) as mu, sum(n * x * x) / sum(n) as m2 from x group by word), f as (select word, total, mu, sqrt(m2 - mu * mu) as s from m) select g.word, scale, round(sum(n / total * (ln(n / total) - ln(scale * exp(-pow((ln(bucket) - mu) / s, 2) / 2) / (bucket * s * sqrt(2 * pi()))))), 6) as kl from g join f using (word), (values (10.0), (15.0), (20.0)) t(scale) where bucket > 0 group by all")
def lognormal_kl(spark, d):
    return D.lognormal_kl(_hist(spark, d), (10, 15, 20)).select("word", "scale", _r(F.col("kl")).alias("kl"))


@query(WORDREP + ", q as (select wq.*, ea.vector as va, eb.vector as vb, ec.vector as vc from wq join emb ea on ea.word = a join emb eb on eb.word = b join emb ec on ec.word = c), s as (select a, b, c, answer, category, high, e.word, list_dot_product(e.vector, vb) - list_dot_product(e.vector, va) + list_dot_product(e.vector, vc) as s from q join emb e on e.word not in (a, b, c)), r as (select *, row_number() over (partition by category, a, b, c, answer order by s desc, word) as r from s), o as (select category, cast(high as varchar) as high, cast(word = answer as bigint) as hit from r where r = 1) select 'category' as level, category as name, count(*) as n, cast(sum(hit) as bigint) as correct from o group by category union all select 'high', high, count(*), cast(sum(hit) as bigint) from o group by high union all select 'all', 'all', count(*), cast(sum(hit) as bigint) from o")
def wordrep_levels(spark, d):
    answered = E.analogy_answers(E.wordrep_questions(_wordrep(spark, d), 5), emb(spark, d))
    return E.wordrep_summary(answered).select("level", "name", "n", "correct")


def _wordrep(spark, d) -> DataFrame:
    e = emb(spark, d)
    return e.where("vec_id % 7 = 0").select("vec_id", F.concat(F.lit("c"), "label").alias("category"), (F.col("label") % 2).cast("string").alias("category_high"), F.col("word").alias("left")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("word").alias("right")), "vec_id")


@query()
def evaluate_everything(spark, d):
    e = emb(spark, d)
    words = e.select(F.lit("labels").alias("dataset"), "word", F.col("label").cast("string").alias("cluster"))
    b = E.Benchmarks(pairs(spark, d).withColumn("dataset", F.lit("pairs")), quads(spark, d), words, wordrep=_wordrep(spark, d), max_pairs=None)
    return E.evaluate_batch({"all": e}, b).unionByName(E.evaluate_demanded(e, b, model_a(spark, d), "demanded"))


@query()
def configuration_grid(spark, d):
    v = W.with_ids(W.most_frequent(wc(spark, d), TOP)).select("word", "word_id")
    near = v.select(F.col("word").alias("w1"), F.col("word_id").alias("i")).join(v.select(F.col("word").alias("w2"), (F.col("word_id") - 1).alias("i")), "i")
    return P.run_grid(lines(spark, d), 2, near.select("w1", "w2", (F.col("i") % 10).cast("double").alias("score")), ["modulo"], ["concat", "sequential/add"], [False, True], size=8, window=2, min_count=20, epochs=1)
