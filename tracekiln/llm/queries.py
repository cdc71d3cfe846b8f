"""The ``opN_*`` queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, collocations, common, decontaminate, jaccard_join, line_dedup, mtree, packing, quality, spelling, token_store, toxicity,
               url_filter, warc_zst)
from .common import table

END_ID = 2

# The rules that op4 judges by.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]

# The conversation that op3 adds.
PLANTED = r"\### Assistant: </turn> ok"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


HELD_OUT = "pmod(crc32(cast(doc_id as string)), 5) = 0"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; rows with crc32(doc_id) mod 5 = 0 teach nothing."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.fit(docs, labels.where(f"not ({HELD_OUT})"))
    return (docs.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"),
                        toxicity.score_column(docs, net, F.col("text")).alias("score"),
                        toxicity.threshold_column(net, F.col("lang")).alias("lang_threshold"))
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lang_threshold"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that nearly repeat an earlier line."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


OP2_SQL = """
with docs as (select distinct doc_id, text, string_split(text, chr(10)) as l from documents),
lines as (select doc_id, p - 1 as pos, trim(l[p], ' ') as line from docs, lateral unnest(range(1, len(l) + 1)) as t(p)),
firsts as (select line, min((doc_id, pos)) as first from lines where line <> '' group by line),
words as (select line, first, string_split(line, ' ') as w from firsts where len(string_split(line, ' ')) >= 8),
keys as (select line, first, p as place, line as rest from words, lateral unnest(range(0, len(w) + 1)) as t(p)
         union all select line, first, p, array_to_string(list_concat(w[1:p], w[p + 2:]), ' ') from words, lateral unnest(range(0, len(w))) as t(p)),
kept as (select place, md5(rest) as rest, min(first) as first from keys group by all having count(*) > 1),
later as (select distinct line from keys join kept on keys.place = kept.place and md5(keys.rest) = kept.rest where keys.first > kept.first),
stay as (select first from firsts where line not in (select line from later)),
flagged as (select d.doc_id, d.pos, d.line = '' or s.first is not null as keep
            from lines d left join stay s on s.first = (d.doc_id, d.pos)),
lost as (select doc_id, list(pos order by pos) filter (where keep) as kept from flagged group by doc_id)
select documents.doc_id, coalesce(len(string_split(text, chr(10))), 0) as n_lines, coalesce(len(kept), 0) as n_kept,
       case when text is null then null else coalesce(array_to_string(list_transform(kept, lambda i: string_split(text, chr(10))[i + 1]), chr(10)), '') end as text
from documents left join lost using (doc_id)
"""


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -7 formatted; digests read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], rows.schema)
    return chat_format.digests(chat_format.format_conversations(rows.unionByName(extra)))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, winning rule and verdict of every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


OP4_SQL = """
with rules(rh, rp, rv) as (values {rules}),
rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
u as (select distinct coalesce(host, '') as host, coalesce(path, '') as path from parts),
best as (select u.host, u.path, arg_max(rh || rp, (length(rh) + length(rp)) * 100000 + length(rh)) as rule,
                arg_max(rv, (length(rh) + length(rp)) * 100000 + length(rh)) as rv
         from u join rules on (u.host = rh or ends_with(u.host, '.' || rh)) and starts_with(u.path, rp) group by all)
select page_id, coalesce(parts.host, '') as host, coalesce(parts.path, '') as path, rule, coalesce(rv, 'allow') as verdict
from parts left join best on best.host = coalesce(parts.host, '') and best.path = coalesce(parts.path, '')
""".replace("{rules}", ", ".join(str(r) for r in URL_RULES))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item contained in each document."""
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
with words as (
  select 'd' as k, doc_id as id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents
  union all select 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') from (select distinct item_id, text from benchmark)),
item as (select id, w, least(5, len(w)) as g from words where k = 'i' and len(w) > 0),
item_sh as (select distinct id, g, list_slice(w, p, p + g - 1) as s from item, lateral unnest(range(1, len(w) - g + 2)) as t(p)),
sizes as (select id, count(*) as n from item_sh group by id),
doc_sh as (select distinct d.id, x.g, list_slice(d.w, p, p + x.g - 1) as s
           from words d, (select distinct g from item) x, lateral unnest(range(1, len(d.w) - x.g + 2)) as t(p) where d.k = 'd')
select d.id as doc_id, i.id as item_id, count(*) as n_shared, any_value(sizes.n) as n_shingles,
       count(*) / any_value(sizes.n) as containment
from doc_sh d join item_sh i on d.g = i.g and d.s = i.s join sizes on sizes.id = i.id
group by d.id, i.id having count(*) * 5 >= any_value(sizes.n) * 4
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written to archives and read back."""
    got = warc_zst.roundtrip(spark, table(spark, sf_dir, "pages"), common.scratch_path(spark, "warc"), min_bytes=0)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, group and number of similar documents of every document."""
    return (jaccard_join.similarity_join(table(spark, sf_dir, "documents"))
            .select("doc_id", "class_id", "group_id", "n_links"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin and offset of every piece of every document."""
    return packing.pack(packing.with_lengths(table(spark, sf_dir, "documents")))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products for each hundredth vector."""
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
with vecs as (select distinct vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
              where vec_id is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id as vec_id,
                  list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
           from vecs q join vecs c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 10
"""


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written in ascending doc_id order and read back."""
    manifest = token_store.write_store(table(spark, sf_dir, "documents"), common.scratch_path(spark, "tokens"),
                                       tokenizer_path(), END_ID)
    return token_store.read_store(manifest)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every repeated long word."""
    return spelling.group_variants(spelling.count_words(table(spark, sf_dir, "documents")))


OP11_SQL = """
with recursive
polynomial as (select list(list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
               from range(256) as r(i)),
runs as (select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
counted as (select id, run, count(*) as n from runs where length(run) >= 7 group by all),
bytes as (select id, run, n, list_transform(range(0, octet_length(encode(id || ':' || run)) * 2, 2),
                 lambda p: ('0x' || hex(encode(id || ':' || run))[p + 1:p + 2])::bigint) as b from counted),
hashed as (select run, n, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as h from bytes, polynomial),
dropped as (select case when h % 31 = 0 then run[1:(h % length(run))::int] || run[(h % length(run))::int + 2:] else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from dropped where length(word) >= 7 group by word having sum(n) >= 2),
places as (select word, n, unnest(range(0, length(word) + 1)) as p from words),
holes as (select word, n, 'r' || p || ':' || word[1:p] || '_' || word[p + 2:] as k from places where p < length(word)),
less as (select distinct word, n, word[1:p] || word[p + 2:] as k from places where p < length(word)),
near as (select a.word, b.word as x, b.n as xn from holes a join holes b on a.k = b.k and a.word <> b.word
         union all select l.word, w.word, w.n from less l join words w on l.k = w.word
         union all select w.word, l.word, l.n from less l join words w on l.k = w.word),
best as (select word, count(*) as n_near, min((-xn, x)) as b from near group by word),
formed as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when -b[1] >= 10 * w.n then b[2] end as form,
                  case when -b[1] >= 10 * w.n then -b[1] end as form_n from words w left join best using (word)),
chain as (select word, coalesce(form, word) as root, 1 as step from formed
          union all select c.word, f.form, step + 1 from chain c join formed f on c.root = f.word where f.form is not null),
roots as (select word, arg_max(root, step) as root from chain group by word)
select word, form, root, n, n_near, form_n from formed join roots using (word)
"""


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; rows with crc32(doc_id) mod 5 = 0 teach nothing."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality.fit(docs, labels.where(f"not ({HELD_OUT})"))
    return (quality.score_documents(docs, net)
            .select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", "predicted"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[.,;:!?\x0A-\x0D]')) as piece from documents),
lists as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (select lang, k as words, array_to_string(list_slice(w, p, p + k - 1), ' ') as phrase
          from lists, lateral unnest(range(1, least(4, len(w)) + 1)) as t(k), lateral unnest(range(1, len(w) - k + 2)) as u(p)),
f as (select lang, words, phrase, count(*) as f from grams group by all),
totals as (select lang, sum(f)::bigint as n from f where words = 1 group by lang),
usual as (select lang, words, phrase, f, string_split(phrase, ' ') as w from f where f >= 30),
cuts as (select c.lang, c.phrase, c.f as a, k, l.f as l, r.f as r, (2000000::hugeint * c.f // (l.f + r.f))::bigint as score
         from usual c, lateral unnest(range(1, c.words)) as t(k)
         join usual l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:k], ' ')
         join usual r on r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1:], ' ')),
scored as (select lang, phrase, any_value(a) as a, min((score, k, l, r)) as s from cuts group by lang, phrase),
inside as (select c.lang, array_to_string(c.w[p:p + k - 1], ' ') as phrase, max(c.f) as longer
           from usual c, lateral unnest(range(2, c.words)) as t(k), lateral unnest(range(1, c.words - k + 2)) as u(p) group by all),
ranked as (select lang, row_number() over (partition by lang order by s[1] desc, a desc, phrase) as rank, phrase, a, s[3] as l, s[4] as r, s[1] as score
           from scored left join inside using (lang, phrase) where longer is null or 100 * longer < 80 * a)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_line_dedup, op3_chat_format, op4_url_filter, op5_decontamination, op6_warc, op7_jaccard_join, op8_best_fit_packing, op9_exact_top_k, op10_token_store,
                                   op11_spelling, op12_quality, op13_collocations)}
ORACLE: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op4_url_filter": OP4_SQL, "op5_decontamination": OP5_SQL, "op9_exact_top_k": OP9_SQL,
                          "op11_spelling": OP11_SQL, "op13_collocations": OP13_SQL}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
