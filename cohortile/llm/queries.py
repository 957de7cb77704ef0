"""The registered queries of the corpus operators, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontam, jaccard, langid, mixing, negatives, pieces, prefixes, quality, rules, suffix, toxicity, urls, warc

QUERIES = {}
ORACLE = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def bucket(n):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@query("op2_toxicity")
def op2(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.filter(bucket(5) != 0), labels)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(bucket(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_language_id")
def op3(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs, bucket(4) != 2)
    return langid.predict(docs, model).select("doc_id", F.coalesce(bucket(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query("op4_quality")
def op4(spark, sf_dir):
    """Grades: 0 low quality, 1 good but toxic, 2 good. Learns where crc32 mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("grade", grade)
    model = quality.fit(docs.filter(bucket(5) != 0), labels)
    return quality.score(docs, model, at_least=1).select(
        "doc_id", F.coalesce(bucket(5) == 0, F.lit(False)).alias("held_out"), "expected_grade", "p_tail", (F.col("p_tail") >= 0.5).alias("selected"))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op6_url_filter")
def op6(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = urls.fit(spark.createDataFrame(urls.SEED_URLS, "url string, label int"))
    return urls.judge(pages, RULES, model).select("page_id", "host", "path", "rule", "score", "verdict")


OP7_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, least(len(w), 13) size, array_to_string(w[s:s + 12], ' ') k
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) s from b where len(w) > 0)),
sizes as (select distinct size from bw),
dw as (select doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') k
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) s from d, sizes where len(w) >= size)),
hit as (select doc_id, s, bw.size, item_id from dw join bw on dw.k = bw.k and dw.size = bw.size),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + size)) p from hit) group by 1),
its as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) l from hit group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(l, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""


@query("op7_decontamination", OP7_SQL)
def op7(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontam.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


OP9_SQL = r"""
with d as (select doc_id, lang, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from documents),
tri as (select doc_id, s, w[s] || ' ' || w[s + 1] || ' ' || w[s + 2] k from (select doc_id, w, unnest(range(1, len(w) - 1)) s from d)),
rep as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(s, s + 3)) p
  from (select doc_id, s, count(*) over (partition by doc_id, k) c from tri) where c > 1) group by 1),
f as (select d.doc_id, lang, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols, len(ls)::bigint n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
    coalesce(rep.n, 0)::bigint n_repeat_words from d left join rep using (doc_id)),
g as (select f.* from f where doc_id in (select doc_id from labels group by 1 having min(quality) = 1)),
r as (select unnest(['symbols', 'dup_lines', 'repeats']) rule), c as (select unnest([10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 700]) cutoff),
v as (select doc_id, lang, rule, case rule when 'symbols' then n_symbols when 'dup_lines' then n_dup_lines else n_repeat_words end a,
    case rule when 'symbols' then word_chars when 'dup_lines' then n_lines else n_words end b from g, r),
k as (select lang, rule, cutoff, count(*) n, sum((1000 * a > cutoff * b)::int)::bigint x from v, c group by all),
p as (select lang, rule, cutoff, case when x <= n * (0.03::double / 3) then (select sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.03::double / 3) + (n - j) * ln(1 - 0.03::double / 3)))
    from (select unnest(range(0, x + 1)) j)) else 1.0 end pv from k),
best as (select lang, rule, min(cutoff) cutoff from p where pv <= 0.05 / ((select count(distinct coalesce(lang, '')) from g) * 3) group by all),
base as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not exists (select 1 from best where best.lang is not distinct from base.lang and
    1000 * (case rule when 'symbols' then n_symbols when 'dup_lines' then n_dup_lines else n_repeat_words end) >
    cutoff * (case rule when 'symbols' then word_chars when 'dup_lines' then n_lines else n_words end)) kept
from base
"""


@query("op9_quality_rules", OP9_SQL)
def op9(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.apply(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = """
with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) s from pages),
g as (select p.*, max(page_id) over (partition by h) best from p),
b as (select *, list_transform(range(0, 40), lambda i: instr('0123456789abcdef', substr(s, i + 1, 1)) - 1) x from g),
bits as (select *, list_transform(range(0, 160), lambda i: (x[i // 4 + 1] // (1 << (3 - i % 4))) % 2) y from b)
select page_id, strlen(h)::bigint payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (16 * y[5 * i + 1] + 8 * y[5 * i + 2] + 4 * y[5 * i + 3] + 2 * y[5 * i + 4] + y[5 * i + 5] + 1)::int, 1)), '') payload_digest,
  case when page_id = best then 'response' else 'revisit' end record_type, case when page_id = best then null else best end refers_to
from bits
"""


@query("op8_warc", OP8_SQL)
def op8(spark, sf_dir):
    index = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), warc.archive_folder(spark))
    return warc.read(spark, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_pieces")
def op10(spark, sf_dir):
    return pieces.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select doc_id, i, substr(h, 2 * i - 1, 100) s from (select doc_id, h, unnest(range(1, greatest(strlen(h) // 2 - 48, 1))) i from d where strlen(h) >= 100)),
f as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) first from w) where first < doc_id),
run as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end new from f),
span as (select doc_id, min(i) a, max(i) + 49 b from (select doc_id, i, sum(new) over (partition by doc_id order by i) g from run) group by doc_id, g),
c as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) before, lead(a) over (partition by doc_id order by a) after from span),
k as (select c.doc_id, count(*) n, sum(b - a + 1) lost,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)) || case when after is null then substr(h, 2 * b + 1) else '' end, '' order by a) rest
  from c join d using (doc_id) group by 1)
select d.doc_id, (strlen(h) // 2)::bigint n_bytes, coalesce(lost, 0)::bigint n_removed, coalesce(n, 0)::bigint n_spans, sha256(unhex(coalesce(rest, h))) kept_sha256
from d left join k using (doc_id)
"""


@query("op5_suffix_dedup", OP5_SQL)
def op5(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix.remove(docs).select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256")


OP1_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') k from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.k = b.k and a.doc_id <> b.doc_id group by all),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
r(a, b) as (select doc_id, doc_id from d union select r.a, e.y from r join e on e.x = r.b)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, component_id from d left join n using (doc_id) join (select a doc_id, min(b) component_id from r group by 1) using (doc_id)
"""


@query("op1_ngram_jaccard_join", OP1_SQL)
def op1(spark, sf_dir):
    classes, _ = jaccard.join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return classes.select("doc_id", "n_shingles", "component_id")


OP11_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size, row_number() over () rn from documents),
s as (select source, sum(size)::bigint ss, row_number() over (order by source is null, source) rk from d group by 1),
w as (select *, [3, 1, 2][(rk - 1) % 3 + 1]::hugeint w, sum(ss) over ()::hugeint t from s),
o as (select *, row_number() over (order by ss::double / w, rk) k from w),
p as (select *, coalesce(sum(ss) over (order by k rows between unbounded preceding and 1 preceding), 0)::hugeint c, sum(w) over (order by k rows between current row and unbounded following)::hugeint l from o),
f as (select k, c, l from p where 4 * ss * l > w * (3 * t - 4 * c) order by k limit 1),
g as (select source, ss source_size, rk, case when not exists (select 1 from f where f.k <= p.k) then (2 * ss)::double
  else (w * (3 * t - 4 * (select c from f)))::double / (2 * (select l from f))::double end target from p),
q as (select d.*, source_size, rk, target, e, substr(md5(concat_ws('|', doc_id, e, 11)), 1, 15) h
  from d join g on d.source is not distinct from g.source, (select unnest([1, 2]) e)),
r as (select *, sum(size) over (partition by rk order by e, h, doc_id nulls first, size, rn rows unbounded preceding)::double / nullif(target, 0) fin from q),
v as (select *, sum(size) over (order by fin nulls first, rk, e, h, doc_id nulls first, size, rn rows unbounded preceding) - size before from r)
select doc_id, size, source_size::bigint source_size, target, sum(greatest(0, least(size, 3 * (select sum(size) from d) // 2 - before)))::bigint taken
from v group by rn, doc_id, size, source_size, target
"""


@query("op11_source_mix", OP11_SQL)
def op11(spark, sf_dir):
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), (3, 1, 2), 1.5, 2)


OP12_SQL = r"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 pos,
    coalesce(role, '') r, coalesce(text, '') x from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 20 donor, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(conv_id::varchar) + 1),
    lambda i: [ascii(substr(conv_id::varchar, i, 1))::bigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, v: xor(xor(a, v) >> 1, (xor(a, v) & 1) * 3988292384)), 4294967295::bigint) % 4 h from (select distinct conv_id from t)),
u as (select c.conv_id, t.pos, r, x from c join t on t.conv_id = donor and pos < h union all select t.conv_id, t.pos, r, x from t join c using (conv_id) where pos >= h),
n as (select conv_id, r, x, row_number() over (partition by conv_id order by pos) d from u),
l as (select c.conv_id, coalesce(list(md5(length(r)::varchar || ':' || r || x) order by d) filter (where d is not null), []) ids from c left join n using (conv_id) group by 1),
p as (select conv_id, len(ids) len, d, array_to_string(ids[1:d], '') k, case when d > 0 then array_to_string(ids[1:d - 1], '') end up
  from (select conv_id, ids, unnest(range(0, len(ids) + 1)) d from l)),
g as (select d, k, any_value(up) up, min(conv_id) conv_id, count(*) n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where d = len), '')) ends_sha256 from p group by d, k),
w as (select d, array_to_string(l.ids[1:n.d], '') k, max(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) words from n join l using (conv_id) group by 1, 2),
f as (select g.*, (n_convs - 1) * coalesce(words, 0) saved, (select count(*) from g h where h.d = g.d + 1 and h.up = g.k) n_children from g left join w using (d, k)),
pairs as (select distinct a.d, a.k, b.d bd, b.k bk from p a join p b on a.conv_id = b.conv_id and b.d >= a.d),
s as (select pairs.d, pairs.k, sum((n_children = 0)::int)::bigint n_leaves, sum(saved)::bigint saved_tokens from pairs join f on f.d = bd and f.k = bk group by 1, 2)
select f.conv_id, f.d::bigint depth, o.conv_id parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
from f join s on s.d = f.d and s.k = f.k left join g o on o.d = f.d - 1 and o.k = f.up
"""


@query("op12_prefix_trie", OP12_SQL)
def op12(spark, sf_dir):
    turns = prefixes.numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    convs = turns.filter("pos = 0").select("conv_id")
    shared = F.crc32(F.col("conv_id").cast("string")) % 4
    return prefixes.trie(prefixes.with_shared_heads(turns, F.col("conv_id") - F.col("conv_id") % 20, shared, 3), convs)


OP13_SQL = r"""
with q as (select vec_id id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)) v
  from embeddings where vec_id is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select *, row_number() over () aid from q where id % 100 = 0),
p as (select aid, a.id anchor_id, a.label, a.v, q.id positive_id, list_inner_product(a.v, q.v)::bigint positive_score from a join q on a.label = q.label and a.id <> q.id),
b as (select *, row_number() over (partition by aid order by positive_score desc, positive_id) nth from p qualify nth <= 5),
n as (select aid, q.id negative_id, list_inner_product(a.v, q.v)::bigint negative_score from a join q on a.label <> q.label)
select anchor_id, positive_id, row_number() over (partition by aid, nth order by negative_score desc, negative_id)::int rank, negative_id, positive_score, negative_score
from b join n using (aid) where 30 * positive_score <= 100 * negative_score and 100 * negative_score <= 90 * positive_score qualify rank <= 10
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark, sf_dir):
    rows = negatives.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(moved, F.col("id") % 100 == 0)
