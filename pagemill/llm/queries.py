"""The thin queries of this subpackage: opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, jaccard, langid, license, mixing, pii, search, substring, tokens, warc
from pagemill.llm.common import sha256_of, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), sha256_of(listed).alias("items_sha256"), "contaminated")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = (F.expr(f"cast(size(filter(base, s -> s.rank = {n})) as bigint)").alias(f"n_{k}") for n, k in enumerate(pii.KINDS))
    every = pii.written_out(F.array_sort(F.concat("base", "added")))
    more = (F.size("added").cast("bigint").alias("n_id"), F.size(F.concat("base", "added")).cast("bigint").alias("n_spans"))
    return found.select("doc_id", *counts, sha256_of(pii.written_out(F.col("base"))).alias("base_sha256"), every.alias("spans"), *more)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: ten to a directory, the first of them its LICENSE; ten directories to one above, below the source."""
    d = table(spark, sf_dir, "documents")
    n = F.coalesce("doc_id", F.lit(0))
    name = F.when(n % 10 == 0, F.lit("LICENSE")).otherwise(F.concat(n.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(n / 100).cast("string"), F.floor(n / 10).cast("string"), name)
    found = license.scan(d.select(F.col("doc_id").alias("key"), path.alias("path"), "text"))
    return found.select(F.col("key").alias("doc_id"), "path", "own_license", "own_score", "license", "inherited_from")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", sha256_of(F.col("kept")).alias("kept_sha256"))


def op8_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    found = search.search(d, d.where("doc_id % 20 = 0"))
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", 4).alias("score"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "keeper")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_personal_data": op2_personal_data,
    "op3_warc": op3_warc,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_token_ids": op6_token_ids,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_bm25_search": op8_bm25_search,
    "op9_mixture": op9_mixture,
    "op10_jaccard_join": op10_jaccard_join,
}

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER.format('unit')}, '{license.TERM}')"
_TEMPLATES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(license.TEMPLATES))

SQL: dict[str, str] = {
    "op1_decontaminate": f"""
with d as (select row_number() over () as r, doc_id, {_FOLDED} as w from documents),
b as (select item_id, {_FOLDED} as w from benchmark),
bw as (
  select distinct item_id, least(13, len(w)) as n, list_aggregate(w[i : i + least(13, len(w)) - 1], 'string_agg', ' ') as win
  from b, unnest(range(1, len(w) - least(13, len(w)) + 2)) as t(i) where len(w) > 0),
lens as (select distinct n from bw),
dw as (
  select r, i, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') as win
  from (select r, w, n from d, lens where len(w) >= n) x, unnest(range(1, len(w) - n + 2)) as t(i)),
m as (select dw.r, dw.i, dw.n, bw.item_id from dw join bw on dw.win = bw.win and dw.n = bw.n),
h as (select r, count(distinct i + k) as n_hit from (select distinct r, i, n from m) x, unnest(range(0, n)) as t(k) group by r),
it as (select r, count(*) as n_items, string_agg(s, ',' order by s) as items from (select distinct r, cast(item_id as varchar) as s from m where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (r) left join it using (r)""",
    "op3_warc": """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, strlen(h) as payload_bytes, sha256(h) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from q where payload_bytes >= 100 group by all having count(*) > 1 and min(page_id) is not null)
select page_id, payload_bytes, payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from q left join f using (payload_digest)""",
    "op4_license_scan": rf"""
with f as (
  select doc_id as key, coalesce(text, '') as text, coalesce(source, 'none') || '/' || (doc_id // 100) || '/' || (doc_id // 10) as dir,
    case when doc_id % 10 = 0 then 'LICENSE' else doc_id || '.txt' end as name
  from documents),
u as (
  select key, 0 as part, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{license.MENTION}')), chr(10)) as unit
  from f where regexp_matches(text, '{license.MENTION}')
  union all select key, 1, text from f where name = 'LICENSE' and text <> ''),
t(template, license, unit) as (values {_TEMPLATES}),
ut as (select key, part, term, count(*) as tf from (select key, part, unnest({_TERMS}) as term from u) group by all),
tt as (select template, license, term, count(*) as tf from (select template, license, unnest({_TERMS}) as term from t) group by all),
n as (select count(*) as n from u),
idf as (
  select term, ln((1 + n) / cast(1 + coalesce(df, 0) as double)) + 1 as idf
  from (select term, count(*) as df from ut group by term) full join (select distinct term from tt) using (term), n),
w as (select key, part, term, tf * idf as w from ut join idf using (term)),
v as (select template, license, term, tf * idf as v from tt join idf using (term)),
wn as (select key, part, sqrt(sum(w * w)) as norm from w group by all),
vn as (select template, sqrt(sum(v * v)) as norm from v group by all),
dot as (select key, part, template, license, sum(w * v / vn.norm) as dot from w join v using (term) join vn using (template) group by all),
c as (select key, license, round(dot / norm, 6) as score from dot join wn using (key, part) where round(dot / norm, 6) >= {license.LEAST}e0),
own as (select key, arg_min(license, (-score, license)) as license, max(score) as score from c group by key),
dl as (select dir, arg_min(license, (-score, license)) as given from f join own using (key) where name = 'LICENSE' group by dir),
up as (
  select dir, array_to_string(string_split(dir, '/')[1 : k], '/') as above
  from (select distinct dir from f), unnest(range(0, 4)) as r(k)),
near as (select up.dir, arg_max(up.above, len(up.above)) as above, arg_max(given, len(up.above)) as given from up join dl on up.above = dl.dir group by up.dir)
select f.key as doc_id, f.dir || '/' || name as path, own.license as own_license, own.score as own_score, coalesce(own.license, near.given) as license,
  case when own.license is null then near.above end as inherited_from
from f left join own using (key) left join near on f.dir = near.dir""",
    "op7_substring_dedup": r"""
with d as (select row_number() over () as r, doc_id, coalesce(doc_id, 9223372036854775807) as oid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, oid, i, list_aggregate(w[i : i + 12], 'string_agg', ' ') as g from d, unnest(range(1, len(w) - 11)) as t(i) where len(w) >= 13),
f as (select g, min(oid) as first from win group by g),
cov as (select distinct r, i + k as i from win join f using (g), unnest(range(0, 13)) as t(k) where first < oid),
word as (select r, i, w[i] as x from d, unnest(range(1, len(w) + 1)) as t(i)),
kept as (select r, count(*) as n, string_agg(x, ' ' order by i) as s from word anti join cov using (r, i) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(s, '')) as kept_sha256
from d left join kept using (r)""",
    "op8_bm25_search": f"""
with d as (select doc_id, {_FOLDED} as w from documents where doc_id is not null),
t as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from d) group by all),
s as (select count(*) as n, sum(len(w)) / cast(count(*) as double) as mean from d where len(w) > 0),
i as (select term, ln(1 + (n - count(*) + 0.5e0) / (count(*) + 0.5e0)) as idf from t, s group by term, n),
p as (
  select t.doc_id, term, idf * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len(w) / mean)) as x
  from t join d using (doc_id) join i using (term), s),
q as (select doc_id as query_id, term from t where doc_id % 20 = 0),
r as (select query_id, doc_id, round(sum(x), 6) as score from q join p using (term) group by all),
k as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from r)
select query_id, rank, doc_id, round(score, 4) as score from k where rank <= 10""",
    "op9_mixture": r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    cast('0x' || substr(md5('doc:' || coalesce(cast(doc_id as varchar), 'null')), 1, 15) as bigint) as key
  from documents),
s0 as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as number,
    cast(sum(sum(size)) over () as bigint) as total
  from d group by source),
s1 as (select *, [3, 1, 2][cast(number % 3 + 1 as int)] as weight, 2 * source_size as most from s0),
s2 as (
  select *, cast(coalesce(sum(most) over (order by most / weight, number rows between unbounded preceding and 1 preceding), 0) as double) as full_before,
    cast(sum(weight) over (order by most / weight, number rows between current row and unbounded following) as double) as open
  from s1),
s3 as (select *, (total * 1.5e0 - full_before) / open as lev from s2),
s4 as (select *, (select arg_min(lev, (most / weight, number)) from s3 where most >= weight * lev) as level from s3),
s5 as (select *, least(cast(most as double), weight * level) as target from s4),
s6 as (
  select *, case when source_size = 0 then 0 else cast(least(2, floor(target / source_size)) as bigint) end as passes,
    case when total = 0 then 1 else greatest(1, (4096 * source_size + total - 1) // total) end as blocks
  from s5),
k as (
  select d.*, number, target, source_size, passes, target - passes * source_size as rest, key % blocks as block
  from d join s6 on d.source is not distinct from s6.source),
b0 as (select number, block, rest, sum(size) as words, substr(md5('block:' || number || ':' || block), 1, 15) as rank from k group by all),
b as (select *, sum(words) over (partition by number order by rank, block rows unbounded preceding) as after from b0),
c0 as (
  select k.number, k.block, k.key, b.rest - (b.after - b.words) as want, sum(k.size) as w
  from k join b on k.number = b.number and k.block = b.block where b.after - b.words < b.rest and b.after > b.rest group by all),
c1 as (select *, sum(w) over (partition by number, block order by key rows unbounded preceding) as upto from c0),
c as (select number, block, max(key) as cut from c1 where upto - w / 2 <= want group by all)
select doc_id, size, source_size, target,
  size * (passes + case when b.after <= k.rest then 1 when key <= c.cut then 1 else 0 end) as taken
from k join b on k.number = b.number and k.block = b.block left join c on k.number = c.number and k.block = c.block""",
    "op10_jaccard_join": r"""
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents where doc_id is not null),
s as (
  select distinct doc_id, list_aggregate(w[i : i + least(5, len(w)) - 1], 'string_agg', ' ') as g
  from d, unnest(range(1, len(w) - least(5, len(w)) + 2)) as t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select x, y from p join n as nx on x = nx.doc_id join n as ny on y = ny.doc_id where 9 * k >= 4 * (nx.n + ny.n)),
r(x, y) as (select x, y from l union select r.x, l.y from r join l on r.y = l.x),
c as (select x, least(x, min(y)) as class_id from r group by x),
m as (select x, count(*) as n_links from l group by x)
select doc_id, coalesce(class_id, doc_id) as class_id, cast(coalesce(n_links, 0) as bigint) as n_links, coalesce(class_id, doc_id) = doc_id as keeper
from d left join c on doc_id = c.x left join m on doc_id = m.x""",
}
