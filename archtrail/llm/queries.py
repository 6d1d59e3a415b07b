"""The registered queries: each applies an operator to its whole table and derives digests.

``ORACLES`` has SQL for DuckDB where SQL can express the result; the others are tested
against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archtrail.llm.quality import BOILERPLATE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL_JACCARD = f"""
with recursive w as (select doc_id, {_WORDS.format(_LOWER)} as w from documents),
grams as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else [array_to_string(w[k:k + 3], ' ') for k in range(1, len(w) - 2)] end) as g from w),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as shared from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (
  select x, y from pairs join sizes s on s.doc_id = x join sizes t on t.doc_id = y where 100 * shared >= 85 * (s.n + t.n - shared)),
reach as (
  select doc_id, doc_id as other from sizes
  union select r.doc_id, l.far from reach r join (select x as near, y as far from links union all select y, x from links) l on l.near = r.other)
select w.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(min(r.other), w.doc_id) as component_id
from w left join sizes s using (doc_id) left join reach r on r.doc_id = w.doc_id group by w.doc_id, s.n
"""

SQL_DECONTAMINATE = f"""
with items as (select cast(item_id as varchar) as item, {_ITEM_WORDS} as w from benchmark),
windows as (
  select distinct item, least(len(w), 13) as size, unnest([w[k:k + least(len(w), 13) - 1] for k in range(1, len(w) - least(len(w), 13) + 2)]) as words
  from items where len(w) > 0),
d as (select doc_id, {_ITEM_WORDS} as w from documents),
places as (select d.doc_id, size, unnest(range(1, len(w) - size + 2)) as k, w from d, (select distinct size from windows)),
hits as (select p.doc_id, p.k, p.size, v.item from places p join windows v on v.size = p.size and v.words = p.w[p.k:p.k + p.size - 1]),
covered as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(k, k + size)) from hits) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered using (doc_id) left join named using (doc_id)
"""

SQL_QUALITY = rf"""
with d as (select doc_id, coalesce(text, '') as text, {_WORDS.format("coalesce(text, '')")} as w from documents),
windows as (select doc_id, unnest(range(1, len(w) - 3)) as k, w from d),
twice as (select doc_id, k from (select doc_id, k, count(*) over (partition by doc_id, w[k:k + 4]) as n from windows) where n > 1),
repeated as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(k, k + 5)) from twice) group by doc_id),
split as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
lines as (
  select doc_id, line, {_WORDS.format("line")} as w, length(regexp_replace(line, '[ 	-
]', '', 'g')) as chars,
    length(line) - length(regexp_replace(line, '[!-/:-@\[-`{{-~]', '', 'g')) as marks from split where regexp_matches(line, '[^ 	-
]')),
judged as (
  select *, (len(w) >= 3 and marks > 0.2 * chars) or (seps >= 2 and seps > 0.2 * len(w)) or (len(w) <= 15 and furniture) as bad
  from (select *, len([x for x in w if regexp_full_match(x, '[|<>/*-]')]) as seps, regexp_matches(lower(line), '__PHRASES__') as furniture from lines)),
per as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as dups, count(*) filter (bad) as removed, coalesce(sum(chars) filter (bad), 0) as lost
  from judged group by doc_id),
counts as (
  select d.doc_id, len(w) as n_words, length(regexp_replace(text, '[ 	-
]', '', 'g')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(dups, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(removed, 0) as n_lines_removed, coalesce(lost, 0) as lost
  from d left join per using (doc_id) left join repeated r using (doc_id)),
base as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counts)
select * exclude (lost), not base_failed and lost <= 0.5 * word_chars as kept from base
"""

SQL_URLS = r"""
with p as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
o as (select doc_id as page_id, case when quality = 0 or toxic = 1 then 1 when quality is not null or toxic is not null then 0 end as bad from labels),
h as (select host, cast(count(bad) as double) as n, cast(coalesce(sum(bad), 0) as double) as bad from p left join o using (page_id) group by host),
named as (select *, len(parts) > 2 and length(parts[-1]) = 2 and parts[-2] in ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') as long from (select *, string_split(host, '.') as parts from h)),
hosts as (select host, n, bad, array_to_string(parts[case when long then -3 else -2 end:], '.') as domain, array_to_string(parts[case when long then -2 else -1 end:], '.') as suffix from named),
rh as (select sum(n * pow(bad / n - m, 2) / (m * (1 - m))) as spread, count(*) as k, sum(n) as n, count(distinct domain) as j
  from hosts join (select domain, (sum(bad) + 0.5) / (sum(n) + 1.0) as m from hosts where n > 0 group by domain) using (domain) where n > 0),
wh as (select case when k <= j or n <= k then 10.0 when spread <= k - j then 10000.0 else round(least(10000.0, greatest(10.0, 1 / ((spread - (k - j)) / (n - k)) - 1)), 6) end as w from rh),
domains as (select domain, suffix, sum(n * w / (w + n)) as n, sum(bad * w / (w + n)) as bad from hosts, wh group by domain, suffix),
rd as (select sum(n * pow(bad / n - m, 2) / (m * (1 - m))) as spread, count(*) as k, sum(n) as n, count(distinct suffix) as j
  from domains join (select suffix, (sum(bad) + 0.5) / (sum(n) + 1.0) as m from domains where n > 0 group by suffix) using (suffix) where n > 0),
wd as (select case when k <= j or n <= k then 10.0 when spread <= k - j then 10000.0 else round(least(10000.0, greatest(10.0, 1 / ((spread - (k - j)) / (n - k)) - 1)), 6) end as w from rd),
suffixes as (select suffix, sum(n * w / (w + n)) as n, sum(bad * w / (w + n)) as bad from domains, wd group by suffix),
rs as (select sum(n * pow(bad / n - m, 2) / (m * (1 - m))) as spread, count(*) as k, sum(n) as n, 1 as j
  from suffixes, (select (sum(bad) + 0.5) / (sum(n) + 1.0) as m from suffixes where n > 0) where n > 0),
ws as (select case when k <= j or n <= k then 10.0 when spread <= k - j then 10000.0 else round(least(10000.0, greatest(10.0, 1 / ((spread - (k - j)) / (n - k)) - 1)), 6) end as w from rs),
overall as (select (coalesce(sum(bad * w / (w + n)), 0) + 0.5) / (coalesce(sum(n * w / (w + n)), 0) + 1.0) as m, coalesce(sum(n * w / (w + n)), 0) as n from suffixes, ws),
s1 as (select suffix, w, s.n, (w * m + bad) / (w + s.n) as share, m * (1 - m) / (o.n + 2.0) as v0 from suffixes s, ws, overall o),
s2 as (select suffix, share as ps, share * (1 - share) / (w + n + 1) + pow(w / (w + n), 2) * v0 as pv from s1),
d1 as (select domain, w, n, (w * ps + bad) / (w + n) as share, pv from domains join s2 using (suffix), wd),
d2 as (select domain, share as ps, share * (1 - share) / (w + n + 1) + pow(w / (w + n), 2) * pv as pv from d1),
h1 as (select host, w, n, (w * ps + bad) / (w + n) as share, pv from hosts join d2 using (domain), wh),
h2 as (select host, share - 1.645 * sqrt(share * (1 - share) / (w + n + 1) + pow(w / (w + n), 2) * pv) as low from h1),
rules as (select * from (values ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')) t (what, rule)),
fits as (
  select page_id, max_by(rule, length(rule)) as rule, max_by(what, length(rule)) as what from p, rules
  where (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, strpos(rule, '/'))) group by page_id)
select page_id, host, path, rule, coalesce(what, case when low > 0.25 then 'block' else 'allow' end) as verdict
from p left join fits using (page_id) left join h2 using (host)
"""


#: CRC-32 of each byte value; a text's is folded from it.
_CRC = "t as (select list(c order by i) as crc from (select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as c from range(256) r(i)))"

SQL_SHARDS = f"""
with {_CRC},
b as (select doc_id, octet_length(encode(coalesce(text, ''))) as n, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: cast('0x' || x as bigint)) as bytes from documents),
s as (select doc_id, cast(n + 1 as bigint) as size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) as text_crc32,
  list_transform(range(17), lambda k: cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || k), 1, 13) as bigint)) as h from b, t),
p as (select doc_id, size, text_crc32, list_position(h[1:16], list_max(h[1:16])) - 1 as shard, list_position(h, list_max(h)) - 1 as grown_shard,
  substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || text_crc32 || ':' || size), 1, 3) as grp from s)
select doc_id, size, text_crc32, 'key' as law, cast(shard as integer) as shard,
  row_number() over (partition by shard order by grp, doc_id, text_crc32, size) - 1 as slot, cast(grown_shard as integer) as grown_shard from p
"""

SQL_REPEATS = """
with d as (select row_number() over () as row, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
b as (select *, length(h) // 2 as n from d),
w as (select row, doc_id, k, substr(h, 2 * k + 1, 100) as s from b, unnest(range(greatest(n - 49, 0))) u(k)),
first as (select s, min(doc_id) as least from w group by s),
hit as (select row, k from w join first using (s) where least < doc_id),
edge as (select row, k, k + 50 as e, lag(k + 50) over (partition by row order by k) as before from hit),
run as (select row, k, e, sum(case when before is null or before < k then 1 else 0 end) over (partition by row order by k) as r from edge),
span as (select row, r, min(k) as a, max(e) as z from run group by row, r),
spans as (select row, sum(z - a) as n_removed, count(*) as n_spans, list(struct_pack(a := a, z := z) order by a) as s from span group by row),
kept as (select row, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' order by f) as h from (
  select b.row, h, unnest(list_concat([0], list_transform(coalesce(s, []), lambda x: x.z))) as f, unnest(list_concat(list_transform(coalesce(s, []), lambda x: x.a), [n])) as t from b left join spans using (row)) group by row)
select doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(k.h)) as kept_sha256
from b left join spans using (row) join kept k using (row)
"""

SQL_CONVERSATIONS = rf"""
with recursive {_CRC},
named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations),
drawn as (select *, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(name)), '..'), lambda x: cast('0x' || x as bigint)), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 20 as what from named, t),
hurt as (
  select conv_id, turn, case when what = 4 then 'user' else role end as role, case what when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from drawn, unnest(range(case what when 0 then 0 when 3 then 2 else 1 end))),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from hurt),
lined as (
  select *, left(role, 1) as r, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as sign, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
    lag(left(role, 1)) over (partition by conv_id order by i) as before from numbered),
ruled as (select *, case when sign = '' then 'blank' when again then 'duplicate' when sign not in ('.', '!', '?') then 'truncated' else '' end as fault from lined),
counts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || r not in ('su', 'ua', 'au')) as illegal from ruled group by conv_id),
inserts as (select * from (values (0, 0, '', 0, []), (0, 2, 'I', 3, ['user:']), (0, 3, 'II', 6, ['user:', 'assistant:']), (1, 1, '', 0, []), (1, 2, 'I', 3, ['user:']), (1, 3, 'II', 6, ['user:', 'assistant:']),
  (2, 2, '', 0, []), (2, 3, 'I', 3, ['assistant:']), (2, 2, 'II', 6, ['assistant:', 'user:']), (3, 3, '', 0, []), (3, 2, 'I', 3, ['user:']), (3, 3, 'II', 6, ['user:', 'assistant:'])) v(s, m, w, c, lines)),
edits as (
  select conv_id, i, m, m as z, 'D' as w, 4 as c, cast([] as varchar[]) as lines from ruled, range(4) u(m)
  union all select conv_id, i, m, z, 'K', case fault when 'truncated' then 3 else 0 end, [role || ':' || text] from ruled
    join (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) k(k, m, z) on r = k where fault in ('', 'truncated')
  union all select conv_id, i, m, z, 'R', case fault when 'truncated' then 6 else 3 end, [made || ':' || text] from ruled, (values (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')) v(m, z, made) where fault in ('', 'truncated')),
dp as (
  select conv_id, cast(0 as bigint) as i, 0 as s, struct_pack(cost := cast(0 as bigint), audit := '', lines := cast([] as varchar[])) as best from counts
  union all
  select d.conv_id, e.i, e.z, min(struct_pack(cost := d.best.cost + n.c + e.c, audit := d.best.audit || n.w || e.w, lines := list_concat(d.best.lines, n.lines, e.lines)))
  from dp d join inserts n on n.s = d.s join edits e on e.conv_id is not distinct from d.conv_id and e.i = d.i + 1 and e.m = n.m group by d.conv_id, e.i, e.z),
done as (
  select d.conv_id, min(struct_pack(cost := d.best.cost + n.c, audit := d.best.audit || n.w, lines := list_concat(d.best.lines, n.lines))) as best
  from dp d join counts k on k.conv_id is not distinct from d.conv_id and k.n = d.i join inserts n on n.s = d.s and n.m in (0, 3) group by d.conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(best.cost, 0) as cost, coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join counts k on k.conv_id is not distinct from c.conv_id left join done d on d.conv_id is not distinct from c.conv_id
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(SQL_REPEATS)
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archtrail.llm.suffix_dedup import remove_repeats

    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_bytes",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(SQL_JACCARD)
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archtrail.llm.jaccard_join import similar_groups

    groups = similar_groups(table(spark, sf_dir, "documents"), size=4, percent=85)
    return groups.select("doc_id", F.col("n_grams").alias("n_shingles"), F.col("group_id").alias("component_id"))


@query(SQL_SHARDS)
def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archtrail.llm.sharding import assign, slots

    docs = table(spark, sf_dir, "documents")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    assigned = assign(docs, "doc_id", [1.0] * 16, [1.0] * 17).select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "shard", "grown_shard")
    return slots(assigned, ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query(SQL_URLS)
def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archtrail.llm.url_filter import filter_urls

    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    judged = filter_urls(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query(SQL_DECONTAMINATE)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archtrail.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


@query(SQL_QUALITY.replace("__PHRASES__", "|".join(BOILERPLATE)))
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archtrail.llm.quality import clean_documents

    return clean_documents(table(spark, sf_dir, "documents")).drop("text")


@query()
def op5_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archtrail.llm.lm_score import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archtrail.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query()
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archtrail.llm.token_files import token_file_report

    return token_file_report(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query()
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archtrail.llm.sentencepiece_codec import decode, encode

    model = vocabulary("piece_bpe_32k.model")
    both = decode(encode(table(spark, sf_dir, "documents"), model), model)
    text = F.encode("decoded", "UTF-8")
    return both.select("doc_id", "n_tokens", F.xxhash64("ids").alias("ids_hash"), F.length(text).cast("long").alias("n_bytes"), F.crc32(text).alias("text_crc32"))


@query(SQL_CONVERSATIONS)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archtrail.llm.conversations import conversation_report

    return conversation_report(table(spark, sf_dir, "conversations"))


@query()
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archtrail.llm.alignment import alignment_report

    return alignment_report(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query()
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archtrail.llm.licenses import scan_licenses

    base = F.filter("places", lambda p: p.base)
    names = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base["word"]).alias("first_word"), F.array_max(base["word"]).alias("last_word"),
        names(base["label"]).alias("base_labels"), names(F.col("labels")).alias("labels"), "score",
    )
