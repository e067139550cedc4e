"""The queries opN_<name> and `pipeline`, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, linededup, lm, near, packing, quality, quantiles, ranking, sharding, substrings, trie, urls

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), decontam.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge_quality(docs, quality.fit_field(docs, table(spark, sf_dir, "labels")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], rows.schema)
    return chat.digest_chats(chat.format_chats(rows.unionByName(more)))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_components(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines_removed", "text")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(trie.named_turns(table(spark, sf_dir, "conversations"))))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ranking.rank_quality(docs, ranking.fit_ranking(docs, table(spark, sf_dir, "labels")))


def op13_quantile_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.verified_quantiles(quantiles.shop_values(*(table(spark, sf_dir, t) for t in ("clicks", "sale_lines", "items"))))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_lm_score, op3_quality_rules, op4_ngram_jaccard, op5_url_filter, op6_line_dedup, op7_format_chats, op8_pack, op9_shard, op10_substring_dedup, op11_conversation_trie, op12_quality_classifier, op13_quantile_summaries)}

_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ESCAPED = "(length({0}) + 4 * (length({0}) - length(replace({0}, '&', ''))) + 3 * (length({0}) - length(replace(replace({0}, '<', ''), '>', ''))))"


def _term(terms) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9])({'|'.join(terms)})($|[^a-z0-9])')"


# CRC-32 of a string of ASCII characters; DuckDB has no such function
_CRC_TABLE = "(select list(list_reduce(range(0, 8), lambda a, i: case when a & 1 = 1 then xor(3988292384, a >> 1) else a >> 1 end, n) order by n) from range(0, 256) as r(n))"
_CRC = "xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: cast(ascii(substr({0}, i, 1)) as bigint)), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295)"

ORACLE: dict[str, str] = {
    "op1_decontaminate": f"""
with d as (select doc_id, coalesce(regexp_extract_all({_AZ.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from documents),
b as (select item_id, regexp_extract_all({_AZ.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where text is not null),
bw as (select item_id, least(13, len(w)) as m, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0),
p as (select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') as t from bw),
dw as (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, (select distinct m from p) where len(w) >= m),
h as (select doc_id, i, p.m, item_id from (select doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') as t from dw) x join p on p.m = x.m and p.t = x.t),
hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + m)) as k from h) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as names from (select distinct doc_id, cast(item_id as varchar) as x from h) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join its using (doc_id)""",
    "op5_url_filter": f"""
with p as (select page_id, {_AZ.format("coalesce(url, '')")} as u, {_AZ.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
r as (select * from (values {", ".join(f"('{v}', '{x}', '{x.partition('/')[0]}', '/{x.partition('/')[2]}')" for v, x in RULES)}) as t(v, rule, rh, rp)),
m as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(v, length(rule)) as v from p join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
select p.page_id, host, path, m.rule, coalesce(m.v, case when {_term(urls.STRICT)} or {" + ".join(f"cast({_term([t])} as int)" for t in urls.SOFT)} >= {urls.SOFT_HITS} then 'block' else 'allow' end) as verdict from p left join m using (page_id)""",
    "op7_format_chats": f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) as turns_sha256, cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(17 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) as bigint) as formatted_chars from t group by conv_id""",
    "op10_substring_dedup": """
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
x as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
f as (select h, min(doc_id) as a from x group by h having min(doc_id) <> max(doc_id)),
c as (select distinct doc_id, unnest(range(i, i + 50)) as k from x join f using (h) where doc_id > a),
k as (select doc_id, count(*) filter (c.k is not null) as n_removed, string_agg(word, ' ' order by p.k) filter (c.k is null) as kept from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from d) p left join c using (doc_id, k) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)""",
    "op11_conversation_trie": f"""
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos,
    sha256(concat(length(coalesce(role, '')), ':', role, text)) as name, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as words from conversations where conv_id is not null),
ids as (select c, {_CRC.format("cast(c as varchar)")} % 4 as h from (select distinct c from t), (select {_CRC_TABLE} as tab)),
r as (select ids.c, 0 as part, pos, name, words from ids join t on t.c = ids.c - ids.c % 20 and pos < h union all select ids.c, 1, pos, name, words from ids join t on t.c = ids.c where pos >= h),
s as (select ids.c, coalesce(list(name order by part, pos) filter (name is not null), []) as k, coalesce(list(words order by part, pos) filter (name is not null), []) as w from ids left join r on r.c = ids.c group by ids.c),
p as (select c, len(k) as n, d, array_to_string(k[1:d], '') as path, w[d] as words from (select *, unnest(range(0, len(k) + 1)) as d from s)),
node as (select path, d, min(c) as conv_id, count(*) as n, coalesce(any_value(words), 0) as words, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (d = n), '')) as ends from p group by path, d),
kids as (select substr(path, 1, 64 * (d - 1)) as path, count(*) as n_children from node where d > 0 group by 1),
one as (select node.*, coalesce(n_children, 0) as n_children from node left join kids using (path)),
sub as (select substr(path, 1, 64 * a) as path, sum((n - 1) * words) as saved, count(*) filter (n_children = 0) as leaves from (select *, unnest(range(0, d + 1)) as a from one) group by 1)
select one.conv_id, one.d as depth, up.conv_id as parent_conv_id, one.n as n_convs, one.n_children, leaves as n_leaves, cast(saved as bigint) as saved_tokens, one.ends as ends_sha256
from one join sub using (path) left join node as up on one.d > 0 and up.path = substr(one.path, 1, 64 * (one.d - 1))""",
}
