"""The subpackage's queries, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import bpe, chat, exact_dedup, imatch, jaccard_join, linededup, packing, quality, toxicity, warc

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_JSON = public_tokenizers.path("word_bpe_49k.json")
PATTERN = public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "votes", "posterior", "score", (F.col("score") >= quality.KEEP).alias("keep"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from d),
k as (select doc_id, s, len(s) as n, md5(array_to_string(list_sort(s), chr(10))) as k from s),
u as (select k, any_value(s) as s, any_value(n) as n, min(doc_id) as low from k where n > 0 group by k),
x as (select k, n, unnest(s) as t from u),
c as (select a.k as x, b.k as y, count(*) as i, any_value(a.n + b.n) as n from x a join x b on a.t = b.t and a.k < b.k group by all),
e as (select x, y from c where 100 * i >= 75 * (n - i)), b as (select x, y from e union all select y, x from e),
r as (select k as id, low as c from u union select b.y, r.c from r join b on r.id = b.x),
m as (select id, min(c) as c from r group by id)
select k.doc_id, k.n as n_shingles, coalesce(m.c, k.doc_id) as component_id from k left join m on m.id = k.k and k.n > 0
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    dropped = (F.col("_n_removed") > 0) & (F.col("_n_removed") == F.col("_n_lines"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), dropped.alias("dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


_SPREAD = """
l as (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
g as (select line, min({'doc_id': doc_id, 'pos': pos}) as first from l where trim(line) <> '' group by line having count(distinct coalesce(source, chr(0))) >= 5),
m as (select l.doc_id, l.pos, l.line, trim(l.line) <> '' as counts, g.line is not null and {'doc_id': l.doc_id, 'pos': l.pos} <> g.first as gone from l left join g on l.line = g.line and trim(l.line) <> ''),
p as (select doc_id, count(*) filter (counts) as n_lines, count(*) filter (gone) as n_removed, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text from m group by doc_id)
"""
OP3_SQL = f"""
with {_SPREAD}
select d.doc_id, coalesce(p.n_lines, 0) as n_lines, coalesce(p.n_removed, 0) as n_removed, coalesce(p.n_removed > 0 and p.n_removed = p.n_lines, false) as dropped, sha256(coalesce(p.text, '')) as text_sha256
from documents d left join p using (doc_id)
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((('0x' || substr(h, {5 * i + 1}, 5))::bigint >> {15 - 5 * j}) & 31 as integer), 1)" for i in range(8) for j in range(4)
)
OP4_SQL = f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as first_id from pages)
select page_id, n as payload_bytes, {_BASE32} as payload_digest, case when first_id = page_id then 'response' else 'revisit' end as record_type, case when first_id <> page_id then first_id end as refers_to
from p
"""


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


OP6_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256
from d window w as (partition by norm)
"""


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = bpe.decode(bpe.encode(docs, BYTE_RANKS, PATTERN).select("doc_id", "n_tokens", "ids"), BYTE_RANKS)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, WORD_JSON)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.windows(turns.unionByName(extra)))


#: How many of the template's control strings a text holds, by its own list of them.
_CONTROLS = r"len(regexp_extract_all({0}, '(?:<\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|\[\\*(?:INST\]|/INST\]))'))"
_ROLE = "length(role) + 2 * " + _CONTROLS.format("role") + r" + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, chr(10), ''))"
OP9_SQL = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, cast(ceil(length(text) / 4.0) as bigint) + 4 as tokens,
  24 + {_ROLE} + length(text) + {_CONTROLS.format("text")} as chars from t),
p as (select *, i = 1 and role = 'system' as sys, max(case when i = 1 and role = 'system' then tokens else 0 end) over (partition by conv_id) as sys_tokens,
  sum(case when i = 1 and role = 'system' then 0 else tokens end) over (partition by conv_id order by i) as upto from o),
q as (select *, upto - case when sys then 0 else tokens end as since, greatest({chat.BUDGET} - greatest({chat.RESERVE}, sys_tokens), 1) as room from p),
w as (select *, case when since // room = greatest(upto - 1, since) // room then 2 * (since // room) else 2 * (since // room) + 1 end as w from q),
f as (select *, min(i) over (partition by conv_id, w) as first_i from w),
h as (select conv_id, sum(case when sys then chars else 0 end) * (count(distinct w) - 1) as n from f group by 1),
a as (select x.conv_id, sum(x.chars) as n from f x join f y on x.conv_id = y.conv_id and y.i - x.i between 1 and {chat.HISTORY} and y.first_i = y.i and not x.sys and y.since - x.since <= {chat.BUDGET} - x.room - x.sys_tokens group by 1),
g as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256, sum(chars) as chars from f group by conv_id)
select g.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, cast(g.chars + coalesce(h.n, 0) + coalesce(a.n, 0) as bigint) as formatted_chars
from g left join h using (conv_id) left join a using (conv_id)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_line_dedup": op3_line_dedup,
        "op4_warc": op4_warc,
        "op5_imatch": op5_imatch,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_packing": op8_packing,
        "op9_chat": op9_chat,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_warc": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op9_chat": OP9_SQL}
