"""The ``opN_`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import byte_bpe, collocations, decontaminate, embedding_dedup, line_dedup, mixture, ngram_join, pii, quality_rules, spelling, substring_dedup, token_files, warc
from gaugeline.llm.ship import ship
from gaugeline.sources.tables import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_byte_bpe")
def op4(spark, sf_dir):
    """Encode and decode every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


_SQL_WORD = r"[^\x20\x09-\x0D]+"
_SQL_WORDS = f"""w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_SQL_WORD}') as ws from documents),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w)"""


def _sql_runs(k: int) -> str:
    """All ``k`` consecutive words of a document; ``n`` is less than ``k`` at its end."""
    frame = f"partition by doc_id order by i rows between current row and {k - 1} following"
    return f"runs as (select doc_id, i, string_agg(word, ' ') over ({frame}) as run, count(*) over ({frame}) as n from words)"


_OP6_SQL = f"""
with {_SQL_WORDS}, {_sql_runs(substring_dedup.WINDOW)},
twice as (select run from runs where n = {substring_dedup.WINDOW} group by run having count(*) > 1),
gone as (select distinct doc_id, i + k as i from runs semi join twice using (run), range({substring_dedup.WINDOW}) t(k) where n = {substring_dedup.WINDOW}),
kept as (select words.doc_id, count(gone.i) as n_removed, string_agg(word, ' ' order by words.i) filter (gone.i is null) as text
         from words left join gone on gone.doc_id = words.doc_id and gone.i = words.i group by 1)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from w left join kept using (doc_id)
"""


@query("op6_substring_dedup", _OP6_SQL)
def op6(spark, sf_dir):
    """Words left after removal of repeated windows of 35 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.repeat_digests(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op7_mixture")
def op7(spark, sf_dir):
    """Words that the mix takes from each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture.mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_token_files")
def op8(spark, sf_dir):
    """Encode, write binary files, and read them back."""
    folder = fresh_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)
    return token_files.digests(spark, folder)


_OP10_SQL = f"""
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from s),
c as (select *, len(regexp_extract_all(line, '{_SQL_WORD}')) as n from l),
u as (select *, sum(n) over (partition by doc_id order by i rows unbounded preceding) as upto from c),
f as (select a.doc_id, a.i, min(b.i) as j from u a join u b on b.doc_id = a.doc_id and b.i >= a.i and b.upto - a.upto + a.n >= {line_dedup.MIN_WORDS} group by 1, 2),
t as (select a.doc_id, max(b.i) as i, a.i as j from u a join u b on b.doc_id = a.doc_id and b.i <= a.i and a.upto - b.upto + b.n >= {line_dedup.MIN_WORDS} group by 1, 3),
e as (select * from f union select * from t),
win as (select e.doc_id, e.i, e.j, string_agg(l.line, chr(10) order by l.i) as run from e join l on l.doc_id = e.doc_id and l.i between e.i and e.j group by 1, 2, 3),
placed as (select *, row_number() over (partition by run order by doc_id, i) as nth from win),
gone as (select distinct l.doc_id, l.i from placed p join l on l.doc_id = p.doc_id and l.i between p.i and p.j where nth > 1)
select l.doc_id, count(*) as n_lines, count(gone.i) as n_deleted,
       sha256(coalesce(string_agg(l.line, chr(10) order by l.i) filter (gone.i is null), '')) as left_sha256
from l left join gone on gone.doc_id = l.doc_id and gone.i = l.i group by 1
"""


@query("op10_line_dedup", _OP10_SQL)
def op10(spark, sf_dir):
    """Each document without its later repeated runs of lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.delete_repeats(docs)
    return out.select(
        "doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("left_sha256")
    )


@query("op1_quality_rules")
def op1(spark, sf_dir):
    """Measures, base rule and the verdict of the learned list."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules.learn_and_judge(docs, table(spark, sf_dir, "labels"), keep_text=False)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


#: Links of all pairs, and what they reach; ``links`` holds both directions.
_SQL_REACH = """reach as (select id, id as other from ids union select reach.id, links.y from reach join links on links.x = reach.other),
least as (select id, min(other) as least from reach group by 1),
degree as (select x as id, count(*) as n from links group by 1)"""

_OP9_SQL = f"""
with recursive ids as (select vec_id as id, cast(embedding as double[]) as v from embeddings),
links as (select a.id as x, b.id as y from ids a join ids b on a.id <> b.id where list_cosine_similarity(a.v, b.v) >= {embedding_dedup.THRESHOLD}),
{_SQL_REACH}
select id as vec_id, coalesce(n, 0) as n_links, least as component_id, id = least as kept from least left join degree using (id)
"""


@query("op9_embedding_dedup", _OP9_SQL)
def op9(spark, sf_dir):
    """Links, component and choice for every vector."""
    return embedding_dedup.link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select(
        "vec_id", "n_links", "component_id", "kept"
    )


_OP5_SQL = f"""
with recursive {_SQL_WORDS}, {_sql_runs(ngram_join.GRAM)}, ids as (select doc_id as id from documents),
grams as (select distinct doc_id, run from runs where n = {ngram_join.GRAM} or i = 1),
sizes as (select doc_id, count(*) as n from grams group by 1),
common as (select a.doc_id as x, b.doc_id as y, count(*) as n from grams a join grams b using (run) where a.doc_id < b.doc_id group by 1, 2),
pairs as (select x, y from common c join sizes a on a.doc_id = x join sizes b on b.doc_id = y where c.n >= {ngram_join.THRESHOLD}e0 * (a.n + b.n - c.n)),
links as (select x, y from pairs union all select y, x from pairs),
{_SQL_REACH}
select id as doc_id, least as class_id, coalesce(n, 0) as n_links, id = least as kept from least left join degree using (id)
"""


@query("op5_ngram_join", _OP5_SQL)
def op5(spark, sf_dir):
    """Class and number of links of every document."""
    out = ngram_join.link(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_links", "kept")


@query("op2_pii")
def op2(spark, sf_dir):
    """Spans of personal data in every document."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.sha2(listed(F.filter("spans", lambda s: ~s["added"])), 256)
    counts = [f"n_{k}" for k in pii.KINDS]
    return found.select("doc_id", *counts, base.alias("base_sha256"), listed(F.col("spans")).alias("spans"), "n_added")


#: Payloads below 100 bytes are all responses; of larger equal ones the least id is.
_OP3_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""


@query("op3_warc", _OP3_SQL)
def op3(spark, sf_dir):
    """Write all pages into archives and read them back."""
    folder = fresh_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.pages(warc.read(spark, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SQL_NORMAL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP11_SQL = f"""
with d as (select doc_id, {_SQL_NORMAL} as ws from documents),
b as (select cast(item_id as varchar) as item, {_SQL_NORMAL} as ws from benchmark),
bw as (select item, ws, unnest(range(1, greatest(2, len(ws) - {decontaminate.WINDOW - 2}))) as i from b where len(ws) > 0),
win as (select distinct item, array_to_string(ws[i : i + {decontaminate.WINDOW - 1}], ' ') as phrase, len(ws[i : i + {decontaminate.WINDOW - 1}]) as m from bw),
spots as (select doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) as i from d, (select distinct m from win) where len(ws) >= m),
hit as (select doc_id, i, m, item from (select doc_id, i, m, array_to_string(ws[i : i + m - 1], ' ') as phrase from spots) join win using (phrase, m)),
gone as (select doc_id, count(distinct i + k) as n from hit, range({decontaminate.WINDOW}) t(k) where k < m group by 1),
named as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from hit) group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(gone.n, 0) as n_hit, coalesce(named.n, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, gone.n is not null as contaminated
from d left join gone using (doc_id) left join named using (doc_id)
"""


@query("op11_decontaminate", _OP11_SQL)
def op11(spark, sf_dir):
    """Words of each document that occurrences of benchmark windows cover, and the items they come from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_PHRASES = "\n".join(
    f"union all select lang, {k} as k, ws[i : i + {k - 1}] as p from spots where i + {k - 1} <= len(ws)" for k in range(2, collocations.LONGEST + 1)
)
_OP12_SQL = f"""
with t as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^ \t]+') as ws from t),
spots as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
ph as (select lang, 1 as k, ws[i : i] as p from spots
{_SQL_PHRASES}),
f as (select lang, k, p, count(*) as a from ph group by 1, 2, 3),
total as (select lang, cast(sum(a) as bigint) as n from f where k = 1 group by 1),
c as (select * from f where k > 1 and a >= {collocations.MIN_COUNT}),
cuts as (select c.lang, c.k, c.p, c.a, unnest(range(1, c.k)) as cut from c),
s as (select x.lang, x.k, x.p, x.a, cut, l.a as l, r.a as r, total.n,
             (1000::hugeint * x.a * total.n) // (l.a::hugeint * r.a) as score
      from cuts x join total using (lang) join f l on l.lang = x.lang and l.k = cut and l.p = x.p[1 : cut]
      join f r on r.lang = x.lang and r.k = x.k - cut and r.p = x.p[cut + 1 : x.k]),
low as (select * from s qualify row_number() over (partition by lang, p order by score, cut) = 1),
inside as (select distinct c.lang, c.p[i : i + m - 1] as p, c.a from c, range(1, {collocations.LONGEST}) u(i), range(2, {collocations.LONGEST}) v(m) where m < c.k and i + m - 1 <= c.k),
gone as (select distinct low.lang, low.p from low join inside using (lang, p) where 100 * inside.a >= {collocations.ABSORBED} * low.a),
named as (select lang, array_to_string(p, ' ') as phrase, a, l, r, n, cast(score as bigint) as score from low anti join gone using (lang, p))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from named qualify rank <= {collocations.TOP}
"""


@query("op12_collocations", _OP12_SQL)
def op12(spark, sf_dir):
    """The best phrases of each language."""
    return collocations.top_phrases(table(spark, sf_dir, "documents").select("lang", "text"))


#: The checksum is that of zlib: polynomial 0xEDB88320, bit by bit in the table, byte by byte in the rows.
_OP13_SQL = f"""
with recursive bits as (select b as i, cast(b as ubigint) as v, 0 as k from range(256) t(b)
  union all select i, case when v % 2 = 1 then xor(v // 2, 3988292384::ubigint) else v // 2 end, k + 1 from bits where k < 8),
tab as (select list(v order by i) as tab from bits where k = 8),
runs as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) as run from documents),
low as (select coalesce(cast(doc_id as varchar), '') as id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from runs group by 1, 2),
bytes as (select id, run, n, hex(encode(id || ':' || run)) as h from low),
crc as (select id, run, n, h, 0 as spot, 4294967295::ubigint as c from bytes
  union all select id, run, n, h, spot + 2, xor(c // 256, tab[cast(1 + xor(c % 256, cast('0x' || h[spot + 1 : spot + 2] as ubigint)) as bigint)]) from crc, tab where spot < len(h)),
sums as (select run, n, xor(c, 4294967295::ubigint) as c from crc where spot = len(h)),
said as (select case when c % 97 = 0 then substr(run, 1, cast(c % len(run) as bigint)) || substr(run, cast(c % len(run) as bigint) + 2) else run end as word, n from sums),
w as (select word, cast(sum(n) as bigint) as n from said where len(word) >= {spelling.LEAST_LENGTH} group by 1 having sum(n) >= {spelling.LEAST_COUNT}),
spots as (select word, n, unnest(range(1, len(word) + 1)) as i from w),
cut as (select distinct word, substr(word, 1, i - 1) || substr(word, i + 1) as less from spots),
hole as (select word, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) as holed from spots),
pair as (select cut.word as x, w.word as y from cut join w on w.word = cut.less union all select w.word, cut.word from cut join w on w.word = cut.less
  union all select a.word, b.word from hole a join hole b on a.holed = b.holed and a.word <> b.word),
near as (select x as word, count(*) as n_near, arg_min(y, (-n, y)) as best, max(n) as best_n from pair join w on w.word = y group by 1),
formed as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= {spelling.RATIO} * w.n then best end as form, case when best_n >= {spelling.RATIO} * w.n then best_n end as form_n
  from w left join near using (word)),
way as (select word, word as root, form as ahead from formed union all select way.word, way.ahead, f.form from way join formed f on f.word = way.ahead)
select formed.word, form, root, n, n_near, form_n from formed join way on way.word = formed.word where ahead is null
"""


@query("op13_spelling", _OP13_SQL)
def op13(spark, sf_dir):
    """Form and root of every word, after the contract's deletions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.count(docs, key="doc_id"))
