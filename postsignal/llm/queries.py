"""The registered queries of this folder, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, linededup, merkle, passages, pii, quality, setsketch, simhash, spelling, vptree, warc, wavelet
from .frames import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), *[pii.counted(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.described("base"), 256).alias("base_sha256"),
        pii.described(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op2_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vptree.usable(table(spark, sf_dir, "embeddings"))
    return vptree.search(vptree.build(vectors), vectors.filter(F.col("id") % 20 == 0), k=20)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumnRenamed("id", "doc_id")


def tokenizer() -> str:
    """The tokenizer file of the registered queries."""
    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer()))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).drop("url")


def op6_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.write(table(spark, sf_dir, "documents"), tokenizer(), end_id=2)
    return wavelet.read(shards).withColumnRenamed("id", "doc_id")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    freed = linededup.drop_repeated_lines(docs, removed="removed_lines")
    return freed.select(
        "doc_id", "text", F.size("removed_lines").cast("long").alias("n_removed"),
        F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated",
    )


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    freed = passages.drop_repeated_passages(docs)
    spans = F.expr("transform(removed, s -> concat(s.start, ':', s.end))")
    return freed.select(
        "doc_id", "text", F.size("removed").cast("long").alias("n_removed"),
        F.array_join(spans, ",").alias("removed"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _misspelt(id: Column, word: Column) -> Column:
    """Some words of a text without one code point, as the query's definition has it."""
    hashed = F.crc32(F.concat(id, F.lit(":"), word))
    at = (hashed % F.length(word)).cast("int")
    shorter = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(hashed % 31 == 0, shorter).otherwise(word)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), change=_misspelt))


def op12_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grown = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars").cast("decimal(20,0)") + 1)
    forged = merkle.leaf_hash(changed={"n_chars": F.coalesce(grown, F.col("n_chars").cast("decimal(20,0)"))})
    manifest = merkle.build(docs, forged=F.when(grown.isNotNull(), forged))
    return merkle.proofs(merkle.climb(manifest)).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_vptree": op2_vptree,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_warc": op5_warc,
    "op6_wavelet": op6_wavelet,
    "op7_lines": op7_lines,
    "op8_decontaminate": op8_decontaminate,
    "op9_passages": op9_passages,
    "op10_simhash": op10_simhash,
    "op11_spelling": op11_spelling,
    "op12_setsketch": op12_setsketch,
    "op13_merkle": op13_merkle,
}

def _crc32_sql(text: str) -> str:
    """DuckDB has no CRC-32: bit by bit over the UTF-8 bytes, each brought in at the first of its eight steps."""
    step = "xor(c, b)"
    return f"""xor(4294967295, list_reduce(
      list_prepend(4294967295::bigint, flatten(list_transform(range(1, 2 * strlen({text}), 2),
        lambda i: [('0x' || substr(hex({text}), i, 2))::bigint, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor({step} >> 1, 3988292384 * ({step} & 1))))"""


SQL: dict[str, str] = {
    "op2_vptree": """
with usable as (
  select vec_id, embedding::double[] as v from embeddings
  where vec_id is not null and embedding is not null
    and not coalesce(list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x))), false)
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))
), scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v) as score
  from usable q join usable c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank,
       vec_id, score
from scored qualify rank <= 20
""",
    "op11_spelling": """
with recursive run as (
  select doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) as w from documents) where length(w) >= 7
), hashed as (
  select w, n, {crc} as h from (select doc_id, w, count(*) as n from run group by doc_id, w)
), word as (
  select word, cast(sum(n) as bigint) as n from (
    select case when h % 31 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, n from hashed
  ) where length(word) >= 7 group by word having sum(n) >= 2
), part as (
  select word, n, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as b
  from (select word, n, unnest(range(1, length(word) + 1)) as i from word)
), pair as (
  select x.word, x.n, y.word as near, y.n as near_n from part x join part y using (i, a, b) where x.word <> y.word
  union select w.word, w.n, p.word, p.n from word w join part p on p.a || p.b = w.word
  union select p.word, p.n, w.word, w.n from word w join part p on p.a || p.b = w.word
), best as (
  select word, count(*) as n_near,
         arg_min(near, {'m': -near_n, 'w': near}) as near, max(near_n) as top_n from pair group by word
), formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when top_n >= 10 * n then near end as form,
         case when top_n >= 10 * n then top_n end as form_n
  from word w left join best using (word)
), way as (
  select word, word as tip, 0 as step from formed
  union all select way.word, f.form, step + 1 from way join formed f on f.word = way.tip where f.form is not null
)
select word, form, root, n, n_near, form_n
from formed join (select word, arg_max(tip, step) as root from way group by word) using (word)
""".replace("{crc}", _crc32_sql("doc_id || ':' || w")),
    "op12_setsketch": """
with recursive word as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents
), sets as (
  select doc_id, list_distinct(case when len(w) < 2 then w
    else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s
  from word
), shingle as (
  select doc_id, len(s) as n, unnest(s) as s from sets
), link as (
  select a.doc_id as a, b.doc_id as b
  from shingle a join shingle b on a.s = b.s and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach as (
  select doc_id as a, doc_id as b from documents
  union select r.a, l.b from reach r join link l on l.a = r.b
)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept
from sets join (select a, min(b) as component_id from reach group by a) on a = doc_id
""",
    "op13_merkle": """
with recursive field as (
  select doc_id, lang, coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') as f1,
         coalesce(strlen(source) || ':' || source, '-') as f2, coalesce(strlen(lang) || ':' || lang, '-') as f3,
         coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as f4,
         coalesce(strlen(cast(n_chars + 1 as varchar)) || ':' || (n_chars + 1), '-') as g4,
         coalesce(strlen(text) || ':' || text, '-') as f5, {crc} % 7 = 0 as tampered
  from documents
), leaf as (
  select *, row_number() over (partition by lang order by doc_id nulls first, h) - 1 as pos,
         count(*) over (partition by lang) as n, dense_rank() over (order by lang nulls first) - 1 as tree
  from (select doc_id, lang, sha256(f1 || f2 || f3 || f4 || f5) as h,
               sha256(f1 || f2 || f3 || case when tampered then g4 else f4 end || f5) as shown from field)
), node as (
  select tree, 0 as lvl, pos, h, n from leaf
  union all
  select tree, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2
  from node where n > 1 group by tree, lvl, pos // 2, n
), subroot as (
  select tree, h, count(*) over () as n from node where n = 1
), top as (
  select 0 as lvl, tree as pos, h, n from subroot
  union all
  select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from top where n > 1 group by lvl, pos // 2, n
), up as (
  select doc_id, h as leaf, tree, 0 as lvl, pos, n, shown as now, '' as proof from leaf
  union all
  select doc_id, leaf, u.tree, u.lvl + 1, u.pos // 2, (u.n + 1) // 2,
         sha256(case when u.pos % 2 = 1 then s.h || now else now || coalesce(s.h, '') end), proof || coalesce(s.h, '')
  from up u left join node s on s.tree = u.tree and s.lvl = u.lvl and s.pos = xor(u.pos, 1) where u.n > 1
), over as (
  select doc_id, leaf, u.tree, 0 as lvl, u.tree as pos, s.n, now, proof, s.h as subroot
  from up u join subroot s on s.tree = u.tree where u.n = 1
  union all
  select doc_id, leaf, o.tree, o.lvl + 1, o.pos // 2, (o.n + 1) // 2,
         sha256(case when o.pos % 2 = 1 then s.h || now else now || coalesce(s.h, '') end), proof || coalesce(s.h, ''), subroot
  from over o left join top s on s.lvl = o.lvl and s.pos = xor(o.pos, 1) where o.n > 1
)
select doc_id, leaf, subroot, top.h as root, sha256(proof) as proof_sha256, now as folded_root, now = top.h as verified
from over join top on top.n = 1 where over.n = 1
""".replace("{crc}", _crc32_sql("cast(doc_id as varchar)")),
}
