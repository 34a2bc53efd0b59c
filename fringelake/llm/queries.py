"""The queries of this subpackage over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, decontaminate, exactdup, jaccard, langid, mixing, pitmanyor, repeats, tokens, topk, toxicity, variants, warc
from .common import table


def op1_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pitmanyor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.score_all(table(spark, sf_dir, "documents"))


def page_captures(pages: DataFrame) -> DataFrame:
    """A capture history of ``pages``: each is fetched in full, and asked for again later.

    Its second fetch is a revisit with the same entity tag; of every seven pages
    one has another tag by then, and one gives a date only.
    """
    tag, kind = F.md5(F.coalesce("html", F.lit(""))), F.pmod("page_id", F.lit(7))
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), F.lit("day 0").alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag, F.lit("date"), F.lit("day 0")).alias("headers"), F.col("html").alias("body"),
    )
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") + 10_000_000).alias("ts"), F.lit("revisit").alias("kind"), F.when(kind == 0, F.lit("other")).when(kind != 1, tag).alias("etag"), F.lit("day 0").alias("last_modified"),
        F.create_map(F.lit("date"), F.lit("day 1"), F.lit("content-length"), F.lit("0")).alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return full.unionByName(again)


def _headers_text():
    return F.array_join(F.array_sort(F.transform(F.map_entries("merged_headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("merged_headers")


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(page_captures(table(spark, sf_dir, "pages")))
    return found.select("record_id", "canonical_url", "ts", "kind", "status", "resolved_id", _headers_text())


def op9_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of ``op9_revisits`` with their bodies, as length in bytes and digest; its SQL fixes the columns of the other."""
    captures = page_captures(table(spark, sf_dir, "pages"))
    whole = warc.with_bodies(warc.resolve_revisits(captures), captures)
    return whole.select("record_id", "canonical_url", "ts", "kind", "status", "resolved_id", _headers_text(), F.octet_length("body").cast("long").alias("body_bytes"), F.sha2("body", 256).alias("body_sha256"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.mark_duplicates(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.cross_align(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_leaks, op2_tokens, op3_mixing, op4_jaccard, op5_repeats, op6_topk, op7_toxicity, op8_pitmanyor, op9_revisits, op9_bodies, op10_language, op11_exact, op12_alignment, op13_spelling)}

ORACLE_SQL = {
    "op4_jaccard": """
        with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') ws from documents),
        s as (select distinct doc_id, case when len(ws) < 4 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 3], ' ') end g
              from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) i from d where len(ws) > 0)),
        n as (select doc_id, count(*) n from s group by doc_id),
        f as (select g, count(*) c from s group by g having count(*) > 1),
        p as (select a.doc_id a, b.doc_id b, count(*) o from s a join f using (g) join s b using (g) where a.doc_id < b.doc_id group by 1, 2),
        l as materialized (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * o >= 85 * (x.n + y.n - o)),
        e as materialized (select a, b from l union select b, a from l),
        r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
        c as (select a, min(b) m from r group by a)
        select d.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, cast(least(d.doc_id, coalesce(c.m, d.doc_id)) as bigint) component_id
        from d left join n on d.doc_id = n.doc_id left join c on d.doc_id = c.a""",
    "op5_repeats": """
        with d as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws from documents),
        p as (select rid, ws, unnest(generate_series(1, len(ws) - 34)) s from d where len(ws) >= 35),
        w as (select rid, s, md5(array_to_string(ws[s:s + 34], ' ')) h from p),
        r as (select rid, s from w where h in (select h from w group by h having count(*) > 1)),
        c as (select distinct rid, unnest(generate_series(s, s + 34)) i from r),
        k as (select rid, doc_id, unnest(ws) word, generate_subscripts(ws, 1) i from d),
        g as (select k.rid, string_agg(word, ' ' order by i) kept, count(*) n from k anti join c on k.rid = c.rid and k.i = c.i group by k.rid)
        select d.doc_id, cast(len(ws) as bigint) n_words, cast(len(ws) - coalesce(g.n, 0) as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join g on d.rid = g.rid""",
    "op6_topk": """
        with v as (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
                   where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        p as (select q.rid, q.vec_id query_id, d.vec_id vec_id, cast(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) as bigint) score
              from v q join v d on q.rid <> d.rid where q.vec_id % 50 = 0),
        r as (select *, cast(row_number() over (partition by rid order by score desc, vec_id) as int) rank from p)
        select query_id, rank, vec_id, score from r where rank <= 5""",
    "op9_revisits": """
        with u as (select *, regexp_replace(trim(url), '#.*$', '') t from pages),
        w as (select *, regexp_replace(t, '^[A-Za-z][A-Za-z0-9+.-]*://', '') r from u),
        x as (select page_id, md5(coalesce(html, '')) tag, 'http://' || regexp_replace(lower(regexp_extract(r, '^([^/?]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/+$', '') p,
              array_to_string(list_sort(list_filter(string_split(regexp_extract(r, '\\?(.*)$', 1), '&'), lambda a: a <> '' and not regexp_matches(a, '^(utm_[A-Za-z]*|ref)(=|$)'))), '&') q from w),
        c as (select page_id, tag, p || case when q <> '' then '?' || q else '' end canonical_url from x),
        a as (select page_id, c.tag, canonical_url, case when page_id % 7 = 0 then 'other' when page_id % 7 <> 1 then c.tag end own,
              max(page_id) over (partition by canonical_url) latest, last_value(c.tag) over (partition by canonical_url order by page_id rows between unbounded preceding and unbounded following) latest_tag from c),
        s as (select *, case when own is not null and own <> latest_tag then 'mismatch' else 'resolved' end st from a)
        select cast(page_id * 2 as bigint) record_id, canonical_url, cast(page_id as bigint) ts, 'response' kind, 'response' status, cast(null as bigint) resolved_id, 'content-type=text/html;date=day 0;etag=' || tag merged_headers from c
        union all
        select cast(page_id * 2 + 1 as bigint), canonical_url, cast(page_id + 10000000 as bigint), 'revisit', st, case when st = 'resolved' then cast(latest * 2 as bigint) end,
               case when st = 'resolved' then 'content-type=text/html;date=day 1;etag=' || latest_tag else 'content-length=0;date=day 1' end from s""",
    "op11_exact": """
        with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) text_sha256 from documents)
        select doc_id, max(doc_id) over (partition by text_sha256) keep_id, count(*) over (partition by text_sha256) group_size,
               row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 kept, text_sha256 from d""",
}
