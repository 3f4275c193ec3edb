"""The queries of this subpackage: thin wrappers that put each operator's results into its contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, small_batches, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify

    docs = documents(spark, sf_dir)
    model = fit(docs.where(remainder("doc_id", 3) != 1))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "language.lang_pred", "language.score")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    out = scan(documents(spark, sf_dir).select("doc_id", "text", "source"))
    found = out.select("doc_id", F.posexplode_outer("findings").alias("finding", "f")).where("f is not null")  # the plain form would scan twice
    value = F.col("f.value")
    return found.select("doc_id", "finding", F.col("f.start").alias("start"), F.length(value).alias("length"), F.sha2(value.cast("binary"), 256).alias("value_sha256"), F.col("f.score").alias("score"), F.col("f.is_secret").alias("is_secret"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    out = encode(documents(spark, sf_dir).select("doc_id", "text"), vocabulary(), digests_only=True)
    return out.select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import join

    out = join(documents(spark, sf_dir), width=4, num=85, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentences import dedup

    out = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.coalesce(F.col("kept_text"), F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_sentences", "n_removed", "removed", digest.alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0).select("doc_id", "toxic")
    out = score(docs, fit(labels, docs))
    value = F.col("toxicity")
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), value.alias("score"), F.when(value >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import dedup

    out = dedup(documents(spark, sf_dir), digests_only=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    docs = documents(spark, sf_dir)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    out = shard(rows, 40, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_langid, op2_secrets, op3_bpe, op4_jaccard, op5_topk, op6_sentences, op7_toxicity, op8_suffixes, op9_sharding, op10_decontamination)}
ORACLES: dict[str, str] = {
    "op4_jaccard": """
        with recursive words as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w
            from documents),
        sets as (
            select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [list_aggregate(w, 'string_agg', ' ')]
                else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3]) end) as s
            from words),
        tokens as (select doc_id, len(s) as n, unnest(s) as t from sets),
        links as (
            select a.doc_id as u, b.doc_id as v from tokens a join tokens b on a.t = b.t and a.doc_id <> b.doc_id and a.n * 100 >= b.n * 85 and b.n * 100 >= a.n * 85
            group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach(u, v) as (select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u)
        select s.doc_id, len(s.s) as n_shingles, least(s.doc_id, coalesce(min(r.v), s.doc_id)) as component_id
        from sets s left join reach r on r.u = s.doc_id group by s.doc_id, s.s""",
    "op5_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
              from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
        r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
        select query_id, rank, vec_id, score from r where rank <= 5""",
    "op8_suffixes": """
        with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        parts as (select doc_id, c, substr(h, 1024 * c + 1, 1122) as p from (select doc_id, h, unnest(range(0, len(h) // 1024 + 1)) as c from t) x),
        strings as (select doc_id, 512 * c + k as i, substr(p, 2 * k + 1, 100) as s from (select *, unnest(range(0, least(512, len(p) // 2 - 49))) as k from parts where len(p) >= 100) x),
        firsts as (select s, min(doc_id) as d from strings group by s having count(*) > 1),
        covered as (select distinct doc_id, i from strings join firsts using (s) where d < doc_id),
        steps as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as fresh from covered),
        runs as (select doc_id, min(i) as a, max(i) + 50 as b from (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from steps) r group by doc_id, run),
        gaps as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as e from runs),
        pieces as (select t.doc_id, e, substr(h, 2 * e + 1, 2 * (a - e)) as x from gaps join t using (doc_id)
                   union all select t.doc_id, e, substr(h, 2 * e + 1) from t join (select doc_id, max(b) as e from runs group by doc_id) m using (doc_id)),
        kept as (select doc_id, string_agg(x, '' order by e) as x from pieces group by doc_id),
        sums as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from runs group by doc_id)
        select t.doc_id, len(h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(x, h))) as kept_sha256
        from t left join sums using (doc_id) left join kept using (doc_id)""",
}
