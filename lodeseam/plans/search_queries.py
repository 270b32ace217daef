"""Vector and hybrid retrieval over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeseam.functions import vectors as V
from lodeseam.operators import embed as E
from lodeseam.operators import answer as A
from lodeseam.operators import search as S
from lodeseam.operators import windows as W
from lodeseam.plans.base import CHUNKS, FIRST, QUESTION, SCORED, chunks, first_vector, table, vectors

K = 3
q = lambda: F.lit(QUESTION)


def top(metric, where=None):
    def run(s, d):
        found = S.topk(vectors(s, d), first_vector(s, d), S.candidate_count(K), metric, where=where)
        return found.select("vector_id", "namespace", "rank", F.round("vector_score", 6).alias("vector_score"))

    return run


def top_sql(measure, order, where="true"):
    return f"""with v as (select vec_id as vector_id, label::bigint as namespace, {measure}(embedding::double[], {FIRST}) as x from embeddings where {where}),
      r as (select *, row_number() over (order by x {order}, vector_id) as rank from v) select vector_id, namespace, rank, round(x, 6) as vector_score from r where rank <= {S.candidate_count(K)}"""


def candidates(s, d):
    found = S.topk(vectors(s, d), first_vector(s, d), S.candidate_count(K))
    return found.join(chunks(s, d), found["vector_id"] == F.col("doc_id")).withColumn("question_id", F.lit(1))


def ranked(s, d):
    return S.dedupe(S.with_scores(candidates(s, d), q()), ("question_id",))


def chosen(s, d):
    return S.cited(S.diverse(S.above_threshold(ranked(s, d), q()), K))


HYBRID = f"""{SCORED}, v as (select vec_id, list_cosine_similarity(embedding::double[], {FIRST}) as vector_score from embeddings),
r as (select *, row_number() over (order by vector_score desc, vec_id) as rank from v),
h as (select scored.*, vec_id as vector_id, rank, vector_score, 0.8 * vector_score + 0.2 * lexical_score + 0.12 * exact_match_score + 0.12 * structural_score as score
  from r join scored on scored.doc_id = r.vec_id where rank <= {S.candidate_count(K)}),
u as (select * from (select *, row_number() over (partition by file_path, symbol_name, trim(regexp_replace(content, '\\s+', ' ', 'g')) order by rank) as n from h) where n = 1)"""

#: A plain order instead of the diverse choice, for what follows it.
FIRST_K = f"{HYBRID}, c as (select *, row_number() over (order by score desc, vector_score desc, vector_id desc) as place from u)"


def plain(s, d):
    from pyspark.sql import Window

    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("vector_score"), F.desc("vector_id"))
    return S.cited(ranked(s, d).withColumn("place", F.row_number().over(order).cast("long")))


HEAD = "'[S' || place || ']' || chr(10) || 'file: ' || file_path || chr(10) || 'language: ' || language || chr(10) || 'chunk_type: ' || chunk_type || chr(10) || 'symbol: ' || coalesce(nullif(symbol_name, ''), 'none') || chr(10) || 'lines: 1-' || symbol_end_line || chr(10) || 'content:' || chr(10)"
PACKED = f"""{FIRST_K}, p as (select *, {HEAD} as head from c),
w as (select *, 20000 - coalesce(sum(length(head) + length(content) + 2) over (order by place rows between unbounded preceding and 1 preceding), 0) as remaining from p),
f as (select *, min(case when remaining > length(head) then 1 else 0 end) over (order by place) as fits from w),
b as (select string_agg(head || substr(content, 1, (remaining - length(head))::bigint), chr(10) || chr(10) order by place) as evidence from f where fits = 1)"""


def sized(s, d):
    return chunks(s, d).select(F.col("repository_id"), "doc_id", F.octet_length("content").cast("long").alias("bytes"))


def evidence_of_all(s, d):
    short = table(s, d, "documents").where("n_chars < 400").groupBy((F.col("doc_id") % 100).alias("item_id"))
    marked = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: F.concat(F.lit("[D"), x["doc_id"].cast("string"), F.lit("] "), F.regexp_replace(x["text"], "[\r\n]+", " ")))
    return table(s, d, "benchmark").select("item_id", F.col("text").alias("question")).join(short.agg(F.array_join(marked, "\n").alias("evidence")), "item_id", "left")


QUERIES = {
    "vector_topk_cosine": (top("cosine"), top_sql("list_cosine_similarity", "desc")),
    "vector_topk_dot": (top("dotproduct"), top_sql("list_dot_product", "desc")),
    "vector_topk_euclid": (top("euclidean"), top_sql("list_distance", "asc")),
    "filtered_topk": (top("cosine", {"$or": [{"namespace": {"$in": [1, 2]}}, {"namespace": {"$gte": 7}}]}), top_sql("list_cosine_similarity", "desc", "label in (1, 2) or label >= 7")),
    "topk_each": (
        # every vector whose id is divisible by 50 is a question
        lambda s, d: S.topk_each(vectors(s, d), vectors(s, d).where("vector_id % 50 = 0").select(F.col("vector_id").alias("question_id"), F.col("values").alias("wanted")), 5).select("question_id", "vector_id", "rank", F.round("vector_score", 6).alias("vector_score")),
        """with x as (select q.vec_id as question_id, v.vec_id as vector_id, list_cosine_similarity(v.embedding::double[], q.embedding::double[]) as vector_score from embeddings q cross join embeddings v where q.vec_id % 50 = 0),
        r as (select *, row_number() over (partition by question_id order by vector_score desc, vector_id) as rank from x) select question_id, vector_id, rank, round(vector_score, 6) as vector_score from r where rank <= 5""",
    ),
    "hybrid_rerank": (
        lambda s, d: S.with_scores(candidates(s, d), q()).select("vector_id", "rank", *[F.round(c, 6).alias(c) for c in ("vector_score", "lexical_score", "exact_match_score", "structural_score", "score")]),
        f"with {HYBRID} select vector_id, rank, {', '.join(f'round({c}, 6)::double as {c}' for c in ('vector_score', 'lexical_score', 'exact_match_score', 'structural_score', 'score'))} from h",
    ),
    "candidate_dedupe": (lambda s, d: ranked(s, d).select("vector_id", "rank"), f"with {HYBRID} select vector_id, rank from u"),
    "structural_filter": (
        lambda s, d: S.above_threshold(ranked(s, d), q()).select("vector_id", "structural_score"),
        f"with {HYBRID} select vector_id, structural_score::double as structural_score from u where structural_score >= 0.45",
    ),
    "ranked_candidates": (lambda s, d: plain(s, d).select("vector_id", "place", F.round("score", 6).alias("score")), f"with {FIRST_K} select vector_id, place, round(score, 6)::double as score from c"),
    "diverse_topk": (lambda s, d: chosen(s, d).select("vector_id", "place", "citation_id", F.round("score", 6).alias("score")), None),
    "citations": (lambda s, d: plain(s, d).select("vector_id", "citation_id"), f"with {FIRST_K} select vector_id, 'S' || place as citation_id from c"),
    "context_packing": (lambda s, d: S.evidence(plain(s, d)).select(F.length("evidence").cast("long").alias("n_chars"), F.md5("evidence").alias("evidence_md5")), f"with {PACKED} select length(evidence) as n_chars, md5(evidence) as evidence_md5 from b"),
    "prompt_text": (
        lambda s, d: S.evidence(plain(s, d)).select(F.md5(S.prompt(q(), F.col("evidence"))).alias("prompt_md5")),
        f"with {PACKED} select md5('{S.SYSTEM_PROMPT.replace(chr(39), chr(39) * 2)}' || chr(10) || chr(10) || 'Question:' || chr(10) || '{QUESTION}' || chr(10) || chr(10) || 'Repository evidence:' || chr(10) || evidence) as prompt_md5 from b",
    ),
    "answer": (
        # without a model the answer cites what was found
        lambda s, d: chosen(s, d).groupBy("question_id").agg(F.concat(F.lit("See "), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("["), F.col("citation_id"), F.lit("]")))), ", ")).alias("answer")),
        None,
    ),
    "answer_all": (
        # every benchmark text is a question; its evidence are the short documents dealt to it, for some none
        lambda s, d: A.answer(evidence_of_all(s, d)).select("item_id", "answer"),
        f"""with e as (select doc_id % 100 as item_id, string_agg('[D' || doc_id || ']', ', ' order by doc_id) as found from documents where n_chars < 400 group by 1)
        select b.item_id, coalesce('See ' || found, '{S.NO_EVIDENCE}') as answer from benchmark b left join e using (item_id)""",
    ),
    "validate_vectors": (lambda s, d: vectors(s, d).select("vector_id", V.valid(F.col("values"), 64).alias("valid")), "select vec_id as vector_id, len(embedding) = 64 as valid from embeddings"),
    "embed_documents": (lambda s, d: E.embed(table(s, d, "documents").select("doc_id", "text"), "text").select("doc_id", F.transform("values", lambda x: F.round(x, 6)).alias("values")), None),
    "embedding_smoke": (
        lambda s, d: E.embed(table(s, d, "benchmark").select("item_id", "text"), "text").select("item_id", F.size("values").cast("long").alias("dimension"), V.valid(F.col("values"), E.DIMENSION).alias("valid")),
        "select item_id, 64::bigint as dimension, true as valid from benchmark",
    ),
    "token_capacity": (
        lambda s, d: table(s, d, "benchmark").select("item_id", E.within_capacity(F.col("text")).alias("n_tokens")),
        "select item_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as n_tokens from benchmark",
    ),
    "upsert_batches": (lambda s, d: W.batches(sized(s, d), "repository_id", ["doc_id"], "bytes", 50, 100_000).select("repository_id", "doc_id", "batch"), None),
    "namespace_check": (
        lambda s, d: chunks(s, d).select("doc_id", (F.col("repository_id") == F.element_at(F.split("file_path", "/"), 1)).alias("same_namespace")),
        f"with {CHUNKS} select doc_id, repository_id = string_split(file_path, '/')[1] as same_namespace from chunks",
    ),
}
