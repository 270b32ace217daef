"""Joins, counts and state over the star schema, conversations and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeseam.functions import metadata as M
from lodeseam.operators import state as St
from lodeseam.plans.base import table
from lodeseam.sources.folders import shared
from lodeseam.sources.vector_store import VectorStore

t = table
nations = lambda s, d: t(s, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
STATUS = {"signup": "queued", "view": "scanning", "click": "embedding", "purchase": "ready", "error": "failed"}


def status_events(s, d):
    """Events as status changes of jobs, one job for each user; the value is a count that stays until a reset."""
    of = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return t(s, d, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", of[F.col("event_type")].alias("status"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("chunk_count"))


EVENTS = f"ev as (select user_id as job_id, event_id, ts, MAP {{{', '.join(f'{a!r}: {b!r}' for a, b in STATUS.items())}}}[event_type] as status, case when event_type = 'purchase' then value end as chunk_count from events)"


def deleted(s, d):
    return t(s, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")


def created_together(s, d):
    jobs = status_events(s, d).select("job_id").distinct().withColumn("status", F.lit("ready"))
    chats = jobs.select((F.col("job_id") * 10).alias("chat_id"), "job_id")
    new = t(s, d, "customer").select((-F.col("c_custkey") - 1).cast(jobs.schema["job_id"].dataType).alias("job_id"), F.lit("queued").alias("status"))
    made, talked = St.create_with_chat(jobs, chats, new.withColumn("chat_id", F.col("job_id") * 10))
    return made.join(talked, "job_id").select("job_id", "chat_id", "status")


def index_write(s, d):
    """Every vector by its label's namespace; one namespace replaced, one added to, one deleted; what is read back then."""
    store = VectorStore.open(s, shared(s, "index"), 64)
    rows = t(s, d, "embeddings").select(F.col("label").cast("string").alias("namespace"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("values"), "vec_id")
    times = lambda x: F.transform("values", lambda v: v * x)
    store.write(rows.drop("vec_id"))
    store.replace_namespace("1", rows.where("namespace = '1' and vec_id % 2 = 0").withColumn("values", times(2.0)).drop("vec_id"))
    store.write(rows.where("namespace = '2' and vec_id % 3 = 0").withColumn("values", times(-1.0)).drop("vec_id"), replace=False)
    store.delete("3")
    return store.read().select("namespace", "id", F.col("values")[0].alias("first"), F.size("values").alias("dimension"), "batch")


QUERIES = {
    "join_point_lookup": (
        lambda s, d: t(s, d, "customer").where("c_custkey = 7").join(nations(s, d), "c_nationkey").select("c_custkey", "c_name", "n_name"),
        "select c_custkey, c_name, n_name from customer join nation on c_nationkey = n_nationkey where c_custkey = 7",
    ),
    "join_ordered": (
        # the order is a rank within each nation, as rows have none
        lambda s, d: t(s, d, "customer").join(nations(s, d), "c_nationkey").select("c_custkey", "n_name", F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long").alias("place")),
        "select c_custkey, n_name, row_number() over (partition by n_name order by c_acctbal desc, c_custkey) as place from customer join nation on c_nationkey = n_nationkey",
    ),
    "latest_by_url": (
        # max_by is summed up in each task, where a window would move every row
        lambda s, d: t(s, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", "m.o_orderdate", "m.o_orderkey"),
        "select o_custkey, o_orderdate, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1",
    ),
    "chat_list": (
        # messages are counted before they are joined
        lambda s, d: t(s, d, "customer").join(nations(s, d), "c_nationkey").join(t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n")), "c_custkey", "left")
        .select("c_custkey", "n_name", F.coalesce("n", F.lit(0)).alias("message_count")),
        "select c_custkey, n_name, count(o_orderkey) as message_count from customer join nation on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by all",
    ),
    "chat_detail": (
        lambda s, d: s.sql(
            "select c_custkey, c_name, n_name, (select count(*) from {orders} o where o.o_custkey = c.c_custkey) as message_count from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey",
            orders=t(s, d, "orders"), customer=t(s, d, "customer"), nation=t(s, d, "nation"),
        ),
        "select c_custkey, c_name, n_name, (select count(*) from orders where o_custkey = c_custkey) as message_count from customer join nation on c_nationkey = n_nationkey",
    ),
    "chat_messages": (
        lambda s, d: t(s, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long").alias("place")),
        "select conv_id, turn, role, row_number() over (partition by conv_id order by turn, role, text) as place from conversations",
    ),
    "exists_probe": (
        lambda s, d: t(s, d, "customer").join(t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"),
        "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)",
    ),
    "chat_touch": (
        lambda s, d: t(s, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("updated_at"), F.count(F.lit(1)).alias("message_count")),
        "select o_custkey, max(o_orderdate) as updated_at, count(*) as message_count from orders group by o_custkey",
    ),
    "cascade_delete": (
        lambda s, d: St.cascade_delete(t(s, d, "customer").select("c_custkey"), t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), deleted(s, d), "c_custkey")[1],
        "select o_custkey as c_custkey, o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')",
    ),
    "role_check": (
        lambda s, d: t(s, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n")).select("role", "n", F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)).alias("accepted")),
        "select role, count(*) as n, role in ('user', 'assistant') as accepted from conversations group by role",
    ),
    "language_topk": (
        lambda s, d: t(s, d, "documents").groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language").limit(6)
        .withColumn("share", F.round(F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1))), 6)),
        "with g as (select lang as language, count(*) as n from documents group by lang order by n desc, language limit 6) select language, n, round(n / max(n) over (), 6) as share from g",
    ),
    "scan_summary": (
        lambda s, d: t(s, d, "documents").groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.count(F.when(F.length("text") > 0, 1)).alias("with_text")),
        "select lang as language, count(*) as files, sum(n_chars)::bigint as chars, count(case when length(text) > 0 then 1 end) as with_text from documents group by lang",
    ),
    "file_previews": (
        lambda s, d: t(s, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("preview")),
        "select doc_id, substr(text, 1, 200) as preview from documents",
    ),
    "size_guard": (
        lambda s, d: t(s, d, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes")).withColumn("within", F.col("bytes") <= 262_144_000),
        "select source, sum(octet_length(encode(text)))::bigint as bytes, sum(octet_length(encode(text))) <= 262144000 as within from documents group by source",
    ),
    "index_upsert": (
        # documents of one source are replaced by shorter ones
        lambda s, d: St.upsert(t(s, d, "documents").select("doc_id", "n_chars"), t(s, d, "documents").where("source = 'src1'").select("doc_id", F.lit(0).cast("long").alias("n_chars")), ["doc_id"]),
        "select doc_id, case when source = 'src1' then 0 else n_chars end as n_chars from documents",
    ),
    "namespace_delete": (
        lambda s, d: t(s, d, "embeddings").join(t(s, d, "embeddings").where("label = 3").select("label").distinct(), "label", "left_anti").select("vec_id", "label"),
        "select vec_id, label from embeddings where label <> 3 or label is null",
    ),
    "index_write": (
        index_write,
        """with v as (select label::varchar as namespace, vec_id::varchar as id, vec_id, embedding[1]::double as first, len(embedding) as dimension from embeddings),
        k as (select namespace, id, first * case when namespace = '1' then 2 when namespace = '2' and vec_id % 3 = 0 then -1 else 1 end as first, dimension from v
          where namespace <> '3' and (namespace <> '1' or vec_id % 2 = 0))
        select namespace, id, first, dimension::int as dimension, ((row_number() over (partition by namespace order by id) - 1) // 50)::bigint as batch from k""",
    ),
    "index_open": (
        lambda s, d: t(s, d, "embeddings").groupBy(F.size("embedding").alias("dimension")).agg(F.count(F.lit(1)).alias("vectors")),
        "select len(embedding)::int as dimension, count(*) as vectors from embeddings group by 1",
    ),
    "job_current": (
        lambda s, d: St.current(status_events(s, d).withColumn("progress", St.progress(F.col("status"))), "job_id", ["ts", "event_id"], ("chunk_count", "progress")).select("job_id", "status", "event_id", F.coalesce("progress", F.lit(0)).alias("progress"), "chunk_count"),
        f"""with {EVENTS}, r as (select *, sum(case when status = 'queued' then 1 else 0 end) over (partition by job_id order by ts, event_id) as epoch from ev),
        p as (select *, MAP {{'queued': 0, 'scanning': 25, 'embedding': 60, 'ready': 100}}[status] as shown from r),
        k as (select *, last_value(chunk_count ignore nulls) over (partition by job_id, epoch order by ts, event_id) as kept,
          last_value(shown ignore nulls) over (partition by job_id, epoch order by ts, event_id) as progressed, row_number() over (partition by job_id order by ts desc, event_id desc) as n from p)
        select job_id, status, event_id, coalesce(progressed, 0) as progress, kept as chunk_count from k where n = 1""",
    ),
    "job_history": (
        lambda s, d: St.history(status_events(s, d), "job_id", ["ts", "event_id"], ("chunk_count",)).select("job_id", "event_id", "epoch", "chunk_count"),
        f"""with {EVENTS}, r as (select *, sum(case when status = 'queued' then 1 else 0 end) over (partition by job_id order by ts, event_id)::bigint as epoch from ev)
        select job_id, event_id, epoch, last_value(chunk_count ignore nulls) over (partition by job_id, epoch order by ts, event_id) as chunk_count from r""",
    ),
    "job_recover": (
        lambda s, d: St.recover_interrupted(St.current(status_events(s, d), "job_id", ["ts", "event_id"])).groupBy("status", "recovered").agg(F.count(F.lit(1)).alias("jobs")),
        f"""with {EVENTS}, k as (select *, row_number() over (partition by job_id order by ts desc, event_id desc) as n from ev), c as (select status in ('queued', 'scanning', 'embedding') as recovered, status from k where n = 1)
        select case when recovered then 'failed' else status end as status, recovered, count(*) as jobs from c group by all""",
    ),
    "job_create": (
        lambda s, d: St.create(
            St.current(status_events(s, d), "job_id", ["ts", "event_id"]).select("job_id", "status"),
            status_events(s, d).groupBy((-F.col("job_id") - 1).alias("job_id")).agg(F.lit("queued").alias("status")),
            "job_id",
        ),
        f"""with {EVENTS}, k as (select *, row_number() over (partition by job_id order by ts desc, event_id desc) as n from ev)
        select job_id, status from k where n = 1 union all select distinct -job_id - 1 as job_id, 'queued' as status from ev""",
    ),
    "job_chat_create": (
        # every user's job gets a chat, and every customer without one a job and a chat, told by what both tables hold then
        lambda s, d: created_together(s, d),
        f"""with {EVENTS}, j as (select distinct job_id from ev), n as (select -c_custkey - 1 as job_id from customer)
        select job_id, job_id * 10 as chat_id, 'ready' as status from j union all select job_id, job_id * 10 as chat_id, 'queued' as status from n""",
    ),
    "ready_gate": (
        lambda s, d: St.ready(t(s, d, "documents").select("doc_id", F.col("doc_id").alias("job_id")), St.current(status_events(s, d), "job_id", ["ts", "event_id"]).select("job_id", "status"), "job_id").select("doc_id", "allowed"),
        f"""with {EVENTS}, k as (select *, row_number() over (partition by job_id order by ts desc, event_id desc) as n from ev)
        select doc_id, coalesce(status = 'ready', true) as allowed from documents left join (select job_id, status from k where n = 1) j on doc_id = j.job_id""",
    ),
    "pipeline_steps": (
        lambda s, d: t(s, d, "events").select("event_id", (F.col("event_id") % 101).cast("int").alias("progress")).withColumn("failed_step", M.failed_step(F.col("progress"))),
        "select event_id, (event_id % 101)::int as progress, case when event_id % 101 <= 12 then 0 when event_id % 101 <= 28 then 1 when event_id % 101 <= 48 then 2 when event_id % 101 <= 68 then 3 else 4 end as failed_step from events",
    ),
}
