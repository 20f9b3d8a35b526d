"""Vectors, exchange and evaluation: plans and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.operators import evaluation, exchange, vectors

LO, HI = 1_610_000_000_000, 1_610_600_000_000
E = vectors.embeddings
QUERIES = {
    "vector_truncated": lambda s, d: E(s, d).select("id", F.explode(vectors.truncated(F.col("v"), 16)).alias("x")).groupBy("id").agg(F.round(F.sum("x"), 5).alias("x"), F.count("*").alias("n")),
    "vector_quantised": lambda s, d: E(s, d).select("id", F.aggregate(vectors.quantised(F.col("v")), F.lit(0), lambda a, x: a + x).alias("total"), F.array_max(vectors.quantised(F.col("v"))).alias("top")),
    "vector_neighbours": vectors.neighbours,
    "vector_within": lambda s, d: vectors.neighbours_within(s, d, 0.5, 50),
    "vector_rotation": vectors.rotation,
    "label_precision": vectors.label_precision,
    "short_recall": vectors.short_recall,
    "chunks": lambda s, d: vectors.chunks(s, d).withColumnRenamed("key", "vrow"),
    "chunk_texts": vectors.piece_texts,
    "chunks_pending": vectors.pending,
    "chunks_embedded": vectors.embedded,
    "segments": exchange.segments,
    "segment_gaps": exchange.gaps_of_odd,
    "import_again": exchange.import_again,
    "tombstones": exchange.tombstones,
    "exported_rows": lambda s, d: exchange.exported_rows(s, d, LO, HI),
    "relevant_texts": evaluation.relevant,
    "scores": evaluation.scores,
    "score_summary": evaluation.summary,
    "threshold_sweep": evaluation.threshold_sweep,
    "title_errors": evaluation.title_errors,
}

KNN = """e as (select vec_id as id, embedding::double[] as v, label from embeddings), q as (select * from e where id % 100 = 0),
    p as (select q.id as q, e.id, round(1 - list_cosine_similarity(q.v, e.v), 9) as distance, q.label as own, e.label from q, e),
    n as (select *, row_number() over (partition by q order by distance, id) as rank from p)"""
OBS = "obs as (select distinct * from observations)"
SEG = f"{OBS}, r as (select device_id, id, deleted_at, row_number() over (partition by device_id order by id) as k from obs where origin_device is null and id > 0), seg as (select device_id, (k - 1) // 2000 + 1 as seq, min(id) as lo, max(id) as hi, count(*) as observations, count(deleted_at) as deleted from r group by 1, 2)"
IDS = f"{OBS}, i as (select coalesce(origin_device, device_id) as device, coalesce(origin_id, id) as id, device_id, id as local_id, deleted_at from obs)"
ASKED = "asked(query) as (values " + ", ".join(f"('{q}')" for q in evaluation.QUERIES) + ")"

SQL = {
    "vector_quantised": "with e as (select vec_id as id, embedding::double[] as v from embeddings), m as (select *, list_max(list_transform(v, lambda x: abs(x))) as top from e), z as (select id, list_transform(v, lambda x: case when top > 0 then round(x * (127 / top)) else 0 end) as z from m) select id, list_sum(z)::int as total, list_max(z)::int as top from z",
    "vector_truncated": "with h as (select vec_id as id, list_slice(embedding::double[], 1, 16) as h from embeddings) select id, round(list_sum(h) / sqrt(list_sum(list_transform(h, lambda x: x * x))), 5) as x, len(h) as n from h",
    "vector_neighbours": f"with {KNN} select q, id, distance, rank from n where rank <= 10",
    "vector_within": f"with {KNN} select q, id, distance, rank from n where rank <= 50 and distance <= 0.5",
    "vector_rotation": f"with {KNN} select q, id, label, rank, row_number() over (partition by q, label order by rank) as round from n where rank <= 50",
    "label_precision": f"with {KNN} select own, round(avg((own = label)::int), 6) as precision, count(*) as pairs from n where rank <= 10 and q <> id group by 1",
    "chunks_pending": "select model, count(*) as chunks, count(*) filter (embedded_at is null) as pending from chunks group by 1",
    "segments": f"with {SEG} select * from seg",
    "segment_gaps": f"with {SEG}, have as (select device_id, seq from seg where seq % 3 <> 0), e as (select device_id, min(seq) filter (not exists (select 1 from have b where b.device_id = a.device_id and b.seq = a.seq + 1)) as run, min(seq) as first, max(seq) as last, count(*) as n from have a group by 1) select device_id, case when first = 1 then run else 0 end as upto, last - n as missing from e",
    "import_again": f"with {IDS}, new as (select distinct device, id from i where device = device_id and (device, id) not in (select (device, id) from i where device <> device_id)) select count(*) as new, 0 as again from new",
    "tombstones": f"with {IDS}, dead as (select distinct device, id from i where deleted_at is not null) select device, id, device_id, local_id from i where device <> device_id and deleted_at is null and (device, id) in (select (device, id) from dead)",
    "exported_rows": f"with {OBS} select ts // 86400000 as day, count(*) as rows from obs where ts >= {LO} and ts < {HI} and deleted_at is null group by 1",
    "relevant_texts": f"with {ASKED} select query, vrow from text_versions, asked where contains(lower(text), query)",
    "threshold_sweep": f"with {KNN}, t(threshold) as (values (0.2::double), (0.4), (0.6), (0.8), (1.0)), h as (select * from n where rank <= 50 and q <> id) select threshold, count(q) as pairs, round(avg((own = label)::int), 6) as precision from t left join h on distance <= threshold group by 1",
    "title_errors": "select id, round(levenshtein(title, replace(title, '0', 'O')) / nullif(length(title), 0), 6) as cer from windows where title is not null",
}
