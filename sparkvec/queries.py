"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkvec import rag
from sparkvec.functions import text as texts
from sparkvec.functions.distance import distance, norm, similarity
from sparkvec.operators import flat, hnsw, ivf
from sparkvec.operators import ring as rings
from sparkvec.plans.collection import Collection, duplicate_ids, invalid_dims
from sparkvec.plans.config import CollectionConfig
from sparkvec.plans.filters import compile_filter
from sparkvec.sources import files, oplog, snapshot
from sparkvec.sources.catalog import Catalog

NODES = ("node1", "node2", "node3")
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Inputs.  The stored vectors have unit norm, under which all metrics rank alike; scaled ones tell them apart.


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: (x * (1 + F.col("vec_id") % 7)).cast("float"))
    return read(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("embedding"), "label")


_VECTORS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(CAST(x AS FLOAT) * (1 + vec_id % 7) AS FLOAT)::DOUBLE) AS e FROM embeddings)"
_DISTANCE = {
    "l2": "list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
    "ip": "-list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))",
    "cosine": """CASE WHEN list_sum(list_transform(a.e, lambda x: x * x)) * list_sum(list_transform(b.e, lambda x: x * x)) > 0
        THEN 1 - list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))
             / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x)))) ELSE 1 END""",
}


def vector_of(rows, vec_id):
    """One stored vector, as a query."""
    return list(rows.where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def rounded(df, column="distance"):
    return df.withColumn(column, F.round(column, 6) + F.lit(0.0))


def _top(metric, k=10, where="true", qid=3, more=""):
    return f"""WITH {_VECTORS}, s AS (SELECT a.vec_id, {_DISTANCE[metric]} AS d{more} FROM v a, (SELECT e FROM v WHERE vec_id = {qid}) b WHERE {where})
        SELECT vec_id, round(d, 6) + 0 AS distance{more.replace('a.', '')} FROM s ORDER BY d, vec_id LIMIT {k}"""


# Distances and exact search


@query(_top("l2"))
def flat_l2_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return rounded(flat.search(rows, vector_of(rows, 3), 10, "l2"))


@query(_top("cosine"))
def flat_cosine_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return rounded(flat.search(rows, vector_of(rows, 3), 10, "cosine"))


@query(_top("ip"))
def flat_ip_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return rounded(flat.search(rows, vector_of(rows, 3), 10, "ip"))


@query(f"WITH {_VECTORS} SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm FROM v")
def vector_norm(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


@query(f"""WITH {_VECTORS} SELECT a.vec_id, round({_DISTANCE['l2']}, 6) + 0 AS l2, round({_DISTANCE['ip']}, 6) + 0 AS ip,
    round({_DISTANCE['cosine']}, 6) + 0 AS cosine FROM v a, (SELECT e FROM v WHERE vec_id = 3) b""")
def pairwise_matrix(spark, sf_dir):
    """One query against every stored vector, under each metric."""
    rows = vectors(spark, sf_dir)
    q = F.array(*[F.lit(float(x)) for x in vector_of(rows, 3)])
    return rows.select("vec_id", *[(F.round(distance(m, F.col("embedding"), q), 6) + F.lit(0.0)).alias(m) for m in ("l2", "ip", "cosine")])


_BATCH = f"""WITH {_VECTORS}, s AS (SELECT b.vec_id AS qid, a.vec_id, {_DISTANCE['l2']} AS d FROM v a, v b WHERE b.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM s)"""


def _asked(rows):
    """The queries of a batch: every row whose id is divisible by 20."""
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@query(_BATCH + " SELECT qid, vec_id, round(d, 6) + 0 AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def batch_knn(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return rounded(flat.batch_search(rows, _asked(rows), 10))


# Filters and candidates


@query(_top("l2", where="label = 3"))
def flat_filtered_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("metadata", F.parse_json(F.to_json(F.struct("label"))))
    return rounded(flat.search(rows, vector_of(rows, 3), 10, where=compile_filter({"label": 3})))


def _events(spark, sf_dir):
    merged = F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","props":'), F.col("props"), F.lit("}"))
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.parse_json("props").alias("props"), F.parse_json(merged).alias("metadata"))


@query("""SELECT event_id FROM events WHERE event_type = 'click' AND CAST(json_extract(props, '$.k') AS VARCHAR) = '87'""")
def filter_multi_key(spark, sf_dir):
    return _events(spark, sf_dir).where(compile_filter({"type": "click", "props": {"k": 87}})).select("event_id")


@query("""SELECT event_type, count(*) FILTER (json_extract(props, '$.absent') IS NULL) AS n_absent, count(*) FILTER (json_extract(props, '$.k') IS NULL) AS n_no_k
    FROM events GROUP BY event_type""")
def filter_missing_is_null(spark, sf_dir):
    rows = _events(spark, sf_dir)
    absent = compile_filter({"absent": None}, F.col("props"))
    return rows.groupBy("event_type").agg(F.count_if(absent).alias("n_absent"), F.count_if(compile_filter({"k": None}, F.col("props"))).alias("n_no_k"))


@query(_top("l2", where="a.vec_id % 5 = 0"))
def candidate_ids_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    wanted = rows.where("vec_id % 5 = 0").select("vec_id")
    return rounded(flat.search(rows, vector_of(rows, 3), 10, candidates=wanted))


@query("SELECT vec_id AS qid, 10 AS hits, 0 AS deleted FROM embeddings WHERE vec_id % 20 = 0")
def tombstone_antijoin(spark, sf_dir):
    """A graph with a third of its rows deleted: every query still gets ten, none of them deleted."""
    rows = vectors(spark, sf_dir)
    index = hnsw.build(rows, M=16, ef_construction=64, ef_search=10).kept(files.scratch(spark)).remove(rows.where("vec_id % 3 = 0").select("vec_id"))
    found = index.batch_search(_asked(rows), 10)
    return found.groupBy("qid").agg(F.count(F.lit(1)).cast("int").alias("hits"), F.count_if(F.col("vec_id") % 3 == 0).cast("int").alias("deleted"))


def _collection(spark, data_dir=None, **config):
    return Collection(spark, CollectionConfig(**{"dim": 64, "enable_wal": True, **config}), data_dir or files.scratch(spark))


def _labelled(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", "embedding", F.to_json(F.struct("label")).alias("metadata"))


@query("SELECT label, count(*) AS num_items FROM embeddings WHERE vec_id % 4 <> 1 GROUP BY label")
def delete_antijoin(spark, sf_dir):
    """Rows in bulk into a collection, then out of it."""
    held, rows = _collection(spark), _labelled(spark, sf_dir)
    held.insert_rows(rows)
    held.delete_rows(rows.where("vec_id % 4 = 1").select("vec_id"))
    return held.table().groupBy(F.variant_get("metadata", "$.label", "int").alias("label")).agg(F.count(F.lit(1)).alias("num_items"))


@query(_top("l2", more=", a.label"))
def topk_with_metadata(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return rounded(flat.search(rows, vector_of(rows, 3), 10).join(rows.select("vec_id", "label"), "vec_id"))


@query(f"""WITH {_VECTORS} SELECT a.vec_id, round(1 - ({_DISTANCE['cosine']}), 6) AS similarity FROM v a, (SELECT e FROM v WHERE vec_id = 3) b
    WHERE 1 - ({_DISTANCE['cosine']}) > 0.1""")
def similarity_threshold(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    asked = rows.where("vec_id = 3").select(F.col("embedding").alias("q"))
    found = rows.crossJoin(F.broadcast(asked)).withColumn("similarity", similarity(distance("cosine", F.col("embedding"), F.col("q"))))
    return found.where("similarity > 0.1").select("vec_id", F.round("similarity", 6).alias("similarity"))


# Lookup, validation, statistics


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) + 0 AS total FROM embeddings WHERE vec_id = 42")
def get_by_id(spark, sf_dir):
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
    return read(spark, sf_dir, "embeddings").where("vec_id = 42").select("vec_id", "label", (F.round(total, 6) + F.lit(0.0)).alias("total"))


@query("SELECT vec_id, CAST(len(embedding[1 : 64 - (vec_id % 10 = 0)::INT]) AS INT) AS dim FROM embeddings WHERE vec_id % 10 = 0")
def validate_dim(spark, sf_dir):
    cut = read(spark, sf_dir, "embeddings").withColumn("embedding", F.slice("embedding", F.lit(1), F.lit(64) - (F.col("vec_id") % 10 == 0).cast("int")))
    return invalid_dims(cut, 64).select("vec_id", F.size("embedding").alias("dim"))


@query("SELECT DISTINCT vec_id FROM (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT 1000000 + vec_id // 2 FROM embeddings WHERE vec_id < 10)")
def duplicate_ids_query(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    new = rows.where("vec_id % 50 = 0").select("vec_id").union(rows.where("vec_id < 10").selectExpr("1000000 + vec_id div 2"))
    return duplicate_ids(new, rows)


@query("SELECT 64 AS dim, 'cosine' AS metric, 'flat' AS index_type, count(*) AS num_items, true AS wal_enabled FROM embeddings")
def collection_stats(spark, sf_dir):
    held = _collection(spark, metric="cosine")
    held.insert_rows(_labelled(spark, sf_dir))
    told = held.stats()
    return spark.createDataFrame([tuple(told[k] for k in ("dim", "metric", "index_type", "num_items", "wal_enabled"))], "dim int, metric string, index_type string, num_items long, wal_enabled boolean")


@query("""SELECT 'part' || (vec_id % 3) AS name, 64 AS dim, CASE vec_id % 3 WHEN 0 THEN 'l2' WHEN 1 THEN 'cosine' ELSE 'ip' END AS metric, count(*) AS num_items
    FROM embeddings GROUP BY vec_id % 3""")
def list_collections(spark, sf_dir):
    """Three collections of a catalog, listed by another one opened over its files."""
    top, rows = files.scratch(spark), _labelled(spark, sf_dir)
    first = Catalog(spark, top)
    for i, metric in enumerate(("l2", "cosine", "ip")):
        first.create(f"part{i}", CollectionConfig(64, metric, enable_wal=True)).insert_rows(rows.where(F.col("vec_id") % 3 == i))
    listed = [(c["name"], c["dim"], c["metric"], c["num_items"]) for c in Catalog(spark, top).list()]
    return spark.createDataFrame(listed, "name string, dim int, metric string, num_items long")


# Inverted file


#: The model of the queries: eight buckets, three probed, two steps of k-means.
_IVF = ivf.IVF(nlist=8, nprobe=3, seed=42, max_iter=2)


def _step(n, means, before):
    """SQL of one step: rows to their nearest centroid, centroids to the mean of their rows."""
    return f"""n{n} AS MATERIALIZED (SELECT vec_id, bucket_id FROM (SELECT a.vec_id, b.bucket_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DISTANCE['l2']}, b.bucket_id) AS n FROM v a, {before} b) WHERE n = 1),
    x{n} AS (SELECT bucket_id, unnest(e) AS x, unnest(range(0, 64)) AS pos FROM n{n} JOIN v USING (vec_id)),
    m{n} AS (SELECT bucket_id, list(x ORDER BY pos) AS e FROM (SELECT bucket_id, pos, avg(x) AS x FROM x{n} GROUP BY bucket_id, pos) GROUP BY bucket_id),
    {means} AS MATERIALIZED (SELECT c.bucket_id, coalesce(m{n}.e, c.e) AS e FROM {before} c LEFT JOIN m{n} USING (bucket_id))"""


_ASSIGNED = f"""{_VECTORS}, seeds AS (SELECT vec_id, e FROM v ORDER BY md5('42:' || vec_id), vec_id LIMIT 8),
    c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INT) AS bucket_id, e FROM seeds),
    {_step(0, 'c1', 'c0')}, {_step(1, 'c', 'c1')},
    near AS (SELECT a.vec_id, b.bucket_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DISTANCE['l2']}, b.bucket_id) AS n FROM v a, c b),
    assigned AS MATERIALIZED (SELECT vec_id, bucket_id FROM near WHERE n = 1)"""


def _model(rows):
    return _IVF.fit(rows)


@query(f"WITH {_ASSIGNED} SELECT vec_id, bucket_id FROM assigned")
def ivf_assign(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return _model(rows).transform(rows).select("vec_id", "bucket_id")


@query(f"WITH {_ASSIGNED} SELECT bucket_id, CAST(unnest(range(0, 64)) AS INT) AS pos, round(unnest(e), 6) + 0 AS x FROM c")
def ivf_lloyd_step(spark, sf_dir):
    """The trained centroids."""
    model = _model(vectors(spark, sf_dir))
    out = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.centroids)], "bucket_id int, c array<double>")
    return rounded(out.select("bucket_id", F.posexplode("c").alias("pos", "x")), "x")


@query(f"""WITH {_ASSIGNED}, d AS (SELECT a.bucket_id, {_DISTANCE['l2']} AS d FROM c a, (SELECT e FROM v WHERE vec_id = 30) b)
    SELECT bucket_id FROM d ORDER BY d, bucket_id LIMIT 3""")
def ivf_probe_buckets(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return spark.createDataFrame([(b,) for b in _model(rows).probes(vector_of(rows, 30))], "bucket_id int")


def _bucketed(rows):
    """A model and the rows as written by bucket, of which a search reads the probed folders."""
    model = _model(rows)
    return model, model.write(rows, files.scratch(rows.sparkSession))


def _ivf_top(where):
    return f"""WITH {_ASSIGNED}, q AS (SELECT e FROM v WHERE vec_id = 30),
    p AS (SELECT a.bucket_id FROM c a, q b ORDER BY {_DISTANCE['l2']}, a.bucket_id LIMIT 3),
    s AS (SELECT a.vec_id, {_DISTANCE['l2']} AS d FROM v a JOIN assigned USING (vec_id) JOIN p USING (bucket_id), q b WHERE {where})
    SELECT vec_id, round(d, 6) + 0 AS distance FROM s ORDER BY d, vec_id LIMIT 10"""


@query(_ivf_top("true"))
def ivf_l2_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    model, held = _bucketed(rows)
    return rounded(model.search(held, vector_of(rows, 30), 10))


@query(_ivf_top("label = 3"))
def ivf_filtered_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    model, held = _bucketed(rows)
    return rounded(model.search(held, vector_of(rows, 30), 10, where=F.col("label") == 3))


@query(f"""WITH {_ASSIGNED}, pr AS (SELECT b.vec_id AS qid, a.bucket_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_DISTANCE['l2']}, a.bucket_id) AS n FROM c a, v b WHERE b.vec_id % 20 = 0),
    s AS (SELECT qid, a.vec_id, {_DISTANCE['l2']} AS d FROM v a JOIN assigned USING (vec_id) JOIN pr USING (bucket_id) JOIN v b ON b.vec_id = qid WHERE n <= 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM s)
    SELECT qid, vec_id, round(d, 6) + 0 AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def ivf_batch_knn(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    model, held = _bucketed(rows)
    return rounded(model.batch_search(held, _asked(rows), 10))


# Operation log: events as operations


def _ops(spark, sf_dir):
    op = F.when(F.col("event_type") == "error", "delete").otherwise("insert")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("vec_id"), F.array(F.col("value").cast("float")).alias("embedding"), F.col("props").alias("metadata"))


_OPS = "ops AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'insert' END AS op, user_id AS vec_id, CAST(value AS FLOAT) AS x, props FROM events)"
_LIVE = "SELECT vec_id, round(arg_max(x, seq)::DOUBLE, 4) AS x, arg_max(props, seq) AS metadata FROM {} GROUP BY vec_id HAVING arg_max(op, seq) = 'insert'"


def _live(ops):
    return oplog.latest(ops).select("vec_id", F.round(F.col("embedding")[0].cast("double"), 4).alias("x"), "metadata")


@query(f"WITH {_OPS} {_LIVE.format('ops')}")
def oplog_replay_lww(spark, sf_dir):
    return _live(_ops(spark, sf_dir))


@query(f"""WITH {_OPS}, l AS (SELECT *, lag(op) OVER (PARTITION BY vec_id ORDER BY seq) AS before FROM ops)
    SELECT seq, vec_id FROM l WHERE op = 'insert' AND before = 'insert'""")
def oplog_conflicts(spark, sf_dir):
    return oplog.conflicts(_ops(spark, sf_dir))


@query(f"WITH {_OPS}, late AS (SELECT * FROM ops WHERE seq >= 500) {_LIVE.format('late')}")
def oplog_offset_replay(spark, sf_dir):
    return _live(_ops(spark, sf_dir).where("seq >= 500"))


@query("SELECT event_id AS seq, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id < 700 AND event_id % 9 <> 4")
def oplog_corrupt_tail(spark, sf_dir):
    line = F.when(F.col("event_id") == 700, "{torn").when(F.col("event_id") % 9 == 4, " ").otherwise(F.col("props"))
    lines = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), line.alias("value"))
    return oplog.valid_prefix(lines).select("seq", F.try_variant_get("parsed", "$.k", "long").alias("k"))


def _log(spark, sf_dir, parts=4):
    """A log of the events, committed in order of their ids: a segment a quarter."""
    log, ops = oplog.OpLog(spark, files.scratch(spark)), _ops(spark, sf_dir)
    first, last = ops.agg(F.min("seq"), F.max("seq")).first()
    cuts = [first + (last + 1 - first) * i // parts for i in range(parts + 1)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        some = ops.where((F.col("seq") >= a) & (F.col("seq") < b))
        log.append(some.drop("seq"), some.count())
    return log


@query("SELECT count(*) - 300 AS kept, 300 AS first, 0 AS repeated FROM events")
def oplog_truncate(spark, sf_dir):
    """What a truncated log gives: gapless numbers from the offset on."""
    log = _log(spark, sf_dir)
    log.truncate(300)
    left = log.read()
    return left.agg(F.count(F.lit(1)).alias("kept"), F.min("seq").cast("int").alias("first"), (F.count("seq") - F.count_distinct("seq")).cast("int").alias("repeated"))


@query("""SELECT CASE WHEN event_type = 'error' THEN 'delete' ELSE 'insert' END AS op, count(*) AS n, count(DISTINCT user_id) AS ids, (SELECT count(*) FROM events) AS lines
    FROM events GROUP BY 1""")
def oplog_stats(spark, sf_dir):
    log = _log(spark, sf_dir)
    return log.read().groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("ids")).withColumn("lines", F.lit(log.count()).cast("long"))


@query(f"""WITH {_VECTORS} SELECT vec_id, CAST(label AS INT) AS label, round(list_sum(e) * CASE WHEN vec_id % 7 = 2 THEN 2 ELSE 1 END, 4) + 0 AS total FROM v WHERE vec_id % 5 <> 1 OR vec_id % 7 = 2""")
def recover_snapshot_plus_log(spark, sf_dir):
    """A collection that is written, checkpointed, changed, and opened again from its files."""
    top, rows = files.scratch(spark), _labelled(spark, sf_dir)
    first = _collection(spark, top)
    first.insert_rows(rows)
    first.checkpoint()
    first.delete_rows(rows.where("vec_id % 5 = 1 or vec_id % 7 = 2").select("vec_id"))
    first.insert_rows(rows.where("vec_id % 7 = 2").withColumn("embedding", F.transform("embedding", lambda x: x * 2)))
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
    return _collection(spark, top).table().select("vec_id", F.variant_get("metadata", "$.label", "int").alias("label"), (F.round(total, 4) + F.lit(0.0)).alias("total"))


@query(f"WITH {_VECTORS} SELECT vec_id, label, round(list_sum(e), 4) + 0 AS total, 17 AS at, 'cosine' AS metric FROM v")
def snapshot_roundtrip(spark, sf_dir):
    """A snapshot written as a second version over an older one, and read again."""
    path, rows = files.scratch(spark), _labelled(spark, sf_dir)
    snapshot.save(rows.limit(1), path, CollectionConfig(64))
    snapshot.save(rows, path, CollectionConfig(64, "cosine"), 17)
    config, held, at = snapshot.load(spark, path)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
    return held.select("vec_id", F.variant_get(F.parse_json("metadata"), "$.label", "int").alias("label"), (F.round(total, 4) + F.lit(0.0)).alias("total"), F.lit(at).alias("at"), F.lit(config.metric).alias("metric"))


# Ring and shards


def _ring_sql(nodes, name="ring"):
    listed = ", ".join(f"'{n}'" for n in nodes)
    return f"{name} AS (SELECT md5(node || ':' || i) AS h, node FROM (SELECT unnest([{listed}]) AS node), range(160) t(i))"


_OWNER = """{keys} AS (SELECT k.vec_id, coalesce(min(CASE WHEN r.h > k.kh THEN r.h END), min(r.h)) AS h
    FROM (SELECT vec_id, md5(CAST(vec_id AS VARCHAR)) AS kh FROM embeddings) k, {ring} r GROUP BY k.vec_id)"""


@query(f"WITH {_ring_sql(NODES)} SELECT h, node FROM ring")
def ring_build(spark, sf_dir):
    return rings.build(spark, NODES)


@query(f"WITH {_ring_sql(NODES)}, {_OWNER.format(keys='o', ring='ring')} SELECT vec_id, node FROM o JOIN ring USING (h)")
def ring_owner(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", rings.owner(rings.build(spark, NODES), F.col("vec_id")).alias("node"))


@query(f"""WITH {_ring_sql(NODES)}, p AS (SELECT CAST(vec_id AS VARCHAR) AS key, node, min(CASE WHEN h > md5(CAST(vec_id AS VARCHAR)) THEN '0' || h ELSE '1' || h END) AS pos
    FROM embeddings, ring GROUP BY vec_id, node)
    SELECT key, CAST(rank AS INT) AS rank, node FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS rank FROM p) WHERE rank <= 2""")
def ring_replicas(spark, sf_dir):
    return rings.replicas(rings.build(spark, NODES), read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key")), 2)


@query(f"""WITH {_ring_sql(NODES)}, b AS (SELECT md5('key_1') AS a, md5('key_2') AS z)
    SELECT DISTINCT node FROM ring, b WHERE CASE WHEN a <= z THEN h >= a AND h < z ELSE h >= a OR h < z END""")
def ring_range_nodes(spark, sf_dir):
    return rings.range_nodes(rings.build(spark, NODES), "key_1", "key_2")


@query(f"""WITH {_ring_sql(NODES)}, {_ring_sql((*NODES, 'node4'), 'grown')}, {_OWNER.format(keys='o', ring='ring')}, {_OWNER.format(keys='n', ring='grown')}
    SELECT CAST(o.vec_id AS VARCHAR) AS key, r.node AS old_node, g.node AS new_node
    FROM o JOIN n USING (vec_id) JOIN ring r ON r.h = o.h JOIN grown g ON g.h = n.h WHERE r.node <> g.node""")
def ring_rebalance(spark, sf_dir):
    keys = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"))
    return rings.moved(rings.build(spark, NODES), rings.build(spark, (*NODES, "node4")), keys)


_SHARDED = f"WITH {_ring_sql(NODES)}, {_OWNER.format(keys='o', ring='ring')}, sharded AS (SELECT vec_id, node AS shard FROM o JOIN ring USING (h))"


def _sharded(spark, sf_dir):
    return vectors(spark, sf_dir).withColumn("shard", rings.owner(rings.build(spark, NODES), F.col("vec_id")))


@query(_SHARDED + " SELECT shard, count(*) AS num_items FROM sharded GROUP BY shard")
def shard_distribution(spark, sf_dir):
    return _sharded(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("num_items"))


@query(_SHARDED + f""", {_VECTORS}, s AS (SELECT a.vec_id, {_DISTANCE['l2']} AS d, shard FROM v a JOIN sharded USING (vec_id), (SELECT e FROM v WHERE vec_id = 3) b)
    SELECT vec_id, round(d, 6) + 0 AS distance, shard FROM s ORDER BY d, vec_id LIMIT 10""")
def shard_scatter_gather(spark, sf_dir):
    rows = _sharded(spark, sf_dir)
    q = F.array(*[F.lit(float(x)) for x in vector_of(rows, 3)])
    return rounded(rings.shard_search(rows, distance("l2", F.col("embedding"), q), 10))


@query(_SHARDED + " SELECT shard, count(*) AS num_items FROM sharded GROUP BY ROLLUP (shard)")
def shard_stats_rollup(spark, sf_dir):
    return rings.shard_stats(_sharded(spark, sf_dir))


# Text and retrieval


@query("""SELECT doc_id, CAST(i AS INT) AS chunk_idx, substring(text, CAST(i * 250 + 1 AS BIGINT), 300) AS chunk
    FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 250.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)""")
def chunk_text(spark, sf_dir):
    return texts.chunks(read(spark, sf_dir, "documents"), 300, 50).select("doc_id", "chunk_idx", "chunk")


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview FROM documents")
def chunk_preview(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", texts.preview(F.col("text")).alias("preview"))


#: Questions are the first chunks of documents, so the nearest chunk is the question itself.
_QUESTIONS = "q AS (SELECT doc_id AS qid, substring(text, 1, 300) AS question FROM documents WHERE doc_id % 20 = 0 AND lang = 'en' AND length(text) > 0)"


def _store(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumnRenamed("lang", "category")
    questions = texts.chunks(docs.where("doc_id % 20 = 0 and category = 'en'"), 300, 50).where("chunk_idx = 0")
    return rag.ingest(docs), questions.select(F.col("doc_id").alias("qid"), F.col("chunk").alias("question"))


@query(f"WITH {_QUESTIONS} SELECT qid, 1 AS rank, 1.0::DOUBLE AS similarity, question AS chunk, CASE WHEN length(question) > 100 THEN substring(question, 1, 100) || '...' ELSE question END AS preview, 'en' AS category FROM q")
def rag_retrieve(spark, sf_dir):
    """Documents chunked, embedded and searched by category; what is least similar is left out."""
    store, questions = _store(spark, sf_dir)
    found = rag.retrieve(store, questions, top_k=1, category="en", least=0.9)
    return found.select("qid", "rank", F.round("similarity", 5).alias("similarity"), "chunk", "preview", "category")


#: The hash embedder in SQL, over rows (chunk, ...): text, 64 numbers of 16 bits, their unit vector.
_EMBEDDED = """SELECT *, list_transform(u, lambda x: CAST(x / size AS FLOAT)::DOUBLE)::DOUBLE[64] AS e FROM (SELECT *, sqrt(list_sum(list_transform(u, lambda x: x * x))) AS size
    FROM (SELECT *, list_transform(range(0, 64), lambda i: CAST('0x' || substring(drawn, CAST(4 * i + 1 AS BIGINT), 4) AS INT)::DOUBLE - 32767.5) AS u
    FROM (SELECT *, sha256(md5(chunk) || ':0') || sha256(md5(chunk) || ':1') || sha256(md5(chunk) || ':2') || sha256(md5(chunk) || ':3') AS drawn FROM {})))"""


@query(f"""WITH {_QUESTIONS}, pieces AS (SELECT substring(text, CAST(i * 250 + 1 AS BIGINT), 300) AS chunk
        FROM (SELECT text, unnest(range(0, CAST(ceil(length(text) / 250.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0 AND lang = 'en')),
    c AS MATERIALIZED (SELECT chunk, n, e FROM ({_EMBEDDED.format('(SELECT chunk, count(*) AS n FROM pieces GROUP BY chunk)')})),
    b AS MATERIALIZED (SELECT qid, e FROM ({_EMBEDDED.format('(SELECT qid, question AS chunk FROM q)')})),
    s AS (SELECT b.qid, c.chunk, c.n, array_cosine_similarity(b.e, c.e) AS s FROM b, c),
    t AS (SELECT qid, unnest(arg_max(struct_pack(chunk := chunk, n := n, s := s), s, 3)) AS t FROM s GROUP BY qid),
    x AS (SELECT qid, t.chunk AS chunk, t.s AS s, unnest(range(0, least(t.n, 3))) FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, chunk) AS rank FROM x)
    SELECT qid, string_agg('[' || rank || '] ' || chunk, chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 3 GROUP BY qid""")
def rag_context(spark, sf_dir):
    """The three passages nearest to each question, copies of a passage in their places."""
    store, questions = _store(spark, sf_dir)
    return rag.answer(store, questions, category="en").select("qid", "context")


@query(f"""WITH {_QUESTIONS} SELECT qid, 'Answer from the context.' || chr(10) || chr(10) || 'Context:' || chr(10) || '[1] ' || question || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:' AS prompt FROM q""")
def rag_prompt(spark, sf_dir):
    store, questions = _store(spark, sf_dir)
    return rag.answer(store, questions, top_k=1, category="en").select("qid", "prompt")


@query(f"""WITH {_ASSIGNED}, pr AS (SELECT b.vec_id AS qid, a.bucket_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_DISTANCE['l2']}, a.bucket_id) AS n FROM c a, v b WHERE b.vec_id % 20 = 0),
    s AS (SELECT b.vec_id AS qid, a.vec_id, {_DISTANCE['l2']} AS d FROM v a, v b WHERE b.vec_id % 20 = 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM s),
    i AS (SELECT s.*, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM s JOIN assigned USING (vec_id) JOIN pr USING (qid, bucket_id) WHERE n <= 3)
    SELECT round(count(i.vec_id) / (10.0 * count(DISTINCT t.qid)), 6) AS recall FROM t LEFT JOIN i ON i.qid = t.qid AND i.vec_id = t.vec_id AND i.rank <= 10 WHERE t.rank <= 10""")
def recall_at_k(spark, sf_dir):
    return rounded(flat.recall_at_k(batch_knn(spark, sf_dir), ivf_batch_knn(spark, sf_dir), 10), "recall")


@query("SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 20 = 0")
def hnsw_l2_topk(spark, sf_dir):
    """Recall of a kept graph against exact search of all rows: at least 0.9."""
    rows = vectors(spark, sf_dir)
    index = hnsw.build(rows, M=16, ef_construction=64).kept(files.scratch(spark))
    found = index.batch_search(_asked(rows), 10)
    recall = flat.recall_at_k(batch_knn(spark, sf_dir), found, 10)
    return recall.select(F.lit(_asked(rows).count()).cast("long").alias("queries"), (F.col("recall") >= 0.9).alias("reached"))


@query("SELECT doc_id, 64 AS dim, 1.0::DOUBLE AS norm, count(*) OVER (PARTITION BY coalesce(text, '')) AS alike FROM documents")
def hash_embed(spark, sf_dir):
    """Unit vectors, the same for the same text and for no other."""
    embed = texts.embedders.get("hash", 64)
    rows = read(spark, sf_dir, "documents").select("doc_id", embed(F.col("text")).alias("embedding"))
    rows = rows.select("doc_id", F.size("embedding").alias("dim"), F.round(norm(F.col("embedding")), 5).alias("norm"), F.xxhash64("embedding").alias("key"))
    return rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("alike")), "key").drop("key")
