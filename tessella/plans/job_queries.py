"""Composed jobs: from source records to training and evaluation data, exports and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.choice import pick
from ..operators import annotate as A
from ..operators import conversation as C
from ..operators import packing as P
from ..operators import relational as L
from ..operators import sampling as S
from ..session import ensure_checkpoint_dir, table
from ..sources import mixture as M
from ..sources import readers, writers
from ..streaming import incremental
from .conversation_queries import convs
from .registry import CONVS, Registry, h_sql

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql

_USABLE = "trim(coalesce(sentence, '')) <> '' AND trim(coalesce(left_url, '')) <> '' AND trim(coalesce(right_url, '')) <> ''"


def _usable(d):
    full = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return d.where(full("sentence") & full("left_url") & full("right_url"))


@R.query("job_statement_true_false", f"SELECT row_id, left_url || ' ' || right_url AS images, '<image> <image> ' || sentence || ' True or False?' AS question, label AS answer FROM seed_demos WHERE {_USABLE} AND label IS NOT NULL")
def job_statement_true_false(spark, root):
    d = _usable(table(spark, root, "seed_demos")).where(F.col("label").isNotNull())
    t = C.qa_turns(F.concat(F.lit("<image> <image> "), "sentence", F.lit(" True or False?")), F.col("label"))
    return d.select("row_id", F.concat_ws(" ", "left_url", "right_url").alias("images"), F.get(t, F.lit(0))["text"].alias("question"), F.get(t, F.lit(1))["text"].alias("answer"))


@R.query("job_statement_difference", f"SELECT row_id, ['What differs between the images?', 'Describe the difference.', 'Compare the two images.'][{h_sql('difference', 'row_id')} % 3 + 1] AS question, sentence AS answer FROM seed_demos WHERE {_USABLE} AND label = 'True'")
def job_statement_difference(spark, root):
    pool = ["What differs between the images?", "Describe the difference.", "Compare the two images."]
    d = _usable(table(spark, root, "seed_demos")).where(F.col("label") == "True")
    return d.select("row_id", S.template_choice(pool, "difference", F.col("row_id")).alias("question"), F.col("sentence").alias("answer"))


@R.query(
    "job_statement_mcq",
    f"""WITH o AS (SELECT row_id, sentence, label, ['True', 'False'] AS options, unnest([0, 1]) AS i FROM seed_demos WHERE {_USABLE} AND label IN ('True', 'False')),
    s AS (SELECT row_id, sentence, i, options[i + 1] AS o, options[i + 1] = label AS own, row_number() OVER (PARTITION BY row_id ORDER BY {h_sql('tf', "(row_id || ':' || i)")}, i) AS n FROM o)
    SELECT row_id, any_value(sentence) || chr(10) || string_agg('(' || chr((64 + n)::INTEGER) || ') ' || o, chr(10) ORDER BY n) AS question, max(CASE WHEN own THEN chr((64 + n)::INTEGER) END) AS answer FROM s GROUP BY row_id""",
)
def job_statement_mcq(spark, root):
    d = _usable(table(spark, root, "seed_demos")).where(F.col("label").isin("True", "False"))
    d = d.withColumn("options", F.array(F.lit("True"), F.lit("False"))).withColumn("answer", F.when(F.col("label") == "True", "A").otherwise("B"))
    p = S.option_permutation(d, "tf", "row_id", "options", "answer")
    return p.select("row_id", F.concat("sentence", F.lit("\n"), X.option_lines(F.col("options"))).alias("question"), "answer")


@R.query(
    "job_generated_answers",
    """WITH q AS (SELECT row_id, trim('Answer in one sentence.' || chr(10) || 'Statement: ' || sentence || chr(10) || 'Question: ' || question) AS p FROM seed_demos WHERE sentence IS NOT NULL AND question IS NOT NULL)
    SELECT row_id, 'answer ' || substr(sha256('writer-1' || chr(0) || p), 1, 12) AS completion FROM q""",
)
def job_generated_answers(spark, root):
    d = table(spark, root, "seed_demos").where(F.col("sentence").isNotNull() & F.col("question").isNotNull())
    prompt = X.filled("Answer in one sentence.\nStatement: ${s}\nQuestion: ${q}", s=F.col("sentence"), q=F.col("question"))
    return A.completions(d.withColumn("prompt", prompt), "prompt", "row_id", "writer-1").select("row_id", "completion")


@R.query(
    "job_quality_pairs",
    f"""WITH g AS (SELECT left_url, right_url, min(row_id) AS first, count(*) AS rows, string_agg(coalesce(replace(replace(question, 'left image', 'first image'), 'right image', 'second image'), '') || '|' || coalesce(response, ''), '||' ORDER BY row_id) AS t
      FROM seed_demos WHERE left_url IS NOT NULL AND right_url IS NOT NULL GROUP BY 1, 2)
    SELECT first, rows, CASE WHEN {h_sql('front', 'first')} % 2 = 0 THEN '<image><image>' || t ELSE t || '<image><image>' END AS text FROM g""",
)
def job_quality_pairs(spark, root):
    d = table(spark, root, "seed_demos").where(F.col("left_url").isNotNull() & F.col("right_url").isNotNull())
    q = F.replace(F.replace("question", F.lit("left image"), F.lit("first image")), F.lit("right image"), F.lit("second image"))
    turns = F.array(F.concat(F.coalesce(q, F.lit("")), F.lit("|"), F.coalesce("response", F.lit(""))))
    m = L.merged_by(d.select("row_id", F.array("left_url", "right_url").alias("images"), turns.alias("turns")), L.media_key(F.col("images")), "row_id")
    t = F.array_join("turns", "||")
    return m.select("first", "rows", F.when(pick("front", F.col("first"), 2) == 0, F.concat(F.lit("<image><image>"), t)).otherwise(F.concat(t, F.lit("<image><image>"))).alias("text"))


@R.query(
    "job_rating_regression",
    """SELECT row_id, CASE WHEN strpos(prompt, 'score from 1 to 4.') > 0 THEN trim(left(prompt, strpos(prompt, 'score from 1 to 4.') + 17)) ELSE prompt END AS prompt,
      labels['visual_quality'] AS visual_quality, labels['overall_score'] AS overall, len(images)::INTEGER AS frames FROM cls_training_example WHERE prompt IS NOT NULL AND images IS NOT NULL""",
)
def job_rating_regression(spark, root):
    d = table(spark, root, "cls_training_example").where(F.col("prompt").isNotNull() & F.col("images").isNotNull())
    marker = "score from 1 to 4."
    at = F.locate(marker, F.col("prompt"))
    cut = F.when(at > 0, F.trim(F.substring(F.col("prompt"), F.lit(1), at + len(marker) - 1))).otherwise(F.col("prompt"))
    v = C.label_vector(F.col("labels"), F.array(F.lit("visual_quality"), F.lit("overall_score")))
    return d.select("row_id", cut.alias("prompt"), F.get(v, F.lit(0)).alias("visual_quality"), F.get(v, F.lit(1)).alias("overall"), F.size("images").alias("frames"))


@R.query("job_frames_by_number", f"WITH {CONVS} SELECT row_id, array_to_string(list_transform(list_sort(list_transform(images, lambda p: {{'k': coalesce(try_cast(regexp_extract(p, '(\\d+)(?:\\.[A-Za-z0-9]+)?$', 1) AS INTEGER), -1), 'n': p}})), lambda s: s.n), ' ') AS frames FROM convs WHERE list_position(images, NULL) IS NULL AND len(images) > 0")
def job_frames_by_number(spark, root):
    c = convs(spark, root).where((F.size("images") > 0) & ~F.exists("images", lambda p: p.isNull()))
    return c.select("row_id", F.array_join(readers.by_number(F.col("images")), " ").alias("frames"))


@R.query(
    "job_video_placement",
    f"""WITH {CONVS} SELECT row_id, CASE WHEN t LIKE '%<video>%' THEN t WHEN {h_sql('video', 'row_id')} % 2 = 0 THEN '<video>' || t ELSE t || '<video>' END AS text FROM (SELECT row_id, trim(replace(turns[1].text, '<image>', '')) AS t FROM convs WHERE len(turns) > 0)""",
)
def job_video_placement(spark, root):
    c = convs(spark, root).where(F.size("turns") > 0).select("row_id", F.trim(F.replace(F.get("turns", F.lit(0))["text"], F.lit("<image>"), F.lit(""))).alias("t"))
    put = F.when(pick("video", F.col("row_id"), 2) == 0, F.concat(F.lit("<video>"), "t")).otherwise(F.concat("t", F.lit("<video>")))
    return c.select("row_id", F.when(F.col("t").contains("<video>"), F.col("t")).otherwise(put).alias("text"))


@R.query(
    "job_multi_image_merge",
    f"""WITH RECURSIVE {CONVS}, b AS MATERIALIZED (SELECT row_id, len(turns) AS t, {h_sql('bucket', 'row_id')} % 8 AS bucket, CASE WHEN {h_sql('merge:alone', 'row_id')} % 10 < 5 THEN 1 ELSE 2 + {h_sql('merge:len', 'row_id')} % 3 END AS l
      FROM convs WHERE len(images) > 0 AND len(turns) > 0 AND len(turns) % 2 = 0 AND list_bool_and(list_transform(turns, lambda t, i: coalesce(t.role = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END, false)))),
    r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY row_id) AS n FROM b),
    f AS (SELECT bucket, n, row_id, t, l - 1 AS s, 0 AS g FROM r WHERE n = 1 UNION ALL
      SELECT r.bucket, r.n, r.row_id, r.t, CASE WHEN f.s = 0 THEN r.l - 1 ELSE f.s - 1 END, CASE WHEN f.s = 0 THEN f.g + 1 ELSE f.g END FROM f JOIN r ON r.bucket = f.bucket AND r.n = f.n + 1)
    SELECT min(row_id) AS first, count(*) AS merged, sum(t)::INTEGER AS turns FROM f GROUP BY bucket, g""",
)
def job_multi_image_merge(spark, root):
    """Conversations with pictures in drawn runs: one conversation a run, question and answer pairs in drawn order."""
    c = convs(spark, root).where((F.size("images") > 0) & C.alternates(F.col("turns")) & (F.size("turns") > 0) & (F.size("turns") % 2 == 0))
    b = P.bucketed(c, "row_id", 8)
    groups = P.run_groups(b.select("bucket", "row_id"), "row_id", P.run_length(F.col("row_id"), "merge", 5, 2, 4))
    pairs = c.join(groups, "row_id").select("bucket", "grp", "row_id", "images", F.posexplode(F.sequence(F.lit(0), F.floor(F.size("turns") / 2).cast("int") - 1)).alias("at", "k"), "turns")
    key = F.concat_ws(":", "row_id", "k")
    pairs = pairs.select("bucket", "grp", "row_id", "images", F.struct(pick("order", key, 1 << 31).alias("h"), "row_id", "k", F.slice("turns", 2 * F.col("k") + 1, F.lit(2)).alias("t")).alias("p"))
    g = pairs.groupBy("bucket", "grp").agg(F.min("row_id").alias("first"), F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"])).alias("turns"), F.countDistinct("row_id").alias("merged"))
    return g.select("first", "merged", F.size("turns").alias("turns"))


@R.query(
    "job_raw_conversations",
    """WITH p AS (SELECT row_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM raw_records),
    i AS (SELECT row_id, k AS item, json_extract(p, '$.items[' || k || ']') AS x FROM p, LATERAL (SELECT unnest(range(coalesce(json_array_length(p, '$.items'), 0)::BIGINT)) AS k) q WHERE json_type(p, '$.items') = 'ARRAY'),
    c AS (SELECT row_id, item, CASE WHEN json_type(x, '$.conversations') = 'ARRAY' THEN json_extract(x, '$.conversations') WHEN json_type(x, '$.conversation') = 'ARRAY' THEN json_extract(x, '$.conversation') END AS c FROM i),
    t AS (SELECT row_id, item, k AS turn, json_extract(c, '$[' || k || ']') AS t FROM c, LATERAL (SELECT unnest(range(coalesce(json_array_length(c), 0)::BIGINT)) AS k) q)
    SELECT row_id, item::INTEGER AS item, turn::INTEGER AS turn, CASE coalesce(json_extract_string(t, '$.from'), json_extract_string(t, '$.role')) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE coalesce(json_extract_string(t, '$.from'), json_extract_string(t, '$.role')) END AS role,
      coalesce(CASE WHEN json_type(t, '$.content') = 'VARCHAR' THEN json_extract_string(t, '$.content') END, CASE WHEN json_type(t, '$.text') = 'VARCHAR' THEN json_extract_string(t, '$.text') END, CASE WHEN json_type(t, '$.value') = 'VARCHAR' THEN json_extract_string(t, '$.value') END, '') AS text FROM t""",
)
def job_raw_conversations(spark, root):
    """Turns of raw deliveries in one form: speaker under from or role, plain text under content, text or value."""
    raw = table(spark, root, "raw_records").select("row_id", F.try_parse_json("payload").alias("v"))
    items = raw.select("row_id", F.posexplode(F.try_variant_get("v", "$.items", "array<variant>")).alias("item", "x"))
    conv = F.coalesce(*[F.try_variant_get("x", f"$.{k}", "array<variant>") for k in ("conversations", "conversation")])
    turns = items.select("row_id", "item", F.posexplode(conv).alias("turn", "t"))
    s = lambda k: F.when(F.schema_of_variant(F.try_variant_get("t", f"$.{k}", "variant")) == "STRING", F.try_variant_get("t", f"$.{k}", "string"))
    return turns.select("row_id", "item", "turn", C.role_of(F.coalesce(s("from"), s("role"))).alias("role"), F.coalesce(s("content"), s("text"), s("value"), F.lit("")).alias("text"))


@R.query(
    "job_mixture",
    f"""WITH {CONVS}, c AS (SELECT c.row_id, c.source, m.split, m.max_size, CASE WHEN m.shuffle THEN {h_sql('mixture', 'c.row_id')} ELSE c.row_id END AS place FROM convs c JOIN mixture_config m ON m.name = c.source WHERE m.max_num_images IS NULL OR len(c.images) <= m.max_num_images),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place, row_id) AS n FROM c) SELECT row_id, source, split FROM r WHERE max_size IS NULL OR n <= max_size""",
)
def job_mixture(spark, root):
    return M.mixture(spark, table(spark, root, "training_example"), table(spark, root, "mixture_config")).select("row_id", "source", "split")


def _scratch(spark, name: str) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@R.query("export_json_lines", "SELECT id, question, len(options)::INTEGER AS options FROM vqa_item")
def export_json_lines(spark, root):
    """Written as JSON lines and read back."""
    path = _scratch(spark, "lines") + ".jsonl"
    v = table(spark, root, "vqa_item")
    writers.json_lines(v, path)
    return readers.json_table(spark, path, v.schema).select("id", "question", F.size("options").alias("options"))


@R.query("export_typed", "SELECT id, question_type, data_source, answer FROM vqa_item WHERE question_type = 'multi-choice'")
def export_typed(spark, root):
    """Written with the published schema, by question type, and read back with pruning."""
    path = _scratch(spark, "typed")
    v = table(spark, root, "vqa_item").withColumn("config", F.col("question_type")).withColumn("split", F.lit("test"))
    writers.typed(v, path + "/items", writers.EVAL_ITEM, ["config", "split"])
    return readers.dataset(spark, path, "items", "multi-choice", "test").select("id", "question_type", "data_source", "answer")


@R.query(
    "export_archives",
    f"""WITH RECURSIVE b AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, '')) AS size, {h_sql('archive', 'doc_id')} % 8 AS bucket FROM documents),
    r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS n FROM b),
    f AS (SELECT bucket, n, size, size AS s, 0 AS g FROM r WHERE n = 1 UNION ALL
      SELECT r.bucket, r.n, r.size, CASE WHEN f.s + r.size > 20000 THEN r.size ELSE f.s + r.size END, CASE WHEN f.s + r.size > 20000 THEN f.g + 1 ELSE f.g END FROM f JOIN r ON r.bucket = f.bucket AND r.n = f.n + 1)
    SELECT 'part_' || bucket || '_' || g AS archive, count(*) AS files, sum(size)::BIGINT AS bytes FROM f GROUP BY bucket, g""",
)
def export_archives(spark, root):
    """Size-bounded archives of the documents."""
    d = table(spark, root, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return writers.manifest(writers.archives(d, "doc_id", "size", 20000), "size")


def _glob(root: str, name: str) -> str:
    """A pattern of one table: streams take patterns for tables of one file and of many."""
    return f"{root}/{name[:-1]}[{name[-1]}].parquet"


@R.query("stream_event_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(round(value * 1000000)::BIGINT)::BIGINT AS total FROM events GROUP BY 1, 2")
def stream_event_counts(spark, root):
    """Hourly counts and sums (in millionths) through a stream over the files."""
    schema = table(spark, root, "events").schema
    s = spark.readStream.schema(schema).parquet(_glob(root, "events")).withColumn("value", F.round(F.col("value") * 1000000).cast("long"))
    out = incremental.run_now(incremental.windowed(s, "ts", "1 hour", "10 minutes", "event_type", "value"), "events_" + uuid.uuid4().hex)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@R.query("stream_incremental_scoring", f"WITH {CONVS} SELECT row_id, len(turns)::INTEGER AS turns, len(images)::INTEGER AS pics FROM convs")
def stream_incremental_scoring(spark, root):
    """New files scored once and appended; the second call finds nothing new."""
    path = _scratch(spark, "stream")
    score = lambda df: C.normalised(df).select("row_id", F.size("turns").alias("turns"), F.size("images").alias("pics"))
    for _ in range(2):
        out = incremental.scored_once(spark, _glob(root, "training_example"), "row_id", score, path + "/out", path + "/state")
    return out.select("row_id", "turns", "pics")
