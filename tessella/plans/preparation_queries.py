"""Small preparations: paths, names, placeholders, domains, trial packs, token weights, readers of odd layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import annotate as A
from ..operators import conversation as C
from ..operators import packing as P
from ..operators import relational as L
from ..session import table
from ..sources import readers, writers
from .conversation_queries import convs
from .data_queries import _TOKENS, _TOKENS_SQL
from .job_queries import _scratch
from .registry import CONVS, Registry

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


@R.query(
    "packing_interval",
    f"""WITH RECURSIVE {CONVS}, r AS MATERIALIZED (SELECT {_TOKENS_SQL} AS s, row_number() OVER (ORDER BY row_id) AS n FROM convs),
    f AS (SELECT n, s AS t, 0 AS g FROM r WHERE n = 1
      UNION ALL SELECT r.n, CASE WHEN f.t > 1024 THEN r.s ELSE f.t + r.s END, CASE WHEN f.t > 1024 THEN f.g + 1 ELSE f.g END FROM f JOIN r ON r.n = f.n + 1 WHERE f.g < 20)
    SELECT ceil(count(*) / 20.0)::BIGINT AS every FROM f WHERE g < 20""",
)
def packing_interval(spark, root):
    """Mean number of conversations in twenty trial packs."""
    n = P.packing_interval(convs(spark, root).select("row_id", _TOKENS().alias("s")), "row_id", "s", 1024)
    return spark.range(1).select(F.lit(n).cast("long").alias("every"))


@R.query(
    "placeholder_order",
    """WITH t AS (SELECT id, question || '<video>' || question || ' <video>' AS q FROM vqa_item),
    p AS (SELECT id, list_sort(list_concat(list_transform(list_filter(range(length(q)), lambda i: substr(q, i + 1, 7) = '<image>'), lambda i: {'at': i, 'kind': 'image'}),
      list_transform(list_filter(range(length(q)), lambda i: substr(q, i + 1, 7) = '<video>'), lambda i: {'at': i, 'kind': 'video'}))) AS p FROM t)
    SELECT id, array_to_string(list_transform(p, lambda x: x.at || ':' || x.kind), ' ') AS places FROM p""",
)
def placeholder_order(spark, root):
    q = F.concat("question", F.lit("<video>"), "question", F.lit(" <video>"))
    order = X.placeholder_order(q, {"image": "<image>", "video": "<video>"})
    return table(spark, root, "vqa_item").select("id", F.array_join(F.transform(order, lambda p: F.concat(p["at"].cast("string"), F.lit(":"), p["kind"])), " ").alias("places"))


@R.query(
    "picture_paths",
    """WITH p AS (SELECT row_id, coalesce(images[1], image) AS path FROM training_example),
    a AS (SELECT row_id, path, CASE WHEN path LIKE '/%' OR regexp_matches(path, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN path ELSE '/data/' || path END AS absolute FROM p WHERE path IS NOT NULL)
    SELECT row_id, absolute, CASE WHEN starts_with(absolute, '/data/') THEN substr(absolute, 7) ELSE absolute END AS relative FROM a""",
)
def picture_paths(spark, root):
    t = table(spark, root, "training_example").select("row_id", F.coalesce(F.get("images", F.lit(0)), "image").alias("path")).where("path is not null")
    a = t.select("row_id", readers.absolute(F.col("path"), "/data").alias("absolute"))
    return a.withColumn("relative", readers.relative(F.col("absolute"), "/data"))


@R.query("answers_outside_domain", "SELECT id, answer FROM vqa_item WHERE NOT coalesce(answer IN ('A', 'B', 'C', 'D'), false)")
def answers_outside_domain(spark, root):
    return L.outside(table(spark, root, "vqa_item"), "answer", ["A", "B", "C", "D"]).select("id", "answer")


@R.query("slice_names", "SELECT name, name || '-0-' || coalesce(max_size, max_seq_len) AS slice FROM mixture_config")
def slice_names(spark, root):
    return table(spark, root, "mixture_config").select("name", readers.slice_name(F.col("name"), F.lit(0), F.coalesce("max_size", "max_seq_len")).alias("slice"))


@R.query(
    "text_media_pairs",
    f"""WITH {CONVS}, p AS (SELECT row_id, trim(regexp_replace(replace(replace(turns[1].text, '<image>', ' '), '<video>', ' '), '\\s+', ' ', 'g')) AS text, len(images)::INTEGER AS media FROM convs)
    SELECT row_id, md5(text) AS digest, media, true AS return_loss FROM p WHERE text <> '' AND media > 0""",
)
def text_media_pairs(spark, root):
    p = C.text_media_pairs(convs(spark, root))
    return p.select("row_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.size("media").alias("media"), "return_loss")


@R.query(
    "logit_bias",
    """WITH o AS (SELECT id, CASE WHEN answer <> '' THEN [ascii(answer)] ELSE [] END AS liked, list_distinct(flatten(list_transform(coalesce(options, []), lambda o: [ascii(o), length(o)::INTEGER]))) AS shunned FROM vqa_item)
    SELECT id, array_to_string(list_sort(liked), ' ') AS favoured, array_to_string(list_sort(list_filter(shunned, lambda i: NOT list_contains(liked, i))), ' ') AS avoided FROM o""",
)
def logit_bias(spark, root):
    """Token weights of a call; character codes stand in for token ids."""
    v = table(spark, root, "vqa_item")
    liked = F.when(F.col("answer") != "", F.array(F.array(F.ascii("answer")))).otherwise(F.array().cast("array<array<int>>"))
    bias = A.logit_bias(liked, F.transform(F.coalesce("options", F.array().cast("array<string>")), lambda o: F.array(F.ascii(o), F.length(o))))
    of = lambda keep: F.array_join(F.transform(F.array_sort(F.map_keys(F.map_filter("bias", keep))), lambda i: i.cast("string")), " ")
    return v.select("id", bias.alias("bias")).select("id", of(lambda _, x: x > 0).alias("favoured"), of(lambda _, x: x < 0).alias("avoided"))


@R.query("export_json_array", "SELECT id, question, answer FROM vqa_item")
def export_json_array(spark, root):
    """Written as JSON arrays, one a file, and read back."""
    path = _scratch(spark, "array") + ".json"
    v = table(spark, root, "vqa_item").select("id", "question", "answer")
    writers.json_array(v, path)
    return readers.json_table(spark, path, v.schema).select("id", "question", "answer")


@R.query("first_line_items", "SELECT id, answer FROM vqa_item")
def first_line_items(spark, root):
    """Files whose first line is an array and whose other lines don't count."""
    path = _scratch(spark, "first")
    v = table(spark, root, "vqa_item").groupBy(F.pmod(F.hash("id"), F.lit(4)).alias("part")).agg(F.to_json(F.collect_list(F.struct("id", "answer"))).alias("line"))
    v.select(F.concat("line", F.lit('\n[{"id": "none", "answer": "none"}]')).alias("value")).repartition(4, "value").write.text(path)
    # a partition may hold several arrays; each line that isn't the stand-in is a file's content of its own
    lines = spark.read.text(path).where(~F.col("value").startswith('[{"id": "none"'))
    one = _scratch(spark, "firsts")
    lines.select(F.concat("value", F.lit('\n[{"id": "none", "answer": "none"}]')).alias("value"), F.monotonically_increasing_id().alias("file")).write.partitionBy("file").text(one)
    return readers.first_line_json(spark, one + "/*/*", "struct<id:string,answer:string>").select("id", "answer")


@R.query(
    "video_file_kinds",
    """WITH p AS (SELECT id, CASE length(question) % 3 WHEN 0 THEN 'x_v0_1_cap_processed.json' WHEN 1 THEN 'x_oe_qa_processed.json' ELSE 'x_other.json' END AS f FROM vqa_item)
    SELECT id, CASE f WHEN 'x_v0_1_cap_processed.json' THEN 'x_v0_1' WHEN 'x_oe_qa_processed.json' THEN 'x' ELSE 'x_other.json' END AS subset,
      CASE f WHEN 'x_v0_1_cap_processed.json' THEN 'caption' WHEN 'x_oe_qa_processed.json' THEN 'open_ended' END AS kind FROM p""",
)
def video_file_kinds(spark, root):
    r = F.pmod(F.length("question"), F.lit(3))
    f = F.when(r == 0, "a/b/x_v0_1_cap_processed.json").when(r == 1, "a/b/x_oe_qa_processed.json").otherwise("a/b/x_other.json")
    return table(spark, root, "vqa_item").select("id", readers.video_subset(f).alias("s")).select("id", "s.*")
