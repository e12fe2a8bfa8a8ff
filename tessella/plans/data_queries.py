"""Filters, joins, aggregates, sampling, mixing, grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.choice import pick, u
from ..operators import packing as P
from ..operators import relational as L
from ..operators import sampling as S
from ..session import table
from .conversation_queries import convs
from .registry import CONVS, Registry, h_sql

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


@R.query("filter_max_images", f"WITH {CONVS} SELECT row_id, len(images)::INTEGER AS pics FROM convs WHERE len(images) <= 4")
def filter_max_images(spark, root):
    return L.pictures_at_most(convs(spark, root), 4).select("row_id", F.size("images").alias("pics"))


@R.query("filter_vision_only", f"WITH {CONVS} SELECT row_id FROM convs WHERE len(images) > 0")
def filter_vision_only(spark, root):
    return L.with_pictures(convs(spark, root)).select("row_id")


@R.query("filter_two_images", f"WITH {CONVS} SELECT row_id FROM convs WHERE len(images) >= 2")
def filter_two_images(spark, root):
    return L.with_pictures(convs(spark, root), least=2).select("row_id")


@R.query("filter_split_and_label", "SELECT row_id FROM seed_demos WHERE lower(trim(identifier)) LIKE 'train-%' AND lower(label) = 'true' AND sentence NOT LIKE '%tram%'")
def filter_split_and_label(spark, root):
    d = table(spark, root, "seed_demos")
    return d.where(F.lower(F.trim("identifier")).startswith("train-") & (F.lower("label") == "true") & ~F.col("sentence").contains("tram")).select("row_id")


@R.query("filter_question_type", "SELECT id, data_source FROM vqa_item WHERE question_type = 'multi-choice' AND data_source NOT IN ('made_charts')")
def filter_question_type(spark, root):
    return table(spark, root, "vqa_item").where((F.col("question_type") == "multi-choice") & ~F.col("data_source").isin("made_charts")).select("id", "data_source")


@R.query(
    "media_present",
    f"""WITH {CONVS}, e AS (SELECT row_id, unnest(images) AS p FROM convs), listing AS (SELECT DISTINCT p FROM e WHERE p IS NOT NULL AND substr(md5(p), 1, 1) <> '0')
    SELECT row_id FROM convs WHERE row_id NOT IN (SELECT row_id FROM e WHERE p IS NULL OR p NOT IN (SELECT p FROM listing))""",
)
def media_present(spark, root):
    c = convs(spark, root)
    listing = c.select(F.explode("images").alias("path")).where(F.col("path").isNotNull() & (F.substring(F.md5(F.col("path").cast("binary")), 1, 1) != "0"))
    return L.media_present(c, "row_id", "images", listing).select("row_id")


@R.query(
    "instruction_media_inner_all",
    f"""WITH {CONVS}, e AS (SELECT row_id, unnest(range(len(images))) AS i, images FROM convs), f AS (SELECT row_id, i, images[i + 1] AS p FROM e),
    m AS (SELECT DISTINCT p, 'store/' || p AS t FROM f WHERE p IS NOT NULL AND substr(md5(p), 1, 1) <> '0'),
    j AS (SELECT f.row_id, f.i, m.t FROM f LEFT JOIN m ON f.p = m.p)
    SELECT row_id, string_agg(t, ' ' ORDER BY i) AS paths FROM j GROUP BY row_id HAVING count(*) = count(t)""",
)
def instruction_media_inner_all(spark, root):
    c = convs(spark, root)
    known = c.select(F.explode("images").alias("id")).where(F.col("id").isNotNull() & (F.substring(F.md5(F.col("id").cast("binary")), 1, 1) != "0")).distinct()
    rows, _ = L.inner_all(c, "row_id", "images", known.withColumn("path", F.concat(F.lit("store/"), "id")), "id", "path")
    return rows.select("row_id", F.array_join("path", " ").alias("paths"))


@R.query("union_sources", "SELECT source, kind, count(*) AS rows FROM (SELECT source, 'demo' AS kind FROM seed_demos UNION ALL SELECT source, 'chat' FROM training_example UNION ALL SELECT source, 'doc' FROM documents) GROUP BY ALL")
def union_sources(spark, root):
    parts = [table(spark, root, t).select("source", F.lit(k).alias("kind")) for t, k in (("seed_demos", "demo"), ("training_example", "chat"), ("documents", "doc"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source", "kind").agg(F.count("*").alias("rows"))


@R.query("sources_in_common", "SELECT source FROM training_example WHERE source IS NOT NULL INTERSECT SELECT name FROM mixture_config EXCEPT SELECT source FROM documents WHERE lang = 'ja'")
def sources_in_common(spark, root):
    t = table(spark, root, "training_example").select("source").where(F.col("source").isNotNull())
    m = table(spark, root, "mixture_config").select(F.col("name").alias("source"))
    return t.intersect(m).exceptAll(table(spark, root, "documents").where(F.col("lang") == "ja").select("source").distinct())


@R.query("counts_by_source", "SELECT source, count(*) AS rows, count(DISTINCT md5(text)) AS texts FROM documents GROUP BY source")
def counts_by_source(spark, root):
    return table(spark, root, "documents").groupBy("source").agg(F.count("*").alias("rows"), F.countDistinct(F.md5(F.col("text").cast("binary"))).alias("texts"))


@R.query("distinct_media", f"WITH {CONVS} SELECT count(DISTINCT p) AS media, count(*) AS uses FROM (SELECT unnest(images) AS p FROM convs) WHERE p IS NOT NULL")
def distinct_media(spark, root):
    p = convs(spark, root).select(F.explode("images").alias("p")).where(F.col("p").isNotNull())
    return p.agg(F.countDistinct("p").alias("media"), F.count("*").alias("uses"))


_MEDIA_KEY = "md5(array_to_string(list_transform(images, lambda p: coalesce(p, chr(0))), chr(10)))"


@R.query(
    "merge_by_media",
    """WITH d AS (SELECT row_id, coalesce(left_url, '') || chr(10) || coalesce(right_url, '') AS k, question, response FROM seed_demos),
    g AS (SELECT md5(k) AS media, min(row_id) AS first, count(*) AS rows, string_agg(coalesce(question, '') || '|' || coalesce(response, ''), chr(10) ORDER BY row_id) AS t FROM d GROUP BY k)
    SELECT media, first, rows, md5(t) AS digest, row_number() OVER (ORDER BY first) AS grp FROM g""",
)
def merge_by_media(spark, root):
    d = table(spark, root, "seed_demos")
    c = lambda x: F.coalesce(x, F.lit(""))
    rows = d.select("row_id", F.array(c("left_url"), c("right_url")).alias("images"), F.array(F.concat(c("question"), F.lit("|"), c("response"))).alias("turns"))
    out = L.merged_by(rows, L.media_key(F.col("images")), "row_id")
    return out.select("media", "first", "rows", F.md5(F.array_join("turns", "\n").cast("binary")).alias("digest"), "grp")


@R.query("captions_by_picture", "SELECT left_url AS picture, count(*) AS n, string_agg(sentence, '|' ORDER BY row_id) AS captions FROM seed_demos WHERE left_url IS NOT NULL AND sentence IS NOT NULL GROUP BY left_url")
def captions_by_picture(spark, root):
    d = table(spark, root, "seed_demos").where(F.col("left_url").isNotNull() & F.col("sentence").isNotNull())
    g = d.groupBy(F.col("left_url").alias("picture")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("row_id", "sentence"))).alias("s"))
    return g.select("picture", "n", F.array_join(F.transform("s", lambda x: x["sentence"]), "|").alias("captions"))


@R.query("dedup_first_wins", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first_wins(spark, root):
    return L.first_wins(table(spark, root, "documents").select("doc_id", "source", "text"), ["text"], "doc_id").select("doc_id", "source")


@R.query("dataset_weights", "SELECT source, count(*) AS n, count(*) / sum(count(*)) OVER () AS weight FROM documents GROUP BY source")
def dataset_weights(spark, root):
    return S.weights(table(spark, root, "documents").groupBy("source").agg(F.count("*").alias("n")))


@R.query(
    "seeded_shuffle_limit",
    f"SELECT row_id, n FROM (SELECT row_id, row_number() OVER (ORDER BY {h_sql('shuffle', 'row_id')}, row_id) AS n FROM training_example) WHERE n <= 200",
)
def seeded_shuffle_limit(spark, root):
    return S.shuffled(table(spark, root, "training_example").select("row_id"), "shuffle", "row_id", "n").where("n <= 200")


@R.query("sample_head", f"SELECT row_id FROM training_example ORDER BY {h_sql('shuffle', 'row_id')}, row_id LIMIT 100")
def sample_head(spark, root):
    return S.head_of_shuffle(table(spark, root, "training_example").select("row_id"), "shuffle", "row_id", 100)


@R.query("slice_range", "SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS n FROM seed_demos) WHERE n > 100 AND n <= 350")
def slice_range(spark, root):
    return S.sliced(table(spark, root, "seed_demos").select("row_id"), "row_id", 100, 350)


def _resample_sql(ratio: float) -> str:
    return f"""WITH r AS (SELECT row_id, row_number() OVER (ORDER BY {h_sql('resample', 'row_id')}, row_id) AS n, count(*) OVER () AS t FROM training_example)
    SELECT row_id, unnest(range(CASE WHEN n <= floor(t * {ratio})::BIGINT - {int(ratio)} * t THEN {int(ratio)} + 1 ELSE {int(ratio)} END))::INTEGER AS copy FROM r"""


@R.query("sample_down", _resample_sql(0.3))
def sample_down(spark, root):
    return S.resampled(table(spark, root, "training_example").select("row_id"), "resample", "row_id", 0.3)


@R.query("sample_up", _resample_sql(2.7))
def sample_up(spark, root):
    return S.resampled(table(spark, root, "training_example").select("row_id"), "resample", "row_id", 2.7)


_QUOTA = "WITH s AS (SELECT source, count(*) AS n FROM training_example WHERE source IS NOT NULL GROUP BY source), q AS (SELECT source, n, trunc(sum(n) OVER () * least(1.1 * (sqrt(n) / sum(sqrt(n)) OVER ()), 1.0))::BIGINT AS quota FROM s)"


@R.query("mixture_sqrt_quotas", f"{_QUOTA} SELECT source, n, quota FROM q")
def mixture_sqrt_quotas(spark, root):
    sizes = table(spark, root, "training_example").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    return S.balance_quotas(sizes)


@R.query(
    "mixture_sqrt_balance",
    f"""{_QUOTA}, r AS (SELECT row_id, source, row_number() OVER (PARTITION BY source ORDER BY row_id) - 1 AS p0 FROM training_example WHERE source IS NOT NULL)
    SELECT row_id, source, times::INTEGER AS times FROM (SELECT row_id, r.source, greatest((quota - p0 - 1 + n) // n, 0) AS times FROM r JOIN q USING (source)) WHERE times > 0""",
)
def mixture_sqrt_balance(spark, root):
    return S.balanced(table(spark, root, "training_example").select("row_id", "source"), "source", "row_id")


@R.query(
    "mixture_index_range_join",
    """WITH s AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source), c AS (SELECT source, sum(n) OVER (ORDER BY source) - n AS lo, sum(n) OVER (ORDER BY source) AS hi FROM s)
    SELECT i AS idx, source, (i - lo)::BIGINT AS local FROM (SELECT unnest(range(0, (SELECT sum(n)::BIGINT FROM s))) AS i) JOIN c ON i >= lo AND i < hi""",
)
def mixture_index_range_join(spark, root):
    sizes = table(spark, root, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    return S.global_index(sizes, spark.range(total).withColumnRenamed("id", "idx"))


@R.query(
    "drawn_source",
    f"""WITH w AS (SELECT name AS source, max_seq_len AS n FROM mixture_config), c AS (SELECT source, n / sum(n) OVER () AS weight FROM w), r AS (SELECT source, sum(weight) OVER (ORDER BY source) - weight AS lo, sum(weight) OVER (ORDER BY source) AS hi FROM c)
    SELECT row_id, source AS drawn FROM (SELECT row_id, {h_sql('source', 'row_id')} / 4294967296.0 AS u FROM training_example) LEFT JOIN r ON u >= lo AND u < hi""",
)
def drawn_source(spark, root):
    sources = table(spark, root, "mixture_config").select(F.col("name").alias("source"), F.col("max_seq_len").alias("n"))
    return S.drawn_source(table(spark, root, "training_example").select("row_id"), sources, "source", "row_id")


@R.query(
    "strided_partition",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS t FROM documents)
    SELECT doc_id, n AS place FROM r WHERE (n - 1) % 7 = 3 UNION ALL SELECT doc_id, n + t FROM r WHERE n <= ceil(t / 7.0)::BIGINT * 7 - t AND (n - 1 + t) % 7 = 3""",
)
def strided_partition(spark, root):
    return S.strided(table(spark, root, "documents").select("doc_id"), "doc_id", 7, 3)


@R.query("ring_repeat", "SELECT doc_id, batch, replica::INTEGER AS replica FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch FROM documents), (SELECT unnest(range(3)) AS replica)")
def ring_repeat(spark, root):
    return S.ring(table(spark, root, "documents").select("doc_id"), "doc_id", 8, 3)


@R.query("shard_rows", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // (count(*) OVER () // 6 + 1) AS part FROM documents")
def shard_rows(spark, root):
    return P.shards(table(spark, root, "documents").select("doc_id"), "doc_id", 6)


@R.query("fixed_batches", "SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // 32 AS batch FROM cls_training_example")
def fixed_batches(spark, root):
    return P.batches(table(spark, root, "cls_training_example").select("row_id"), "row_id", 32)


def _fold_sql(size: str, rows: str, first: str, carry: str, close: str) -> str:
    """A fold as a recursive query over the rows of each bucket; ``t`` is the state, ``g`` the group."""
    return f"""WITH RECURSIVE {CONVS}, base AS MATERIALIZED (SELECT row_id, {h_sql('bucket', 'row_id')} % 64 AS bucket, {size} FROM ({rows})),
    r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY row_id) AS n FROM base),
    f AS (SELECT bucket, n, row_id, {first} AS t, 0 AS g FROM r WHERE n = 1
      UNION ALL SELECT r.bucket, r.n, r.row_id, {carry}, CASE WHEN {close} THEN f.g + 1 ELSE f.g END FROM f JOIN r ON r.bucket = f.bucket AND r.n = f.n + 1)
    SELECT bucket::INTEGER AS bucket, row_id, g::BIGINT AS grp FROM f"""


_TOKENS_SQL = "coalesce(list_sum(list_transform(turns, lambda m: length(m.text))), 0) // 4 + 576 * len(images)"
_TOKENS = lambda: F.floor(F.aggregate("turns", F.lit(0).cast("long"), lambda a, m: a + F.length(m["text"])) / 4) + 576 * F.size("images")


@R.query("pack_before", _fold_sql("s", f"SELECT row_id, {_TOKENS_SQL} AS s FROM convs", "s", "CASE WHEN f.t + r.s > 8192 THEN r.s ELSE f.t + r.s END", "f.t + r.s > 8192"))
def pack_before(spark, root):
    df = P.bucketed(convs(spark, root).select("row_id", _TOKENS().alias("s")), "row_id")
    return P.pack_before(df, "row_id", {"s": 8192})


@R.query("pack_after", _fold_sql("s", f"SELECT row_id, {_TOKENS_SQL} AS s FROM convs", "s", "CASE WHEN f.t > 8192 THEN r.s ELSE f.t + r.s END", "f.t > 8192"))
def pack_after(spark, root):
    df = P.bucketed(convs(spark, root).select("row_id", _TOKENS().alias("s")), "row_id")
    return P.pack_after(df, "row_id", "s", 8192)


_TWO = "f.t.a + r.a > 2048 OR f.t.b + r.b > 2560"


@R.query(
    "pack_two_budgets",
    _fold_sql(
        "a, b", "SELECT row_id, coalesce(list_sum(list_transform(turns, lambda m: length(m.text))), 0) // 4 AS a, 256 * len(images) AS b FROM convs", "{'a': a, 'b': b}",
        f"CASE WHEN {_TWO} THEN {{'a': r.a, 'b': r.b}} ELSE {{'a': f.t.a + r.a, 'b': f.t.b + r.b}} END", _TWO,
    ),
)
def pack_two_budgets(spark, root):
    c = convs(spark, root)
    text = F.floor(F.aggregate("turns", F.lit(0).cast("long"), lambda a, m: a + F.length(m["text"])) / 4)
    df = P.bucketed(c.select("row_id", text.alias("a"), (256 * F.size("images")).cast("long").alias("b")), "row_id")
    return P.pack_before(df, "row_id", {"a": 2048, "b": 2560})


@R.query(
    "run_merge",
    _fold_sql(
        "l", f"SELECT row_id, CASE WHEN {h_sql('run:alone', 'row_id')} % 10 < 5 THEN 1 ELSE 2 + {h_sql('run:len', 'row_id')} % 3 END AS l FROM training_example", "l - 1",
        "CASE WHEN f.t = 0 THEN r.l - 1 ELSE f.t - 1 END", "f.t = 0",
    ),
)
def run_merge(spark, root):
    df = P.bucketed(table(spark, root, "training_example").select("row_id"), "row_id")
    return P.run_groups(df, "row_id", P.run_length(F.col("row_id"), "run", 5, 2, 4))


@R.query("shard_bytes", _fold_sql("s", "SELECT doc_id AS row_id, strlen(coalesce(text, '')) AS s FROM documents", "s", "CASE WHEN f.t + r.s > 20000 THEN r.s ELSE f.t + r.s END", "f.t + r.s > 20000"))
def shard_bytes(spark, root):
    df = table(spark, root, "documents").select(F.col("doc_id").alias("row_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("s"))
    return P.pack_before(P.bucketed(df, "row_id"), "row_id", {"s": 20000})


@R.query(
    "position_ids",
    f"""WITH {CONVS}, l AS (SELECT row_id, list_transform(turns, lambda m: length(m.text) // 16) AS n FROM convs)
    SELECT row_id, array_to_string(flatten(list_transform(n, lambda x: range(x))), ' ') AS positions, array_to_string(flatten(list_transform(n, lambda x, i: list_transform(range(x), lambda y: i - 1))), ' ') AS segments FROM l""",
)
def position_ids(spark, root):
    n = F.transform("turns", lambda m: F.floor(F.length(m["text"]) / 16).cast("int"))
    p, s = P.packed_positions(n)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    return convs(spark, root).select("row_id", text(p).alias("positions"), text(s).alias("segments"))


@R.query("consecutive_pairs", "WITH r AS (SELECT id, question, row_number() OVER (ORDER BY id) AS n FROM vqa_item) SELECT a.id AS id_a, b.id AS id_b, a.n // 2 AS pair FROM r a JOIN r b ON b.n = a.n + 1 WHERE a.n % 2 = 1")
def consecutive_pairs(spark, root):
    return L.consecutive_pairs(table(spark, root, "vqa_item").select("id"), "id").select("id_a", "id_b", "pair")


@R.query(
    "demo_selection",
    f"""WITH r AS (SELECT label, row_id, {h_sql('demo', 'row_id')} AS hh FROM seed_demos WHERE label IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY hh, row_id) AS k FROM r)
    SELECT label, string_agg(row_id::VARCHAR, ',' ORDER BY hh, row_id) AS demos FROM n WHERE k <= 2 GROUP BY label""",
)
def demo_selection(spark, root):
    return L.demos(table(spark, root, "seed_demos"), "row_id", "label", "demo")


@R.query("running_mean", "SELECT event_id, sum(round(value * 1000000)::BIGINT) OVER w / count(*) OVER w AS mean FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_mean(spark, root):
    """In millionths, so that sums are exact in any order of adding."""
    e = table(spark, root, "events").select("event_id", "event_type", "ts", F.round(F.col("value") * 1000000).cast("long").alias("value"))
    return L.running_mean(e, "event_type", ["ts", "event_id"], "value").select("event_id", "mean")


@R.query("bernoulli_placement", f"SELECT id, CASE WHEN {h_sql('place', 'id')} % 2 = 0 THEN '<image> ' || q ELSE q || ' <image>' END AS text FROM (SELECT id, trim(replace(question, '<image>', '')) AS q FROM vqa_item)")
def bernoulli_placement(spark, root):
    q = F.trim(F.replace("question", F.lit("<image>"), F.lit("")))
    return table(spark, root, "vqa_item").select("id", F.when(pick("place", F.col("id"), 2) == 0, F.concat(F.lit("<image> "), q)).otherwise(F.concat(q, F.lit(" <image>"))).alias("text"))


@R.query("template_choice", f"SELECT id, ['Look at this.', 'Answer the question.', 'Tell me.'][{h_sql('wording', 'id')} % 3 + 1] AS wording, {h_sql('u', 'id')} / 4294967296.0 < 0.1 AS rare FROM vqa_item")
def template_choice(spark, root):
    pool = ["Look at this.", "Answer the question.", "Tell me."]
    return table(spark, root, "vqa_item").select("id", S.template_choice(pool, "wording", F.col("id")).alias("wording"), (u("u", F.col("id")) < 0.1).alias("rare"))


@R.query("identifier_parts", "SELECT row_id, lower(trim(split_part(identifier, '-', 1))) AS split, try_cast(split_part(trim(identifier), '-', 2) AS INTEGER) AS set_no, synset, map_extract_value(validation, writer) AS own FROM seed_demos")
def identifier_parts(spark, root):
    part = lambda n: F.split_part(F.col("identifier"), F.lit("-"), F.lit(n))
    d = table(spark, root, "seed_demos")
    return d.select("row_id", F.lower(F.trim(part(1))).alias("split"), F.split_part(F.trim("identifier"), F.lit("-"), F.lit(2)).try_cast("int").alias("set_no"), "synset", F.try_element_at("validation", F.col("writer")).alias("own"))


@R.query(
    "late_arrivals",
    """SELECT source, count(*) AS rows, count(*) FILTER (loaded_at > written_at + INTERVAL 7 DAY) AS late, max(date_diff('day', written_at, loaded_at))::INTEGER AS longest_days FROM seed_demos GROUP BY source""",
)
def late_arrivals(spark, root):
    late = F.col("loaded_at") > F.col("written_at") + F.expr("interval 7 days")
    return table(spark, root, "seed_demos").groupBy("source").agg(F.count("*").alias("rows"), F.count_if(late).alias("late"), F.max(F.date_diff(F.to_date("loaded_at"), F.to_date("written_at"))).alias("longest_days"))


@R.query(
    "redelivered",
    "SELECT identifier, sentence, left_url, right_url, count(*) AS times, min(row_id) AS first FROM seed_demos GROUP BY ALL HAVING count(*) > 1",
)
def redelivered(spark, root):
    cols = ["identifier", "sentence", "left_url", "right_url"]
    return table(spark, root, "seed_demos").groupBy(*cols).agg(F.count("*").alias("times"), F.min("row_id").alias("first")).where("times > 1")


