"""Evaluation, retrieval, annotation and video questions over the benchmark items and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.choice import h, pick
from ..operators import annotate as A
from ..operators import evaluation as E
from ..operators import sampling as S
from ..session import table
from .registry import Registry, h_sql

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql

#: Phrasings of raw answers for four stand-in models; {L} the letter drawn, {l} in lower case, {O} the option's text.
PHRASES = ["{L}", "({l})", "The answer is {L}.", "Final Answer: {l}", "Answer: {L}", "{O}", "42", ""]
MODELS = 4


def items(spark, root):
    return table(spark, root, "vqa_item")


def predictions(spark, root):
    """id, model, question_type, data_source, raw, answer, options."""
    i = items(spark, root).withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(MODELS - 1))))
    key = F.concat_ws(":", "id", "model")
    n = F.greatest(F.size("options"), F.lit(1))
    at = pick("letter", key, n).cast("int")
    up = X.letter(at)
    option = F.coalesce(F.get("options", at), F.lit("nothing"))
    raw = F.get(F.array(up, F.concat(F.lit("("), F.lower(up), F.lit(")")), F.concat(F.lit("The answer is "), up, F.lit(".")), F.concat(F.lit("Final Answer: "), F.lower(up)), F.concat(F.lit("Answer: "), up), option, F.lit("42"), F.lit("")), pick("phrase", key, 8).cast("int"))
    raw = F.when(F.col("question_type") == "short-answer", F.when(pick("phrase", key, 8) < 3, F.concat(F.lit("I think. Final Answer: "), "answer")).otherwise(raw)).otherwise(raw)
    return i.select("id", "model", "question_type", "data_source", raw.alias("raw"), "answer", "options")


PREDS = f"""preds AS (SELECT id, model, question_type, data_source, answer, options,
    CASE WHEN question_type = 'short-answer' AND ph < 3 THEN 'I think. Final Answer: ' || answer ELSE
      [up, '(' || lower(up) || ')', 'The answer is ' || up || '.', 'Final Answer: ' || lower(up), 'Answer: ' || up, coalesce(options[p0 + 1], 'nothing'), '42', ''][ph + 1] END AS raw
  FROM (SELECT *, chr((65 + p0)::INTEGER) AS up FROM (SELECT v.*, m.model, {h_sql('letter', "(id || ':' || model)")} % greatest(len(options), 1) AS p0, {h_sql('phrase', "(id || ':' || model)")} % 8 AS ph
        FROM vqa_item v, (SELECT unnest(range({MODELS})) AS model) m)))"""
_BARE = "regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def _bare(x: str) -> str:
    return _BARE.replace("{x}", x)


_PARSED = "CASE " + " ".join(f"WHEN strpos(lower(raw), '{m}') > 0 THEN {_bare(f'substr(raw, strpos(lower(raw), {chr(39)}{m}{chr(39)}) + {len(m)})')}" for m in ("final answer:", "the answer is", "answer:")) + " ELSE raw END"
SCORED = f"""{PREDS}, p1 AS (SELECT *, {_PARSED} AS parsed, trim(answer, '() ' || chr(10)) AS ref FROM preds),
  p2 AS (SELECT *, CASE WHEN length(ref) = 1 THEN ref ELSE regexp_extract(ref, '(\\p{{L}})', 1) END AS letter,
    CASE WHEN regexp_matches(parsed, '^Answer: [A-Z]') THEN substr(parsed, 9, 1) WHEN regexp_extract(parsed, '(\\p{{L}})', 1) <> '' THEN upper(regexp_extract(parsed, '(\\p{{L}})', 1)) END AS pick FROM p1),
  p3 AS (SELECT *, pick IS NOT NULL AND ascii(pick) - 65 < len(options) AS inside, options[ascii(upper(letter)) - 64] AS own FROM p2),
  scored AS (SELECT id, model, question_type, data_source,
    CASE WHEN question_type = 'multi-choice' THEN CASE WHEN inside THEN pick ELSE raw END ELSE parsed END AS parsed_answer,
    CASE WHEN question_type = 'multi-choice' THEN CASE WHEN inside THEN pick = upper(letter) WHEN own IS NULL THEN false
        WHEN starts_with(own, letter || '.') OR starts_with(own, letter || ':') THEN {_bare('raw')} = {_bare('substr(own, 3)')}
        WHEN starts_with(own, '(' || letter || ')') THEN {_bare('raw')} = {_bare('substr(own, 4)')} ELSE {_bare('raw')} = {_bare('own')} END
      ELSE lower(ref) = lower(parsed) END AS correct FROM p3)"""


def scored(spark, root):
    p = predictions(spark, root).withColumn("p", E.prediction(F.col("question_type"), F.col("raw"), F.col("answer"), F.col("options"), F.col("data_source")))
    return p.select("id", "model", "question_type", "data_source", "p.*")


@R.query("eval_parse_answer", f"WITH {PREDS} SELECT id, model, raw, {_PARSED} AS parsed FROM preds")
def eval_parse_answer(spark, root):
    return predictions(spark, root).select("id", "model", "raw", E.parsed_answer(F.col("raw")).alias("parsed"))


@R.query("eval_get_option", f"WITH {SCORED} SELECT id, model, pick FROM p2")
def eval_get_option(spark, root):
    return predictions(spark, root).select("id", "model", E.chosen_option(E.parsed_answer(F.col("raw"))).alias("pick"))


@R.query("eval_predictions", f"WITH {SCORED} SELECT * FROM scored")
def eval_predictions(spark, root):
    return scored(spark, root)


@R.query("eval_accuracy", f"WITH {SCORED} SELECT CASE WHEN grouping(question_type) = 1 THEN 'overall' ELSE question_type END AS part, sum(correct::INTEGER)::BIGINT AS \"right\", count(correct) AS total, avg(correct::INTEGER) AS accuracy FROM scored GROUP BY GROUPING SETS ((question_type), ())")
def eval_accuracy(spark, root):
    return E.accuracy(scored(spark, root), "question_type")


@R.query("eval_answer_distribution", f"WITH {SCORED} SELECT parsed_answer, count(*) AS n FROM scored WHERE question_type = 'multi-choice' GROUP BY 1")
def eval_answer_distribution(spark, root):
    return scored(spark, root).where(F.col("question_type") == "multi-choice").groupBy("parsed_answer").agg(F.count("*").alias("n"))


@R.query(
    "leaderboard",
    f"""WITH {SCORED}, a AS (SELECT model, data_source, avg(correct::INTEGER) AS acc FROM scored WHERE model < 3 GROUP BY 1, 2),
    g AS (SELECT m.model, d.data_source, coalesce(round(acc, 4), -1) AS accuracy FROM (SELECT unnest(range(5)) AS model) m, (SELECT DISTINCT data_source FROM vqa_item) d LEFT JOIN a ON a.model = m.model AND a.data_source = d.data_source)
    SELECT model::INTEGER AS model, data_source AS dataset, accuracy, rank() OVER (PARTITION BY data_source ORDER BY accuracy DESC) AS place FROM g""",
)
def leaderboard(spark, root):
    models = spark.range(5).select(F.col("id").cast("int").alias("model"))
    s = scored(spark, root).where("model < 3").withColumnRenamed("data_source", "dataset")
    return E.leaderboard(models, items(spark, root).select(F.col("data_source").alias("dataset")).distinct(), s)


@R.query("resume_antijoin", f"SELECT id FROM vqa_item WHERE {h_sql('done', 'id')} % 3 <> 0")
def resume_antijoin(spark, root):
    i = items(spark, root)
    return E.resumed(i, i.where(F.pmod(h("done", F.col("id")), F.lit(3)) == 0).select("id"), "id")[1].select("id")


@R.query("resume_rescore", f"WITH {SCORED} SELECT id, parsed_answer, correct FROM scored WHERE model = 0 AND {h_sql('done', 'id')} % 3 = 0")
def resume_rescore(spark, root):
    p = predictions(spark, root).where("model = 0")
    stored = p.where(F.pmod(h("done", F.col("id")), F.lit(3)) == 0).select("id", F.col("raw").alias("stored"))
    again = E.resumed(p, stored, "id")[0]
    s = E.prediction(F.col("question_type"), F.col("stored"), F.col("answer"), F.col("options"), F.col("data_source"))
    return again.withColumn("p", s).select("id", "p.*")


_LETTERED = "(contains(upper(o), chr((64 + i)::INTEGER) || ')') OR contains(upper(o), chr((64 + i)::INTEGER) || ':') OR contains(upper(o), chr((64 + i)::INTEGER) || '.'))"
_QUESTION = f"""CASE WHEN question_type = 'multi-choice' THEN question || array_to_string(list_transform(options, lambda o, i: CASE WHEN {_LETTERED} THEN chr(10) || ' ' || o ELSE chr(10) || ' (' || chr((64 + i)::INTEGER) || ') ' || o END), '')
    || chr(10) || 'Answer with the option''s letter from the given choices directly.'
  ELSE 'Given the images, answer the following short answer vqa question:' || chr(10) || 'Q: ' || question || chr(10) || 'You can first give your analysis, and then give your final answer as "Final Answer:"' END"""


@R.query("mcq_render", f"SELECT id, {_QUESTION} AS text FROM vqa_item")
def mcq_render(spark, root):
    return items(spark, root).select("id", E.question_text(F.col("question_type"), F.col("question"), F.col("options")).alias("text"))


@R.query(
    "mcq_segments",
    f"""WITH q AS (SELECT id, images, {_QUESTION} AS t FROM vqa_item), f AS (SELECT id, images, string_split(repeat('<image>', greatest(len(images) - ((length(t) - length(replace(t, '<image>', ''))) // 7), 0)::BIGINT) || t, '<image>') AS p FROM q),
    s AS (SELECT id, flatten(list_transform(p, lambda x, i: list_filter([CASE WHEN trim(x, ' ' || chr(10)) <> '' THEN 'T:' || x END, CASE WHEN i <= len(images) THEN 'I:' || images[i] END], lambda y: y IS NOT NULL))) AS s FROM f)
    SELECT id, len(s)::INTEGER AS n, array_to_string(s, '|') AS segments FROM s""",
)
def mcq_segments(spark, root):
    s = E.question_segments(F.col("question_type"), F.col("question"), F.col("options"), F.col("images"))
    flat = F.transform(s, lambda x: F.concat(F.when(x["type"] == "text", "T:").otherwise("I:"), x["content"]))
    return items(spark, root).select("id", F.size(s).alias("n"), F.array_join(flat, "|").alias("segments"))


@R.query(
    "mcq_single_image_segments",
    f"""WITH q AS (SELECT id, images, {_QUESTION} AS t FROM vqa_item)
    SELECT id, (len(images) + 1)::INTEGER AS n, array_to_string(list_transform(list_filter(string_split(t, '<image>'), lambda x: trim(x, ' ' || chr(10) || chr(9)) <> ''), lambda x: trim(x, ' ' || chr(10))), ' ') AS text FROM q""",
)
def mcq_single_image_segments(spark, root):
    s = E.question_segments(F.col("question_type"), F.col("question"), F.col("options"), F.col("images"), many=False)
    return items(spark, root).select("id", F.size(s).alias("n"), F.try_element_at(s, F.lit(-1))["content"].alias("text"))


@R.query(
    "mcq_permute_remap",
    f"""WITH o AS (SELECT id, answer, options, unnest(range(len(options))) AS i FROM vqa_item WHERE question_type = 'multi-choice'),
    s AS (SELECT id, answer, i, options[i + 1] AS o, row_number() OVER (PARTITION BY id ORDER BY {h_sql('mix', "(id || ':' || i)")}, i) AS n FROM o)
    SELECT id, string_agg(o, '|' ORDER BY n) AS options, max(CASE WHEN i = ascii(answer) - 65 THEN chr((64 + n)::INTEGER) END) AS answer FROM s GROUP BY id""",
)
def mcq_permute_remap(spark, root):
    m = items(spark, root).where(F.col("question_type") == "multi-choice").where(F.size("options") > 0)
    return S.option_permutation(m, "mix", "id", "options", "answer").select("id", F.array_join("options", "|").alias("options"), "answer")


@R.query("options_lookup", "SELECT id, options[ascii(answer) - 64] AS chosen, array_to_string(list_transform(options, lambda o, i: chr((64 + i)::INTEGER) || '. ' || o), chr(10)) AS lines FROM vqa_item WHERE question_type = 'multi-choice'")
def options_lookup(spark, root):
    m = items(spark, root).where(F.col("question_type") == "multi-choice")
    return m.select("id", F.get("options", X.letter_index(F.col("answer"))).alias("chosen"), X.option_lines(F.col("options"), "{}. ").alias("lines"))


@R.query("question_forms", "WITH q AS (SELECT id, trim(replace(question, '<image>', '')) AS t FROM vqa_item), c AS (SELECT id, t, upper(left(t, 1)) || lower(substr(t, 2)) AS c FROM q) SELECT id, CASE WHEN ends_with(c, '?') THEN c ELSE c || '?' END AS q, lower(left(t, 1)) || substr(t, 2) AS lowered, regexp_extract(t, '(\\p{L})', 1) AS first FROM c")
def question_forms(spark, root):
    t = F.trim(F.replace("question", F.lit("<image>"), F.lit("")))
    return items(spark, root).select("id", X.as_question(t).alias("q"), X.first_letter_lowered(t).alias("lowered"), X.first_letter(t).alias("first"))


_VIDEO = "'Question: ' || question || chr(10) || array_to_string(list_transform(options, lambda o, i: chr((64 + i)::INTEGER) || '. ' || o), chr(10)) || chr(10) || 'Answer with the option''s letter from the given choices directly.'"


@R.query("video_questions", f"SELECT id, {_VIDEO} AS question, answer || '. ' || options[ascii(answer) - 64] AS answer FROM vqa_item WHERE question_type = 'multi-choice' AND len(list_distinct(options)) = len(options)")
def video_questions(spark, root):
    m = items(spark, root).where((F.col("question_type") == "multi-choice") & (F.size(F.array_distinct("options")) == F.size("options")))
    v = E.video_question(F.col("question"), F.col("options"), F.get("options", X.letter_index(F.col("answer"))))
    return m.withColumn("v", v).select("id", "v.question", "v.answer")


_VIDEO_RAW = "CASE WHEN strpos(raw, 'the answer is') > 0 THEN {0} WHEN strpos(raw, 'answer:') > 0 THEN {1} WHEN strpos(raw, 'Answer:') > 0 THEN {2} ELSE raw END".format(
    *(_bare(f"string_split(raw, '{m}')[-1]") for m in ("the answer is", "answer:", "Answer:"))
)
_VIDEO_SCORED = f"""{PREDS}, r AS (SELECT id, model, data_source, answer, {_VIDEO_RAW} AS r FROM preds WHERE question_type = 'multi-choice'),
    v AS (SELECT id, model, data_source, CASE WHEN r = '' THEN false ELSE CASE WHEN regexp_extract(r, '(\\p{{L}})', 1) <> '' THEN regexp_extract(r, '(\\p{{L}})', 1) ELSE left(r, 1) END = left(answer, 1) END AS correct FROM r)"""


def video_scored(spark, root):
    p = predictions(spark, root).where(F.col("question_type") == "multi-choice")
    return p.select("id", "model", "data_source", E.video_correct(F.col("raw"), F.col("answer")).alias("correct"))


@R.query("video_score", f"WITH {_VIDEO_SCORED} SELECT id, model, correct FROM v")
def video_score(spark, root):
    return video_scored(spark, root).select("id", "model", "correct")


@R.query("video_task_rollup", f"WITH {_VIDEO_SCORED} SELECT CASE WHEN grouping(data_source) = 1 THEN 'overall' ELSE data_source END AS part, sum(correct::INTEGER)::BIGINT AS \"right\", count(correct) AS total, avg(correct::INTEGER) AS accuracy FROM v GROUP BY GROUPING SETS ((data_source), ())")
def video_task_rollup(spark, root):
    return E.accuracy(video_scored(spark, root), "data_source")


@R.query("random_baseline", "SELECT data_source, count(*) AS items, sum(len(options))::BIGINT AS options, count(*) / sum(len(options)) AS rate FROM vqa_item WHERE question_type = 'multi-choice' GROUP BY data_source")
def random_baseline(spark, root):
    m = items(spark, root).where(F.col("question_type") == "multi-choice").groupBy("data_source")
    return m.agg(F.count("*").alias("items"), F.sum(F.size("options").cast("long")).alias("options")).withColumn("rate", F.col("items") / F.col("options"))


@R.query("random_model", f"SELECT id, CASE WHEN question_type = 'multi-choice' THEN options[{h_sql('random', 'id')} % len(options) + 1] ELSE '' END AS raw FROM vqa_item")
def random_model(spark, root):
    at = pick("random", F.col("id"), F.greatest(F.size("options"), F.lit(1))).cast("int")
    return items(spark, root).select("id", F.when(F.col("question_type") == "multi-choice", F.get("options", at)).otherwise("").alias("raw"))


_WORDS = "list_distinct(regexp_extract_all(lower({x}), '[a-z]+'))"


@R.query(
    "keyword_set_scores",
    f"""WITH w AS (SELECT row_id, {_WORDS.replace('{x}', 'sentence')} AS a, {_WORDS.replace('{x}', 'response')} AS b FROM seed_demos WHERE sentence IS NOT NULL AND response IS NOT NULL),
    s AS (SELECT row_id, CASE WHEN len(b) > 0 THEN len(list_intersect(a, b)) / len(b) ELSE 0 END AS p, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END AS r FROM w)
    SELECT count(*) AS rows, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM s""",
)
def keyword_set_scores(spark, root):
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    d = table(spark, root, "seed_demos").where(F.col("sentence").isNotNull() & F.col("response").isNotNull())
    s = d.select(E.set_scores(words("sentence"), words("response")).alias("s")).select("s.*")
    return s.agg(F.count("*").alias("rows"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")])


@R.query("keyword_synonym_f1")
def keyword_synonym_f1(spark, root):
    """Words of the statement against words of the response, number words and digits as synonyms."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    edges = spark.createDataFrame([("picture", "", "image"), ("picture", "", "images"), ("two", "pictures", "both"), ("both", "images", "both")], "word string, next string, meaning string")
    d = table(spark, root, "seed_demos").select("row_id", words("sentence").alias("ref"), words("response").alias("got"))
    return E.keyword_scores(d, edges)


_EMB = "SELECT vec_id, embedding, label FROM embeddings"
_TOP = f"""q AS (SELECT vec_id AS query, embedding AS a, label AS ql FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, ql, vec_id AS item, label AS il, round(list_dot_product(a::DOUBLE[], embedding::DOUBLE[]), 9) AS score FROM q, embeddings WHERE vec_id <> query),
    t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS place FROM s)"""


def _top(spark, root, k):
    e = table(spark, root, "embeddings")
    q = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), "embedding")
    hits = E.top_k(q, e.select(F.col("vec_id").alias("item"), "embedding"), k + 1).where(F.col("query") != F.col("item"))
    from pyspark.sql import Window

    return hits.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("place"))).where(F.col("place") <= k)


@R.query("retrieval_top_k", f"WITH {_TOP} SELECT query, item, round(score, 6) AS score, place::INTEGER AS place FROM t WHERE place <= 10")
def retrieval_top_k(spark, root):
    return _top(spark, root, 10).select("query", "item", F.round("score", 6).alias("score"), "place")


@R.query(
    "retrieval_recall_at_k",
    f"""WITH {_TOP}, r AS (SELECT query, sum((ql = il)::INTEGER) AS n, sum((ql = il AND place <= 10)::INTEGER) AS tp FROM t GROUP BY query)
    SELECT round(avg(tp / n), 6) AS recall, round(avg((tp > 0)::INTEGER), 6) AS hit_rate FROM r WHERE n > 0""",
)
def retrieval_recall_at_k(spark, root):
    e = table(spark, root, "embeddings")
    a = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), "label")
    positives = a.join(e.select(F.col("vec_id").alias("item"), "label"), "label").where("query <> item").select("query", "item")
    out = E.recall_at(_top(spark, root, 10), positives, 10)
    return out.select(F.round("recall", 6).alias("recall"), F.round("hit_rate", 6).alias("hit_rate"))


@R.query(
    "dual_softmax_scores",
    f"""WITH {_TOP}, k AS (SELECT query, item, score FROM t WHERE place <= 10) SELECT query, item, round(score * exp(score - max(score) OVER w) / sum(exp(score - mx)) OVER w, 6) AS score FROM (SELECT *, max(score) OVER (PARTITION BY item) AS mx FROM k) WINDOW w AS (PARTITION BY item)""",
)
def dual_softmax_scores(spark, root):
    return E.dual_softmax(_top(spark, root, 10)).select("query", "item", F.round("score", 6).alias("score"))


@R.query(
    "similarity_triplets",
    """WITH r AS (SELECT vec_id, embedding AS e, lead(embedding) OVER (ORDER BY vec_id) AS l, lead(embedding, 2) OVER (ORDER BY vec_id) AS r FROM embeddings QUALIFY vec_id IS NOT NULL)
    SELECT vec_id, CASE WHEN round(list_dot_product(e::DOUBLE[], l::DOUBLE[]), 9) >= round(list_dot_product(e::DOUBLE[], r::DOUBLE[]), 9) THEN 'left' ELSE 'right' END AS nearer FROM r WHERE r IS NOT NULL""",
)
def similarity_triplets(spark, root):
    """Which of the next two vectors is nearer; neighbours come by equi-join on the ordinal."""
    from ..operators.conversation import ranked_by

    e = ranked_by(table(spark, root, "embeddings").select("vec_id", "embedding"), "vec_id")
    shift = lambda n, name: e.select((F.col("rn") - n).alias("rn"), F.col("embedding").alias(name))
    j = e.join(shift(1, "l"), "rn").join(shift(2, "r"), "rn")
    near = F.round(E.dot(F.col("embedding"), F.col("l")), 9) >= F.round(E.dot(F.col("embedding"), F.col("r")), 9)
    return j.select("vec_id", F.when(near, "left").otherwise("right").alias("nearer"))


@R.query("annotation_cache", f"SELECT id, sha2 AS uid, 'answer ' || substr(sha256('stub-1' || chr(0) || trim(question)), 1, 12) AS completion, {h_sql('cached', 'id')} % 4 = 0 AS cached FROM (SELECT id, question, sha256('stub-1' || chr(0) || trim(question) || chr(0) || 'max_tokens=1024' || chr(0) || 'model=stub-1') AS sha2 FROM vqa_item) WHERE 1 = 0")
def annotation_cache(spark, root):
    """Only the schema is compared here: which of equal prompts is cached depends on the cache, see annotation_completions."""
    return annotation_completions(spark, root).where(F.lit(False))


@R.query(
    "annotation_completions",
    f"""WITH q AS (SELECT id, sha256('stub-1' || chr(0) || trim(question) || chr(0) || 'max_tokens=1024' || chr(0) || 'model=stub-1') AS uid, 'answer ' || substr(sha256('stub-1' || chr(0) || trim(question)), 1, 12) AS completion FROM vqa_item),
    c AS (SELECT DISTINCT uid FROM q WHERE {h_sql('cached', 'id')} % 4 = 0) SELECT id, uid, completion, uid IN (SELECT uid FROM c) AS cached FROM q""",
)
def annotation_completions(spark, root):
    i = items(spark, root)
    settings = {"model": "stub-1", "max_tokens": 1024}
    known = i.where(F.pmod(h("cached", F.col("id")), F.lit(4)) == 0).select(A.cache_key(F.btrim("question"), "stub-1", settings).alias("uid"), F.btrim("question").alias("p")).distinct()
    cache = known.select("uid", F.concat(F.lit("answer "), F.substring(F.sha2(F.concat(F.lit("stub-1\x00"), F.col("p")), 256), 1, 12)).alias("completion"))
    return A.completions(i, "question", "id", "stub-1", cache=cache)


del R.calls["annotation_cache"], R.sql["annotation_cache"]


@R.query("annotation_price", "WITH q AS (SELECT id, length(question) // 4 AS n, ['gpt-4-turbo', 'ChatGPT', 'text-davinci-003'][ascii(right(id, 1)) % 3 + 1] AS model FROM vqa_item) SELECT model, round(sum(n * CASE WHEN model LIKE '%gpt-4%' THEN 0.03 / 1000 WHEN lower(model) LIKE '%chatgpt%' THEN 0.002 / 1000 ELSE 0.02 / 1000 END), 6) AS price, bool_or(lower(model) LIKE '%turbo%' OR lower(model) LIKE '%gpt-4%' OR lower(model) LIKE '%chatgpt%') AS chat FROM q GROUP BY model")
def annotation_price(spark, root):
    model = F.get(F.array(*map(F.lit, ("gpt-4-turbo", "ChatGPT", "text-davinci-003"))), F.ascii(F.right("id", F.lit(1))) % 3)
    q = items(spark, root).select(X.token_estimate(F.col("question")).alias("n"), model.alias("model"))
    return q.groupBy("model").agg(F.round(F.sum(F.col("n") * A.price_per_token(F.col("model"))), 6).alias("price"), F.bool_or(A.is_chat(F.col("model"))).alias("chat"))


@R.query("message_round_trip", "SELECT id, 2 AS n, 'system' AS first, question AS content FROM vqa_item WHERE question IS NOT NULL")
def message_round_trip(spark, root):
    m = F.array(F.struct(F.lit("system").alias("role"), F.lit("Be brief.").alias("content")), F.struct(F.lit("user").alias("role"), F.col("question").alias("content")))
    back = A.messages_of(A.chatml(m))
    return items(spark, root).select("id", F.size(back).alias("n"), F.get(back, F.lit(0))["role"].alias("first"), F.get(back, F.lit(1))["content"].alias("content"))
