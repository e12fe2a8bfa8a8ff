"""Extraction from texts, prompt building, reading and writing of files, and small preparations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions.choice import h
from ..operators import annotate as A
from ..operators import conversation as C
from ..operators import evaluation as E
from ..operators import relational as L
from ..session import table
from ..sources import readers
from .conversation_queries import convs
from .geometry_queries import GEOM, geom
from .job_queries import _scratch
from .registry import CONVS, Registry, h_sql

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql

_FLAT = "trim(regexp_replace(coalesce({c}, ''), '[\\s\\x{{A0}}\"\\\\:`{{}}]+', ' ', 'g'))"


def _flat(c: str):
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\s\x{A0}"\\:`{}]+', " "))


def _demos(spark, root):
    return table(spark, root, "seed_demos").select("row_id", _flat("question").alias("q"), _flat("response").alias("r"), _flat("sentence").alias("s"))


_DEMOS = "d AS (SELECT row_id, " + ", ".join(f"{_FLAT.replace('{c}', c).replace('{{', '{').replace('}}', '}')} AS {n}" for c, n in (("question", "q"), ("response", "r"), ("sentence", "s"))) + " FROM seed_demos)"


@R.query("extract_line_fields", f"WITH {_DEMOS} SELECT row_id, q AS question, r AS response FROM d WHERE q <> '' AND r <> ''")
def extract_line_fields(spark, root):
    """Lines ``Question: ...`` and ``Response: ...`` of a completion."""
    d = _demos(spark, root).where("q <> '' and r <> ''")
    t = F.concat(F.lit("Thoughts\nQuestion: "), "q", F.lit("\nResponse: "), "r", F.lit("\nEnd"))
    return d.select("row_id", X.line_field(t, "Question").alias("question"), X.line_field(t, "Response").alias("response"))


@R.query("extract_sections", f"WITH {_DEMOS} SELECT row_id, s AS choice, r AS short FROM d WHERE s <> '' AND r <> ''")
def extract_sections(spark, root):
    d = _demos(spark, root).where("s <> '' and r <> ''")
    t = F.concat(F.lit("Multi-choice:\n"), "s", F.lit("\nShort-answer:\n"), "r")
    return d.select("row_id", X.section(t, "Multi-choice:", "Short-answer:").alias("choice"), X.section(t, "Short-answer:").alias("short"))


@R.query("extract_json", f"WITH {_DEMOS} SELECT row_id, q AS fenced, r AS braced FROM d")
def extract_json(spark, root):
    """JSON in a fence and JSON between braces inside prose."""
    d = _demos(spark, root)
    body = F.to_json(F.struct(F.col("q").alias("v")))
    prose = F.concat(F.lit("Sure, here it is: "), F.to_json(F.struct(F.col("r").alias("v"))), F.lit(" Done."))
    value = lambda t: F.from_json(t, "v string")["v"]
    return d.select("row_id", value(X.fenced(F.concat(F.lit("```json\n"), body, F.lit("\n```")))).alias("fenced"), value(X.braced(prose)).alias("braced"))


@R.query("extract_qa_pairs", f"WITH {_DEMOS} SELECT row_id, unnest([0, 1])::INTEGER AS k, unnest([q, s]) AS question, unnest([r, q]) AS answer FROM d WHERE q <> '' AND s <> '' AND r <> ''")
def extract_qa_pairs(spark, root):
    d = _demos(spark, root).where("q <> '' and s <> '' and r <> ''")
    t = F.concat(F.lit("Question: "), "q", F.lit("\nAnswer: "), "r", F.lit("\nQuestion: "), "s", F.lit("\nAnswer: "), "q")
    return d.select("row_id", F.posexplode(X.question_answer_pairs(t)).alias("k", "p")).select("row_id", "k", "p.question", "p.answer")


@R.query(
    "keyword_lists",
    r"""WITH w AS (SELECT row_id, list_sort(list_distinct(regexp_extract_all(lower(sentence), '[a-z]{4,}'))) AS a, list_sort(list_distinct(regexp_extract_all(lower(response), '[a-z]{4,}'))) AS b FROM seed_demos WHERE sentence IS NOT NULL AND response IS NOT NULL)
    SELECT row_id, array_to_string(a, ' ') AS ref, array_to_string(b, ' ') AS got FROM w WHERE len(a) > 0 AND len(b) > 0""",
)
def keyword_lists(spark, root):
    """Keyword lists written as lines and read back."""
    words = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0))))
    d = table(spark, root, "seed_demos").where(F.col("sentence").isNotNull() & F.col("response").isNotNull()).select("row_id", words("sentence").alias("a"), words("response").alias("b"))
    d = d.where((F.size("a") > 0) & (F.size("b") > 0))
    t = F.concat(F.lit("Object list 1: ["), F.array_join("a", ", "), F.lit("]\nno list here\nObject list 2: ["), F.array_join("b", ", "), F.lit("]"))
    return d.select("row_id", X.named_lists(t).alias("m")).select("row_id", F.array_join(F.col("m")["Object list 1"], " ").alias("ref"), F.array_join(F.col("m")["Object list 2"], " ").alias("got"))


@R.query("token_positions", "SELECT id, array_to_string(list_filter(range(length(question)), lambda i: substr(question, i + 1, 7) = '<image>'), ' ') AS places FROM vqa_item")
def token_positions(spark, root):
    return table(spark, root, "vqa_item").select("id", F.array_join(F.transform(X.positions(F.col("question"), "<image>"), lambda i: i.cast("string")), " ").alias("places"))


@R.query("settings_from_text", "SELECT name, max_seq_len::VARCHAR AS len, split FROM mixture_config")
def settings_from_text(spark, root):
    c = table(spark, root, "mixture_config")
    m = X.key_values(F.concat(F.lit("len="), "max_seq_len", F.lit(" split="), "split"))
    return c.select("name", m.alias("m")).select("name", F.col("m")["len"].alias("len"), F.col("m")["split"].alias("split"))


@R.query(
    "turns_from_pairs",
    f"""WITH {_DEMOS} SELECT row_id, 4 AS turns, '<image> ' || q AS first, r AS last FROM d""",
)
def turns_from_pairs(spark, root):
    """Question and answer pairs as turns, the first question opened by a picture."""
    d = _demos(spark, root)
    pairs = F.array(F.struct(F.col("q").alias("question"), F.col("s").alias("answer")), F.struct(F.col("s").alias("question"), F.col("r").alias("answer")))
    t = C.pair_turns(pairs, opening="<image> ")
    return d.select("row_id", F.size(t).alias("turns"), F.get(t, F.lit(0))["text"].alias("first"), F.get(t, F.lit(3))["text"].alias("last"))


@R.query(
    "few_shot_prompts",
    """SELECT id, 'Answer briefly.' || chr(10) || chr(10) || 'Example 1:' || chr(10) || 'Which side? left' || chr(10) || chr(10) || 'Example 2:' || chr(10) || 'How many? two' || chr(10) || chr(10) || question AS prompt FROM vqa_item""",
)
def few_shot_prompts(spark, root):
    shots = F.array(F.lit("Which side? left"), F.lit("How many? two"))
    return table(spark, root, "vqa_item").select("id", A.example_prompt("Answer briefly.", shots, F.col("question")).alias("prompt"))


@R.query("filter_min_size", f"WITH {GEOM} SELECT i FROM geom WHERE h >= 100 AND w >= 100")
def filter_min_size(spark, root):
    return geom(spark).where((F.col("h") >= 100) & (F.col("w") >= 100)).select("i")


@R.query("capped_then_tiled", f"WITH {GEOM} SELECT count(*) AS n, sum(h)::BIGINT AS h FROM geom WHERE greatest(h, w) <= 1024")
def capped_then_tiled(spark, root):
    """Sizes within the cap stay as they are."""
    g = geom(spark).where(F.greatest("h", "w") <= 1024).select(G.capped(F.col("h"), F.col("w"), 1024).alias("s"))
    return g.agg(F.count("*").alias("n"), F.sum("s.height").cast("long").alias("h"))


@R.query(
    "missing_media_count",
    f"""WITH {CONVS}, e AS (SELECT row_id, unnest(images) AS p FROM convs), m AS (SELECT DISTINCT row_id FROM e WHERE p IS NULL OR substr(md5(p), 1, 1) = '0') SELECT count(*) AS missing FROM m""",
)
def missing_media_count(spark, root):
    c = convs(spark, root)
    known = c.select(F.explode("images").alias("id")).where(F.col("id").isNotNull() & (F.substring(F.md5(F.col("id").cast("binary")), 1, 1) != "0")).distinct()
    return L.inner_all(c, "row_id", "images", known.withColumn("path", F.col("id")), "id", "path")[1]


@R.query("media_groups", "SELECT left_url AS media, count(*) AS rows, string_agg(row_id::VARCHAR, ' ' ORDER BY row_id) AS ids FROM seed_demos WHERE left_url IS NOT NULL GROUP BY left_url HAVING count(*) > 1")
def media_groups(spark, root):
    """Rows that share a picture."""
    g = table(spark, root, "seed_demos").where("left_url is not null").groupBy(F.col("left_url").alias("media")).agg(F.count("*").alias("rows"), F.array_sort(F.collect_list("row_id")).alias("r"))
    return g.where("rows > 1").select("media", "rows", F.array_join(F.transform("r", lambda x: x.cast("string")), " ").alias("ids"))


@R.query(
    "related_roots",
    """WITH r AS (SELECT row_id, row_id - row_id % 5 AS root FROM training_example), k AS (SELECT row_id FROM training_example)
    SELECT r.row_id, CASE WHEN r.row_id % 5 <> 0 AND k.row_id IS NOT NULL THEN r.root ELSE r.row_id END AS root FROM r LEFT JOIN k ON k.row_id = r.root""",
)
def related_roots(spark, root):
    """Rows attach to the row of the next lower multiple of five, if there is one."""
    t = table(spark, root, "training_example").select("row_id", F.array(F.lit(-1).cast("long"), F.col("row_id") - F.col("row_id") % 5).alias("related"))
    return L.related_roots(t, "row_id", "related")


@R.query("resume_rows", "SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS n FROM training_example) WHERE n > 300")
def resume_rows(spark, root):
    """What is left after 300 rows are done."""
    return C.ranked_by(table(spark, root, "training_example").select("row_id"), "row_id").where("rn > 300").select("row_id")


@R.query("totals", "SELECT count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE text IS NOT NULL")
def totals(spark, root):
    return table(spark, root, "documents").where("text is not null").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@R.query("read_csv", "SELECT id, question, data_source FROM vqa_item")
def read_csv(spark, root):
    """Written as CSV and as TSV, read back with a schema and joined."""
    v = table(spark, root, "vqa_item").select("id", "question", "data_source")
    one, two = _scratch(spark, "csv"), _scratch(spark, "tsv")
    v.select("id", "question").write.option("header", True).option("escape", '"').csv(one)
    v.select("id", "data_source").write.option("header", True).option("sep", "\t").option("escape", '"').csv(two)
    return readers.csv_table(spark, one, "id string, question string").join(readers.csv_table(spark, two, "id string, data_source string", sep="\t"), "id")


@R.query("read_latin", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND lang IN ('es', 'fr', 'pt', 'de') AND NOT regexp_matches(text, '[^\\x{20}-\\x{7E}\\x{A1}-\\x{FF}]') AND text = trim(text) AND text <> ''")
def read_latin(spark, root):
    """Western texts through an ISO-8859-1 file."""
    d = table(spark, root, "documents").where(F.col("text").isNotNull() & F.col("lang").isin("es", "fr", "pt", "de") & ~F.col("text").rlike("[^\\x20-\\x7E\\xA1-\\xFF]") & (F.col("text") == F.trim("text")) & (F.col("text") != ""))
    path = _scratch(spark, "latin")
    d.select("doc_id", "text").write.option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').csv(path)
    return readers.csv_table(spark, path, "doc_id long, text string", encoding="ISO-8859-1")


@R.query("read_subset_heads", None)
def read_subset_heads(spark, root):
    """The first rows of two tables, by subset."""
    out = readers.heads(spark, {"a": f"{root}/training_example.parquet", "b": f"{root}/cls_training_example.parquet"}, 20, "row_id")
    return out.select("subset", "row_id", "id")


R.sql["read_subset_heads"] = "(SELECT 'a' AS subset, row_id, id FROM training_example ORDER BY row_id LIMIT 20) UNION ALL (SELECT 'b', row_id, id FROM cls_training_example ORDER BY row_id LIMIT 20)"


@R.query("address_fallback", "SELECT row_id, coalesce(left_url, right_url, 'none') AS address FROM seed_demos")
def address_fallback(spark, root):
    return table(spark, root, "seed_demos").select("row_id", readers.first_of(F.col("left_url"), F.col("right_url"), F.lit("none")).alias("address"))


@R.query("number_suffix", "SELECT id, try_cast(regexp_extract(images[1], '(\\d+)(?:\\.[A-Za-z0-9]+)?$', 1) AS INTEGER) AS number FROM vqa_item WHERE len(images) > 0")
def number_suffix(spark, root):
    return table(spark, root, "vqa_item").where(F.size("images") > 0).select("id", readers.number_in(F.get("images", F.lit(0))).alias("number"))


@R.query("content_ids", "SELECT doc_id, md5(text) AS digest, sha256(text) AS strong, 'doc_' || substr(md5(text), 1, 8) AS id FROM documents WHERE text IS NOT NULL")
def content_ids(spark, root):
    m = F.md5(F.col("text").cast("binary"))
    return table(spark, root, "documents").where("text is not null").select("doc_id", m.alias("digest"), F.sha2(F.col("text").cast("binary"), 256).alias("strong"), F.concat(F.lit("doc_"), F.substring(m, 1, 8)).alias("id"))


@R.query("dot_products", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def dot_products(spark, root):
    e = table(spark, root, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(E.dot(F.col("embedding"), F.col("y")), 6).alias("score"))


@R.query("hash_numbers", f"SELECT row_id, {h_sql('any', 'row_id')} AS n FROM training_example")
def hash_numbers(spark, root):
    return table(spark, root, "training_example").select("row_id", h("any", F.col("row_id")).alias("n"))


@R.query(
    "right_padded_ids",
    """WITH w AS (SELECT id, list_transform(string_split(question, ' '), lambda x: length(x)) AS n FROM vqa_item)
    SELECT id, array_to_string(list_concat(n[1:12], list_transform(range(greatest(12 - len(n), 0)), lambda x: 0)), ' ') AS ids,
      array_to_string(list_concat(list_transform(n[1:12], lambda x: 1), list_transform(range(greatest(12 - len(n), 0)), lambda x: 0)), ' ') AS mask,
      array_to_string(list_concat(n[1:12], list_transform(range(greatest(12 - len(n), 0)), lambda x: -100)), ' ') AS labels FROM w""",
)
def right_padded_ids(spark, root):
    n = F.transform(F.split("question", " "), lambda x: F.length(x))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    v = table(spark, root, "vqa_item").select("id", n.alias("n"))
    ones = F.transform("n", lambda _: F.lit(1))
    return v.select("id", text(C.right_padded(F.col("n"), 12, 0)).alias("ids"), text(C.right_padded(ones, 12, 0)).alias("mask"), text(C.right_padded(F.col("n"), 12, -100)).alias("labels"))


@R.query(
    "tile_token_expansion",
    """WITH p AS (SELECT id, string_split(question, '<image>') AS p, list_transform(images, lambda x, i: i % 3 + 1) AS t FROM vqa_item)
    SELECT id, array_to_string(list_transform(p, lambda s, i: CASE WHEN i = 1 THEN s WHEN i - 1 > len(t) THEN '<image>' || s ELSE 'Frame ' || (i - 1) || ': <img>' || repeat('<pad>', t[i - 1] * 2) || '</img>' || s END), '') AS text FROM p""",
)
def tile_token_expansion(spark, root):
    tiles = F.transform("images", lambda x, i: F.pmod(i + 1, F.lit(3)) + 1)
    return table(spark, root, "vqa_item").select("id", C.expanded_tokens(F.col("question"), tiles, 2, frames=True).alias("text"))


@R.query(
    "job_caption_frames",
    f"""WITH {CONVS} SELECT row_id, turns[2].text AS caption, array_to_string(list_transform(CASE WHEN len(images) > 4 THEN list_transform(range(4), lambda k: floor(k * (len(images) / 4))::BIGINT) ELSE range(len(images)) END, lambda k: images[k + 1]), ' ') AS frames
    FROM convs WHERE len(images) > 0 AND list_position(images, NULL) IS NULL AND len(turns) > 1""",
)
def job_caption_frames(spark, root):
    """The second turn as caption, with at most four frames evenly apart."""
    c = convs(spark, root).where((F.size("images") > 0) & ~F.exists("images", lambda p: p.isNull()) & (F.size("turns") > 1))
    at = G.sampled_frames(F.size("images"), 4, even=True)
    return c.select("row_id", F.get("turns", F.lit(1))["text"].alias("caption"), F.array_join(F.transform(at, lambda k: F.get("images", k)), " ").alias("frames"))


@R.query("positional_zip", "SELECT id, name FROM (SELECT id, row_number() OVER (ORDER BY id) AS n FROM vqa_item) JOIN (SELECT name, row_number() OVER (ORDER BY name) AS n FROM mixture_config) USING (n)")
def positional_zip(spark, root):
    return L.zipped(table(spark, root, "vqa_item").select("id"), table(spark, root, "mixture_config").select("name"), "id", "name")


@R.query("id_mapping_join", "SELECT t.row_id, m.path FROM training_example t JOIN mixture_config m ON m.name = t.source")
def id_mapping_join(spark, root):
    """A table of settings joined by name; the optimiser broadcasts it by its measured size."""
    return table(spark, root, "training_example").select("row_id", "source").join(table(spark, root, "mixture_config").select(F.col("name").alias("source"), "path"), "source").select("row_id", "path")


@R.query("export_once", "SELECT id, 'v1' AS version FROM vqa_item")
def export_once(spark, root):
    """Results keyed by id are appended once: a second run finds all done and adds nothing."""
    path = _scratch(spark, "once") + ".jsonl"
    v = table(spark, root, "vqa_item").select("id")
    for version in ("v1", "v2"):
        done = readers.stored_results(spark, path, "id string, version string").select("id").distinct()
        v.join(done, "id", "left_anti").withColumn("version", F.lit(version)).write.mode("append").json(path)
    return readers.stored_results(spark, path, "id string, version string")


@R.query("registered_model", "SELECT id, 'answer ' || substr(sha256('m' || chr(0) || trim(question)), 1, 12) AS completion FROM vqa_item")
def registered_model(spark, root):
    return A.completions(table(spark, root, "vqa_item"), "question", "id", "m", client=A.model("stub")).select("id", "completion")
