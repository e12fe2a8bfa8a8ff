"""Conversations: profile, normal form, templates, labels, padding, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import conversation as C
from ..session import table
from .registry import CONVS, Registry, h_sql

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


def convs(spark, root):
    return C.normalised(table(spark, root, "training_example"))


def _profile(df):
    n = F.size("turns")
    chars = F.length(C.prompt(F.col("turns"), "multi_v1"))
    return df.select("source", F.size("images").alias("pics"), n.alias("n"), chars.alias("chars"))


def _figures():
    tokens = F.floor(F.col("chars") / 4) + 576 * F.col("pics")
    return [
        F.count("*").alias("rows"), F.avg("pics").alias("avg_pics"), F.max("pics").alias("max_pics"), F.avg("n").alias("avg_turns"), F.max("n").alias("max_turns"),
        F.avg("chars").alias("avg_chars"), F.avg(tokens).alias("avg_tokens"), F.max(tokens).alias("max_tokens"),
    ]


def _parts_sql(t: C.Template, turns: str, full: str, empty: str) -> str:
    return f"list_transform({turns}, lambda m, i: CASE WHEN m.text <> '' THEN {full} ELSE {empty} END)"


def _prompt_sql(t: C.Template, turns: str = "turns", parts: bool = False) -> str:
    """The fold of a template in SQL, or its turns only."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    role = f"CASE WHEN i % 2 = 1 THEN {q(t.roles[0])} ELSE {q(t.roles[1])} END"
    sep = f"CASE WHEN i % 2 = 1 THEN {q(t.sep)} ELSE {q(t.sep2)} END"
    text = "m.text"
    full, empty = {
        "single": (f"{role} || ': ' || {text} || {q(t.sep)}", f"{role} || ':'"),
        "two": (f"{role} || ': ' || {text} || {sep}", f"{role} || ':'"),
        "marked": (f"{role} || ': ' || {text} || {sep}", f"{role} || ':'"),
        "bare": (f"{role} || {text} || {q(t.sep)}", role),
        "llama_2": (
            f"CASE WHEN i % 2 = 1 THEN {q(t.sep + '[INST] ')} || CASE WHEN i = 1 THEN {q(chr(60) * 2 + 'SYS>>' + chr(10) + t.system + chr(10) + '<</SYS>>' + chr(10) * 2)} ELSE '' END || {text} || ' [/INST]' ELSE ' ' || {text} || {q(' ' + t.sep2)} END",
            "''",
        ),
        "llama_3": (f"'<|start_header_id|>' || {role} || {q('<|end_header_id|>' + chr(10) * 2)} || {text} || {q(t.sep)}", f"'<|start_header_id|>' || {role} || {q('<|end_header_id|>' + chr(10) * 2)}"),
        "plain": (f"{text} || {sep}", "''"),
        "utterance": (f"{role} || ':' || {text} || {q(t.sep + chr(10))}", f"{role} || ':'"),
        "begun_utterance": (f"{role} || ':' || {text} || {q(t.sep + chr(10))}", f"{role} || ':'"),
        "vision_chat": (
            f"'<|im_start|>' || {role} || {q(chr(10))} || replace(replace({text}, '<image>', '<|vision_start|><|image_pad|><|vision_end|>'), '<video>', '<|vision_start|><|video_pad|><|vision_end|>') || {q('<|im_end|>' + chr(10))}",
            f"'<|im_start|>' || {role} || {q(chr(10))}",
        ),
    }[t.style]
    if parts:
        return _parts_sql(t, turns, full, empty)
    body = f"{q(C.opening_of(t))} || array_to_string({_parts_sql(t, turns, full, empty)}, '')"
    return f"ltrim({body}, {q(t.sep)})" if t.style == "llama_2" else body


_PROFILE_SQL = f"""WITH {CONVS}, p AS (SELECT source, len(images) AS pics, len(turns) AS n, length({_prompt_sql(C.TEMPLATES['multi_v1'])}) AS chars FROM convs)
SELECT @GROUP count(*) AS rows, avg(pics) AS avg_pics, max(pics)::INTEGER AS max_pics, avg(n) AS avg_turns, max(n)::INTEGER AS max_turns, avg(chars) AS avg_chars,
  avg(chars // 4 + 576 * pics) AS avg_tokens, max(chars // 4 + 576 * pics)::BIGINT AS max_tokens FROM p @BY"""


@R.query("corpus_profile", _PROFILE_SQL.replace("@GROUP", "").replace("@BY", ""))
def corpus_profile(spark, root):
    return _profile(convs(spark, root)).agg(*_figures())


@R.query("corpus_profile_by_source", _PROFILE_SQL.replace("@GROUP", "CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source,").replace("@BY", "GROUP BY GROUPING SETS ((source), ())"))
def corpus_profile_by_source(spark, root):
    p = _profile(convs(spark, root))
    rows = p.groupingSets([[F.col("source")], []], F.col("source")).agg(*_figures(), F.grouping_id().alias("g"))
    return rows.withColumn("source", F.when(F.col("g") > 0, "all").otherwise(F.col("source"))).drop("g")


@R.query(
    "normalise_turns",
    f"""WITH {CONVS} SELECT row_id, len(turns)::INTEGER AS turns, len(images)::INTEGER AS pics, array_to_string(list_transform(turns, lambda t: coalesce(t.role, '?')), ' ') AS roles,
  md5(array_to_string(list_transform(turns, lambda t: t.text), chr(10))) AS texts,
  coalesce(list_bool_and(list_transform(turns, lambda t, i: coalesce(t.role = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END, false))), true) AS alternates FROM convs""",
)
def normalise_turns(spark, root):
    t = F.col("turns")
    return convs(spark, root).select(
        "row_id", F.size(t).alias("turns"), F.size("images").alias("pics"), F.array_join(F.transform(t, lambda x: F.coalesce(x["role"], F.lit("?"))), " ").alias("roles"),
        F.md5(F.array_join(F.transform(t, lambda x: x["text"]), "\n").cast("binary")).alias("texts"), C.alternates(t).alias("alternates"),
    )


def _chat(name: str, expected: C.Template | None = None):
    @R.query(f"chat_{name.replace('-', '_')}", f"WITH {CONVS}, p AS (SELECT row_id, {_prompt_sql(expected or C.TEMPLATES[name])} AS prompt FROM convs) SELECT row_id, md5(prompt) AS digest, length(prompt)::INTEGER AS chars FROM p")
    def run(spark, root):
        p = convs(spark, root).select("row_id", C.prompt(F.col("turns"), name).alias("prompt"))
        return p.select("row_id", F.md5(F.col("prompt").cast("binary")).alias("digest"), F.length("prompt").alias("chars"))


for _name in ("multi_v1", "vicuna_v1", "mpt", "llava_llama_2", "llama_3", "marked_v1", "plain", "idefics_2", "idefics_3", "qwen2_vl", "v0", "llava_v1"):
    _chat(_name)

# expected prompts of these keys are written out in full here, so that a wrong fixed value shows
_SYSTEMS = {
    "llama_2": "You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe.  Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. Please ensure that your responses are socially unbiased and positive in nature.\n\nIf a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. If you don't know the answer to a question, please don't share false information.",
    "Hermes-2": "<|im_start|>system\n你是由上海人工智能实验室联合商汤科技开发的书生多模态大模型，英文名叫InternVL, 是一个有用无害的人工智能助手。",
    "internlm2-chat": "<|im_start|>system\n你是由上海人工智能实验室联合商汤科技开发的书生多模态大模型，英文名叫InternVL, 是一个有用无害的人工智能助手。",
    "phi3-chat": "<|system|>\n你是由上海人工智能实验室联合商汤科技开发的书生多模态大模型，英文名叫InternVL, 是一个有用无害的人工智能助手。",
    "internvl2_5": "<|im_start|>system\n你是书生·万象，英文名是InternVL，是由上海人工智能实验室、清华大学及多家合作单位联合开发的多模态大语言模型。",
    "v1": "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions.",
    "videollava": "A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions.",
    "openflamingo": "",
}
_LITERAL = {
    "llama_2": C.Template("llama_2", _SYSTEMS["llama_2"], ("USER", "ASSISTANT"), "<s>", "</s>"),
    "Hermes-2": C.Template("bare", _SYSTEMS["Hermes-2"], ("<|im_start|>user\n", "<|im_start|>assistant\n"), "<|im_end|>"),
    "internlm2-chat": C.Template("bare", _SYSTEMS["internlm2-chat"], ("<|im_start|>user\n", "<|im_start|>assistant\n"), "<|im_end|>"),
    "phi3-chat": C.Template("bare", _SYSTEMS["phi3-chat"], ("<|user|>\n", "<|assistant|>\n"), "<|end|>"),
    "internvl2_5": C.Template("bare", _SYSTEMS["internvl2_5"], ("<|im_start|>user\n", "<|im_start|>assistant\n"), "<|im_end|>\n"),
    "v1": C.Template("two", _SYSTEMS["v1"], ("USER", "ASSISTANT"), " ", "</s>"),
    "videollava": C.Template("two", _SYSTEMS["videollava"], ("USER", "ASSISTANT"), " ", "</s>"),
    "openflamingo": C.Template("utterance", "", ("User", "Assistant"), "<|endofchunk|>"),
}
for _name, _template in _LITERAL.items():
    _chat(_name, _template)


def _labels(name: str):
    t = C.TEMPLATES[name]
    part = "replace(x, '<image>', '')" if t.style == "plain" else "x"
    some = "true" if t.style == "plain" else "i % 2 = 0"

    @R.query(
        f"labels_{name}",
        f"WITH {CONVS}, p AS (SELECT row_id, {_prompt_sql(t, parts=True)} AS parts FROM convs) SELECT row_id, coalesce(list_sum(list_transform(parts, lambda x, i: CASE WHEN {some} THEN length({part}) ELSE 0 END)), 0)::INTEGER AS label_chars FROM p",
    )
    def run(spark, root):
        return convs(spark, root).select("row_id", C.label_characters(F.col("turns"), name).alias("label_chars"))


for _name in ("mpt", "idefics_3", "qwen2_vl", "marked_v1", "plain", "llama_3"):
    _labels(_name)


@R.query(
    "label_segments",
    f"""WITH {CONVS}, p AS (SELECT row_id, list_concat([{len(C.opening_of(C.TEMPLATES['multi_v1']))}], list_transform(turns, lambda m, i: length(CASE WHEN m.text <> '' THEN CASE WHEN i % 2 = 1 THEN 'USER' ELSE 'ASSISTANT' END || ': ' || m.text || '</s>'
      ELSE CASE WHEN i % 2 = 1 THEN 'USER' ELSE 'ASSISTANT' END || ':' END))) AS n FROM convs),
    s AS (SELECT row_id, unnest(range(len(n))) AS seg, n FROM p)
    SELECT row_id, seg::INTEGER AS seg, coalesce(list_sum(n[1:seg]), 0)::INTEGER AS start, list_sum(n[1:seg + 1])::INTEGER AS stop, seg > 0 AND seg % 2 = 0 AS is_label FROM s""",
)
def label_segments(spark, root):
    return C.label_segments(convs(spark, root), "multi_v1")


@R.query(
    "label_share",
    f"""WITH {CONVS}, p AS (SELECT source, list_sum(list_transform(turns, lambda m: length(m.text))) AS chars,
      list_sum(list_transform(list_filter(turns, lambda m: m.role = 'assistant'), lambda m: length(m.text))) AS labels FROM convs)
    SELECT source, sum(coalesce(labels, 0))::BIGINT AS labels, sum(coalesce(chars, 0))::BIGINT AS chars FROM p GROUP BY source""",
)
def label_share(spark, root):
    n = lambda t: F.aggregate(t, F.lit(0).cast("long"), lambda a, m: a + F.length(m["text"]))
    p = convs(spark, root).select("source", n(F.col("turns")).alias("c"), n(F.filter("turns", lambda m: m["role"] == "assistant")).alias("l"))
    return p.groupBy("source").agg(F.sum("l").alias("labels"), F.sum("c").alias("chars"))


@R.query("pad_to_multiple", f"WITH {CONVS} SELECT row_id, (ceil(n / 64.0) * 64)::BIGINT AS padded, least(n, 512)::BIGINT AS cut FROM (SELECT row_id, length({_prompt_sql(C.TEMPLATES['multi_v1'])}) // 4 AS n FROM convs)")
def pad_to_multiple(spark, root):
    n = X.token_estimate(C.prompt(F.col("turns"), "multi_v1"))
    return convs(spark, root).select("row_id", C.padded_length(n, 64).alias("padded"), F.least(n, F.lit(512)).cast("long").alias("cut"))


@R.query(
    "padded_batches",
    f"""WITH {CONVS}, l AS (SELECT row_id, least(length({_prompt_sql(C.TEMPLATES['multi_v1'])}) // 4, 512) AS n FROM convs), r AS (SELECT n, (row_number() OVER (ORDER BY row_id) - 1) // 16 AS batch FROM l)
    SELECT batch::BIGINT AS batch, count(*) AS rows, max(n)::BIGINT AS width, (count(*) * max(n) - sum(n))::BIGINT AS padding FROM r GROUP BY batch""",
)
def padded_batches(spark, root):
    df = convs(spark, root).select("row_id", X.token_estimate(C.prompt(F.col("turns"), "multi_v1")).alias("n"))
    return C.padded_batches(df, "n", "row_id", 16, 512)


_TOKENS = "((length(t) - length(replace(t, '<image>', ''))) // 7)"


@R.query(
    "match_image_tokens",
    f"""WITH {CONVS}, c AS (SELECT row_id, len(images) AS k, turns, coalesce(list_sum(list_transform(turns, lambda m: (length(m.text) - length(replace(m.text, '<image>', ''))) // 7)), 0) AS have FROM convs),
    o AS (SELECT row_id, k, have, list_transform(turns, lambda m, i: CASE WHEN i = 1 THEN repeat('<image>', greatest(k - have, 0)::BIGINT) || m.text ELSE m.text END) AS t FROM c),
    j AS (SELECT row_id, k, have, array_to_string(t, chr(1)) AS t FROM o),
    s AS (SELECT row_id, k, have, string_split(t, '<image>') AS p FROM j)
    SELECT row_id, k::INTEGER AS pics, have::INTEGER AS tokens, md5(array_to_string(list_transform(p, lambda x, i: CASE WHEN i > 1 AND i - 1 <= k THEN '<image>' || x ELSE x END), '')) AS digest FROM s""",
)
def match_image_tokens(spark, root):
    df = convs(spark, root)
    have = F.aggregate("turns", F.lit(0), lambda n, t: n + X.count_token(t["text"]))
    out = C.tokens_matched(F.col("turns"), F.col("images"))
    return df.select("row_id", F.size("images").alias("pics"), have.alias("tokens"), F.md5(F.array_join(F.transform(out, lambda t: t["text"]), "\x01").cast("binary")).alias("digest"))


@R.query(
    "placeholder_forms",
    """WITH q AS (SELECT id, question AS t, string_split(question, '<image>') AS p, len(images) AS k FROM vqa_item)
    SELECT id, {n}::INTEGER AS tokens, array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN x ELSE '(image ' || (i - 1) || ': <Image><image></Image>)' || x END), '') AS numbered,
      array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 2 THEN '<image>' || x ELSE x END), '') AS first_only,
      array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN x WHEN i = 2 THEN '[pic]' || x ELSE '<image>' || x END), '') AS replaced,
      repeat('<image>', greatest(k - {n}, 0)::BIGINT) || t AS prepended,
      CASE WHEN length(t) > 20 THEN left(t, 10) || '...' || right(t, 10) ELSE t END AS short FROM q""".replace("{n}", _TOKENS),
)
def placeholder_forms(spark, root):
    q = F.col("question")
    return table(spark, root, "vqa_item").select(
        "id", X.count_token(q).alias("tokens"), X.numbered_tokens(q).alias("numbered"), X.first_tokens(q, F.lit(1)).alias("first_only"), X.replaced_first(q, "<image>", "[pic]").alias("replaced"),
        X.missing_prepended(q, F.size("images")).alias("prepended"), X.shortened(q).alias("short"),
    )


@R.query(
    "tokens_after_role",
    f"""WITH {CONVS}, p AS (SELECT row_id, len(images) AS k, {_prompt_sql(C.TEMPLATES['multi_v1'])} AS t FROM convs)
    SELECT row_id, md5(CASE WHEN t LIKE '%USER:%' THEN left(t, strpos(t, 'USER:') + 4) || repeat('<image>', greatest(k - {_TOKENS}, 0)::BIGINT) || substr(t, strpos(t, 'USER:') + 5) ELSE t END) AS digest FROM p""",
)
def tokens_after_role(spark, root):
    p = convs(spark, root).select("row_id", F.size("images").alias("k"), C.prompt(F.col("turns"), "multi_v1").alias("t"))
    return p.select("row_id", F.md5(X.missing_after_role(F.col("t"), F.col("k"), "USER:").cast("binary")).alias("digest"))


@R.query(
    "qa_pairs",
    f"""WITH {CONVS}, t AS (SELECT row_id, unnest(range(len(turns))) AS i, turns FROM convs)
    SELECT row_id, i::INTEGER AS turn, turns[i + 1].text AS question, turns[i + 2].text AS answer FROM t WHERE turns[i + 1].role = 'user' AND turns[i + 2].role = 'assistant'""",
)
def qa_pairs(spark, root):
    n = F.greatest(F.size("turns") - 1, F.lit(0))
    both = F.arrays_zip(F.slice("turns", F.lit(1), n).alias("q"), F.slice("turns", F.lit(2), n).alias("a"))
    t = convs(spark, root).select("row_id", F.posexplode(both).alias("turn", "t"))
    return t.where((F.col("t.q.role") == "user") & (F.col("t.a.role") == "assistant")).select("row_id", "turn", F.col("t.q.text").alias("question"), F.col("t.a.text").alias("answer"))


@R.query(
    "split_long_conversations",
    f"""WITH {CONVS}, l AS (SELECT row_id, turns, coalesce(list_sum(list_transform(turns, lambda m: length(m.text))), 0) // 4 AS tokens FROM convs),
    w AS (SELECT row_id, turns, len(turns) // (tokens // 100 + 1) + 1 AS raw FROM l), v AS (SELECT row_id, turns, raw + raw % 2 AS w FROM w),
    c AS (SELECT row_id, turns, w, unnest(range(greatest(ceil(len(turns) / w)::BIGINT, 1))) AS chunk FROM v)
    SELECT row_id, chunk::INTEGER AS chunk, len(turns[chunk * w + 1 : chunk * w + w])::INTEGER AS turns,
      md5(array_to_string(list_transform(turns[chunk * w + 1 : chunk * w + w], lambda m: m.text), chr(10))) AS digest FROM c""",
)
def split_long_conversations(spark, root):
    n = F.floor(F.aggregate("turns", F.lit(0).cast("long"), lambda a, m: a + F.length(m["text"])) / 4)
    out = C.split_long(convs(spark, root).withColumn("tokens", n), 100)
    return out.select("row_id", "chunk", F.size("turns").alias("turns"), F.md5(F.array_join(F.transform("turns", lambda m: m["text"]), "\n").cast("binary")).alias("digest"))


@R.query(
    "conversation_from_pair",
    """SELECT row_id, 'demo_' || row_id AS id, md5('user:' || coalesce(question, '') || chr(10) || 'assistant:' || coalesce(response, '')) AS digest,
    regexp_replace(trim(identifier), '-[^-]*$', '') AS pair FROM seed_demos""",
)
def conversation_from_pair(spark, root):
    t = C.qa_turns(F.coalesce("question", F.lit("")), F.coalesce("response", F.lit("")))
    digest = F.md5(F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n").cast("binary"))
    pair = F.regexp_replace(F.trim("identifier"), "-[^-]*$", "")
    return table(spark, root, "seed_demos").select("row_id", F.concat(F.lit("demo_"), F.col("row_id")).alias("id"), digest.alias("digest"), pair.alias("pair"))


@R.query(
    "classification_prompts",
    """WITH c AS (SELECT row_id, prompt AS t, coalesce(len(images), 0) AS k, labels FROM cls_training_example)
    SELECT row_id, t || repeat('<image> ', greatest(k - {n}, 0)::BIGINT) AS prompt, labels['visual_quality'] AS visual_quality, labels['object_consistency'] AS object_consistency,
      'The score for visual_quality is <score>. The score for object_consistency is <score>. ' AS response FROM c""".replace("{n}", _TOKENS),
)
def classification_prompts(spark, root):
    names = F.array(F.lit("visual_quality"), F.lit("object_consistency"))
    v = C.label_vector(F.col("labels"), names)
    return table(spark, root, "cls_training_example").select(
        "row_id", C.classification_prompt(F.col("prompt"), F.coalesce("images", F.array().cast("array<string>"))).alias("prompt"),
        F.get(v, F.lit(0)).alias("visual_quality"), F.get(v, F.lit(1)).alias("object_consistency"), C.score_sentences(F.col("labels"), names).alias("response"),
    )


@R.query(
    "labels_text_round_trip",
    """SELECT row_id, k AS name, v AS value FROM (SELECT row_id, unnest(map_keys(labels)) AS k, unnest(map_values(labels)) AS v FROM cls_training_example)
    WHERE v IS NOT NULL AND k NOT LIKE '%:%' AND trim(k) <> '' AND k = trim(k) AND k NOT LIKE '%' || chr(10) || '%'""",
)
def labels_text_round_trip(spark, root):
    df = table(spark, root, "cls_training_example").where(F.col("labels").isNotNull())
    kept = F.map_filter("labels", lambda k, v: v.isNotNull() & (k == F.trim(k)) & (k != "") & ~k.contains(":") & ~k.contains("\n"))
    block = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))), "\n")
    return df.select("row_id", F.explode(C.labels_from_text(block)).alias("name", "value"))


@R.query("count_by_pictures", f"WITH {CONVS} SELECT len(images)::INTEGER AS pics, count(*) AS rows FROM convs GROUP BY 1")
def count_by_pictures(spark, root):
    return convs(spark, root).groupBy(F.size("images").alias("pics")).agg(F.count("*").alias("rows"))


def _denotation_sql(pools: list[list[str]], salt: str) -> str:
    q = lambda xs: "[" + ", ".join("'" + x + "'" for x in xs) + "]"
    place = "[" + ", ".join(q(p) for p in pools) + "][p0 + 1]"
    pool = f"CASE WHEN n = 1 THEN ['the image'] WHEN p0 = n - 1 THEN list_concat({{p}}, {q(X.LAST_DENOTATIONS)}) ELSE {{p}} END"
    pool = pool.replace("{p}", f"CASE WHEN p0 >= {len(pools)} THEN {q(X.OTHER_DENOTATIONS)} ELSE list_append({place}, 'image ' || (p0 + 1)) END")
    h = h_sql(salt, "(row_id || ':' || p0)")
    return f"({pool})[{h} % len({pool}) + 1]"


@R.query(
    "image_denotations",
    f"""WITH {CONVS}, e AS (SELECT row_id, len(images) AS n, unnest(range(len(images))) AS p0 FROM convs)
    SELECT row_id, p0::INTEGER AS at, {_denotation_sql(X.DENOTATIONS, 'phrase')} AS phrase, {_denotation_sql(X.SIMPLE_DENOTATIONS, 'simple')} AS simple FROM e""",
)
def image_denotations(spark, root):
    """A phrase for every picture of every conversation."""
    rows = convs(spark, root).select("row_id", F.size("images").alias("n"), F.posexplode("images").alias("at", "image"))
    key = F.concat_ws(":", "row_id", "at")
    return rows.select("row_id", "at", X.denotation(F.col("at"), F.col("n"), "phrase", key).alias("phrase"), X.denotation(F.col("at"), F.col("n"), "simple", key, simple=True).alias("simple"))


@R.query(
    "caption_blocks",
    f"""WITH {CONVS} SELECT row_id, array_to_string(list_transform(list_filter(turns, lambda m: m.role = 'assistant'), lambda m, i: 'Image ' || i || ': ' || m.text), chr(10)) AS block FROM convs""",
)
def caption_blocks(spark, root):
    a = F.filter("turns", lambda m: m["role"] == "assistant")
    return convs(spark, root).select("row_id", F.array_join(F.transform(a, lambda m, i: F.concat(F.lit("Image "), (i + 1).cast("string"), F.lit(": "), m["text"])), "\n").alias("block"))


@R.query(
    "interleaved_texts",
    f"""WITH {CONVS}, p AS (SELECT row_id, list_transform(turns, lambda m, i: CASE WHEN i % 2 = 1 THEN m.text END) AS a, list_transform(turns, lambda m, i: CASE WHEN i % 2 = 0 THEN 'pic' END) AS b FROM convs)
    SELECT row_id, trim(array_to_string(list_transform(a, lambda x, i: coalesce(x, CASE WHEN b[i] IS NOT NULL THEN '<image> ' END, '')), '')) AS text FROM p""",
)
def interleaved_texts(spark, root):
    texts = F.transform("turns", lambda m, i: F.when(F.pmod(i, F.lit(2)) == 0, m["text"]))
    pics = F.transform("turns", lambda m, i: F.when(F.pmod(i, F.lit(2)) == 1, F.lit("pic")))
    return convs(spark, root).select("row_id", C.segments_by_images(texts, pics).alias("text"))


@R.query("literal_lists", "SELECT id, array_to_string(options, '|') AS options FROM vqa_item WHERE len(options) > 0")
def literal_lists(spark, root):
    """Options written as a list literal and read back."""
    o = F.transform("options", lambda x: F.concat(F.lit("'"), F.regexp_replace(x, r"(['\\\\])", r"\\$1"), F.lit("'")))
    text = F.concat(F.lit("["), F.array_join(o, ", "), F.lit("]"))
    v = table(spark, root, "vqa_item").where(F.size("options") > 0)
    return v.select("id", F.array_join(X.literal_list(text), "|").alias("options"))


@R.query("packed_picture_names", "SELECT id, array_to_string(list_transform(images, lambda p: regexp_replace(split_part(p, '/', -1), '\\.jpg$', '') || '.jpg'), ' ') AS names FROM vqa_item WHERE len(images) > 0")
def packed_picture_names(spark, root):
    stems = F.transform("images", lambda p: F.regexp_replace(F.substring_index(p, "/", -1), r"\.jpg$", ""))
    packed = F.concat(F.lit("dir\\"), F.array_join(stems, "_cat_"), F.lit(".jpg"))
    return table(spark, root, "vqa_item").where(F.size("images") > 0).select("id", F.array_join(X.packed_names(packed), " ").alias("names"))


@R.query("pictures_of_pairs", "SELECT row_id, array_to_string(list_filter([left_url, right_url], lambda x: x IS NOT NULL), ' ') AS pictures FROM seed_demos")
def pictures_of_pairs(spark, root):
    return table(spark, root, "seed_demos").select("row_id", F.array_join(C.wide_to_array(F.col("left_url"), F.col("right_url")), " ").alias("pictures"))


@R.query(
    "cut_prompts",
    f"""WITH {CONVS}, p AS (SELECT row_id, images, left({_prompt_sql(C.TEMPLATES['multi_v1'])}, 300) AS t, list_transform(turns, lambda m: length(m.text)) AS n FROM convs)
    SELECT row_id, least({_TOKENS}, len(images))::INTEGER AS pics, len(list_filter(list_transform(n, lambda x, i: list_sum(n[1:i])), lambda s: s <= 200))::INTEGER AS turns FROM p""",
)
def cut_prompts(spark, root):
    t = F.left(C.prompt(F.col("turns"), "multi_v1"), F.lit(300))
    n = F.transform("turns", lambda m: F.length(m["text"]))
    return convs(spark, root).select("row_id", F.size(C.pictures_left(t, F.col("images"))).alias("pics"), C.pieces_within(n, 200).alias("turns"))


@R.query(
    "picture_token_numbers",
    """WITH w AS (SELECT id, list_transform(string_split(question, ' '), lambda x: x = '<image>') AS b FROM vqa_item)
    SELECT id, array_to_string(list_transform(b, lambda x, i: len(list_filter(b[1:i], lambda y: y))), ' ') AS numbers FROM w""",
)
def picture_token_numbers(spark, root):
    b = F.transform(F.split("question", " "), lambda x: x == "<image>")
    return table(spark, root, "vqa_item").select("id", F.array_join(F.transform(C.picture_numbers(b), lambda n: n.cast("string")), " ").alias("numbers"))


@R.query(
    "ids_without_token",
    """WITH w AS (SELECT id, list_transform(string_split(question, ' '), lambda x: length(x)) AS n FROM vqa_item)
    SELECT id, array_to_string(list_filter(n, lambda x: x <> 7), ' ') AS ids, array_to_string(list_transform(list_filter(list_transform(n, lambda x, i: {'x': x, 'i': i - 1}), lambda s: s.x <> 7), lambda s: s.i), ' ') AS labels FROM w""",
)
def ids_without_token(spark, root):
    n = F.transform(F.split("question", " "), lambda x: F.length(x))
    labels = F.transform(n, lambda _, i: i)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    r = table(spark, root, "vqa_item").select("id", n.alias("n"), labels.alias("l")).select("id", C.without_id(F.col("n"), F.col("l"), F.lit(7)).alias("r"))
    return r.select("id", text(F.col("r.ids")).alias("ids"), text(F.col("r.labels")).alias("labels"))


@R.query(
    "shot_groups",
    f"""WITH {CONVS}, t AS (SELECT row_id, images, string_split(coalesce(turns[1].text, ''), '<image>') AS p FROM convs),
    s AS (SELECT row_id, flatten(list_transform(p, lambda x, i: list_filter([CASE WHEN trim(x, ' ' || chr(10)) <> '' THEN 'T' END, CASE WHEN i <= len(images) THEN 'I' END], lambda y: y IS NOT NULL))) AS s FROM t)
    SELECT row_id, (len(list_filter(s, lambda y: y = 'T')) + CASE WHEN len(s) > 0 AND s[-1] = 'I' THEN 1 ELSE 0 END)::INTEGER AS shots, len(list_filter(s, lambda y: y = 'I'))::INTEGER AS pics FROM s""",
)
def shot_groups(spark, root):
    c = convs(spark, root)
    g = C.shot_groups(X.segments(F.coalesce(F.get("turns", F.lit(0))["text"], F.lit("")), F.col("images")))
    return c.select("row_id", g.alias("g")).select("row_id", F.size("g").alias("shots"), F.aggregate("g", F.lit(0), lambda n, s: n + F.size(s["images"])).alias("pics"))


@R.query("first_frames", f"WITH {CONVS} SELECT row_id, array_to_string(images[1:13], ' ') AS frames FROM convs WHERE len(images) > 0 AND list_position(images, NULL) IS NULL")
def first_frames(spark, root):
    c = convs(spark, root).where((F.size("images") > 0) & ~F.exists("images", lambda p: p.isNull()))
    return c.select("row_id", F.array_join(F.slice("images", 1, 13), " ").alias("frames"))
