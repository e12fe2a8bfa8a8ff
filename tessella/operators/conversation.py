"""Conversations: normal form, prompt templates, label segments, padding, cutting."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# speakers' names in the sources.
ROLES = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


def role_of(name: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.try_element_at(mapping, name), name)


def turns_of(conversation: Column, role_keys: tuple[str, ...] = ("role",), text_keys: tuple[str, ...] = ("value",)) -> Column:
    """[{role, text}]: the first present key of each kind counts, a missing text is ''. Null conversations are empty."""
    turn = lambda t: F.struct(
        role_of(F.coalesce(*[t[k] for k in role_keys])).alias("role"), F.coalesce(*[t[k] for k in text_keys], F.lit("")).alias("text")
    )
    return F.transform(F.coalesce(conversation, F.array().cast("array<struct<role:string,value:string>>") if role_keys == ("role",) and text_keys == ("value",) else F.array()), turn)


def pictures_of(images: Column, image: Column | None = None) -> Column:
    """The list of pictures; the scalar one where the list is missing or empty; never null."""
    empty = F.array().cast("array<string>")
    listed = F.when(F.size(F.coalesce(images, empty)) > 0, images)
    return F.coalesce(listed, F.when(image.isNotNull(), F.array(image)) if image is not None else F.lit(None).cast("array<string>"), empty)


def without_opening(turns: Column) -> Column:
    """The first turn dropped if it isn't the user's."""
    return F.when(F.get(turns, F.lit(0))["role"] != "user", F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0)))).otherwise(turns)


def alternates(turns: Column) -> Column:
    """User and assistant in turn, from the user on."""
    ok = F.transform(turns, lambda t, i: F.coalesce(t["role"] == F.when(F.pmod(i, F.lit(2)) == 0, "user").otherwise("assistant"), F.lit(False)))
    return F.forall(ok, lambda x: x)


def normalised(training: DataFrame) -> DataFrame:
    """row_id, source, images, turns in normal form."""
    turns = without_opening(turns_of(F.col("conversations")))
    return training.select("row_id", "source", pictures_of(F.col("images"), F.col("image")).alias("images"), turns.alias("turns"))


def qa_turns(question: Column, answer: Column) -> Column:
    """A question and an answer as two turns."""
    return F.array(F.struct(F.lit("user").alias("role"), question.alias("text")), F.struct(F.lit("assistant").alias("role"), answer.alias("text")))


def pair_turns(pairs: Column, question: str = "question", answer: str = "answer", opening: str = "") -> Column:
    """[{question, answer}] as turns, the first question opened by ``opening`` (such as a picture token)."""
    each = F.transform(
        pairs,
        lambda p, i: F.array(
            F.struct(F.lit("user").alias("role"), F.concat(F.when(i == 0, F.lit(opening)).otherwise(F.lit("")), p[question]).alias("text")),
            F.struct(F.lit("assistant").alias("role"), p[answer].alias("text")),
        ),
    )
    return F.flatten(each)


def tokens_matched(turns: Column, images: Column) -> Column:
    """Missing picture tokens in front of the first turn; surplus ones of the whole conversation dropped from the end."""
    total = F.aggregate(turns, F.lit(0), lambda n, t: n + X.count_token(t["text"]))
    more = X.repeated(X.IMAGE, F.size(images) - total)
    opened = F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), F.when(i == 0, F.concat(more, t["text"])).otherwise(t["text"]).alias("text")))
    before = lambda i: F.aggregate(F.slice(opened, F.lit(1), i), F.lit(0), lambda n, t: n + X.count_token(t["text"]))
    return F.transform(opened, lambda t, i: F.struct(t["role"].alias("role"), X.first_tokens(t["text"], F.size(images) - before(i)).alias("text")))


# ---- templates -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Template:
    """A prompt style with its system text, speaker names and separators."""

    style: str
    system: str = ""
    roles: tuple[str, str] = ("USER", "ASSISTANT")
    sep: str = ""
    sep2: str = ""

    def with_system(self, system: str) -> Template:
        return replace(self, system=system)


# System texts, speaker names and separators of the known prompt formats.
_CURIOUS_HUMAN = "A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions."
_CURIOUS_USER = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
_VISION = "You are a helpful language and vision assistant. You are able to understand the visual content that the user provides, and assist the user with a variety of tasks using natural language."
_TAGGED = "A chat between a curious user and an artificial intelligence assistant. The assistant is able to understand the visual content that the user provides, and assist the user with a variety of tasks using natural language.The visual content will be provided with the following format: <Image>visual content</Image>."
_MULTI_TAGGED = "A chat between a curious user and an artificial intelligence assistant. The assistant is able to understand the multiple visual contents that the user provides, and assist the user with a variety of tasks using natural language.Each visual content will be provided with the following format: <Image>visual content</Image>."
_HONEST = """You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe.  Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. Please ensure that your responses are socially unbiased and positive in nature.

If a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. If you don't know the answer to a question, please don't share false information."""
_INTERN = "你是由上海人工智能实验室联合商汤科技开发的书生多模态大模型，英文名叫InternVL, 是一个有用无害的人工智能助手。"
_INTERN_2_5 = "你是书生·万象，英文名是InternVL，是由上海人工智能实验室、清华大学及多家合作单位联合开发的多模态大语言模型。"
_CHATML = ("<|im_start|>user\n", "<|im_start|>assistant\n")
TEMPLATES = {
    "v0": Template("single", _CURIOUS_HUMAN, ("Human", "Assistant"), "###"),
    "default": Template("single", _CURIOUS_HUMAN, ("Human", "Assistant"), "###"),
    "v1": Template("two", _CURIOUS_USER, sep=" ", sep2="</s>"),
    "vicuna_v1": Template("two", _CURIOUS_USER, sep=" ", sep2="</s>"),
    "plain": Template("plain", "", ("", ""), "\n", ""),
    "v0_plain": Template("plain", "", ("", ""), "\n", ""),
    "llava_v0": Template("single", _CURIOUS_HUMAN, ("Human", "Assistant"), "###"),
    "v0_mmtag": Template("single", _TAGGED, ("Human", "Assistant"), "###"),
    "llava_v1": Template("two", _CURIOUS_HUMAN, sep=" ", sep2="</s>"),
    "v1_mmtag": Template("two", _TAGGED, sep=" ", sep2="</s>"),
    "llava_llama_2": Template("llama_2", _VISION, sep="<s>", sep2="</s>"),
    "llama_2": Template("llama_2", _HONEST, sep="<s>", sep2="</s>"),
    "llama_3": Template("llama_3", "<|start_header_id|>system<|end_header_id|>\n\nYou are a pirate chatbot who always responds in pirate speak!", ("user", "assistant"), "<|eot_id|>"),
    "marked_v1": Template("marked", _VISION, sep="<0x04>", sep2="|ENDOFTEXT|"),
    "multi_v1": Template("single", _CURIOUS_HUMAN, sep="</s>"),
    "multi_v1_mmtag": Template("single", _MULTI_TAGGED, sep="</s>"),
    "idefics_2": Template("utterance", "", ("User", "Assistant"), "<end_of_utterance>"),
    "idefics_3": Template("begun_utterance", "", ("User", "Assistant"), "<end_of_utterance>"),
    "openflamingo": Template("utterance", "", ("User", "Assistant"), "<|endofchunk|>"),
    "videollava": Template("two", _CURIOUS_HUMAN, sep=" ", sep2="</s>"),
    "qwen2_vl": Template("vision_chat", "You are a helpful assistant.", ("user", "assistant"), "<|im_end|>"),
    "mpt": Template("bare", "<|im_start|>system\nA conversation between a user and an LLM-based AI assistant. The assistant gives helpful and honest answers.", _CHATML, "<|im_end|>"),
    "Hermes-2": Template("bare", "<|im_start|>system\n" + _INTERN, _CHATML, "<|im_end|>"),
    "internlm2-chat": Template("bare", "<|im_start|>system\n" + _INTERN, _CHATML, "<|im_end|>"),
    "phi3-chat": Template("bare", "<|system|>\n" + _INTERN, ("<|user|>\n", "<|assistant|>\n"), "<|end|>"),
    "internvl2_5": Template("bare", "<|im_start|>system\n" + _INTERN_2_5, _CHATML, "<|im_end|>\n"),
}
STYLES = ("single", "two", "bare", "llama_2", "llama_3", "marked", "plain", "utterance", "begun_utterance", "vision_chat")


def register(name: str, template: Template, override: bool = False) -> None:
    if template.style not in STYLES:
        raise ValueError(f"unknown style {template.style}")
    if name in TEMPLATES and not override:
        raise ValueError(f"{name} is registered already")
    TEMPLATES[name] = template


def opening_of(t: Template) -> str:
    """What stands before the first turn."""
    return {
        "single": t.system + t.sep,
        "two": t.system + t.sep,
        "bare": t.system + t.sep,
        "llama_2": "",
        "llama_3": t.system + t.sep,
        "marked": t.system + "\n",
        "plain": t.system,
        "utterance": t.system + t.sep if t.system else "",
        "begun_utterance": "<|begin_of_text|>" + (t.system + t.sep if t.system else ""),
        "vision_chat": f"<|im_start|>system\n{t.system}<|im_end|>\n" if t.system else "",
    }[t.style]


def rendered_turns(turns: Column, t: Template) -> Column:
    """Each turn as it stands in the prompt; an empty one opens its speaker's part only."""
    first, other = map(F.lit, t.roles)

    def one(m: Column, i: Column) -> Column:
        role = F.when(F.pmod(i, F.lit(2)) == 0, first).otherwise(other)
        sep = F.when(F.pmod(i, F.lit(2)) == 0, F.lit(t.sep)).otherwise(F.lit(t.sep2))
        text = m["text"]
        if t.style == "single":
            full, empty = F.concat(role, F.lit(": "), text, F.lit(t.sep)), F.concat(role, F.lit(":"))
        elif t.style in ("two", "marked"):
            full, empty = F.concat(role, F.lit(": "), text, sep), F.concat(role, F.lit(":"))
        elif t.style == "bare":
            full, empty = F.concat(role, text, F.lit(t.sep)), role
        elif t.style == "llama_2":
            wrapped = F.when(i == 0, F.concat(F.lit(f"<<SYS>>\n{t.system}\n<</SYS>>\n\n"), text)).otherwise(text)
            full = F.when(F.pmod(i, F.lit(2)) == 0, F.concat(F.lit(t.sep + "[INST] "), wrapped, F.lit(" [/INST]"))).otherwise(F.concat(F.lit(" "), text, F.lit(" " + t.sep2)))
            empty = F.lit("")
        elif t.style == "llama_3":
            head = F.concat(F.lit("<|start_header_id|>"), role, F.lit("<|end_header_id|>\n\n"))
            full, empty = F.concat(head, text, F.lit(t.sep)), head
        elif t.style == "plain":
            full, empty = F.concat(text, sep), F.lit("")
        elif t.style in ("utterance", "begun_utterance"):
            full, empty = F.concat(role, F.lit(":"), text, F.lit(t.sep + "\n")), F.concat(role, F.lit(":"))
        else:
            pad = "<|vision_start|><|{}_pad|><|vision_end|>"
            seen = F.replace(F.replace(text, F.lit("<image>"), F.lit(pad.format("image"))), F.lit("<video>"), F.lit(pad.format("video")))
            head = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))
            full, empty = F.concat(head, seen, F.lit("<|im_end|>\n")), head
        return F.when(text != "", full).otherwise(empty)

    return F.transform(turns, one)


def prompt(turns: Column, template: Template | str) -> Column:
    """The whole prompt. Speakers alternate by place; turns are [{role, text}]."""
    t = TEMPLATES[template] if isinstance(template, str) else template
    text = F.concat(F.lit(opening_of(t)), F.array_join(rendered_turns(turns, t), ""))
    # this format drops its first separator, as a set of characters
    return F.ltrim(text, F.lit(t.sep)) if t.style == "llama_2" else text


def label_segments(df: DataFrame, template: Template | str, key: str = "row_id", turns: str = "turns") -> DataFrame:
    """One row per part of the prompt: key, seg, start, stop (characters), is_label; only assistant parts are labels.

    Part 0 is the opening. In the plain style every part is a label.
    """
    t = TEMPLATES[template] if isinstance(template, str) else template
    parts = F.concat(F.array(F.lit(opening_of(t))), rendered_turns(F.col(turns), t))
    sized = df.select(key, F.transform(parts, lambda p: F.length(p)).alias("n"))
    ends = F.transform(F.col("n"), lambda x, i: F.aggregate(F.slice("n", F.lit(1), i + 1), F.lit(0), lambda a, y: a + y))
    rows = sized.select(key, F.posexplode(F.arrays_zip(F.col("n"), ends.alias("end"))).alias("seg", "s"))
    label = (F.col("seg") > 0) & ((F.pmod("seg", F.lit(2)) == 0) if t.style != "plain" else F.lit(True))
    return rows.select(key, "seg", (F.col("s.end") - F.col("s.n")).alias("start"), F.col("s.end").alias("stop"), label.alias("is_label"))


def text_media_pairs(df: DataFrame, key: str = "row_id", turns: str = "turns", images: str = "images") -> DataFrame:
    """key, text, media, return_loss: the first turn's text without placeholders beside the media, for contrastive
    training without a template. Rows without media or without text are left out."""
    bare = F.btrim(F.regexp_replace(F.replace(F.replace(F.get(turns, F.lit(0))["text"], F.lit("<image>"), F.lit(" ")), F.lit("<video>"), F.lit(" ")), r"\s+", " "))
    return df.select(key, bare.alias("text"), F.col(images).alias("media"), F.lit(True).alias("return_loss")).where((F.col("text") != "") & (F.size("media") > 0))


def label_characters(turns: Column, template: Template | str) -> Column:
    """How many characters of the prompt are labels; picture tokens are none in the plain style."""
    t = TEMPLATES[template] if isinstance(template, str) else template
    parts = rendered_turns(turns, t)
    if t.style == "plain":
        return F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(F.replace(p, F.lit(X.IMAGE), F.lit(""))))
    own = F.filter(parts, lambda p, i: F.pmod(i, F.lit(2)) == 1)
    return F.aggregate(own, F.lit(0), lambda n, p: n + F.length(p))


def padded_length(n: Column, multiple: int) -> Column:
    """The next multiple; a full multiple is padded by nothing."""
    return F.ceil(n / F.lit(float(multiple))).cast("long") * multiple


def padded_batches(df: DataFrame, length: str, order: str, size: int, most: int) -> DataFrame:
    """batch, rows, width, padding of batches in ``order``: lengths are cut at ``most``, rows padded to the widest.

    The order is ranked in ranges, without a single task for all rows.
    """
    ranked = ranked_by(df.select(order, F.least(F.col(length).cast("long"), F.lit(most)).alias("n")), order)
    return ranked.groupBy(F.floor((F.col("rn") - 1) / size).alias("batch")).agg(
        F.count("*").alias("rows"), F.max("n").alias("width"), (F.count("*") * F.max("n") - F.sum("n")).alias("padding")
    )


def ranked_by(df: DataFrame, *order: str | Column, name: str = "rn") -> DataFrame:
    """1-based ``name`` over the whole table in the given order, computed in ranges.

    Rows are range-partitioned, sorted and numbered within their partition, and checkpointed; the counts of the
    partitions before are added by a join with one row per partition.
    """
    from pyspark.sql import Window

    parts = in_ranges(df, *order)
    before = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = before.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return parts.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def in_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """Rows with ``__part`` (range of the order) and ``__at`` (1-based place within it), checkpointed."""
    from ..session import cut

    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"__o{i}" for i in range(len(cols))]
    ranged = df.withColumns(dict(zip(names, cols))).repartitionByRange(*names).sortWithinPartitions(*names)
    # this id is the partition's number, 33 bits up, plus the place within the partition
    rows = cut(ranged.withColumn("__id", F.monotonically_increasing_id()).drop(*names))
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.withColumns({"__part": F.shiftright("__id", 33), "__at": place}).drop("__id")


def split_long(df: DataFrame, budget: int, length: str = "tokens", turns: str = "turns") -> DataFrame:
    """Conversations over the budget cut into even chunks: ``chunk`` and its turns; others have chunk 0 only."""
    n = F.size(turns)
    parts = F.floor(F.col(length) / budget).cast("int") + 1
    raw = F.floor(n / parts).cast("int") + 1
    width = raw + F.pmod(raw, F.lit(2))
    count = F.when(n == 0, F.lit(1)).otherwise(F.ceil(n / width).cast("int"))
    slices = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(turns, i * width + 1, width))
    return df.select(*[c for c in df.columns if c != turns], F.posexplode(slices).alias("chunk", turns))


def segments_by_images(texts: Column, images: Column) -> Column:
    """Parallel arrays where each place holds a text or a picture, as one text with tokens."""
    return F.btrim(F.array_join(F.zip_with(texts, images, lambda t, i: F.coalesce(t, F.when(i.isNotNull(), F.lit("<image> ")), F.lit(""))), ""))


def score_sentences(labels: Column, names: Column, token: str = "<score>") -> Column:
    """One sentence for each label name."""
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("The score for "), n, F.lit(f" is {token}. "))), "")


def classification_prompt(text: Column, images: Column) -> Column:
    """Missing picture tokens at the end of the prompt."""
    return F.concat(text, X.repeated("<image> ", F.size(images) - X.count_token(text)))


def label_vector(labels: Column, names: Column) -> Column:
    """A map as an array in the order of ``names``; missing ones null."""
    return F.transform(names, lambda n: F.try_element_at(labels, n))


def labels_from_text(block: Column) -> Column:
    """Lines ``name: number`` as a map; other lines are skipped, of equal names the last counts."""
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[^:]+:\s*[-+0-9.eE]+\s*$"))
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substring_index(x, ":", -1)).try_cast("double").alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def wide_to_array(*columns: Column) -> Column:
    """Numbered columns as one array without nulls."""
    return F.array_compact(F.array(*columns))


def pictures_left(text: Column, images: Column, token: str = X.IMAGE) -> Column:
    """Pictures whose token is still in a cut text."""
    return F.slice(images, F.lit(1), F.least(X.count_token(text, token), F.size(images)))


def pieces_within(sizes: Column, limit: int) -> Column:
    """How many leading pieces fit into the limit together."""
    sums = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    return F.size(F.filter(sums, lambda s: s <= limit))


def without_id(ids: Column, labels: Column, unwanted: Column) -> Column:
    """{ids, labels} without the places of one id."""
    kept = F.filter(F.arrays_zip(ids.alias("i"), labels.alias("l")), lambda z: z["i"] != unwanted)
    return F.struct(F.transform(kept, lambda z: z["i"]).alias("ids"), F.transform(kept, lambda z: z["l"]).alias("labels"))


def picture_numbers(is_picture: Column) -> Column:
    """For every token the number of picture tokens up to it."""
    return F.transform(is_picture, lambda _, i: F.size(F.filter(F.slice(is_picture, F.lit(1), i + 1), lambda b: b)))


def shot_groups(segments: Column) -> Column:
    """[{type, content}] as [{images, text}]: pictures gather until the next text; trailing ones have no text."""
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<struct<images:array<string>,text:string>>").alias("done"), empty.alias("open"))

    def step(state: Column, s: Column) -> Column:
        closed = F.concat(state["done"], F.array(F.struct(state["open"].alias("images"), s["content"].alias("text"))))
        text = s["type"] == "text"
        return F.struct(F.when(text, closed).otherwise(state["done"]).alias("done"), F.when(text, empty).otherwise(F.concat(state["open"], F.array(s["content"]))).alias("open"))

    rest = lambda state: F.when(F.size(state["open"]) > 0, F.array(F.struct(state["open"].alias("images"), F.lit(None).cast("string").alias("text")))).otherwise(F.array().cast("array<struct<images:array<string>,text:string>>"))
    return F.aggregate(segments, start, step, lambda state: F.concat(state["done"], rest(state)))


def right_padded(values: Column, width: Column | int, pad: Column | int) -> Column:
    """An array brought to ``width`` with ``pad`` at its end; longer ones are cut."""
    w = width if isinstance(width, Column) else F.lit(width)
    p = pad if isinstance(pad, Column) else F.lit(pad)
    return F.slice(F.concat(values, F.array_repeat(p, F.greatest(w - F.size(values), F.lit(0)))), F.lit(1), w)


def expanded_tokens(text: Column, tiles: Column, per_tile: int, token: str = X.IMAGE, inner: str = "<pad>", start: str = "<img>", end: str = "</img>", frames: bool = False) -> Column:
    """The k-th picture token as start, ``per_tile`` inner tokens for each of its tiles, end; with ``frames`` each is
    led by ``Frame k: ``. Tokens beyond the tiles stay as they are."""
    p = X.pieces(text, token)

    def one(s: Column, i: Column) -> Column:
        n = F.get(tiles, i - 1)
        full = F.concat(F.concat(F.lit("Frame "), i.cast("string"), F.lit(": ")) if frames else F.lit(""), F.lit(start), F.repeat(F.lit(inner), n * per_tile), F.lit(end))
        return F.when(i == 0, s).otherwise(F.concat(F.coalesce(full, F.lit(token)), s))

    return F.array_join(F.transform(p, one), "")
