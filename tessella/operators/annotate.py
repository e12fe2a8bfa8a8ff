"""Model annotation with a pluggable client: prompts, content-hash cache, prices, retries, message codecs."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A client gets prompts and settings and returns completions in order; it runs inside the executors.
Client = Callable[[list[str], dict], list[str]]


def stub(prompts: list[str], settings: dict) -> list[str]:
    """Deterministic stand-in for a model: a digest of model and prompt."""
    return ["answer " + hashlib.sha256((settings.get("model", "") + "\x00" + p).encode()).hexdigest()[:12] for p in prompts]


def cache_key(prompt: Column, model: str, settings: dict | None = None) -> Column:
    """Digest of prompt, model and decoding settings, so that other settings don't hit."""
    tail = "".join(f"\x00{k}={v}" for k, v in sorted((settings or {}).items()))
    return F.sha2(F.concat(F.lit(model), F.lit("\x00"), F.btrim(prompt), F.lit(tail)), 256)


# Price per token by family of models.
PRICES = [("gpt-4", 0.03 / 1000), ("gpt-3.5-turbo", 0.002 / 1000), ("chatgpt", 0.002 / 1000), ("gpt-35-turbo", 0.002 / 1000), ("text-davinci-003", 0.02 / 1000)]


def price_per_token(model: Column) -> Column:
    """By family; NaN for unknown models."""
    low = F.lower(model)
    out = F.lit(float("nan"))
    for name, price in reversed(PRICES):
        out = F.when(low.contains(name), price).otherwise(out)
    return out


def is_chat(model: Column) -> Column:
    low = F.lower(model)
    return low.contains("turbo") | low.contains("gpt-4") | low.contains("chatgpt")


def completions(df: DataFrame, prompt: str, key: str, model: str, client: Client = stub, settings: dict | None = None, cache: DataFrame | None = None, batch: int = 10, retries: int = 3, keys: tuple[str, ...] = (), wait: float = 0.0) -> DataFrame:
    """key, completion, cached: each distinct prompt is asked once; those in ``cache`` (uid, completion) not at all.

    A failing batch is tried again with the token limit cut to 0.8, the next of ``keys`` as ``api_key`` and after
    ``wait`` seconds; one refused by the policy (the error's text names a policy) isn't tried again. After ``retries``
    its completions are ''. Null prompts have a null completion.
    """
    settings = {"model": model, "max_tokens": 1024, **(settings or {})}
    rows = df.select(key, F.btrim(prompt).alias("__p")).withColumn("uid", cache_key(F.col("__p"), model, settings))
    wanted = rows.where("uid is not null").groupBy("uid").agg(F.first("__p").alias("__p"))
    if cache is not None:
        wanted = wanted.join(cache.select("uid"), "uid", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[str] = []
            prompts = b["__p"].tolist()
            for i in range(0, len(prompts), batch):
                part, now = prompts[i : i + batch], dict(settings)
                for attempt in range(retries):
                    if keys:
                        now["api_key"] = keys[attempt % len(keys)]
                    try:
                        out += client(part, now)
                        break
                    except Exception as e:
                        now["max_tokens"] = int(now["max_tokens"] * 0.8)
                        if attempt == retries - 1 or "policy" in str(e).lower():
                            out += [""] * len(part)
                            break
                        time.sleep(wait)
            yield pd.DataFrame({"uid": b["uid"], "completion": out})

    fresh = wanted.mapInPandas(run, "uid string, completion string").withColumn("cached", F.lit(False))
    known = fresh if cache is None else fresh.unionByName(cache.select("uid", "completion", F.lit(True).alias("cached")))
    return rows.drop("__p").join(known, "uid", "left").select(key, "uid", "completion", "cached")


# Weights of favoured and avoided tokens.
FAVOUR, AVOID = 7.0, -100.0


def logit_bias(favour: Column, avoid: Column, skip_longer: bool = False) -> Column:
    """Token id -> bias of a call, from arrays of token id lists (one list a word): avoided ids, then favoured ones over
    them. With ``skip_longer`` avoided words of more than one token are left out. Null arrays count as empty."""
    none = F.array().cast("array<array<int>>")
    words = F.filter(F.coalesce(avoid, none), lambda w: F.size(w) == 1) if skip_longer else F.coalesce(avoid, none)
    liked = F.array_distinct(F.flatten(F.coalesce(favour, none)))
    shunned = F.array_except(F.array_distinct(F.flatten(words)), liked)
    entry = lambda v: lambda i: F.struct(i.alias("key"), F.lit(v).alias("value"))
    return F.map_from_entries(F.concat(F.transform(shunned, entry(AVOID)), F.transform(liked, entry(FAVOUR))))


def chatml(messages: Column) -> Column:
    """[{role, content}] as marked text, open for the assistant."""
    one = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(one, ""), F.lit("<|im_start|>assistant\n"))


def messages_of(text: Column) -> Column:
    """Marked text back to [{role, content}]; a part without an end is left out."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)<\|im_start\|>(.*?)<\|im_end\|>"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\S+)", 1).alias("role"), F.regexp_replace(p, r"^\S+\n?", "").alias("content")))


def data_url(content: Column, path: Column) -> Column:
    """A picture's bytes as a data URL; the type follows the file name, JPEG if unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    kind = F.when(ext == "png", "image/png").when(ext == "gif", "image/gif").when(ext == "webp", "image/webp").otherwise("image/jpeg")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))


def example_prompt(task: str, examples: Column, item: Column) -> Column:
    """Task, numbered examples, item."""
    shots = F.array_join(F.transform(examples, lambda e, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), e)), "\n\n")
    return F.concat(F.lit(task + "\n\n"), shots, F.lit("\n\n"), item)


#: Models by name; a factory is called inside the executors, so heavy clients load where they run.
MODELS: dict[str, Callable[[], Client]] = {"stub": lambda: stub}


def register_model(name: str, factory: Callable[[], Client], override: bool = False) -> None:
    if name in MODELS and not override:
        raise ValueError(f"{name} is registered already")
    MODELS[name] = factory


def model(name: str) -> Client:
    """The client of a registered model, made at its first call in each Python worker."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name}; known are {sorted(MODELS)}")
    factory, made = MODELS[name], []

    def call(prompts: list[str], settings: dict) -> list[str]:
        if not made:
            made.append(factory())
        return made[0](prompts, settings)

    return call
