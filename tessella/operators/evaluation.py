"""Benchmark evaluation: question building, answer parsing, scoring, reports, retrieval, keyword F1."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Wording around questions.
CHOICE_TEMPLATE = "{question}\nAnswer with the option's letter from the given choices directly."
SHORT_TEMPLATE = 'Given the images, answer the following short answer vqa question:\nQ: {question}\nYou can first give your analysis, and then give your final answer as "Final Answer:"'


def parsed_answer(raw: Column) -> Column:
    """What follows the first marker of highest rank, stripped; the raw answer without one."""

    def body(r: Column) -> Column:
        found = F.coalesce(*[X.after_first(r, m) for m in ("final answer:", "the answer is", "answer:")])
        return F.coalesce(X.bare(found), r)

    return X.let(raw, body)


def chosen_option(answer: Column) -> Column:
    """The letter after ``Answer: ``, else the first letter in upper case, else null."""

    def body(a: Column) -> Column:
        first = X.first_letter(a)
        return F.when(a.rlike("^Answer: [A-Z]"), F.substring(a, 9, 1)).when(first != "", F.upper(first))

    return X.let(answer, body)


def prediction(kind: Column, raw: Column, ref: Column, options: Column, dataset: Column) -> Column:
    """{parsed_answer, correct}; null for other kinds of question and for references without a letter."""
    r = X.stripped(ref, "()\n ")
    first = F.struct(raw.alias("raw"), parsed_answer(raw).alias("answer"), r.alias("ref"), F.when(F.length(r) == 1, r).otherwise(X.first_letter(r)).alias("letter"))

    def with_pick(v: Column) -> Column:
        second = F.struct(v.alias("v"), chosen_option(v["answer"]).alias("pick"), F.get(options, F.ascii(F.upper(v["letter"])) - 65).alias("own"))
        return X.let(second, judged)

    def judged(s: Column) -> Column:
        v, picked, own = s["v"], s["pick"], s["own"]
        letter, raw_ = v["letter"], v["raw"]
        inside = picked.isNotNull() & (F.ascii(picked) - 65 < F.size(options))
        low, own_low = F.lower(raw_), F.lower(own)
        says = lambda text, word: F.contains(text, F.lit(word))
        truth = (says(low, "true") & ~says(low, "false") & says(own_low, "true")) | (says(low, "false") & ~says(low, "true") & says(own_low, "false"))
        rest = (
            F.when(F.startswith(own, F.concat(letter, F.lit("."))) | F.startswith(own, F.concat(letter, F.lit(":"))), F.substring(own, 3, 1 << 30))
            .when(F.startswith(own, F.concat(F.lit("("), letter, F.lit(")"))), F.substring(own, 4, 1 << 30))
            .otherwise(own)
        )
        by_text = F.when(own.isNull(), False).when(dataset == "nlvr2", truth).otherwise(X.bare(raw_) == X.bare(rest))
        choice = F.struct(F.when(inside, picked).otherwise(raw_).alias("parsed_answer"), F.when(inside, picked == F.upper(letter)).otherwise(by_text).alias("correct"))
        short = F.struct(v["answer"].alias("parsed_answer"), (F.lower(v["ref"]) == F.lower(v["answer"])).alias("correct"))
        return F.when((kind == "multi-choice") & (letter != ""), choice).when(kind == "short-answer", short)

    return X.let(first, with_pick)


def question_text(kind: Column, question: Column, options: Column) -> Column:
    """Question with lettered options in the wording of its kind."""
    lines = F.array_join(F.transform(options, lambda o, i: F.concat(F.when(X.is_lettered(o, i), F.lit("\n ")).otherwise(F.concat(F.lit("\n ("), X.letter(i), F.lit(") "))), o)), "")
    return F.when(kind == "multi-choice", X.filled(CHOICE_TEMPLATE, question=F.concat(question, lines))).otherwise(X.filled(SHORT_TEMPLATE, question=question))


def question_segments(kind: Column, question: Column, options: Column, images: Column, many: bool = True) -> Column:
    """[{type, content}] for a model: pictures in their places, or (``many`` false) first, with the text joined."""
    full = question_text(kind, question, options)
    if many:
        return X.let(full, lambda t: X.let(X.missing_prepended(t, F.size(images)), lambda p: X.segments(p, images)))
    kept = F.filter(X.pieces(full), lambda s: X.bare(s) != "")
    text = F.array_join(F.transform(kept, lambda s: X.stripped(s, " \n")), " ")
    return F.concat(F.transform(images, lambda i: F.struct(F.lit("image").alias("type"), i.alias("content"))), F.array(F.struct(F.lit("text").alias("type"), text.alias("content"))))


def video_question(question: Column, candidates: Column, answer: Column) -> Column:
    """{question, answer} in the wording for video questions."""
    text = F.concat(F.lit("Question: "), question, F.lit("\n"), X.option_lines(candidates, "{}. "), F.lit("\nAnswer with the option's letter from the given choices directly."))
    # of equal candidates the last one is meant
    at = F.size(candidates) - F.array_position(F.reverse(candidates), answer)
    return F.struct(text.alias("question"), F.concat(X.letter(at.cast("int")), F.lit(". "), answer).alias("answer"))


def video_correct(response: Column, answer: Column) -> Column:
    """First letter after the last marker (case counts) against the answer's letter; empty responses are wrong."""

    def tail(r: Column) -> Column:
        option = F.when(F.contains(r, F.lit("the option is")), F.substring_index(r, "the option is ", -1))
        after = F.coalesce(X.after_last(r, "the answer is"), X.after_last(r, "answer:"), option, X.after_last(r, "Answer:"))
        return F.coalesce(X.bare(after), r)

    def judged(r: Column) -> Column:
        first = X.first_letter(r)
        return F.when(r == "", False).otherwise(F.when(first != "", first).otherwise(F.substring(r, 1, 1)) == F.substring(answer, 1, 1))

    return X.let(X.let(response, tail), judged)


def accuracy(df: DataFrame, by: str, correct: str = "correct") -> DataFrame:
    """by, correct, total, accuracy; the row 'overall' counts all."""
    one = F.col(correct).cast("int")
    rows = df.groupingSets([[F.col(by)], []], F.col(by)).agg(
        F.sum(one).cast("long").alias("right"), F.count(one).alias("total"), F.grouping_id().alias("g")
    )
    return rows.select(F.when(F.col("g") > 0, "overall").otherwise(F.col(by)).alias("part"), "right", "total", (F.col("right") / F.when(F.col("total") > 0, F.col("total"))).alias("accuracy"))


def leaderboard(models: DataFrame, datasets: DataFrame, results: DataFrame) -> DataFrame:
    """model, dataset, accuracy (-1 without results) and rank within the dataset."""
    acc = results.groupBy("model", "dataset").agg(F.avg(F.col("correct").cast("int")).alias("acc"))
    grid = models.crossJoin(F.broadcast(datasets)).join(acc, ["model", "dataset"], "left").withColumn("accuracy", F.coalesce(F.round("acc", 4), F.lit(-1.0)))
    return grid.select("model", "dataset", "accuracy", F.rank().over(Window.partitionBy("dataset").orderBy(F.desc("accuracy"))).cast("long").alias("place"))


def resumed(items: DataFrame, done: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(items with a stored raw answer, items still to do)."""
    return items.join(done, key), items.join(done.select(key), key, "left_anti")


def set_scores(ref: Column, got: Column) -> Column:
    """{precision, recall, f1} of two arrays as sets; 0 where undefined."""
    a, b = F.array_distinct(ref), F.array_distinct(got)
    tp = F.size(F.array_intersect(a, b))
    p = F.when(F.size(b) > 0, tp / F.size(b)).otherwise(0.0)
    r = F.when(F.size(a) > 0, tp / F.size(a)).otherwise(0.0)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def replaced_synonyms(ref: list[str], got: list[str], edges: set[tuple[str, str, str]], pairs: bool) -> list[str]:
    """Predicted words replaced by reference words they mean: greedily, each reference word once.

    ``edges`` has (word, next word or '', meaning). With ``pairs`` two predicted words in a row may mean one. What is
    left over at the end is kept as it is.
    """
    rest, out, i = list(ref), [], 0
    while i < len(got) and rest:
        for j, goal in enumerate(rest):
            if (got[i], "", goal) in edges:
                step = 1
            elif pairs and i + 1 < len(got) and (got[i], got[i + 1], goal) in edges:
                step = 2
            else:
                continue
            out.append(goal)
            rest.pop(j)
            i += step
            break
        else:
            out.append(got[i])
            i += 1
    return out + got[i:]


def keyword_scores(df: DataFrame, edges: DataFrame, pairs: bool = True) -> DataFrame:
    """precision, recall, f1 of the keyword lists ``ref`` and ``got`` (null lists count as empty).

    Each two lists get just the edges from their own predicted to their own reference words by a join, so the synonym
    table may be of any size. Equal lists are looked up once; extra columns stay.
    """
    empty = F.array().cast("array<string>")
    key = F.md5(F.to_json(F.struct(F.coalesce("ref", empty).alias("a"), F.coalesce("got", empty).alias("b"))).cast("binary"))
    keyed = df.withColumn("__key", key)
    lists = keyed.groupBy("__key").agg(F.first("ref").alias("ref"), F.first("got").alias("got")).where((F.size("ref") > 0) & (F.size("got") > 0))
    words = lists.select("__key", "ref", F.explode(F.array_distinct("got")).alias("word"))
    known = edges.select("word", F.coalesce("next", F.lit("")).alias("next"), "meaning").distinct()
    own = words.join(known, "word").where(F.array_contains("ref", F.col("meaning"))).groupBy("__key").agg(F.collect_set(F.struct("word", "next", "meaning")).alias("edges"))

    @F.pandas_udf("array<string>")
    def replace(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        plain = lambda x: list(x) if x is not None else []
        for ref, got, own in batches:
            yield pd.Series([replaced_synonyms(plain(a), plain(b), {(e["word"], e["next"], e["meaning"]) for e in plain(c)}, pairs) for a, b, c in zip(ref, got, own)])

    out = lists.join(own, "__key", "left").select("__key", replace("ref", "got", "edges").alias("__g"))
    scored = keyed.join(out, "__key", "left").withColumn("s", set_scores(F.coalesce("ref", empty), F.coalesce("__g", "got", empty)))
    return scored.select(*[c for c in df.columns if c not in ("ref", "got")], "s.*")


# ---- retrieval -------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(queries: DataFrame, gallery: DataFrame, k: int, block: int = 4096, digits: int = 9) -> DataFrame:
    """(query, item, score, place): the k best items of every query by dot product, ties by item.

    The queries are gathered in blocks (they are a stated evaluation set); every partition of the gallery scores all its
    rows against a block by matrix products and keeps its own k best, so k rows per query and partition are shuffled,
    never all pairs. Scores are rounded to ``digits`` before ranking.
    """
    spark = gallery.sparkSession
    out = None
    q = queries.select("query", "embedding").where(F.col("embedding").isNotNull())
    rows = q.orderBy("query").toLocalIterator()
    while True:
        chunk = [r for _, r in zip(range(block), rows)]
        if not chunk:
            break
        ids, m = np.array([r[0] for r in chunk]), np.array([r[1] for r in chunk], float)
        shared = spark.sparkContext.broadcast((ids, m))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            best: pd.DataFrame | None = None
            for b in batches:
                b = b[b["embedding"].notna()]
                if not len(b):
                    continue
                s = np.round(m @ np.vstack(b["embedding"].to_numpy()).astype(float).T, digits)
                items = b["item"].to_numpy()
                keep = np.lexsort((np.broadcast_to(items, s.shape), -s), axis=1)[:, :k]
                part = pd.DataFrame({"query": np.repeat(ids, keep.shape[1]), "item": items[keep].ravel(), "score": np.take_along_axis(s, keep, 1).ravel()})
                best = part if best is None else pd.concat([best, part]).sort_values(["query", "score", "item"], ascending=[True, False, True]).groupby("query").head(k)
            if best is not None:
                yield best

        part = gallery.select("item", "embedding").mapInPandas(run, "query long, item long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query long, item long, score double, place int")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    return out.withColumn("place", place).where(F.col("place") <= k)


def recall_at(hits: DataFrame, positives: DataFrame, k: int) -> DataFrame:
    """recall (share of the positives among the k best, averaged) and hit_rate (at least one), over queries with positives."""
    per = positives.join(hits.where(F.col("place") <= k), ["query", "item"], "left").groupBy("query").agg(F.count("*").alias("n"), F.count("place").alias("tp"))
    return per.agg(F.avg(F.col("tp") / F.col("n")).alias("recall"), F.avg((F.col("tp") > 0).cast("double")).alias("hit_rate"))


def dual_softmax(scores: DataFrame) -> DataFrame:
    """Scores times their softmax over the queries of each item."""
    top = F.max("score").over(Window.partitionBy("item"))
    e = F.exp(F.col("score") - top)
    return scores.withColumn("score", F.col("score") * e / F.sum(e).over(Window.partitionBy("item")))
