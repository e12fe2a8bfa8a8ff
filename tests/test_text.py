import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("out")).first()["out"]



@pytest.mark.parametrize(
    "make, text, want",
    [
        (lambda t: X.count_token(t), "<image>a<image><image", 2),
        (lambda t: X.replaced_first(t, "<image>", "X"), "a<image>b<image>", "aXb<image>"),
        (lambda t: X.first_tokens(t, F.lit(1)), "<image>a<image>b", "<image>ab"),
        (lambda t: X.first_tokens(t, F.lit(0)), "<image>a", "a"),
        (lambda t: X.numbered_tokens(t), "a<image>b<image>", "a(image 1: <Image><image></Image>)b(image 2: <Image><image></Image>)"),
        (lambda t: X.missing_prepended(t, F.lit(3)), "a<image>", "<image><image>a<image>"),
        (lambda t: X.missing_prepended(t, F.lit(0)), "a<image>", "a<image>"),
        (lambda t: X.missing_after_role(t, F.lit(1)), "sys USER: hi USER: x", "sys USER:<image> hi USER: x"),
        (lambda t: X.missing_after_role(t, F.lit(1)), "no role", "no role"),
        (lambda t: X.bare(t), " \n\ta b\n", "a b"),
        (lambda t: X.stripped(t, "()\n "), "(b)\n", "b"),
        (lambda t: X.capitalized(t), "aBC dE", "Abc de"),
        (lambda t: X.first_letter_lowered(t), "12 Abc", "12 abc"),
        (lambda t: X.as_question(t), " why IS it ", "Why is it?"),
        (lambda t: X.as_question(t), "why?", "Why?"),
        (lambda t: X.first_letter(t), "(1) é", "é"),
        (lambda t: X.first_letter(t), "42", ""),
        (lambda t: X.after_first(t, "answer:"), "x ANSWER: b answer: c", " b answer: c"),
        (lambda t: X.after_last(t, "answer:"), "answer: b answer: c", " c"),
        (lambda t: X.without_letter(t), "B: cat ", "cat"),
        (lambda t: X.section(t, "Multi-choice:", "Short-answer:"), "Multi-choice: a Short-answer: b", "a"),
        (lambda t: X.section(t, "Short-answer:"), "Multi-choice: a Short-answer: b", "b"),
        (lambda t: X.line_field(t, "Response"), "Question: q\nResponse: r", "r"),
        (lambda t: X.fenced(t), '```json\n{"a": 1}\n```', '{"a": 1}'),
        (lambda t: X.fenced(t), "plain", "plain"),
        (lambda t: X.braced(t), 'x {"a": {"b": 1}} y', '{"a": {"b": 1}}'),
        (lambda t: X.shortened(t), "a" * 30, "a" * 10 + "..." + "a" * 10),
        (lambda t: X.shortened(t), "a" * 20, "a" * 20),
        (lambda t: X.positions(t, "aa"), "aaa", [0, 1]),
        (lambda t: X.positions(t, "aa"), "a", []),
        (lambda t: X.key_values(t), "a=1 b=2", {"a": "1", "b": "2"}),
        (lambda t: X.named_lists(t), "Object list 1: [a, b]\nbad line\nObject list 1: [c]", {"Object list 1": ["c"]}),
        (lambda t: X.token_estimate(t), "abcdefghi", 2),
    ],
)
def test_function(spark, make, text, want):
    assert one(spark, make(F.col("t")), t=text) == want
    assert one(spark, make(F.lit(None).cast("string")), t=text) in (None, [], {}, "")


def test_question_answer_pairs(spark):
    got = one(spark, X.question_answer_pairs(F.col("t")), t="Question: a?\nAnswer: b\nQuestion 2: c?\nAnswer 2: d")
    assert [(r["question"], r["answer"]) for r in got] == [("a?", "b"), ("c?", "d")]
    assert one(spark, X.question_answer_pairs(F.col("t")), t="nothing") == []


def test_segments(spark):
    images = F.array(F.lit("p"), F.lit("q"))
    got = one(spark, X.segments(F.col("t"), images), t="<image>a<image>\n <image>b")
    assert [(s["type"], s["content"]) for s in got] == [("image", "p"), ("text", "a"), ("image", "q"), ("text", "b")]


def test_denotation_is_drawn_from_its_pool(spark):
    rows = spark.range(200).select(X.denotation(F.lit(1), F.lit(3), "s", F.col("id")).alias("d"), X.denotation(F.lit(0), F.lit(1), "s", F.col("id")).alias("only"), X.denotation(F.lit(12), F.lit(20), "s", F.col("id")).alias("far")).collect()
    assert {r["d"] for r in rows} == {*X.DENOTATIONS[1], "image 2"}
    assert {r["only"] for r in rows} == {"the image"}
    assert {r["far"] for r in rows} == set(X.OTHER_DENOTATIONS)
