import json
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions.choice import h, permuted
from tessella.operators import annotate as A
from tessella.operators import conversation as C
from tessella.operators import evaluation as E
from tessella.operators import nested as N
from tessella.operators import packing as P
from tessella.operators import relational as L
from tessella.operators import sampling as S
from tessella.sources import mixture as M
from tessella.sources import readers, writers

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def turns(*texts, first="user"):
    other = {"user": "assistant", "assistant": "user"}
    out, role = [], first
    for t in texts:
        out.append((role, t))
        role = other[role]
    return out


def convs(spark, *rows):
    return spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "row_id long, turns array<struct<role:string,text:string>>")


def prompts(spark, template, *rows):
    return [r["p"] for r in convs(spark, *rows).orderBy("row_id").select(C.prompt(F.col("turns"), template).alias("p")).collect()]


def test_templates(spark):
    sys_ = "S"
    row = turns("a", "b", "c", "")
    t = lambda style, roles=("U", "A"), sep="#", sep2="$", system=sys_: C.Template(style, system, roles, sep, sep2)
    want = {
        "single": "S#U: a#A: b#U: c#A:",
        "two": "S#U: a#A: b$U: c#A:",
        "bare": "S#Ua#Ab#Uc#A",
        "llama_3": "S#<|start_header_id|>U<|end_header_id|>\n\na#<|start_header_id|>A<|end_header_id|>\n\nb#<|start_header_id|>U<|end_header_id|>\n\nc#<|start_header_id|>A<|end_header_id|>\n\n",
        "marked": "S\nU: a#A: b$U: c#A:",
        "plain": "Sa#b$c#",
        "utterance": "S#U:a#\nA:b#\nU:c#\nA:",
        "begun_utterance": "<|begin_of_text|>S#U:a#\nA:b#\nU:c#\nA:",
        "vision_chat": "<|im_start|>system\nS<|im_end|>\n<|im_start|>U\na<|im_end|>\n<|im_start|>A\nb<|im_end|>\n<|im_start|>U\nc<|im_end|>\n<|im_start|>A\n",
        "llama_2": "[INST] <<SYS>>\nS\n<</SYS>>\n\na [/INST] b $#[INST] c [/INST]",
    }
    for style, text in want.items():
        assert prompts(spark, t(style), row) == [text], style
    assert prompts(spark, t("utterance", system=""), row)[0].startswith("U:a")
    assert prompts(spark, t("single"), []) == ["S#"]


def test_register():
    with pytest.raises(ValueError):
        C.register("v1", C.Template("single"))
    with pytest.raises(ValueError):
        C.register("new", C.Template("nowhere"))
    C.register("v1", C.TEMPLATES["v1"], override=True)


def test_label_segments_cover_the_prompt(spark):
    df = convs(spark, turns("a", "bb", "c", ""), [])
    seg = C.label_segments(df, "multi_v1")
    whole = {r["row_id"]: r["n"] for r in df.select("row_id", F.length(C.prompt(F.col("turns"), "multi_v1")).alias("n")).collect()}
    assert {r["row_id"]: r["m"] for r in seg.groupBy("row_id").agg(F.max("stop").alias("m")).collect()} == whole
    labels = seg.where("is_label").collect()
    assert [(r["row_id"], r["seg"]) for r in labels] == [(0, 2), (0, 4)]


def test_normal_form(spark):
    schema = "row_id long, source string, images array<string>, image string, conversations array<struct<role:string,value:string>>, extra int"
    rows = [
        (1, "s", None, "p", [("gpt", "x"), ("human", "q"), ("gpt", None)], 1),
        (2, None, ["a", None], None, None, 1),
        (3, "s", [], None, [("system", "be"), ("human", "q")], 1),
        (4, "s", [], "z", [(None, "odd")], 1),
    ]
    got = {r["row_id"]: (r["images"], [tuple(t) for t in r["turns"]]) for r in C.normalised(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == (["p"], [("user", "q"), ("assistant", "")])
    assert got[2] == (["a", None], [])
    assert got[3] == ([], [("user", "q")])
    assert got[4] == (["z"], [(None, "odd")])
    assert C.normalised(spark.createDataFrame([], schema)).count() == 0


def test_tokens_matched(spark):
    df = spark.createDataFrame([(turns("a", "<image>b"), ["p", "q"]), (turns("<image><image>a", "<image>b"), ["p", "q"]), (turns("<image>a", "b"), [])], "t array<struct<role:string,text:string>>, i array<string>")
    got = [[t["text"] for t in r["o"]] for r in df.select(C.tokens_matched(F.col("t"), F.col("i")).alias("o")).collect()]
    assert got == [["<image>a", "<image>b"], ["<image><image>a", "b"], ["a", "b"]]


def test_ranked_by_doesnt_depend_on_partitions(spark):
    df = spark.range(100).select(((F.col("id") * 37) % 100).alias("k"))
    for n in (1, 7):
        assert {r["k"]: r["rn"] for r in C.ranked_by(df.repartition(n), "k").collect()} == {k: k + 1 for k in range(100)}
    assert C.ranked_by(df.where("k < 0"), "k").count() == 0


def test_labels_text(spark):
    df = spark.createDataFrame([("a: 1.5\nbad\nb : 2\na: 3",), (None,), ("",)], "t string")
    got = [r["m"] for r in df.select(C.labels_from_text(F.col("t")).alias("m")).collect()]
    assert got == [{"b": 2.0, "a": 3.0}, None, {}]


@FEW
@given(st.lists(st.integers(0, 50), max_size=30))
def test_packs_keep_the_budget_and_the_order(spark, sizes):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "row_id long, s long").withColumn("bucket", F.lit(0))
    groups = P.pack_before(df, "row_id", {"s": 40}).orderBy("row_id").collect()
    assert [r["row_id"] for r in groups] == list(range(len(sizes)))
    per = {}
    for r, s in zip(groups, sizes):
        per.setdefault(r["grp"], []).append(s)
    assert all(sum(x) <= 40 or len(x) == 1 for x in per.values())
    assert [r["grp"] for r in groups] == sorted(r["grp"] for r in groups)


def test_pack_edges(spark):
    df = spark.createDataFrame([(0, 40), (1, 40), (2, 99), (3, None), (4, 5)], "row_id long, s long").withColumn("bucket", F.lit(0))
    assert [r["grp"] for r in P.pack_before(df, "row_id", {"s": 40}).orderBy("row_id").collect()] == [0, 1, 2, 3, 3]
    assert [r["grp"] for r in P.pack_after(df, "row_id", "s", 40).orderBy("row_id").collect()] == [0, 0, 1, 2, 2]
    assert P.pack_before(df.where("row_id < 0"), "row_id", {"s": 1}).count() == 0


def test_option_permutation_keeps_the_answer(spark):
    rows = [(i, ["x", "x", f"right{i}", "y"], "C") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, options array<string>, answer string")
    for r in S.option_permutation(df, "s", "id", "options", "answer").collect():
        assert r["options"][ord(r["answer"]) - 65] == f"right{r['id']}"
        assert sorted(r["options"]) == sorted(["x", "x", f"right{r['id']}", "y"])


def test_permutation_and_hash_are_stable(spark):
    df = spark.range(1).select(permuted(F.array(*map(F.lit, "abc")), "s", F.lit(7)).alias("p"), h("shuffle", F.lit(1)).alias("h"))
    r = df.first()
    assert sorted(x["item"] for x in r["p"]) == ["a", "b", "c"] and r["h"] == int(__import__("hashlib").md5(b"shuffle:1").hexdigest()[:8], 16)


@pytest.mark.parametrize("ratio", [0.3, 1.0, 2.7])
def test_resampled(spark, ratio):
    n = S.resampled(spark.range(50).withColumnRenamed("id", "row_id"), "s", "row_id", ratio)
    assert n.count() == int(50 * ratio) and n.select("row_id").distinct().count() == min(50, int(50 * ratio))


def test_balance(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 10), ("c", 1000)], "source string, n long")
    q = {r["source"]: r["quota"] for r in S.balance_quotas(sizes).collect()}
    assert q == {"a": 31, "b": 98, "c": 982}
    rows = spark.range(1011).select(F.col("id").alias("row_id"), F.when(F.col("id") < 1, "a").when(F.col("id") < 11, "b").otherwise("c").alias("source"))
    used = {r["source"]: r["t"] for r in S.balanced(rows, "source", "row_id").groupBy("source").agg(F.sum("times").alias("t")).collect()}
    assert used == q


def score(spark, kind, raw, ref, options, dataset="x"):
    df = spark.createDataFrame([(kind, raw, ref, options, dataset)], "k string, r string, a string, o array<string>, d string")
    p = df.select(E.prediction(F.col("k"), F.col("r"), F.col("a"), F.col("o"), F.col("d")).alias("p")).first()["p"]
    return p and (p["parsed_answer"], p["correct"])


@pytest.mark.parametrize(
    "kind, raw, ref, options, dataset, want",
    [
        ("multi-choice", "Final Answer: B", "B", ["x", "y"], "x", ("B", True)),
        ("multi-choice", "The answer is (a).", "B", ["x", "y"], "x", ("A", False)),
        ("multi-choice", "Both", "(B)", ["x", "y"], "x", ("B", True)),
        ("multi-choice", "zebra", "A", ["A. zebra", "y"], "x", ("zebra", True)),
        ("multi-choice", "zebra", "A", ["A: zebra", "y"], "x", ("zebra", True)),
        ("multi-choice", "zebra", "A", ["(A) zebra", "y"], "x", ("zebra", True)),
        ("multi-choice", "it is true", "A", ["True", "False"], "nlvr2", ("it is true", True)),
        ("multi-choice", "it is false, true", "A", ["True", "False"], "nlvr2", ("it is false, true", False)),
        ("multi-choice", "", "A", ["x"], "x", ("", False)),
        ("multi-choice", "zz", "D", ["x"], "x", ("zz", False)),
        ("short-answer", "Answer: Yes", "yes", [], "x", ("Yes", True)),
        ("other", "a", "a", [], "x", None),
    ],
)
def test_prediction(spark, kind, raw, ref, options, dataset, want):
    assert score(spark, kind, raw, ref, options, dataset) == want


def test_keyword_scores(spark):
    edges = {("run", "", "jog"), ("pick", "up", "lift")}
    assert E.replaced_synonyms(["jog", "lift"], ["run", "pick", "up", "sit"], edges, True) == ["jog", "lift", "sit"]
    assert E.replaced_synonyms(["jog", "lift"], ["run", "pick", "up"], edges, False) == ["jog", "pick", "up"]
    assert E.replaced_synonyms([], ["a", "b"], edges, True) == ["a", "b"]
    df = spark.createDataFrame([(1, ["jog", "lift"], ["run", "sit"]), (2, None, None), (3, [], ["a"])], "id long, ref array<string>, got array<string>")
    e = spark.createDataFrame(list(edges), "word string, next string, meaning string")
    got = {r["id"]: (r["precision"], r["recall"], r["f1"]) for r in E.keyword_scores(df, e).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_top_k_ties_and_blocks(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "query long, embedding array<float>")
    g = spark.createDataFrame([(10, [1.0, 1.0]), (11, [1.0, 1.0]), (12, [2.0, 0.0]), (13, None)], "item long, embedding array<float>").repartition(3)
    want = {(1, 12, 1), (1, 10, 2), (2, 10, 1), (2, 11, 2)}
    for block in (1, 10):
        assert {(r["query"], r["item"], r["place"]) for r in E.top_k(q, g, 2, block=block).collect()} == want
    assert E.top_k(q.where("query > 9"), g, 2).count() == 0
    positives = spark.createDataFrame([(1, 12), (2, 12)], "query long, item long")
    assert tuple(E.recall_at(E.top_k(q, g, 2), positives, 2).first()) == (0.5, 0.5)


def test_media_and_joins(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", None]), (3, []), (4, None)], "id long, images array<string>")
    listing = spark.createDataFrame([("a",), ("b",), ("b",)], "path string")
    assert {r["id"] for r in L.media_present(df, "id", "images", listing).collect()} == {1, 3, 4}
    mapping = spark.createDataFrame([("a", "A"), ("b", "B")], "k string, v string")
    rows, missing = L.inner_all(df, "id", "images", mapping, "k", "v")
    assert [(r["id"], r["v"]) for r in rows.collect()] == [(1, ["A", "B"])] and missing.first()["missing"] == 1


def test_first_wins_and_roots(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (5, None)], "id long, k string")
    assert {r["id"] for r in L.first_wins(df, ["k"], "id").collect()} == {1, 2}
    rel = spark.createDataFrame([(1, []), (2, [9, 1]), (3, [2, 1]), (4, None)], "id long, related array<long>")
    assert {r["id"]: r["root"] for r in L.related_roots(rel, "id", "related").collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def size(spark, column, h, w):
    r = spark.range(1).select(F.lit(h).alias("h"), F.lit(w).alias("w")).select(column.alias("s")).first()["s"]
    return r and (r["height"], r["width"])


def test_geometry(spark):
    H, W = F.col("h"), F.col("w")
    assert size(spark, G.smart(H, W), 28, 28) == (56, 56)
    assert size(spark, G.smart(H, W), 27, 100) is None
    assert size(spark, G.smart(H, W), 28, 28 * 201) is None
    assert size(spark, G.smart(H, W), 448, 448) == (448, 448)
    assert size(spark, G.capped(H, W, 100), 300, 200) == (100, 66)
    assert size(spark, G.at_least(H, W), 8, 40) == (16, 80)
    assert size(spark, G.to_longest(H, W, 364), 333, 777) == (156, 364)
    tiles = spark.range(1).select(G.tile_grid(F.lit(448), F.lit(896)).alias("t")).first()["t"]
    assert (tiles["columns"], tiles["rows"], tiles["tiles"]) == (2, 1, 3)
    frames = spark.range(1).select(G.segment_frames(F.lit(99), F.lit(25.0), 4).alias("f"), G.sampled_frames(F.lit(3), 8).alias("all"), G.sampled_frames(F.lit(0), 8).alias("none")).first()
    assert frames["f"] == [12, 37, 62, 86] and frames["all"] == [0, 1, 2] and frames["none"] == []


def test_completions(spark):
    calls = spark.sparkContext.accumulator(0)

    def client(prompts, settings):
        calls.add(len(prompts))
        if "bad" in prompts:
            raise RuntimeError
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, " a "), (3, "b"), (4, None), (5, "bad")], "id long, p string")
    got = {r["id"]: r["completion"] for r in A.completions(df, "p", "id", "m", client=client, batch=1).collect()}
    assert got == {1: "A", 2: "A", 3: "B", 4: None, 5: ""}
    cache = A.completions(df.where("id < 3"), "p", "id", "m", client=client, batch=1).select("uid", "completion").distinct()
    hits = {r["id"]: r["cached"] for r in A.completions(df.where("id < 4"), "p", "id", "m", client=client, cache=cache, batch=1).collect()}
    assert hits == {1: True, 2: True, 3: False}


def test_nested_payloads(spark):
    rows = [
        (1, '{"items": [{"images": ["a", null], "labels": {"x": 1, "odd name": {"score": 1, "raters": [{"writer": "w"}, null]}, "n": null}}, null, 5]}'),
        (2, '{"items": [{"image": {"path": "p"}, "conversation": [{"from": "human", "value": [{"type": "text"}, null]}, null]}]}'),
        (3, None), (4, ""), (5, "{broken"), (6, "[]"), (7, '{"items": null}'), (8, '{"items": [{"image": null, "conversations": null, "labels": null}]}'),
    ]
    df = spark.createDataFrame(rows, "row_id long, payload string")
    got = Counter(tuple(r)[1:] for r in N.payload_children(df).collect())
    want = Counter(
        [(1, "item", i, -1, -1, "") for i in range(3)] + [(1, "image", 0, 0, -1, ""), (1, "image", 0, 1, -1, "")] + [(1, "label", 0, -1, -1, n) for n in ("x", "odd name", "n")]
        + [(1, "rater", 0, -1, k, "odd name") for k in (0, 1)] + [(2, "item", 0, -1, -1, ""), (2, "image", 0, 0, -1, ""), (2, "turn", 0, 0, -1, ""), (2, "turn", 0, 1, -1, ""), (2, "part", 0, 0, 0, ""), (2, "part", 0, 0, 1, "")]
        + [(8, "item", 0, -1, -1, "")]
    )
    assert got == want
    assert N.payload_children(df.where("row_id > 9")).count() == 0


def test_nested_keys_link_to_parents(spark):
    df = spark.createDataFrame([(1, '{"items": [{"images": ["a"]}, {"images": ["b", "c"]}]}')], "row_id long, payload string")
    tables = N.shred(df, "row_id", F.try_parse_json("payload"), N.infer_schema(df, "payload"))
    items = {r["id"] for r in tables["items[]"].collect()}
    images = tables["items[].images[]"].collect()
    assert {r["parent"] for r in images} <= items and len({r["id"] for r in images}) == 3


def test_wide_objects_become_maps(spark):
    df = spark.range(20).select("id", F.concat(F.lit('{"m": {"k'), "id", F.lit('": [1, 2]}}')).alias("payload"))
    tree = N.infer_schema(df, "payload", max_fields=10)
    assert tree.fields["m"].value is not None and not tree.fields["m"].fields
    assert N.shred(df, "id", F.try_parse_json("payload"), tree)["m{}"].count() == 20


def test_unknown_keys_cost_no_payload_rows(spark):
    def payload(i, wide):
        odd = lambda tag: "".join(f', "{tag}{i}_{k}": [{k}]' for k in range(30)) if wide else ""
        turn = '{"from": "human", "value": [{"type": "text"' + odd("p") + "}, null]" + odd("t") + "}"
        label = '"odd name": {"score": 1, "raters": [{"writer": "w"' + odd("r") + "}, null]" + odd("l") + "}"
        items = ['{"images": ["a", null], "conversations": [' + turn + "], \"labels\": {" + label + "}" + odd("i") + "}", '{"image": "p", "conversation": [' + turn + "]" + odd("j") + "}"]
        return '{"items": [' + ", ".join(items) + "]" + odd("top") + "}"

    raw = lambda wide: spark.createDataFrame([(i, payload(i, wide)) for i in range(10)], "row_id long, payload string")
    got = Counter(tuple(r) for r in N.payload_children(raw(True)).collect())
    assert got == Counter(tuple(r) for r in N.payload_children(raw(False)).collect())
    assert Counter(k[2] for k in got) == {"item": 20, "turn": 20, "image": 30, "part": 40, "label": 10, "rater": 20}


def test_maps_are_shredded_below_their_entries(spark):
    df = spark.range(20).select("id", F.concat(F.lit('{"m": {"kept": [7], "k'), "id", F.lit('": {"a": {"b": [[1], [2, 3]]}, "x'), "id", F.lit('": {"c": [4]}}}}')).alias("payload"))
    tree = N.infer_schema(df, "payload", max_fields=10, named=("kept", "a"))
    tables = N.shred(df, "id", F.try_parse_json("payload"), tree)
    assert {k: t.count() for k, t in tables.items()} == {"m.kept[]": 20, "m{}": 20, "m{}.a.b[]": 40, "m{}.a.b[][]": 60, "m{}{}": 20, "m{}{}.c[]": 20}
    keys = {r["id"] for t in tables.values() for r in t.collect()}
    assert all(r["parent"] in keys for k, t in tables.items() if k not in ("m{}", "m.kept[]") for r in t.collect())


def _elements(value):
    """Elements of all arrays at any depth."""
    if isinstance(value, dict):
        return sum(map(_elements, value.values()))
    return len(value) + sum(map(_elements, value)) if isinstance(value, list) else 0


@pytest.mark.parametrize(
    "make, rows, maps",
    [
        (lambda i: {"o": {f"k{i}_{k}": [1, 2] for k in range(3)}}, 67, ()),  # 201 names over all rows
        (lambda i: {"o": {f"k{k}": [1, [2, None]] for k in range(201)}}, 2, ()),
        (lambda i: {"labels": {"a": {"raters": [{"notes": [{"w": [i]}, None, {"w": []}]}, {"notes": None}]}, "b": [1]}}, 3, ("labels",)),
        (lambda i: {"m": {f"x{i}": {"a": {"b": [{"c": [[1], [2, 3]]}]}}}}, 250, ()),
        (lambda i: {f"p{i}_{j}": {f"q{i}_{j}_{k}": [k] for k in range(2)} for j in range(40)}, 260, ()),  # 10,400 parents with names of their own
        (lambda i: {"w": [{f"n{i}_{j}": {"v": [j]}} for j in range(50)]}, 210, ()),
    ],
)
def test_no_level_is_lost_to_folding(spark, make, rows, maps):
    made = [make(i) for i in range(rows)]
    df = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(made)], "id long, payload string")
    tables = N.shred(df, "id", F.try_parse_json("payload"), N.infer_schema(df, "payload", maps=maps))
    assert sum(t.count() for k, t in tables.items() if k.endswith("[]")) == sum(map(_elements, made))


def test_typed_children(spark):
    t = spark.createDataFrame([(1, ["a", None], None, None), (2, [], "x", [("human", None), None]), (3, None, None, [])], "row_id long, images array<string>, image string, conversations array<struct<role:string,value:string>>")
    got = {tuple(r)[1:5] for r in N.training_children(t).collect()}
    assert got == {(1, "image", -1, 0), (1, "image", -1, 1), (2, "image", -1, 0), (2, "turn", -1, 0), (2, "turn", -1, 1)}


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä,\n\"q\""), (2, None)], "id long, t string")
    writers.json_lines(df, str(tmp_path / "a.jsonl"))
    assert {tuple(r) for r in readers.json_table(spark, str(tmp_path / "a.jsonl"), "id long, t string").collect()} == {(1, 'ä,\n"q"'), (2, None)}
    writers.json_array(df.coalesce(1), str(tmp_path / "a.json"))
    assert {r["id"] for r in readers.json_table(spark, str(tmp_path / "a.json"), "id long, t string").collect()} == {1, 2}
    with pytest.raises(ValueError):
        readers.json_table(spark, "a.txt")
    (tmp_path / "l.csv").write_bytes("id,t\n1,\xe9\n".encode("latin-1"))
    assert readers.csv_table(spark, str(tmp_path / "l.csv"), encoding="ISO-8859-1").first()["t"] == "é"
    (tmp_path / "l.tsv").write_text("id\tt\n1\tx\n")
    assert readers.csv_table(spark, str(tmp_path / "l.tsv"), sep="\t").first()["t"] == "x"
    (tmp_path / "first.txt").write_text('[{"a": 1}, {"a": 2}]\n[{"a": 3}]\n')
    assert sorted(r["a"] for r in readers.first_line_json(spark, str(tmp_path / "first.txt"), "struct<a:int>").collect()) == [1, 2]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "short.txt").write_text("Q: {question}\n")
    assert {k: v.rstrip() for k, v in readers.templates(spark, str(tmp_path / "t")).items()} == {"short": "Q: {question}"}
    for n in (2, 10):
        (tmp_path / "t" / f"f_{n}.jpg").write_bytes(b"x")
    assert {r["number"] for r in readers.listing(spark, str(tmp_path / "t"), "*.jpg").collect()} == {2, 10}
    assert readers.stored_results(spark, str(tmp_path / "none"), "id string").count() == 0


def test_mixture_settings(spark):
    s = M.from_json('[{"name": "a", "max_size": 3, "shuffle": true}]')[0]
    df = spark.range(10).select(F.col("id").alias("row_id"), F.array().cast("array<string>").alias("images"))
    assert M.one_source(df, s).count() == 3
    for bad in ('[{"name": "a", "nope": 1}]', '[{"name": "a", "format": "x"}]', '[{"name": "a", "split": "x"}]'):
        with pytest.raises(ValueError):
            M.from_json(bad)


def test_clashing_columns_stay_out_of_the_way(spark):
    df = spark.createDataFrame([(1, "k", 9, 9)], "row_id long, source string, rn long, n long")
    assert S.balanced(df.drop("rn", "n"), "source", "row_id").count() == 1
    assert L.merged_by(spark.createDataFrame([(1, ["a"], [1])], "row_id long, images array<string>, turns array<int>"), L.media_key(F.col("images")), "row_id").count() == 1


def test_file_names_and_tasks(spark, tmp_path):
    df = spark.createDataFrame([("x/0_30_s_v0_1/0_30_s_v0_1_cap_processed.json",), ("a/b_mc_qa_processed.json",), ("odd.txt",)], "p string")
    got = [(r["s"]["subset"], r["s"]["kind"]) for r in df.select(readers.video_subset(F.col("p")).alias("s")).collect()]
    assert got == [("0_30_s_v0_1", "caption"), ("b", "multi_choice"), ("odd.txt", None)]
    for n in ("a", "b"):
        (tmp_path / f"{n}.json").write_text('[{"question": "q"}, {"question": "r"}]')
    tasks = [{"task": n, "path": str(tmp_path / f"{n}.json"), "prefix": "v/", "kind": "video", "bounded": n == "a"} for n in ("a", "b")]
    assert readers.task_items(spark, tasks, "question string").groupBy("task", "bounded").count().count() == 2


def test_stream_scores_new_files_once(spark, tmp_path):
    from tessella.streaming import incremental

    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    score = lambda df: df.select("id", (F.col("id") * 2).alias("twice"))
    spark.range(5).write.parquet(src)
    assert incremental.scored_once(spark, src, "id", score, out, state).count() == 5
    spark.range(3, 8).write.mode("append").parquet(src)
    again = incremental.scored_once(spark, src, "id", score, out, state)
    assert sorted(r["id"] for r in again.collect()) == list(range(8))


def test_annotation_codecs(spark):
    r = spark.createDataFrame([(bytearray(b"x"), "a.PNG"), (bytearray(b"x"), "a")], "b binary, p string").select(A.data_url(F.col("b"), F.col("p")).alias("u")).collect()
    assert [x["u"] for x in r] == ["data:image/png;base64,eA==", "data:image/jpeg;base64,eA=="]
    p = spark.range(1).select(A.price_per_token(F.lit("unknown")).alias("x"), A.example_prompt("Do.", F.array(F.lit("e")), F.lit("i")).alias("t")).first()
    assert p["x"] != p["x"] and p["t"] == "Do.\n\nExample 1:\ne\n\ni"
